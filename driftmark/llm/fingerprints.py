"""Document fingerprints: digests of improbable features.

A feature is a window of 16 bytes. Its rarity is the information it carries, the sum of -log2 p(byte | byte before)
under the byte pairs of all documents, in whole thousandths of a bit. A window is selected if no window that begins up to 8 bytes
before is as rare and none up to 8 bytes after is rarer, in texts of any length. Selected windows go, in their order, into Bloom filters of
2,048 bits with 5 hashes; after 160 features the next filter of the chain begins. Filters are compared by the bits
they share beyond what chance gives, over the most they could share beyond it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import range_bounds, range_bucket, shuffle_width, slices

WINDOW, REACH, BITS, HASHES, FEATURES = 16, 8, 2048, 5, 160
_FACTORS = np.array([pow(int(textvec.FACTOR), 2 * i + 1, 1 << 64) for i in range(WINDOW // 8)], dtype=np.uint64)


def byte_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rarity in thousandths of a bit of each byte after each other (256 x 256), counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "body"):
                raw, offs = textvec.utf8(batch.column("body"))
                if len(raw) < 2:
                    continue
                pairs = raw[:-1].astype(np.int32) << 8 | raw[1:]
                cuts = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(raw))]
                total += np.bincount(pairs, minlength=65536)
                cuts = np.unique(cuts)
                total -= np.bincount(pairs[cuts - 1], minlength=65536)  # not across texts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["pair", "n"])

    rows = docs.select(F.col(text_col).alias("body")).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 65,536 at most
    counts = np.zeros((256, 256))
    for r in rows:
        counts[r.pair >> 8, r.pair & 255] = r.n
    return np.rint(-1000 * np.log2((counts + 1) / (counts.sum(axis=1, keepdims=True) + 256))).astype(np.int64).ravel()


def features(data: bytes, rarity: np.ndarray, window: int = WINDOW, reach: int = REACH) -> np.ndarray:
    """64-bit hashes of the selected windows, distinct, in the order of the text. A text no longer than a window is one window, filled up with zeros; an empty one has none."""
    if not data:
        return np.zeros(0, dtype=np.uint64)
    if len(data) <= window:
        b = np.frombuffer(data.ljust(window, b"\0"), dtype=np.uint8)[None, :]
    else:
        b = np.frombuffer(data, dtype=np.uint8)
        sums = np.zeros(len(b), dtype=np.int64)
        np.cumsum(rarity[b[:-1].astype(np.int32) << 8 | b[1:]], out=sums[1:])
        own = sums[window - 1 :] - sums[: len(b) - window + 1]
        best = np.full(len(own) + 2 * reach, -1, dtype=np.int64)
        best[reach:-reach] = own
        step = 1
        while step < reach:
            best = np.maximum(best[:-step], best[step:])
            step *= 2
        at = np.flatnonzero((own > best[: len(own)]) & (own >= best[reach + 1 : reach + 1 + len(own)]))
        b = np.lib.stride_tricks.sliding_window_view(b, window)[at]
    words = np.ascontiguousarray(b).view("<u8")
    hashes = textvec.mix((textvec.mix(words.copy()) * _FACTORS[: window // 8]).sum(axis=1, dtype=np.uint64))
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def digest(hashes: np.ndarray) -> np.ndarray:
    """The chained filters of features, a row of 32 words of 64 bits for each."""
    if not len(hashes):
        return np.zeros((0, BITS // 64), dtype=np.uint64)
    bits = np.zeros(((len(hashes) - 1) // FEATURES + 1, BITS), dtype=np.uint8)
    row = np.arange(len(hashes)) // FEATURES
    for i in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter chain against its best match in the other; chains as long as each other are compared both ways. Two empty chains are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if len(a) < len(b) else _one_way(b, a)


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of a of the best match in b.

    The best of many matches is above one's mean even by chance, and so is the mark to beat: Bernstein's bound for as many filters as b has.
    """
    nb = np.bitwise_count(b).sum(axis=1).astype(np.float64)
    share = nb / BITS
    most = 2 * np.log(len(b))
    total = 0.0
    for f in a:
        na = float(np.bitwise_count(f).sum())
        both = np.bitwise_count(b & f).sum(axis=1)
        chance = na * share + np.sqrt(most * na * share * (1 - share)) + most / 3
        room = np.minimum(na, nb) - chance
        total += float(np.max(np.where(room > 0, np.clip((both - chance) / np.maximum(room, 1e-9), 0.0, 1.0), 0.0)))
    return total / len(a)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex, 512 digits for each filter, empty for an empty text)."""
    rarity = byte_pairs(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "body")):
            prints = [digest(features((t or "").encode(), rarity)).tobytes().hex() for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(run, "doc_id long, fingerprint string")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of each text and of an edit of it, and how alike the text is to the edit and to the next document.

    The edit replaces the last floor(n / share) code points by the first as many (or all) of the next document in
    descending id order; after the last comes the first. Null texts are empty. Null ids come last; equal ids follow
    each other by their texts' md5, descending. A single document is its own next one. An empty table gives an
    empty table. Other columns are not read.

    Documents are dealt out by ranges of their id; the first document of a range also goes to the range before, as
    the next one of its last document. Rows of a range are read as a stream, two at a time.
    """
    rarity = byte_pairs(docs, text_col)
    parts = shuffle_width(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    ids = base.select("doc_id")
    bounds = range_bounds(ids, "doc_id", parts)
    heads = ids.groupBy(range_bucket(F.col("doc_id"), bounds).alias("pid")).agg(F.max("doc_id").alias("head")).orderBy(F.desc("pid")).collect()  # one for each range
    if not heads:
        return docs.sparkSession.createDataFrame([], EDITS)
    before = {h.head: heads[i - 1].pid for i, h in enumerate(heads)}  # the first one's goes to the last range
    to = F.broadcast(docs.sparkSession.createDataFrame([(k, v) for k, v in before.items()], "head long, extra int"))
    dealt = base.withColumn("pid", range_bucket(F.col("doc_id"), bounds)).join(to, F.col("doc_id").eqNullSafe(F.col("head")), "left")
    places = F.array(F.struct(F.col("pid"), F.lit(0).alias("extra")))
    places = F.when(F.col("extra").isNull(), places).otherwise(F.concat(places, F.array(F.struct(F.col("extra").alias("pid"), F.lit(1).alias("extra")))))
    dealt = dealt.select("doc_id", "body", F.md5("body").alias("tie"), F.explode(places).alias("p")).select("p.pid", "p.extra", "doc_id", "tie", "body")
    dealt = dealt.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", "extra", F.col("doc_id").desc_nulls_last(), F.desc("tie"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, "body")):
            yield from zip(batch.column("pid").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("body").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None
        for pid, extra, doc_id, body in rows(batches):
            mine = digest(features(body.encode(), rarity)) if held is None or not (extra and held[1]) else None
            if held is not None and held[0] == pid and not held[1]:
                _, _, last_id, text, own = held
                n = len(text)
                k = n // share
                new = (text[: n - k] + body[:k]).encode()
                theirs = digest(features(new, rarity))
                out.append((last_id, n, hashlib.sha256(new).hexdigest(), own.tobytes().hex(), theirs.tobytes().hex(), likeness(own, theirs), likeness(own, mine)))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            held = (pid, extra, doc_id, body, mine)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = [x.split()[0] for x in EDITS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in EDITS.split(", ")]
    return dealt.mapInArrow(run, EDITS)
