"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding, with control bytes kept apart.

Documents are dealt out by ranges of their id and encoded in that order. A file is a Parquet file of blocks that
Spark's writer commits, so lost executors leave no half files. A block of some hundred thousand ids has
  part, block            its place: blocks in this order hold the documents in ascending id order
  doc_ids, counts        the documents, and the number of ids of each, with the end id
  ranks                  the distinct ids, the most frequent first (ties: smaller id), as little-endian 32 bits
  control, payload       each id's place in ranks in 1 to 4 bytes; 2 bits of a control byte say how many less one
Reading looks up a control byte's four lengths in a table, and ids by their ranks in `ranks`.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import running, shuffle_width, slices

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
BLOCKS = "part int, block int, total long, doc_ids array<long>, counts array<int>, ranks binary, control binary, payload binary"
BLOCK_IDS = 1 << 18
MOST_PIECES, MOST_BYTES = 500_000, 1 << 25


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and payload bytes of values below 2**32."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < lengths[:, None]].tobytes()


def unpack(control: bytes, payload: bytes, n: int) -> np.ndarray:
    """The n values that `pack` was given."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    data = np.frombuffer(payload, dtype=np.uint8)
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(lengths > j)
        out[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


@lru_cache(maxsize=2)
def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_words(tokenizer) -> bool:
    """Whether a tokenizer is of the kind that PieceEncoder takes apart: NFC and lower case, white space dropped, runs of letters, single digits and runs of signs apart, word ends marked."""
    spec = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": pattern} and bool(spec["model"].get("end_of_word_suffix"))


# Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 sign. Bytes from 0x80 on are letters where PieceEncoder allows them.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes that make a word special: controls, the apostrophe, and lead bytes of other than U+00C0 to U+00FF.
_ODD = np.zeros(256, dtype=bool)
_ODD[:9] = _ODD[14:32] = _ODD[0x27] = _ODD[0x7F] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False


class PieceEncoder:
    """Encodes texts piece by piece: each distinct piece of a task, by its bytes, goes through the tokenizer once while it is remembered.

    A piece is a run of letters, a digit or a run of signs of a word that has only ASCII and letters of U+00C0 to U+00FF,
    without an apostrophe, in lower case; the tokenizer cuts there whatever stands around it. Other words are pieces as
    they are and go through the whole tokenizer; NFC and its cuts never reach across white space. A tokenizer of
    another kind encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path)
        self.by_piece = splits_words(self.tokenizer)
        if self.by_piece:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = self.plain.model.end_of_word_suffix
            self.last = np.zeros(self.plain.get_vocab_size(), dtype=bool)
            self.last[[i for token, i in self.plain.get_vocab().items() if token.endswith(suffix)]] = True
            self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: list[bytes], odd: list[bool]) -> None:
        pieces = [k.decode() for k in keys]
        plain, special = [i for i, o in enumerate(odd) if not o], [i for i, o in enumerate(odd) if o]
        sizes = np.zeros(len(pieces), dtype=np.int64)
        found: list[np.ndarray] = []
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.plain.encode(" ".join([pieces[i] for i in some]), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a piece was cut by the tokenizer")
            sizes[some] = np.diff(ends, prepend=0)
            found.append(ids)
        for at in range(0, len(special), 2000):
            some = special[at : at + 2000]
            for i, code in zip(some, self.tokenizer.encode_batch([pieces[i] for i in some], add_special_tokens=False)):
                sizes[i] = len(code.ids)
                found.append(np.array(code.ids, dtype=np.uint32))
        order = np.array([*plain, *special], dtype=np.int64)
        self.place.update((keys[i], len(self.starts) + n) for n, i in enumerate(order.tolist()))
        self.held += sum(map(len, keys))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes[order]) - sizes[order]])
        self.sizes = np.concatenate([self.sizes, sizes[order]])
        self.ids = np.concatenate([self.ids, *found])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the number of ids of each text."""
        if not self.by_piece:
            codes = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for c in codes for i in c], dtype=np.uint32), np.array([len(c) for c in codes], dtype=np.int64)
        raw, offs = textvec.utf8(column)
        none = np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        if not len(raw):
            return none
        odd = _ODD[raw]
        wide = np.flatnonzero(raw == 0xC3) + 1
        odd[wide] |= (raw[wide] == 0x97) | (raw[wide] == 0xB7)
        odd[1:] |= (raw[1:] == 0x7C) & (raw[:-1] == 0x3C)  # "<|" may begin a special token
        # Continuation bytes of C2 and higher leads need no mark of their own: their lead has one.
        kind = _KIND[raw]
        low = _LOWER[raw]
        up = wide[(raw[wide] < 0x9F) & (raw[wide] != 0x97)]
        low[up] += 32
        special = np.zeros(len(raw), dtype=bool)
        if odd.any():
            a, b, _ = textvec.word_spans(raw, offs)
            sums = np.concatenate([[0], np.cumsum(odd)])
            hit = np.flatnonzero(sums[b] > sums[a])
            edge = np.zeros(len(raw) + 1, dtype=np.int8)
            np.add.at(edge, a[hit], 1)
            np.add.at(edge, b[hit], -1)
            special = np.cumsum(edge[:-1]) > 0
            kind[special] = 1
            low[special] = raw[special]
        first = np.ones(len(raw), dtype=bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first[offs[:-1][offs[:-1] < len(raw)]] = True
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(raw))
        inside = kind[a] > 0
        a, b = a[inside], b[inside]
        if not len(a):
            return none
        # A piece's bytes say whether it is a special one: only those hold an odd byte or "<|".
        found = textvec.pieces(low, kind > 0, a, b).dictionary_encode()
        codes, keys = found.indices.to_numpy(), found.dictionary.to_pylist()
        if len(self.place) + len(keys) > MOST_PIECES or self.held > MOST_BYTES:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            at = np.zeros(len(keys), dtype=np.int64)
            at[codes] = a
            self.learn([keys[i] for i in new], special[at[new]].tolist())
        place = np.fromiter((self.place[k] for k in keys), np.int64, len(keys))[codes]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(a, offs)])


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts + 1)
    out = np.empty(len(ids) + len(counts), dtype=np.uint32)
    body = np.ones(len(out), dtype=bool)
    body[ends - 1] = False
    out[body], out[ends - 1] = ids, end_id
    return out, counts + 1


def _block(part: int, block: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    times = np.bincount(ids)
    values = np.flatnonzero(times)
    order = np.lexsort((values, -times[values]))
    rank = np.empty(len(times), dtype=np.uint32)
    rank[values[order]] = np.arange(len(order), dtype=np.uint32)
    control, payload = pack(rank[ids])
    row = {"part": part, "block": block, "total": len(ids), "doc_ids": doc_ids, "counts": counts.tolist(), "ranks": values[order].astype("<u4").tobytes(), "control": control, "payload": payload}
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs into files at path, in ascending id order (null ids first; equal ids by a hash of their text, and those by the text).

    Null texts are empty: they have the end id alone. A text of any length stays in one block. Repeated rows are
    written again. Columns other than the id and the text are not read. An empty table gives files without blocks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        encoder = PieceEncoder(tokenizer)
        doc_ids: list = []
        counts, ids, held = [], [], 0
        for whole in batches:
            for batch in slices(whole, "body"):
                some, each = _with_end(*encoder.encode(batch.column("body")), end_id)
                doc_ids += batch.column("doc_id").to_pylist()
                counts.append(each)
                ids.append(some)
                held += len(some)
                if held >= block_ids:
                    yield _block(part, block, doc_ids, np.concatenate(counts), np.concatenate(ids))
                    block, doc_ids, counts, ids, held = block + 1, [], [], [], 0
        if doc_ids:
            yield _block(part, block, doc_ids, np.concatenate(counts), np.concatenate(ids))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    rows = rows.withColumn("tie", F.xxhash64("body"))
    rows = rows.repartitionByRange(max(1, shuffle_width(docs.sparkSession)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "body").drop("tie")
    rows.mapInArrow(encode, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids (array<int>)."""
    return _decoded(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As `read`, with ids_crc32 (of the ids as little-endian unsigned 32 bits) in place of ids, so that the ids stay in the task."""
    return _decoded(spark, path, False)


def _decoded(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i] for k in batch.schema.names}
                ranks = np.frombuffer(r["ranks"].as_py(), dtype="<u4")
                ids = ranks[unpack(r["control"].as_py(), r["payload"].as_py(), r["total"].as_py())]
                counts = np.asarray(r["counts"].values, dtype=np.int64)
                ends = np.cumsum(counts)
                n = len(counts)
                out = [pa.array(np.full(n, r["part"].as_py(), np.int32)), pa.array(np.full(n, r["block"].as_py(), np.int32)), r["doc_ids"].values, pa.array(ends - counts), pa.array(counts)]
                if whole:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                else:
                    data = memoryview(ids.tobytes())
                    out.append(pa.array([zlib.crc32(data[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", "doc_id", "inside", "n_tokens", last])

    last, kind = ("ids", "array<int>") if whole else ("ids_crc32", "long")
    blocks = spark.read.schema(BLOCKS).parquet(path)
    docs = blocks.mapInArrow(decode, f"part int, block int, doc_id long, inside long, n_tokens long, {last} {kind}")
    places = blocks.select(F.lit(0).alias("all"), F.col("part").alias("_part"), F.col("block").alias("_block"), "total")
    places = running(places, ["all"], ["_part"], [F.col("_block")], F.col("total"), "_start").select("_part", "_block", "_start")
    return docs.join(places, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))).select("doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", last)
