"""Benchmark decontamination: SimHash of item-sized windows, looked up by multi-index Hamming blocks, then verified.

The blocks retrieve the items; before them stands an exact filter, after them an exact comparison. Every window of a document, at every start word and of every length, is a query for the items of each length; an item that a document
holds only in part is found in a shorter window, one with words put in in a longer one. A window that begins or ends with a
shingle which no item of the length has is less similar than without it, and one that can't reach the similarity, as
running sums of the weights it shares with such items show, is left out before it is fingerprinted; both lose nothing.
The others get a 64-bit SimHash of their words. The items' fingerprints are cut into 8 blocks and stored under each
block's value and under all values one bit away. A fingerprint within 15 bits differs in at most one bit in some
block, so one look-up in each block finds every item within the radius. An item none of whose windows comes within the
radius is lost; README gives the share. The exact similarity of the weighted shingles
(sum of smaller weights over sum of larger ones) decides. A shingle weighs ln(1 + items / items with it).

The items go to the tasks in parts of at most `part_bytes` in memory, one pass over the documents for each part, whose
result is written before the next part is read: the driver and the tasks hold one part at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import Rounds, cut, slices

RADIUS, BLOCKS = 15, 8
LEAKS = "doc_id long, item_id long, start_word int, n_words int, distance int, similarity double"


def simhash(words: np.ndarray) -> np.uint64:
    """64-bit SimHash of word hashes: a bit is 1 where more words have 1 than 0."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    return np.packbits(2 * bits.sum(axis=0) > len(words)).view(">u8")[0].astype(np.uint64)


def window_prints(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, piece: int = 65_536) -> np.ndarray:
    """SimHash of the windows from begin to stop, from counts at their ends; the words are gone through `piece` at a time."""
    places = np.unique(np.concatenate([begin, stop]))
    counts = np.zeros((len(places), 64), dtype=np.int32)
    total = np.zeros(64, dtype=np.int32)
    for a in range(int(places[0]), int(places[-1]), piece):
        b = min(a + piece, int(places[-1]))
        bits = np.cumsum(np.unpackbits(words[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32)
        inside = (places > a) & (places <= b)
        counts[inside] = total + bits[places[inside] - a - 1]
        total = total + bits[-1]
    ones = counts[np.searchsorted(places, stop)] - counts[np.searchsorted(places, begin)]
    return np.packbits(2 * ones > (stop - begin)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _stretches(sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Neighbouring entries (from, to) of at most `most` in sum, or one by one."""
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


@dataclass
class Index:
    """What a task needs of one part of the items, for shingles of k words."""

    k: int
    ids: np.ndarray
    prints: np.ndarray
    totals: np.ndarray  # of an item's weights
    counts: list[dict[int, int]]  # of an item's shingles
    lengths: np.ndarray  # distinct ones, in words
    least: np.ndarray  # the smallest total of the items of each length
    largest: np.ndarray  # and the largest
    known: np.ndarray  # sorted shingles of all items
    weights: np.ndarray
    filter: np.ndarray
    rare: float
    holders: np.ndarray  # for each shingle where its lengths begin in holding (and the last ends)
    holding: np.ndarray  # places in self.lengths of the items that hold a shingle
    most: np.ndarray  # how often, at most, one of those items holds it
    own: np.ndarray  # for each item the place of its length
    tables: list[list[np.ndarray]]  # for each block and value the items

    @staticmethod
    def build(k: int, items: list[tuple[int, np.ndarray]], df: dict[int, int], n: int) -> Index:
        counts, totals, prints, lengths = [], [], [], []
        weight = lambda g: math.log(1 + n / df[g])
        for _, words in items:
            grams, _ = textvec.shingles(words, np.array([0, len(words)]), k)
            values, times = np.unique(grams, return_counts=True)
            counts.append(dict(zip(values.tolist(), times.tolist())))
            totals.append(sum(weight(g) * c for g, c in counts[-1].items()))
            prints.append(simhash(words))
            lengths.append(len(words))
        known = np.array(sorted({g for c in counts for g in c}), dtype=np.uint64)
        weights = np.array([weight(g) for g in known.tolist()])
        bits = np.zeros(1 << max(16, min(26, (16 * len(known)).bit_length())), dtype=bool)
        bits[known & np.uint64(len(bits) - 1)] = True
        each, totals_ = np.array(lengths), np.array(totals)
        distinct = np.unique(each)
        least = np.array([totals_[each == w].min() for w in distinct])
        own = np.searchsorted(distinct, each)
        largest = np.array([totals_[each == w].max() for w in distinct])
        often: dict[tuple[int, int], int] = {}
        for c, o in zip(counts, own.tolist()):
            for g, times in c.items():
                pair = (int(np.searchsorted(known, np.uint64(g))), o)
                often[pair] = max(often.get(pair, 0), times)
        pairs = sorted(often)
        holders = np.searchsorted([p[0] for p in pairs], np.arange(len(known) + 1))
        holding = np.array([p[1] for p in pairs], dtype=np.int64)
        most = np.array([often[p] for p in pairs], dtype=np.int64)
        found: list[list[list[int]]] = [[[] for _ in range(256)] for _ in range(BLOCKS)]
        for i, p in enumerate(prints):
            for b in range(BLOCKS):
                value = (int(p) >> (8 * b)) & 255
                for v in (value, *(value ^ (1 << j) for j in range(8))):
                    found[b][v].append(i)
        tables = [[np.array(x, dtype=np.int64) for x in block] for block in found]
        return Index(k, np.array([i for i, _ in items]), np.array(prints, dtype=np.uint64), totals_, counts, distinct, least, largest, known, weights, bits, math.log(1 + n), holders, holding, most, own, tables)

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint the items within RADIUS bits."""
        out = []
        for p in prints.tolist():
            seen = np.unique(np.concatenate([self.tables[b][(p >> (8 * b)) & 255] for b in range(BLOCKS)]))
            out.append(seen[np.bitwise_count(self.prints[seen] ^ np.uint64(p)) <= RADIUS])
        return out

    def search(self, words: np.ndarray, grams: np.ndarray, known: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """Best window of one text for each item that reaches the threshold: (item, start, words, distance, similarity).

        known: for each shingle of the text its place in self.known, or -1.
        """
        n, k = len(words), self.k
        all_weights = np.concatenate([[0.0], np.cumsum(np.where(known >= 0, self.weights[known], self.rare))])
        at = np.flatnonzero(known >= 0)
        held = self.holders[known[at] + 1] - self.holders[known[at]]
        spot = np.repeat(at, held)
        held_at = np.repeat(self.holders[known[at]] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        of = self.holding[held_at]
        best: dict[int, tuple[float, int, int, int]] = {}
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            place = int(of[order[a]])
            mine = spot[order[a:b]]
            values, first, times = np.unique(known[mine], return_index=True, return_counts=True)
            if (self.weights[values] * np.minimum(times, self.most[held_at[order[a:b][first]]])).sum() < threshold * self.least[place] - 1e-9:
                continue  # the whole text holds too little of any item of this length
            shared = np.concatenate([[0.0], np.cumsum(self.weights[known[mine]])])
            # A best window begins and ends with a shingle of the item: pairs of mine, neither too light nor too heavy.
            low = np.searchsorted(shared, shared[:-1] + threshold * self.least[place] - 1e-6) - 1
            high = np.searchsorted(all_weights[mine + 1], all_weights[mine] + self.largest[place] / threshold + 1e-6, "right")
            low = np.maximum(low, np.arange(len(mine)))
            wide = np.maximum(high - low, 0)
            for c, d in _stretches(wide):
                i = np.repeat(np.arange(c, d), wide[c:d])
                j = np.arange(len(i)) - np.repeat(np.cumsum(wide[c:d]) - wide[c:d], wide[c:d]) + np.repeat(low[c:d], wide[c:d])
                got = shared[j + 1] - shared[i]
                total = all_weights[mine[j] + 1] - all_weights[mine[i]]
                bound = got / (self.least[place] + np.maximum(total - got, 0.0))  # no item of this length is more similar to the window
                kept = np.flatnonzero(bound >= threshold - 1e-9)
                if not len(kept):
                    continue
                kept = kept[np.argsort(-bound[kept], kind="stable")]
                starts, ends, bound = mine[i[kept]], mine[j[kept]] + 1, bound[kept]
                for e in range(0, len(starts), 4096):
                    begin, end, top = starts[e : e + 4096], ends[e : e + 4096], bound[e : e + 4096]
                    stop = np.minimum(end + k - 1, n)
                    prints = window_prints(words, begin, stop)
                    for start, last, w, limit, mark, items in zip(begin.tolist(), end.tolist(), (stop - begin).tolist(), top.tolist(), prints.tolist(), self.near(prints)):
                        part = None
                        for item in items[self.own[items] == place].tolist():
                            if item in best and limit < best[item][0] - 1e-9:
                                continue
                            if part is None:
                                values, times = np.unique(known[start:last], return_counts=True)
                                part = {int(v): int(x) for v, x in zip(values, times)}
                                unknown = part.pop(-1, 0) * self.rare
                            theirs = self.counts[item]
                            both = more = 0.0
                            for v, x in part.items():
                                other = theirs.get(int(self.known[v]), 0)
                                both += min(x, other) * float(self.weights[v])
                                more += max(x - other, 0) * float(self.weights[v])
                            similarity = both / (self.totals[item] + more + unknown)
                            if similarity < threshold - 1e-9:
                                continue
                            now = best.get(item)
                            if now is None or similarity > now[0] + 1e-12 or (similarity > now[0] - 1e-12 and (start, w) < now[1:3]):
                                best[item] = (similarity, start, w, (int(self.prints[item]) ^ mark).bit_count())
        return [(int(self.ids[i]), s, w, d, x) for i, (x, s, w, d) in sorted(best.items())]

    def places(self, grams: np.ndarray) -> np.ndarray:
        """For each shingle its place in self.known, or -1."""
        out = np.full(len(grams), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.filter[grams & np.uint64(len(self.filter) - 1)])
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        ok = self.known[at] == grams[maybe]
        out[maybe[ok]] = at[ok]
        return out


def _parts(items: DataFrame, id_col: str, text_col: str, k: int, part_bytes: int) -> tuple[int, Iterator[list[Index]]]:
    """The items as indexes, in parts of bounded size, and the number of parts. Weights are counted over all items, by Spark."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("body")).where("body is not null and item_id is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, firsts = textvec.word_hashes(batch.column("body"))
            flat = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(words.view(np.int64)))
            sets = [sorted({int(g) for g in textvec.shingles(words[a:b], np.array([0, b - a]), k)[0].view(np.int64)}) for a, b in zip(firsts[:-1], firsts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), flat, pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "words", "grams"])

    hashed = cut(rows.mapInArrow(split, "item_id long, words array<long>, grams array<long>").where("size(words) > 0"))
    n, words = hashed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    frequent = hashed.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    pieces = max(1, math.ceil(words * 200 / part_bytes))  # an item's word takes about 200 bytes in an index
    if pieces > 1:
        frequent = cut(frequent)

    def built() -> Iterator[list[Index]]:
        for piece in range(pieces if n else 0):
            mine = hashed.where(F.pmod(F.xxhash64("item_id"), F.lit(pieces)) == piece)
            grams = mine.select(F.explode("grams").alias("gram")).distinct()
            df = {r.gram & (2**64 - 1): r["count"] for r in frequent.join(grams, "gram", "left_semi").toLocalIterator()}
            by_k: dict[int, list[tuple[int, np.ndarray]]] = {}
            for r in mine.select("item_id", "words").orderBy("item_id", "words").toLocalIterator():
                by_k.setdefault(min(k, len(r.words)), []).append((r.item_id, np.array(r.words, dtype=np.int64).view(np.uint64)))
            if by_k:
                yield [Index.build(kk, mine_, df, n) for kk, mine_ in sorted(by_k.items())]

    return pieces, built()


def _search(batch: pa.RecordBatch, text_col: str, indexes: list[Index], threshold: float) -> list[tuple]:
    """(row, item, start, words, distance, similarity) of the leaks in one batch."""
    words, firsts = textvec.word_hashes(batch.column(batch.schema.get_field_index(text_col)))
    out = []
    for index in indexes:
        grams, starts = textvec.shingles(words, firsts, index.k)
        known = index.places(grams)
        hits = np.flatnonzero(known >= 0)
        for row in np.unique(np.searchsorted(starts, hits, "right") - 1).tolist():
            a, b = starts[row], starts[row + 1]
            out += [(row, *x) for x in index.search(words[firsts[row] : firsts[row + 1]], grams[a:b], known[a:b], threshold)]
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8, part_bytes: int = 64_000_000) -> DataFrame:
    """One row for each document and benchmark item of which it holds a window of similarity `threshold` or more.

    start_word and n_words are of the most similar window (the first of equals), in words split at ASCII white space;
    case is ignored. A window may be shorter or longer than the item. An item of fewer than `words` words is one shingle and
    must occur as it is. Null or empty texts, on either side, leak nothing; items of a null id are left out;
    rows of a null doc_id keep it. Repeated rows give repeated results; items with equal texts give a row each. Other columns are not read.
    """
    out = None
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    pieces, parts = _parts(items, item_col, item_text, words, part_bytes)
    for indexes in parts:

        def scan(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "body"):
                    found = _search(batch, "body", indexes, threshold)
                    if found:
                        row, item, start, n, distance, similarity = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(distance, pa.int32()), pa.array(similarity, pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        part = base.mapInArrow(scan, LEAKS)
        part = part if pieces == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8, part_bytes: int = 64_000_000) -> DataFrame:
    """The rows of docs in which `leaks` finds nothing, with all their columns; they are filtered where they are read.

    Null and empty texts stay, and so do all rows where no item has words. Equal rows stay or go together. An empty table gives an empty table.
    Columns may have any names.
    """
    out = docs
    pieces, parts = _parts(items, item_col, item_text, words, part_bytes)
    rounds = Rounds(docs.sparkSession)
    for indexes in parts:

        def keep(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    bad = {x[0] for x in _search(batch, text_col, indexes, threshold)}
                    yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        out = out.mapInArrow(keep, docs.schema)
        out = out if pieces == 1 else rounds.put(out)
    return out
