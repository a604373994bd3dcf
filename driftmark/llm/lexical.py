"""Ranked lexical search, a term at a time with a limited number of accumulators.

1. The items' terms are the vocabulary of a pass. One pass over the documents finds their terms and writes, for each
   document, its length and its frequencies of vocabulary terms. Document counts and weights follow from that table.
2. Each task reads the table in blocks and turns a block into postings by term. For each item the terms are taken rarest first. A
   posting of a document without an accumulator creates one, as long as the sum of the bounds of this and the later terms reaches
   the k-th best score known: of the partial scores in the block, or of the documents of earlier blocks of the task.
   From then on only survivors are updated, exactly; those whose score and remaining bounds don't reach the k-th are let go.
   A term's bound is the largest contribution that it makes in the block.
3. A task returns its k best documents of each item, and windows rank those of all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec
from .common import cut, slices

#: Bytes of terms: digits, letters and all bytes of characters beyond ASCII.
TERM = np.zeros(256, dtype=bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
RANKED = "item_id long, rank int, doc_id long, score long"
NO_ID = (1 << 63) - 1
SALTS = 64


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a column of texts, ASCII letters in lower case, and for each text the number of its first one (one more entry at the end)."""
    raw, offs = textvec.utf8(column)
    inside = TERM[raw]
    a, b, firsts = textvec.spans(inside, offs)
    return textvec.pieces(LOWER[raw], inside, a, b), firsts


def weight(n: int, df: int) -> int:
    """Weight of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """The items of one pass: ids, and for each the places of its terms in the vocabulary, rarest first."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray  # by term
    n_docs: int
    length: int  # terms of all documents

    def contributions(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a score: n is its document's length."""
        if 90 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            share = 90 * n * self.n_docs // self.length
        else:
            share = np.array([90 * x * self.n_docs // self.length for x in n.tolist()], dtype=np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + share)))


class Best:
    """The k best (score, doc_id) of an item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The k-th best score, or 0."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Postings:
    """The postings of a block of documents, by term."""

    def __init__(self, queries: Queries, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(term, kind="stable")
        self.ids, self.doc = ids, doc[order]
        self.adds = queries.contributions(term, tf, n[doc])[order]
        self.begins = np.searchsorted(term[order], np.arange(len(queries.weights) + 1))
        self.bounds = np.zeros(len(queries.weights), dtype=np.int64)
        np.maximum.at(self.bounds, term[order], self.adds)

    def search(self, wanted: np.ndarray, best: Best) -> int:
        """Adds this block's documents to the best ones of an item, and returns how many accumulators there were."""
        wanted = wanted[self.begins[wanted] < self.begins[wanted + 1]]
        if not len(wanted):
            return 0
        bounds = self.bounds[wanted]
        rest = np.cumsum(bounds[::-1])[::-1].tolist()  # of this term and the later ones
        score = np.zeros(len(self.ids), dtype=np.int64)
        known = best.floor()
        alive = np.zeros(0, np.int64)
        at, made = 0, 0
        while at < len(wanted) and rest[at] >= known:
            a, b = self.begins[wanted[at]], self.begins[wanted[at] + 1]
            score[self.doc[a:b]] += self.adds[a:b]
            at += 1
            if at < len(wanted):
                alive = np.flatnonzero(score)
                if len(alive) >= best.k:
                    known = max(known, int(np.partition(score[alive], len(alive) - best.k)[len(alive) - best.k]))
        alive = np.flatnonzero(score)
        made = len(alive)
        for i in range(at, len(wanted)):
            alive = alive[score[alive] + rest[i] >= known]
            if not len(alive):
                return made
            a, b = self.begins[wanted[i]], self.begins[wanted[i] + 1]
            place = np.searchsorted(self.doc[a:b], alive)
            found = self.doc[a:b][np.minimum(place, b - a - 1)] == alive
            score[alive[found]] += self.adds[a:b][place[found]]
        alive = alive[(score[alive] >= max(known, 1))]
        best.add(score[alive], self.ids[alive])
        return made


def _indexed(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """A row for each document with a term: doc_id, n, and the places and frequencies of the vocabulary's terms in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                words, firsts = terms(batch.column("body"))
                n = np.diff(firsts)
                place = pc.index_in(words, value_set=vocabulary)
                hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                doc = np.searchsorted(firsts, hit, "right") - 1
                width = max(1, len(vocabulary))
                pairs, tf = np.unique(doc * width + place.take(pa.array(hit)).to_numpy(), return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(n) + 1) * width)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % width, tf)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _holders(indexed: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all documents, and for each term of the vocabulary the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, dtype=np.int64)
        for batch in batches:
            total[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            total[size] += batch.num_rows
            total[size + 1] += pc.sum(batch.column("n")).as_py() or 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    total = np.zeros(size + 2, dtype=np.int64)
    for r in indexed.select("n", "terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of this pass
        total[r.term] = r.n
    return int(total[size]), int(total[size + 1]), total[:size]


def _passes(items: DataFrame, id_col: str, text_col: str, part_bytes: int) -> Iterator[tuple[list, pa.Array, list[np.ndarray]]]:
    """The items in parts of bounded size: ids, vocabulary, and for each item the places of its terms."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("body"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, firsts = terms(batch.column("body"))
            lists = [pc.unique(words.slice(a, b - a)).cast(pa.large_string()).to_pylist() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.string()))], names=["item_id", "terms"])

    found = cut(rows.mapInArrow(split, "item_id long, terms array<string>").where("size(terms) > 0").withColumn("number", F.monotonically_increasing_id()))
    n = found.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    pieces = math.ceil(n * 100 / part_bytes)  # a term takes about 100 bytes in a pass
    for piece in range(pieces):
        mine = found.where(F.pmod(F.xxhash64("number"), F.lit(pieces)) == piece)
        ids, lists = [], []
        for r in mine.orderBy("number").toLocalIterator():
            ids.append(r.item_id)
            lists.append(r.terms)
        vocabulary = sorted({t for x in lists for t in x})
        place = {t: i for i, t in enumerate(vocabulary)}
        yield ids, pa.array([t.encode() for t in vocabulary], pa.large_binary()), [np.array([place[t] for t in x], dtype=np.int64) for x in lists]


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, part_bytes: int = 16_000_000) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score (long, above 0).

    Terms are runs of digits, letters and characters beyond ASCII; only A to Z are lower-cased. Of equal scores the smaller doc_id comes
    first, null last; repeated rows are documents of their own. Null and empty texts hold no term, are not counted and
    not found; an item without terms, or whose terms no document holds, has no rows. Items that repeat, or whose id is null, are ranked
    each on its own. Columns other than ids and texts are not read. An empty table, on either side, gives an empty table.

    Items go to the tasks in parts of at most `part_bytes`, one pass over the documents for each part.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    out = None
    for ids, vocabulary, places in _passes(items, item_col, item_text, part_bytes):
        indexed = cut(_indexed(base, vocabulary))
        n_docs, length, held = _holders(indexed, len(vocabulary))
        if not n_docs:
            continue
        weights = np.array([weight(n_docs, x) for x in held.tolist()], dtype=np.int64)
        queries = Queries(ids, [p[np.lexsort((p, held[p]))] for p in places], weights, n_docs, length)

        def search(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in queries.ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("terms")
                ends = lists.offsets.to_numpy().astype(np.int64)
                own = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
                postings = Postings(queries, own, batch.column("n").to_numpy(), ends - ends[0], lists.flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy().astype(np.int64))
                for b, wanted in zip(best, queries.terms):
                    postings.search(wanted, b)
            sizes = [len(b.ids) for b in best]
            if sum(sizes):
                docs_ = np.concatenate([b.ids for b in best])
                number = np.repeat(np.arange(len(best)), sizes)
                item = pa.array(queries.ids, pa.int64()).take(pa.array(number))
                salt = np.full(len(number), TaskContext.get().partitionId() % SALTS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), item, pa.array(salt), pa.array(docs_, mask=docs_ == NO_ID), pa.array(np.concatenate([b.scores for b in best]))], names=["number", "item_id", "salt", "doc_id", "score"])

        found = indexed.mapInArrow(search, "number long, item_id long, salt int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], RANKED)
