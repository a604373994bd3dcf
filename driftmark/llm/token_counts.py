"""Token counts of a unigram tokenizer, without its tokens.

Texts are split into words at white space, and each word begins with the mark U+2581. An Aho-Corasick automaton of the vocabulary
gives all pieces that end at each character of a word; a table of the best score up to each character carries the
number of pieces of the best path. Ties go as in the `tokenizers` library's Unigram model: a path replaces another
only if its score is higher, and pieces are tried in the order of their beginnings, so that the longest of equal
last pieces stays. A character that no piece of one character covers costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).
Each distinct word of a task is counted once while it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import slices

MARK = "▁"
#: White space beyond ASCII, as the Unicode property White_Space has it (fixed values).
WIDE_SPACE = re.compile("[\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
UNKNOWN_PENALTY = 10.0
MOST_WORDS, MOST_BYTES = 500_000, 1 << 25


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a sentencepiece file, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}
        self.held = 0

    def count(self, word: str) -> int:
        """Pieces of one word, its mark included in it."""
        n = len(word)
        best: list = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0.0
        matches = iter(self.automaton.iter(word))
        nxt = next(matches, None)
        for end in range(1, n + 1):
            top, count = None, 0
            while nxt is not None and nxt[0] + 1 == end:  # the longest piece, which begins first, comes first
                size, score = nxt[1]
                candidate = best[end - size] + score
                if top is None or candidate > top:
                    top, count = candidate, pieces[end - size] + 1
                nxt = next(matches, None)
            if word[end - 1] not in self.single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, count = candidate, pieces[end - 1] + len(word[end - 1].encode())
            best[end], pieces[end] = top, count
        return pieces[n]

    def word(self, raw: str) -> int:
        """Pieces of a run of other than ASCII white space; wider white space splits it further."""
        if raw.isascii():
            return self.count(MARK + raw)
        return sum(self.count(MARK + part) for part in WIDE_SPACE.split(raw) if part)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Pieces of each text of a column."""
        found, firsts = textvec.words(column, lower=False)
        if not len(found):
            return np.zeros(len(firsts) - 1, dtype=np.int64)
        distinct = found.dictionary.to_pylist()
        if len(self.known) + len(distinct) > MOST_WORDS or self.held > MOST_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        for word in distinct:
            if word not in known:
                known[word] = self.word(word.decode())
                self.held += len(word)
        each = np.fromiter((known[word] for word in distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[firsts])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (long) under the unigram vocabulary of the file at path.

    Null and empty texts, and texts of white space, have 0 tokens. Rows of a null id and repeated rows are counted like
    others. Columns other than the id and the text are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for whole in batches:
            for batch in slices(whole, "body"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counter.counts(batch.column("body")))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(run, "doc_id long, n_tokens long")
