"""Word and shingle hashes of whole Arrow columns of text, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd factor with bits all over it.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler, so that all bits of a hash depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the place at which each text begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, places, data = column.buffers()
    offs = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of bytes that are inside, never across texts, and for each text its first run's number (one more entry at the end)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = inside[begins]
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends] = inside[ends]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(a, offs)


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `spans`, of words: runs of other than ASCII white space."""
    return spans(~SPACE[raw], offs)


def pieces(raw: np.ndarray, inside: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The bytes from a to b of each span, as a column; the spans are all that is inside."""
    places = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(places), pa.py_buffer(raw[inside])])


def words(column: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a column of texts, each different one once in the dictionary, and for each text its first word's number."""
    raw, offs = utf8(column, lower)
    inside = ~SPACE[raw]
    a, b, firsts = spans(inside, offs)
    return pieces(raw, inside, a, b).dictionary_encode(), firsts


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash (xxh3) of each word of a column of texts, and for each text its first word's number."""
    found, firsts = words(column, lower)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    return each[found.indices.to_numpy()], firsts


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and for each text the number of its first one. A text of 1 to k - 1 words has one shingle of them all; one without words has none.

    Each word is mixed into the hash of those before it, so that no sum over a shingle's words decides.
    """
    n = len(words)
    counts = np.diff(firsts)
    own = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    starts = np.zeros(len(firsts), dtype=np.int64)
    np.cumsum(own, out=starts[1:])
    out = np.zeros(starts[-1], dtype=np.uint64)
    if n >= k:
        whole = mix(words[: n - k + 1])
        for j in range(1, k):
            whole = mix(whole * FACTOR + words[j : n - k + 1 + j])
        inside = np.ones(len(whole), dtype=bool)  # not across texts
        for j in range(1, k):
            at = firsts[1:-1] - j
            inside[at[(at >= 0) & (at < len(whole))]] = False
        out[np.repeat(counts >= k, own)] = whole[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = firsts[:-1][short]
        some = mix(words[first])
        for j in range(1, k - 1):
            more = counts[short] > j
            some[more] = mix(some[more] * FACTOR + words[first[more] + j])
        out[starts[:-1][short]] = some
    return out, starts


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a column."""
    hashes, starts = shingles(*word_hashes(column), k)
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
