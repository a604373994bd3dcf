"""Words that collide under any polynomial hash modulo 2^64, through all operators that hash or remember words."""

import public_tokenizers
import pyarrow as pa
import pytest

from driftmark.llm import decontaminate, ngram_join, textvec, token_counts, token_files

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(a, b, doublings):
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("doublings", (10, 11, 12))
def test_words_of_one_batch(doublings):
    column = pa.array(thue_morse("t", "h", doublings))
    hashes, _ = textvec.word_hashes(column)
    assert hashes[0] != hashes[1]
    one, two = textvec.shingle_sets(column)
    assert set(one) != set(two)
    tokenizer = token_files.load(WORD_BPE)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
    encoder = token_files.PieceEncoder(WORD_BPE)
    ids, counts = encoder.encode(column)
    assert ids.tolist() == want[0] + want[1] and counts.tolist() == [len(w) for w in want]
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    alone = [int(token_counts.Counter(pieces).counts(column.slice(i, 1))[0]) for i in (0, 1)]
    assert token_counts.Counter(pieces).counts(column).tolist() == alone


def test_sequences_of_words():
    a, b = thue_morse(["x"], ["y"], 10)
    for k in (5, 1024):
        hashes, starts = textvec.shingles(*textvec.word_hashes(pa.array([" ".join(a), " ".join(b)])), k)
        assert k == 5 or hashes[starts[0]] != hashes[starts[1]]


def test_shingles_are_those_of_each_text():
    texts = ["", None, "one", "one two", "one two three four", "a b c d e", "a b c d e f g", "  ", "a b c d e"]
    hashes, starts = textvec.shingles(*textvec.word_hashes(pa.array(texts)), 5)
    assert (starts[1:] - starts[:-1]).tolist() == [0, 0, 1, 1, 1, 1, 3, 0, 1]
    for i, t in enumerate(texts):
        alone, _ = textvec.shingles(*textvec.word_hashes(pa.array([t], pa.string())), 5)
        assert alone.tolist() == hashes[starts[i] : starts[i + 1]].tolist()
    assert hashes[starts[5]] == hashes[starts[6]] == hashes[starts[8]] and len(set(hashes.tolist())) == 6


def test_documents_of_such_words(spark):
    a, b = thue_morse("t", "h", 10)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()} == {(1, 1, 1), (2, 2, 0), (3, 1, 1)}
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, b)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(2, 7)]


def test_pieces_are_forgotten_by_their_size(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_BYTES", 50)
    tokenizer = token_files.load(WORD_BPE)
    encoder = token_files.PieceEncoder(WORD_BPE)
    for t in ("some plain words", "don't É日本 <|x|> é", "some plain words again and again with more of them", "Some 12 words!!"):
        assert encoder.encode(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
