"""The operators against brute force, exact round trips and held-out labels, on small and hostile tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmark.llm import chat_format, common, decontaminate, fingerprints, licenses, mixing, ngram_join, quality, sharding, textvec, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, size long, key string, tie string, _id long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, nulls in every column, ties, repeated rows, empty and very long texts."""
    base = [" ".join(prose(i, 60)) for i in range(12)]
    near = base[0].split()
    near[30] = "changed"
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (21, base[0]), (22, " ".join(near)), (23, ""), (24, None), (25, "  \n\t "), (26, "one two"), (27, "ONE  two"), (28, "É ü ß 日本 😀 don't"), (29, " ".join(prose(99, 60_000))), (None, base[3])]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), "x", 1, "k", None, None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_lose_no_link(spark, docs, rows, none):
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    named = [r for r in rows if r[0] is not None]
    links = Counter()
    for (i, a), (j, b) in combinations(list(enumerate(named)), 2):
        x, y = shingle_set(a[1]), shingle_set(b[1])
        if (a[1] or "") == (b[1] or "") or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
            links[i] += 1
            links[j] += 1
    want = sorted((named[i][0], links[i] + (1 if named[i][0] == 3 else 0)) for i in range(len(named)))
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == want
    by = {r.doc_id: r.class_id for r in got}
    assert by[0] == by[20] == by[21] == by[22] == 0 and by[23] == by[24] == 23 and by[26] == by[27] == 26 and by[None] == 3 and by[1] == 1
    assert ngram_join.near_duplicates(none).count() == 0
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted([*range(12), 23, 25, 26, 28, 29])  # the row without an id is a copy of 3


def test_large_groups_of_near_copies_are_counted_whole(spark):
    base = prose(7, 200)
    texts = []
    for i in range(600):
        w = list(base)
        w[(i * 7) % 200] = f"edit{i}"
        texts.append(" ".join(w))
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [shingle_set(t) for t in texts]
    links = Counter()
    for i, j in combinations(range(600), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
    assert all(r.n_links == links[r.doc_id] and r.class_id == 0 for r in got)


def test_an_id_with_two_texts_loses_no_link_and_no_row(spark):
    t1, t2 = prose(41, 80), prose(42, 80)
    near = lambda t, i: " ".join([*t[:i], "edit", *t[i + 1 :]])
    rows = [(5, " ".join(t1)), (5, " ".join(t2)), (6, near(t2, 30)), (7, near(t1, 20)), (8, " ".join(t2)), (9, " ".join(prose(43, 50))), (9, " ".join(prose(44, 50))), (None, " ".join(prose(45, 50))), (None, " ".join(prose(45, 50)))]
    docs = spark.createDataFrame([(i, t, "x", k % 2, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, same string, n int, row int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.copies, r.n_links) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted([(5, 5, 1, 1), (5, 5, 2, 2), (6, 5, 1, 2), (7, 5, 1, 1), (8, 5, 2, 2), (9, 9, 1, 0), (9, 9, 1, 0), (-1, -1, 2, 1), (-1, -1, 2, 1)])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect() if r.row < 7) == [0, 1, 5, 6] and kept.count() == 5


def test_recall_at_each_depth_is_that_of_the_formula(spark):
    """Pairs of a similarity of 0.8 to 0.85: those found at the depth that was chosen, against brute force."""
    texts = []
    for i in range(600):
        t = prose(5000 + i, 60)
        other = list(t)
        other[29] = f"edit{i}"  # 51 of 61 shingles in common
        texts += [" ".join(t), " ".join(other)]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r.n_links == 1 and r.class_id == r.doc_id - r.doc_id % 2 for r in got) >= 0.999 * len(got)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(edges).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


def test_leaks_are_found_and_clean_documents_left(spark, docs, none):
    items = [(1, " ".join(prose(500, 40))), (2, "short item here"), (3, None), (4, "  "), (5, " ".join(prose(501, 30))), (None, "no id at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = prose(501, 30)
    edited[1] = "other"
    leaky = [(100, " ".join(prose(1, 50) + prose(500, 40) + prose(2, 50))), (101, "a SHORT item HERE b"), (102, " ".join(prose(3, 20) + edited)), (103, " ".join(prose(501, 12))), (104, " ".join(prose(500, 40)))]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaky, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(all_docs, bench).collect()}
    assert set(got) == {(100, 1), (101, 2), (102, 5), (104, 1)}
    assert (got[100, 1].start_word, got[100, 1].n_words, got[100, 1].distance) == (50, 40, 0) and got[100, 1].similarity > 0.999
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(all_docs, bench, part_bytes=3000).collect()} == set(got)
    kept = decontaminate.without_leaks(all_docs, bench)
    assert kept.count() == all_docs.count() - 4 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(all_docs, bench.limit(0)).count() == 0 and decontaminate.without_leaks(docs, bench).columns == docs.columns


def test_leaks_are_found_in_windows_of_other_lengths_than_the_item(spark):
    items = [(i, " ".join(prose(600 + i, n))) for i, n in enumerate((16, 31, 44, 59))]
    cut = {i: t.split()[: -(len(t.split()) - 4) // 6] for i, t in items}
    fuller = {i: t.split()[: len(t.split()) // 2] + ["put", "in"] + t.split()[len(t.split()) // 2 :] for i, t in items if i == 3}
    leaky = [(10 * k + i, " ".join(prose(700 + i, 40) + w + prose(800 + i, 40))) for k, words in enumerate((cut, fuller), 1) for i, w in words.items()]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(leaky, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(d, d % 10) for d, _ in leaky}
    for i, w in cut.items():
        assert (got[10 + i, i].start_word, got[10 + i, i].n_words) == (40, len(w)) and 0.8 <= got[10 + i, i].similarity < 0.9
    assert all(got[20 + i, i].n_words == len(w) for i, w in fuller.items())


def test_leaks_are_those_of_all_windows(spark):
    """Every window of every text against every item, by counting."""
    import math

    items = {i: prose(3000 + i, 8 + 3 * i) for i in range(8)}
    items[8] = items[3][:10] + prose(3100, 9)
    texts = {}
    for d in range(12):
        item, other = items[d % 9], items[(d + 4) % 9]
        kept = item[: len(item) - d % 3] if d % 2 else item[:4] + ["put"] + item[4:]
        texts[d] = prose(3200 + d, 15) + kept + prose(3300 + d, 9) + other[d % 4 :] + prose(3400 + d, 5)
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    df = Counter(g for w in items.values() for g in set(grams(w)))
    weight = lambda g: math.log(1 + len(items) / df[g]) if df[g] else math.log(1 + len(items))
    want = {}
    for d, w in texts.items():
        for i, t in items.items():
            theirs = Counter(grams(t))
            total = sum(weight(g) * n for g, n in theirs.items())
            for a in range(len(w)):
                for b in range(a + 5, len(w) + 1):
                    mine = Counter(grams(w[a:b]))
                    both = sum(weight(g) * min(n, theirs[g]) for g, n in mine.items())
                    s = both / (total + sum(weight(g) * n for g, n in mine.items()) - both)
                    if s >= 0.8 - 1e-9 and s > want.get((d, i), (0,))[0] + 1e-9:
                        want[d, i] = (s, a, b - a)
    found = decontaminate.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in found}
    assert len(want) >= 15 and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(np.isclose(got[k][0], want[k][0]) and got[k][1:] == want[k][1:] for k in got)


def test_prints_of_windows_piece_by_piece():
    words = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    begin = np.array([0, 5, 17, 100, 250, 299, 0])
    stop = np.array([4, 60, 18, 290, 300, 300, 300])
    want = [decontaminate.simhash(words[a:b]) for a, b in zip(begin, stop)]
    assert all(np.array_equal(decontaminate.window_prints(words, begin, stop, piece), want) for piece in (7, 64, 1000))


def test_blocks_reach_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(50)]
    df = {int(g): 1 for w in words for g in textvec.shingles(w, np.array([0, 30]), 5)[0]}
    index = decontaminate.Index.build(5, list(enumerate(words)), df, 50)
    probes = index.prints.copy()
    for i in range(50):
        for bit in rng.choice(64, rng.integers(0, 22), replace=False):
            probes[i] ^= np.uint64(1) << np.uint64(bit)
    for p, found in zip(probes.tolist(), index.near(probes)):
        assert set(found.tolist()) == {i for i, q in enumerate(index.prints.tolist()) if (p ^ q).bit_count() <= decontaminate.RADIUS}


def test_licenses_as_by_brute_force(spark, docs, none):
    import re

    texts = [(200, "x " * 30 + "Released under the MIT License. " + "y " * 40), (201, "LICENSED under the Apache license, version 2.0"), (202, "Released under the license."), (203, licenses.NOTICES[5][1] * 2), (204, " ".join(licenses.NOTICES[6][1].split()[:19]) + " and so on"), (204, "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 4.0."), (205, "no notice " * 200)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    want = Counter()
    for r in all_docs.collect():
        own = grams(words(r.text))
        for k, (_, notice) in enumerate(licenses.NOTICES + licenses.TEXTS):
            t = set(grams(words(notice)))
            m = 1 << (len(t) - 1).bit_length()
            best = max((len(t & set(own[s : s + 2 * m])) for s in range(0, max(1, len(own)), m)), default=0)
            if best >= 0.8 * len(t):
                want[r.doc_id, k] += 1
    got = Counter((r.doc_id, r.template_id) for r in licenses.scan(all_docs, licenses.notices(spark)).collect())
    assert got == want and len(want) >= 6
    assert licenses.scan(none, licenses.notices(spark)).count() == 0 and licenses.scan(docs, licenses.notices(spark).limit(0)).count() == 0


def test_licenses_of_other_kinds_and_short_notices(spark):
    gnu = "You can redistribute it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. x y z"
    said = {
        1: (gnu.format("Lesser General", 3), "LGPL-3.0-or-later"), 2: (gnu.format("Affero General", 3), "AGPL-3.0-or-later"), 3: (gnu.format("General", 2), "GPL-2.0-or-later"),
        4: ("// SPDX-License-Identifier: EPL-2.0 import a b c", "EPL-2.0"), 5: ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in said.items()] + [(6, "a b c. Copyright 2020 by N. N. All rights reserved. d e f"), (7, "# SPDX-License-Identifier: MIT\nimport os"), (8, "all the rights are reserved")], "doc_id long, text string")
    top = {}
    for r in licenses.scan(docs, licenses.notices(spark)).collect():
        top[r.doc_id] = max(top.get(r.doc_id, (0, "")), (r.containment, r.license))
    assert {i: x[1] for i, x in top.items() if i <= 5} == {i: name for i, (_, name) in said.items()}
    short = licenses.scan(docs, licenses.notices(spark, short=True)).collect()
    assert {(r.doc_id, r.license) for r in short} - {(5, "Public domain")} == {(6, "Proprietary"), (7, "MIT")}


def test_licenses_by_many_long_templates(spark, tmp_path):
    """Thousands of templates of hundreds of words, in one pass and in several; whole files as templates."""
    rows = [(i, f"own-{i}", " ".join(prose(9000 + i, 200 + i % 300))) for i in range(2000)]
    forms = spark.createDataFrame(rows, "template_id int, license string, text string").repartition(4)
    texts = [(i, " ".join(prose(70 + i, 100)) + " " + " ".join(rows[i * 7][2].split()[: 190 + i]) + " end " + " ".join(prose(90 + i, 300))) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.template_id) for r in licenses.scan(docs, forms).collect()}
    want = {(i, i * 7) for i in range(30) if 190 + i - 4 >= 0.8 * (200 + (i * 7) % 300 - 4)}
    assert got == want and len(want) >= 5
    assert {(r.doc_id, r.template_id) for r in licenses.scan(docs, forms, most_sent=300_000).collect()} == want
    (tmp_path / "OWN-1.txt").write_text(rows[0][2])
    assert [(r.doc_id, r.license) for r in licenses.scan(docs, licenses.templates_of(spark, str(tmp_path))).collect()] == [(0, "OWN-1")]


def test_chats_come_back_whole(spark):
    hostile = ["\\### Assistant: </turn> ok", "<|turn|>user<|says|>x<|end|>", "\\<|end|>\\\\", "", None, "日本 😀 é", " lead and trail \n", "<<||>>", "<|endoftext|>"]
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], hostile[(c * 3 + t) % len(hostile)]) for c in range(9) for t in range(5)] + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, None, "assistant", "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, mine in by.items():
        mine.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(mine)
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_chats(turns.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_unigram_counts_as_the_library(spark, docs, rows, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    hf = Tokenizer(models.Unigram(list(token_counts.vocabulary(path)), 0, True))
    hf.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == Counter((r[0], len(hf.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    odd = ["▁▁a <0x41> <unk> <s>", "\u0085 a b", "a" * 500, "\x1c\x1d", "ﬁ…Ⅷ"]
    assert token_counts.Counter(token_counts.vocabulary(path)).counts(pa.array(odd)).tolist() == [len(hf.encode(t, add_special_tokens=False).ids) for t in odd]
    ties = [("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0), ("<unk>", 0.0)]
    other = Tokenizer(models.Unigram(ties, 5, False))
    assert [token_counts.Counter(ties).count("▁" + "a" * n) for n in range(9)] == [len(other.encode("▁" + "a" * n).ids) for n in range(9)]
    assert token_counts.token_counts(none, path).count() == 0


def test_shards_are_even_and_keep_copies_together(spark, docs, rows, none):
    for df, n in ((docs, len(rows)), (docs.unionByName(docs).unionByName(docs.limit(5)), None), (docs.where("doc_id IN (0, 20, 21)"), 4)):
        out = sharding.shard(df).collect()
        n = n or df.count()
        sizes = Counter(r.shard for r in out)
        assert len(out) == n and max(sizes.values()) - min([sizes[s] for s in range(24)]) <= 1
        for s in sizes:
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
        assert all(r["law"] == "rows" and r.grown_shard is None for r in out)
    by = {r[0]: r[1] for r in rows}
    for r in sharding.shard(docs).collect():
        text = by[r.doc_id]
        assert r["size"] == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
    assert sharding.shard(none).count() == 0
    pairs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(240)], "doc_id long, text string")
    where = defaultdict(set)
    for r in sharding.shard(pairs).collect():
        where[r.doc_id // 2].add(r.shard)
    assert sum(len(s) == 1 for s in where.values()) >= 110


def test_few_links_are_cut(spark, none):
    """Within 5 % and 8 links of the least that any filling of the quotas cuts: groups that fit a shard stay whole, one beyond it fills whole shards first."""
    for sizes, shards in (([5, 4, 4, 3, 3, 2, 2, 1], 4), ([30, 3, 3, 2, 2, 2, 2, 2, 2], 8), ([2] * 50 + [1] * 20, 6)):
        rows = [(1000 * g + i, f"text of {g}") for g, n in enumerate(sizes) for i in range(n)]
        out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards)
        got = sharding.cut_links(out).first()
        quota = len(rows) // shards
        over = lambda n: n * (n - 1) // 2 - sum(k * (k - 1) // 2 for k in [quota] * (n // quota) + [n % quota])
        least = sum(over(n) for n in sizes if n > quota)
        by = Counter((r.doc_id // 1000, r.shard) for r in out.collect())
        want = sum(n * (n - 1) // 2 for n in sizes) - sum(n * (n - 1) // 2 for n in by.values())
        assert (got.links, got.cut) == (sum(n * (n - 1) // 2 for n in sizes), want) and got.cut <= 1.05 * least + 8
    assert tuple(sharding.cut_links(sharding.shard(none)).first()) == (0, 0)


def test_placed_documents_move_on(spark):
    """Groups dealt out at random over full shards: only exchanges can bring them together, which filling shards in turn never does."""
    cut = lambda rows: sum(sum(n for _, n in own) * (sum(n for _, n in own) - 1) // 2 - sum(n * (n - 1) // 2 for _, n in own) for own in rows.values())

    def by_group(placed):
        out = defaultdict(list)
        for r in placed.collect():
            out[r.g].append((r.shard, r.n))
        return out

    rng = np.random.default_rng(11)
    rows = Counter((f"g{g}", int(rng.integers(0, 5))) for g in range(30) for _ in range(int(rng.integers(2, 9))))
    placed = spark.createDataFrame([(g, s, n) for (g, s), n in rows.items()], "g string, shard int, n long")
    loads = [sum(n for (_, s), n in rows.items() if s == shard) for shard in range(5)]
    costs = []
    for moves in (0, 1, 3, 40):
        after = by_group(sharding.propagated(placed, loads, moves))
        assert [sum(n for own in after.values() for s, n in own if s == shard) for shard in range(5)] == loads
        assert {g: sum(n for _, n in own) for g, own in after.items()} == {f"g{g}": sum(n for (h, _), n in rows.items() if h == f"g{g}") for g in range(30)}
        costs.append(cut(after))
    assert costs == sorted(costs, reverse=True) and costs[-1] < 0.25 * costs[0]
    # A group of five on two full shards comes together by a swap with a whole group of two.
    stuck = spark.createDataFrame([("g", 0, 3), ("g", 1, 2), ("q", 0, 2), ("r", 1, 3)], "g string, shard int, n long")
    assert cut(by_group(sharding.propagated(stuck, [5, 5], 0))) == 6 and cut(by_group(sharding.propagated(stuck, [5, 5]))) == 0


def test_flows_keep_the_quotas():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(2, 9))
        wants = {(a, b): int(rng.integers(0, 20)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4}
        rooms = [int(x) for x in rng.integers(0, 6, n) * (rng.random(n) < 0.3)]
        flows = sharding._flows(wants, rooms)
        assert all(0 <= x <= wants[k] for k, x in flows.items())
        net = [sum(x for (a, b), x in flows.items() if b == s) - sum(x for (a, b), x in flows.items() if a == s) for s in range(n)]
        assert all(net[s] <= rooms[s] for s in range(n))
        left = {k: v - flows.get(k, 0) for k, v in wants.items()}
        assert all(min(left.get((a, b), 0), left.get((b, a), 0)) == 0 for a in range(n) for b in range(n))
        assert all(not (x > 0 and rooms[b] - net[b] > 0) for (_, b), x in left.items())


def test_quality_learns_from_its_fold_only(spark, none):
    rng = np.random.default_rng(3)
    good = [" ".join(prose(i, 100)) for i in range(150)]
    bad = [" ".join(prose(1000 + i, 60) + [f"{w}!!$" for w in prose(i, 40)]) for i in range(150)]
    rows = [(i, t, 1 - i % 2) for i, t in enumerate(x for p in zip(good, bad) for x in p)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality.fit(d, labels.where(~fold), most_of_a_class=100)
    scores = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    held = [(scores[i] >= 0.7) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    twisted = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(d, twisted.where(~fold), most_of_a_class=100)
    assert {r.doc_id: r.score for r in quality.score(d, again).collect()} == scores
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "日本 " * 3000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.fit(d, labels.limit(0)) is None and quality.score(none, None).count() == 0
    assert {r.score for r in quality.score(d, None).collect()} == {0.5} and quality.good_rows(d, model).columns == d.columns


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, starts = rng.normal(size=(9, quality.WIDTH)), np.array([0, 2, 5, 9])
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = quality.Model.start(x, 1)

    def loss():
        y = model.forward(x, starts)["y"]
        return float(-(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum())

    slopes = model.slopes(x, starts, label, weight, 0.0)
    for name, at in (("W", (3, 2)), ("V", (1, 1)), ("U", (2, 0)), ("w", (4,)), ("c", (5,)), ("c0", (0,)), ("b", (7,))):
        p = model.layers[name]
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert np.isclose((up - down) / 2e-5, slopes[name][at], rtol=1e-4, atol=1e-7)


def test_mixture_meets_its_targets(spark, docs, rows, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    count = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    sizes, of = Counter(), {}
    for r in rows:
        sizes[r[3]] += count(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in out:
        want = 3 * sizes[r.source] if r.source in capped else weight[r.source] * level
        assert np.isclose(r.target, want) and r.taken == r["size"] * r.copies <= 3 * r["size"] and r.source_size == sizes[r.source]
    assert sorted((r.doc_id or -1, r["size"]) for r in out) == sorted((r[0] or -1, count(r[1])) for r in rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    many = spark.createDataFrame([(i, "w " * (1 + i % 17), "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, text string, source string")
    sums = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(r.t - r.goal) <= 9 for r in sums)
    assert mixing.mix(none).count() == 0
    made = mixing.mixed_rows(docs)
    assert made.columns == docs.columns and made.count() == sum(r.copies for r in out)


def test_digests_follow_edits(spark, docs, rows, none):
    out = fingerprints.edited(docs).collect()
    order = sorted(((r[0] if r[0] is not None else -1, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1] or "") for r in rows), reverse=True)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.edited_sha256, r.n_chars) for r in out))
    want = []
    for i, (k, _, t) in enumerate(order):
        n = len(t) // 3
        new = t[: len(t) - n] + order[(i + 1) % len(order)][2][:n]
        want.append((k, hashlib.sha256(new.encode()).hexdigest(), len(t)))
    assert got == sorted(want)
    prints = {r.doc_id: r for r in out}
    assert prints[0].fingerprint == prints[20].fingerprint == prints[21].fingerprint != prints[1].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out) and prints[23].fingerprint == ""
    assert prints[29].near_edited > 0.5 > prints[29].near_next and prints[1].near_edited > prints[1].near_next
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()} == {k: r.fingerprint for k, r in prints.items()}
    assert fingerprints.edited(none).count() == 0
    single = fingerprints.edited(docs.where("doc_id = 29")).collect()
    assert len(single) == 1 and single[0].near_next == 1


def test_token_files_come_back(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(WORD_BPE)
    more = ["a<|endoftext|>b <|startoftext|>", "it's I'LL O'Neil !'s", "ÀÉÎ×÷ßÿ œuvre İ ΣΑΣ", "á é", "\x00\x1c\x7f", "abc123!?x_y", "x\u0085y ª²"]
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    path = str(tmp_path / "tokens")
    token_files.write(extra, path, WORD_BPE, block_ids=500)
    found = {(r.doc_id, r.start): r.ids for r in token_files.read(spark, path).collect()}
    order = sorted([(r[0] if r[0] is not None else -1, r[1] is not None, r[1] or "") for r in rows] + [(1000 + i, True, t) for i, t in enumerate(more)])
    start = 0
    for k, _, t in order:
        ids = hf.encode(t, add_special_tokens=False).ids + [2]
        assert found[k if k >= 0 else None, start] == ids
        start += len(ids)
    assert len(found) == len(order)
    for r in token_files.read_digests(spark, path).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(found[r.doc_id, r.start], dtype="<u4").tobytes())
    token_files.write(none, str(tmp_path / "none"), WORD_BPE)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0
    token_files.write(docs, str(tmp_path / "other"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read(spark, str(tmp_path / "other")).count() == len(rows)


def test_variable_length_codes():
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 7, dtype=np.uint32)
    for n in range(len(values)):
        assert np.array_equal(token_files.unpack(*token_files.pack(values[:n]), n), values[:n])


def test_ranges_are_found_by_two_levels(spark):
    bounds = sorted(np.random.default_rng(0).integers(0, 10_000, 37).tolist())
    got = spark.range(0, 10_000, 13).select("id", common.range_bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == np.searchsorted(bounds, r.id, "right") for r in got)
