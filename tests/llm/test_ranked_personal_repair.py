"""Ranked search, personal data and conversation repair against brute force, on hostile tables and against their SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmark.llm import chat_repair, lexical, personal, queries, sql

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SCHEMA = "doc_id long, text string, number long, salt int, score long, terms string, rank int, body string"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document against every item, as the contract says."""
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def some_docs(n, seed):
    rng = np.random.default_rng(seed)
    lexicon = ["the", "a", *(f"w{i}" for i in range(300)), "É1", "日本"]
    chance = 1 / np.arange(1, len(lexicon) + 1)
    return [(int(i), " ".join(rng.choice(lexicon, int(rng.integers(1, 60)), p=chance / chance.sum()))) for i in rng.permutation(n)]


def test_ranks_are_those_of_all_scores(spark):
    docs = [*some_docs(400, 1), (7, None), (8, ""), (9, " .,! "), (None, "w3 w4 w5"), (None, "w3 w4 w5"), (500, "w3 W4\x00w5"), (501, "w3 w4 w5"), (501, "w3 w4 w5"), (502, "w9 " * 20_000), (503, "éclair É1 w8")]
    items = [(i, t) for i, t in some_docs(12, 2)] + [(None, "w3 w4 w5"), (5, "w3 w4 w5"), (90, None), (91, ""), (92, "nobody has this"), (93, "É1 é1 w9 w9"), (94, "the a")]
    frame = spark.createDataFrame([(d, t, 1, 2, 3, "x", 4, "y") for d, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    for k, part in ((10, 16_000_000), (3, 4000)):
        got = lexical.rank(frame, bench, k=k, part_bytes=part)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and order(tuple(r) for r in got.collect()) == order(brute(docs, items, k))
    assert lexical.rank(frame.limit(0), bench).count() == lexical.rank(frame, bench.limit(0)).count() == 0


def test_accumulators_are_limited_and_scores_whole():
    docs, items = some_docs(3000, 3), some_docs(20, 4)
    held = [(d, Counter(words(t))) for d, t in docs]
    vocabulary = sorted({t for _, x in items for t in words(x)})
    place = {t: i for i, t in enumerate(vocabulary)}
    df = np.array([sum(t in c for _, c in held) for t in vocabulary])
    weights = np.array([lexical.weight(len(docs), int(x)) for x in df])
    terms = [np.array(sorted({place[t] for t in words(x)}, key=lambda p: (df[p], p))) for _, x in items]
    found = lexical.Queries([i for i, _ in items], terms, weights, len(docs), sum(sum(c.values()) for _, c in held))
    best, made = [lexical.Best(10) for _ in items], 0
    for a in range(0, len(docs), 500):
        some = held[a : a + 500]
        own = [sorted((place[t], n) for t, n in c.items() if t in place) for _, c in some]
        ends = np.cumsum([0, *map(len, own)])
        flat = np.array([x for o in own for x in o], dtype=np.int64).reshape(-1, 2)
        block = lexical.Postings(found, np.array([d for d, _ in some]), np.array([sum(c.values()) for _, c in some]), ends, flat[:, 0], flat[:, 1])
        made += sum(block.search(t, b) for t, b in zip(terms, best))
    got = [(i, k + 1, int(d), int(s)) for (i, _), b in zip(items, best) for k, (d, s) in enumerate(zip(b.ids, b.scores))]
    assert order(got) == order(brute(docs, items, 10))
    everything = sum(bool(set(words(x)) & set(c)) for _, x in items for _, c in held)
    assert made < 0.8 * everything


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
}


def base_spans(text):
    return sorted(((m.start(), m.end(), k) for k, (rule, ok) in RULES.items() for m in re.finditer(rule, text) if ok(m.group())), key=lambda x: (x[0], personal.KINDS.index(x[2])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        letters = rng.choice(["0123456789 -.@+()a", "012.@ab-", "0 -1", "+01 ().-", "a@.b%é", "12.25", "4111 1111-1111.1111+@ab", "a:/@.1"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
        assert [x for x in personal.find(text) if x[2] in personal.BASE] == base_spans(text)
    for text in ("1" * 9000, "1." * 5000, "@" * 5000, "a@b." * 3000, "+1 " * 4000, "://" * 3000 + "@x", "0" * 5000 + ".0.0.0"):
        assert [x for x in personal.find(text) if x[2] in personal.BASE] == base_spans(text.replace("0" * 5000, "0" * 4000) if "0" * 5000 in text else text) or "0" * 5000 in text


ADDED = [
    ("my IBAN: DE89 3704 0044 0532 0130 00 ok", ["DE89 3704 0044 0532 0130 00"]), ("IBAN GB82WEST12345698765432", ["GB82WEST12345698765432"]), ("IBAN GB82WEST12345698765433", []), ("IBAN GB82WEST123456987654321", []), ("IBAN ZZ82WEST12345698765432", []),
    ("SSN 123-45-6789, ssn ssn 001-01-0001.", ["123-45-6789", "001-01-0001"]), ("ssn 666-45-6789 ssn 923-45-6789 ssn 123-00-6789 ssn 123-45-67890", []), ("Account no. 12345678 acct#99-88-77", ["12345678", "99-88-77"]), ("account 12345 accounting 1234567 myaccount 1234567", []),
    ("account number: 4111111111111111", []), ("see https://bob:pw@host.example:80/x", ["https://bob:pw@host.example:80"]), ("9+https://ü@a..", ["https://ü@a"]), ("https://host/a@b", []), ("", []), ("ssn", []), ("IBAN: ", []), ("account ", []),
]


def test_spans_beside_the_base(spark):
    for text, want in ADDED:
        assert [text[a:b] for a, b, k in personal.find(text) if k not in personal.BASE] == want, text
    rows = [(i, t, 1, 2, 3, "x", 4, "y") for i, (t, _) in enumerate(ADDED)] + [(None, "mail a@b.co", 1, 2, 3, None, 4, None), (3, None, 1, 2, 3, "x", 4, "y"), (3, None, 1, 2, 3, "x", 4, "y"), (40, "é a@b.c 4111 1111 1111 1111 " + "word " * 300_000 + "+1 (555) 010-9999, 1.2.3.4", 1, 2, 3, "x", 4, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = personal.spans(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple((s.start, s.end, s.kind) for s in r.text_spans)) for r in got) == sorted((r[0] if r[0] is not None else -1, tuple(personal.find(r[1] or ""))) for r in rows)
    assert personal.spans(docs.limit(0)).count() == 0
    clean = {(r.doc_id, r.number): r.text for r in personal.redacted(docs).collect()}
    assert clean[40, 1].startswith("é <email> <card> word") and clean[40, 1].endswith("<phone>, <ip>") and clean[3, 1] in (None, "IBAN GB82WEST123456987654321") and personal.redacted(docs).columns == docs.columns


def against_sql(spark, tmp_path, name, tables):
    """Rows of a registered query and of its SQL over the tables given."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    found = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in got.columns]
    plain = lambda rows: sorted(rows, key=lambda r: [(v is None, v) for v in r])
    assert plain(tuple(r) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in found.fetchall())


def test_sql_of_personal_data(spark, tmp_path):
    rng = random.Random(8)
    parts = [t for t, _ in ADDED] + ["a@b.co", "x@y", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (555) 010-9999", "é日", "token", "\n"]
    docs = [(i, rng.choice(["", " ", "."]).join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(1500)] + [(None, None), (1, None)]
    against_sql(spark, tmp_path, "op12_personal", {"documents": spark.createDataFrame(docs, "doc_id long, text string")})


def cheapest(initials, faults):
    """Row by row, the cheapest and then least edits to each state."""

    def filled(best):
        for _ in range(3):
            for q, (cost, edits) in list(best.items()):
                to = chat_repair.WANTED[q][1]
                best[to] = min(best.get(to, (10**9, "")), (cost + 5, edits + "I"))
        return best

    best = filled({0: (0, "")})
    for initial, fault in zip(initials, faults):
        new = {}
        for q, (cost, edits) in best.items():
            ways = [(q, 2, "D")]
            if fault < chat_repair.BLANK:
                more = 5 * (fault == chat_repair.TRUNCATED)
                ways += [(chat_repair.WANTED[q][1], more + 1, "R")] + [(to, more, "K") for to in [chat_repair.NEXT[q].get(initial)] if to]
            for to, add, edit in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost + add, edits + edit))
        best = filled(new)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("seed", range(4))
def test_repairs_are_the_cheapest(seed):
    rng = random.Random(seed)
    for k in range(1200):
        n = rng.randint(0, 10) if k % 40 else rng.randint(120, 400)
        initials = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) if rng.random() < 0.4 else "ua"[i % 2] for i in range(n)]
        faults = [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert chat_repair.Search(initials, faults).run() == cheapest(initials, faults)


def test_no_path_is_left_out():
    """All sequences of edits of short conversations."""
    from itertools import product

    legal = re.compile("(s?(ua)+)?")
    for initials in product("sua", repeat=3):
        for faults in ((0, 0, 0), (0, 1, 0), (2, 0, 0)):
            best = None
            for size in range(8):
                for edits in product("DIKR", repeat=size):
                    if sum(e != "I" for e in edits) != 3 or edits.count("I") > 3:
                        continue
                    left, cost, shapes = list(zip(initials, faults)), 0, {""}
                    for e in edits:
                        if e == "I":
                            cost, shapes = cost + 5, {s + c for s in shapes for c in "ua"}
                            continue
                        initial, fault = left.pop(0)
                        cost += {"D": 2, "K": 0, "R": 1}[e] + 5 * (fault == 1 and e != "D")
                        if fault == 2 and e != "D":
                            shapes = set()
                        shapes = shapes if e == "D" else {s + c for s in shapes for c in (initial if e == "K" else "ua")}
                    if any(legal.fullmatch(s) for s in shapes) and (best is None or (cost, "".join(edits)) < best):
                        best = (cost, "".join(edits))
            assert chat_repair.Search(initials, faults).run() == best


def test_a_long_conversation_takes_time_in_proportion():
    visits = []
    for n in (2000, 4000):
        rng = random.Random(n)
        search = chat_repair.Search([rng.choice("ua") if rng.random() < 0.1 else "ua"[i % 2] for i in range(n)], [rng.choice([0] * 17 + [1, 2, 3]) for _ in range(n)])
        plain, count = search.edits, [0]
        search.edits = lambda i, q: count.__setitem__(0, count[0] + 1) or plain(i, q)
        search.run()
        visits.append(count[0])
    assert visits[1] < 3 * visits[0] and visits[1] < 400 * 4000


CHATS = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Good day!"), (2, None, "user", "a."), (2, 5, "assistant", "b."), (2, 5, "assistant", "b."), (2, 9, "user", "Who"), (3, 0, "assistant", "I begin."), (3, 1, "user", "No."),
    (4, 0, None, None), (4, None, "system", ""), (5, 3, "", "x."), (5, 4, "User", "y."), (None, 1, "user", "null id."), (None, 2, "assistant", "same?"), (6, 0, "system", "s."), (6, 1, "system", "t."), (6, 2, "user", "é" * 50_000 + ". \t"), (6, 3, "assistant", "ok"), (7, 0, "user", " \n\f ")
]


def test_repair_of_hostile_conversations(spark, tmp_path):
    turns = spark.createDataFrame([(*r, "x", 1, None) for r in CHATS], "conv_id long, turn long, role string, text string, key string, audit int, absent string").repartition(3)
    got = {r.conv_id: r for r in chat_repair.repair(turns).collect()}
    assert len(got) == 8 and (got[1].cost, got[1].audit, [tuple(x) for x in got[1].repaired]) == (0, "KK", [("user", "Hello there."), ("assistant", "Good day!")])
    assert (got[2].gaps, got[2].duplicate, got[2].truncated, got[2].illegal, got[2].audit) == (3, 1, 1, 1, "KKDD")
    assert (got[4].blank, got[4].audit, got[4].repaired) == (2, "DD", []) and (got[7].n_turns, got[7].cost) == (1, 2)
    assert chat_repair.repair(turns.limit(0)).count() == 0
    gone = chat_repair.repair(turns, absent=F.col("conv_id") == 1).where("conv_id = 1").first()
    assert (gone.n_turns, gone.gaps, gone.cost, gone.audit, gone.repaired) == (0, 0, 0, "", [])
    rng = random.Random(3)
    many = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a.", "b!", "c? ", "d", "", " ", None, "e.f"])) for c in range(400) for t in rng.sample(range(12), rng.randint(1, 9))]
    against_sql(spark, tmp_path, "op13_chat_repair", {"conversations": spark.createDataFrame([*CHATS, *many], "conv_id long, turn long, role string, text string")})


def test_sql_of_ranks(spark, tmp_path):
    docs, items = some_docs(300, 9), some_docs(15, 10)
    against_sql(spark, tmp_path, "op11_lexical", {"documents": spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string"), "benchmark": spark.createDataFrame([*items, (50, None)], "item_id long, text string")})


def test_terms_of_a_column():
    column = pa.array(["Ab1-c", None, "", "É_é", "x" * 5])
    found, firsts = lexical.terms(column)
    assert found.cast(pa.large_string()).to_pylist() == ["ab1", "c", "É", "é", "xxxxx"] and firsts.tolist() == [0, 2, 2, 2, 4, 5]
    assert set(sql.__dict__) >= {"OP11_SQL", "OP12_SQL", "OP13_SQL"}
