"""Fingerprints against a plain reading of their rules, and across sizes."""

import math

import numpy as np

from driftmark.llm import fingerprints

MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & MASK
    return x ^ x >> 31


def some_text(rng, n):
    syllables = ["ka", "lo", "mi", "ren", "tu", "é", "and ", "the ", "x", " "]
    return "".join(rng.choice(syllables, n, p=[0.14, 0.14, 0.14, 0.1, 0.1, 0.04, 0.1, 0.1, 0.02, 0.12]))[:n].encode()


def rarities(texts):
    counts = np.zeros((256, 256))
    for t in texts:
        for a, b in zip(t, t[1:]):
            counts[a, b] += 1
    return np.rint(-1000 * np.log2((counts + 1) / (counts.sum(axis=1, keepdims=True) + 256))).astype(np.int64).ravel()


def plain_features(data, rarity):
    if not data:
        return []
    if len(data) <= 16:
        windows = [data.ljust(16, b"\0")]
    else:
        own = [sum(int(rarity[a << 8 | b]) for a, b in zip(data[i : i + 16], data[i + 1 : i + 16])) for i in range(len(data) - 15)]
        windows = [data[i : i + 16] for i, x in enumerate(own) if all(y < x for y in own[max(0, i - 8) : i]) and all(y <= x for y in own[i + 1 : i + 9])]
    out = []
    for w in windows:
        total = 0
        for k in range(2):
            word = int.from_bytes(w[8 * k : 8 * k + 8], "little")
            total += mixed(word) * pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)
        h = mixed(total & MASK)
        if h not in out:
            out.append(h)
    return out


def plain_digest(hashes):
    chain = []
    for a in range(0, len(hashes), 160):
        chain.append({h >> 11 * i & 2047 for h in hashes[a : a + 160] for i in range(5)})
    return chain


def plain_likeness(a, b):
    def one_way(x, y):
        total = 0.0
        for f in x:
            best = 0.0
            for g in y:
                share, most = len(g) / 2048, 2 * math.log(len(y))
                chance = len(f) * share + math.sqrt(most * len(f) * share * (1 - share)) + most / 3
                room = min(len(f), len(g)) - chance
                if room > 0:
                    best = max(best, min(1.0, max(0.0, (len(f & g) - chance) / room)))
            total += best
        return total / len(x)

    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    if len(a) == len(b):
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a) < len(b) else one_way(b, a)


def bits(chain):
    return [{int(i) for i in np.flatnonzero(np.unpackbits(row.view(np.uint8)))} for row in chain]


def test_features_digests_and_likeness_are_those_of_the_rules():
    rng = np.random.default_rng(4)
    texts = [some_text(rng, n) for n in (0, 1, 7, 15, 16, 17, 18, 40, 200, 511, 512, 513, 3000, 9000)] + [b"a" * 500, b"ab" * 300]
    texts += [texts[12][:2500] + texts[13][:400], texts[13][4000:] + texts[12]]
    rarity = rarities(texts)
    found, plain = [], []
    for t in texts:
        hashes = fingerprints.features(t, rarity)
        assert hashes.tolist() == plain_features(t, rarity)
        found.append(fingerprints.digest(hashes))
        plain.append(plain_digest(hashes.tolist()))
        assert bits(found[-1]) == plain[-1]
    for a, x in zip(found, plain):
        for b, y in zip(found, plain):
            assert math.isclose(fingerprints.likeness(a, b), plain_likeness(x, y), abs_tol=1e-12)


def test_no_size_is_treated_otherwise():
    """Cutting 15 bytes off costs about as much on either side of any size."""
    rng = np.random.default_rng(5)
    texts = [some_text(rng, 700) for _ in range(60)]
    rarity = rarities(texts)
    whole = lambda t: fingerprints.digest(fingerprints.features(t, rarity))
    means = {n: np.mean([fingerprints.likeness(whole(t[:n]), whole(t[: n - 15])) for t in texts]) for n in (480, 505, 512, 518, 526, 540, 600)}
    assert min(means.values()) > 0.9 and max(means.values()) - min(means.values()) < 0.04


def test_other_texts_are_unlike():
    rng = np.random.default_rng(6)
    texts = [some_text(rng, n) for n in (30, 60, 400, 3000, 60_000, 200_000)]
    rarity = rarities(texts[:4])
    chains = [fingerprints.digest(fingerprints.features(t, rarity)) for t in texts]
    assert all(fingerprints.likeness(a, b) < 0.5 for i, a in enumerate(chains) for b in chains[:i])
    assert all(fingerprints.likeness(a, a) == 1 for a in chains)
