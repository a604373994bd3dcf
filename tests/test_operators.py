"""Hand-checked fixtures and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.functions import scalars, tails
from driftmark.operators import batch, edits, features, graph, locomotion, masks, mixtures, registration, report, stats, transitions, windows


def one(df):
    return df.first()


def test_line_walk(spark):
    t = spark.createDataFrame([(1, "a", 0, 0.0, 0.0), (1, "a", 1, 3.0, 4.0), (1, "a", 2, 3.0, 4.0), (1, "a", 3, None, None)], "video_id long, object_id string, frame_idx long, cx double, cy double")
    assert one(locomotion.path_lengths(t)).path == 5.0
    assert one(locomotion.locomotion(t, 4, 4)).distance is None
    assert one(locomotion.locomotion(t, 3, 3)).distance == 5.0
    assert one(locomotion.locomotion(t, 3, 2)).distance == 5.0


def test_windows_lie_inside(spark):
    t = spark.range(67).select(F.lit(1).alias("v"), F.col("id").alias("frame_idx"))
    got = {r.start_frame: r.n for r in windows.sliding(t, ["v"], 30, 10).groupBy("start_frame").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 30, 10: 30, 20: 30, 30: 30}
    assert windows.sliding(t.where("frame_idx < 29"), ["v"], 30, 10).isEmpty()


def test_path_does_not_change_by_rotation(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(size=(50, 2))
    turned = xy @ np.array([[0.6, -0.8], [0.8, 0.6]])
    rows = [(k, "a", i, float(p[0]), float(p[1])) for k, pts in enumerate((xy, turned)) for i, p in enumerate(pts)]
    t = spark.createDataFrame(rows, "video_id long, object_id string, frame_idx long, cx double, cy double")
    a, b = [r.path for r in locomotion.path_lengths(t).orderBy("video_id").collect()]
    assert math.isclose(a, b, rel_tol=1e-12)


def test_ranks_and_snapshot(spark):
    t = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,)], "v double").withColumn("k", F.lit(1))
    assert sorted(r.quantile for r in locomotion.quantile_ranks(t, ["k"], "v").collect()) == [0.25, 0.75, 0.75, 1.0]
    s = one(locomotion.snapshot(t, ["k"], "v"))
    assert math.isclose(s.p05, 1.15) and math.isclose(s.std, 3.631460, abs_tol=1e-6)
    q = one(stats.summary(t, ["k"], "v"))
    assert q.q25 == 1.75 and q.n == 4


def test_quantiles_and_ranks_in_chunks_with_null_keys(spark):
    rng = np.random.default_rng(11)
    rows = [(k, float(v)) for k, n in (("a", 700), (None, 61), ("b", 2), ("c", 1)) for v in rng.integers(-20, 40, n) / 3] + [("d", None)]
    t = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.05, 0.5, 0.99, 1.0)
    of = lambda k: np.array([v for key, v in rows if key == k and v is not None])
    got = {r.k: r["_q"] for r in stats.quantiles(t, ["k"], "v", shares).collect()}
    assert set(got) == {"a", None, "b", "c"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile(of(k), shares), rtol=1e-12, atol=1e-12)
    assert np.allclose(one(stats.quantiles(t, [], "v", shares))["_q"], np.quantile([v for _, v in rows if v is not None], shares))
    assert one(stats.quantiles(t.where("v IS NULL"), [], "v", [0.5]))["_q"] == [None]
    counts = t.where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("_c"))
    for r in stats.placed(counts, ["k"], "v", chunks=7).collect():
        assert r["_below"] == (of(r.k) < r.v).sum() and r["_n"] == len(of(r.k))
    assert {r.k: r.n for r in stats.summary(t, ["k"], "v").collect()} == {"a": 700, None: 61, "b": 2, "c": 1}


def test_boundary_as_by_neighbours(spark):
    rng = np.random.default_rng(12)
    p = {(f, int(x), int(y)) for f in range(3) for x, y in rng.integers(0, 12, (110, 2))}
    runs = masks.merged(spark.createDataFrame([(f, "a", x, y, 1) for f, x, y in p], "frame_idx long, object_id string, x long, y0 long, len long"))
    want = {(f, x, y) for f, x, y in p if not {(f, x + 1, y), (f, x - 1, y), (f, x, y + 1), (f, x, y - 1)} <= p}
    got = [(r.frame_idx, r.x, r.y) for r in masks.boundary(runs).collect()]
    assert len(got) == len(want) and set(got) == want


def test_square_mask(spark):
    runs = spark.createDataFrame([(0, "a", x, 5, 3) for x in (2, 3, 4)] + [(0, "a", 2, 6, 1)], "frame_idx long, object_id string, x long, y0 long, len long")
    m = masks.merged(runs)
    s = one(masks.shapes(m))
    assert (s.area, s.cx, s.cy) == (9.0, 3.0, 6.0)
    assert masks.boundary(m).count() == 8
    assert one(masks.large_components(m, least=1)).components == 1


def test_shapes_as_by_eigenvalues(spark):
    rng = np.random.default_rng(2)
    rows = [(f, "a", int(x), int(y), 1) for f in range(5) for x, y in rng.integers(0, 9, (20, 2))]
    got = {r.frame_idx: r for r in masks.shapes(masks.merged(spark.createDataFrame(rows, "frame_idx long, object_id string, x long, y0 long, len long"))).collect()}
    for f in range(5):
        p = np.array(sorted({(x, y) for g, _, x, y, _ in rows if g == f}), float)
        values = np.linalg.eigvalsh(np.cov(p.T, bias=True))
        assert math.isclose(got[f].major, math.sqrt(values[1]), rel_tol=1e-9) and math.isclose(got[f].minor, math.sqrt(values[0]), rel_tol=1e-6)


def test_transitions_and_loops(spark):
    t = spark.createDataFrame([(1, i, c) for i, c in enumerate("AABA")], "video_id long, start_frame long, cluster string")
    p = transitions.pairs(t, ["video_id"])
    got = {(r.from_label, r.to_label): (r.n, r.p) for r in transitions.matrix(p).collect()}
    assert got == {("A", "A"): (1, 0.5), ("A", "B"): (1, 0.5), ("B", "A"): (1, 1.0)}
    assert {r.p for r in transitions.matrix(p, loops=False).collect()} == {1.0}


def test_box_gap(spark):
    b = spark.createDataFrame([(0, "1", 0.0, 0.0, 0.1, 0.1), (0, "2", 0.2, 0.0, 0.1, 0.1)], "frame_idx long, object_id string, x double, y double, w double, h double")
    r = one(masks.box_pairs(b, 100, 100))
    assert math.isclose(r.gap_px, 10.0) and math.isclose(r.centre_px, 20.0) and r.pair == "1:2"


def test_a_second_object_that_comes_late_is_found(spark):
    t = spark.createDataFrame([(1, i, "a") for i in range(70)] + [(1, 65, "b"), (2, 0, "c"), (3, 9, "e"), (3, 9, "d"), (3, 9, "f")], "video long, frame_idx long, object_id string")
    got = {r.video: (r.object_a, r.object_b) for r in masks.object_pair(t, "video").collect()}
    assert got == {1: ("a", "b"), 2: ("c", ""), 3: ("d", "e")}


def test_tails():
    assert math.isclose(tails.fisher_p(3, 1, 1, 3), 34 / 70, rel_tol=1e-9)
    assert math.isclose(tails.t_p(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(tails.f_p(3.0, 2, 20), 0.07253815028640, rel_tol=1e-7)
    assert math.isclose(tails.rank_sum_exact_p(0, 3, 3), 0.1)
    assert math.isclose(tails.signed_rank_exact_p(0, 5), 0.0625)


def test_exact_rank_sum_for_small_samples(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "s string, v double").withColumn("k", F.lit(1))
    r = one(stats.mann_whitney(t, ["k"], "v", "s", "a", "b"))
    assert r.u == 0 and math.isclose(r.p, 0.1)


def test_swap_twice_changes_nothing(spark):
    t = spark.createDataFrame([(i, o, 10 * i + ord(o)) for i in range(9) for o in "abc"], "frame_idx long, object_id string, mark long")
    once = edits.swapped(t, "a", "b", 2, 6)
    assert not edits.same_rows(once, t) and edits.same_rows(edits.swapped(once, "a", "b", 2, 6), t)


def test_merging_a_project_with_itself_is_an_error(spark):
    t = spark.createDataFrame([(1, "x")], "video_id long, name string")
    with pytest.raises(ValueError):
        edits.merged_projects(t, t, "p", "p")


def test_frame_plans(spark):
    row = spark.range(1)
    plan = lambda s, n, k: one(row.select(report.sample_frames(F.lit(s).cast("long"), F.lit(n).cast("long"), F.lit(k).cast("long")).alias("p"))).p
    assert plan(0, 3500, 1000) == [0, 1000, 2000, 3000, 3499]
    assert plan(50, 0, 100) == []


def test_mask_quality_reasons(spark):
    t = spark.createDataFrame([(0, 1, 1), (2000, 50, 50), (6000, 100, 100)], "area long, bw long, bh long")
    got = [(r.reason, r.ok) for r in masks.quality(t, 10000, 100, 100).orderBy("area").collect()]
    assert got == [("empty_mask", False), ("ok", True), ("mask_covers_most_of_frame", False)]


def test_components_of_all_rows_as_by_union_find(spark, tmp_path):
    from driftmark.plans import catalog

    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), 1 + i % 7, float(i % 50)) for i, (a, b) in enumerate(zip(rng.integers(1, 400, 300), rng.integers(1, 500, 300)))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, *_ in rows:
        low, high = sorted((root(a), root(-1 - b)))
        up[high] = low
    got = {r.node: r.root for r in catalog.queries()["components"](spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_planted_communities_are_found(spark):
    rng = np.random.default_rng(3)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.5 if a // 20 == b // 20 else 0.02)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    for g in range(3):
        names = [got[i] for i in range(20 * g, 20 * g + 20)]
        assert max(names.count(c) for c in set(names)) >= 18
    assert len({max(set(x), key=x.count) for x in ([got[i] for i in range(20 * g, 20 * g + 20)] for g in range(3))}) == 3


def test_spectral_clusters_of_two_planted_groups(spark):
    rng = np.random.default_rng(13)
    edges = [(a, b, 1.0 if a // 20 == b // 20 else 0.01) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.7]
    got = {r.node: r.community for r in graph.spectral(spark.createDataFrame(edges, "src long, dst long, weight double"), k=2).collect()}
    first, second = ([got[i] for i in range(20 * g, 20 * g + 20)] for g in range(2))
    assert max(first.count(c) for c in set(first)) >= 18 and max(second.count(c) for c in set(second)) >= 18
    assert max(set(first), key=first.count) != max(set(second), key=second.count)


def test_hashed_neighbours_reach_the_exact_ones(spark):
    rng = np.random.default_rng(14)
    v = rng.uniform(0, 1, (400, 3))
    t = spark.createDataFrame([(i, *map(float, v[i])) for i in range(400)], "k long, x double, y double, z double")
    want = {(a, int(b)) for a in range(400) for b in np.argsort(((v - v[a]) ** 2).sum(1), kind="stable")[1:7]}
    exact = {(r.src, r.dst) for r in graph.nearest(t, "k", ["x", "y", "z"], 6).collect()}
    assert exact == want
    hashed = {(r.src, r.dst) for r in graph.nearest_hashed(t, "k", ["x", "y", "z"], 6, reach=0.6).collect()}
    assert len(want & hashed) >= 0.9 * len(want)


def test_modularity_as_by_its_sum_over_pairs(spark):
    rng = np.random.default_rng(15)
    w = np.triu(rng.integers(0, 3, (12, 12)), 1).astype(float)
    c = rng.integers(0, 3, 12)
    edges = spark.createDataFrame([(a, b, w[a, b].item()) for a in range(12) for b in range(a + 1, 12) if w[a, b]], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, int(c[i])) for i in range(12)], "node long, community int")
    w = w + w.T
    k, m = w.sum(1), w.sum()
    want = sum(w[a, b] / m - 1.5 * k[a] * k[b] / m**2 for a in range(12) for b in range(12) if c[a] == c[b])
    assert math.isclose(one(graph.modularity(edges, labels, resolution=1.5)).q, want, rel_tol=1e-9)


def test_components_of_variance_as_by_singular_values(spark):
    rng = np.random.default_rng(16)
    v = rng.normal(size=(80, 4)) @ np.diag([3.0, 1.0, 1.0, 0.2]) @ rng.normal(size=(4, 4))
    t = spark.createDataFrame([(i, *map(float, v[i])) for i in range(80)], "k long, p double, q double, r double, s double")
    got = batch.pca(t, ["k"], ["p", "q", "r", "s"]).orderBy("k").collect()
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    for name, axis in zip(("pc1", "pc2"), axes):
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        assert np.allclose([r[name] for r in got], z @ axis, atol=1e-8)


def test_coordinates_as_by_a_dense_eigensolver(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(90, 2))
    edges = sorted({(min(a, b), max(a, b)) for a in range(90) for b in np.argsort(((p - p[a]) ** 2).sum(1))[1:7].tolist()})
    w = np.zeros((90, 90))
    for a, b in edges:
        w[a, b] = w[b, a] = 1 + (a + b) % 3
    got = graph.coordinates(spark.createDataFrame([(a, b, float(w[a, b])) for a, b in edges], "src long, dst long, weight double")).orderBy("node").collect()
    k = w.sum(1)
    values, vectors = np.linalg.eigh(w / np.sqrt(np.outer(k, k)))
    for name, i in (("x", -2), ("y", -3)):
        mine, theirs = np.array([r[name] for r in got]), vectors[:, i] / np.sqrt(k)
        assert abs((k * mine * theirs).sum()) > 0.999


def test_combat_removes_batch_means(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"b{i % 2}", float(rng.normal() + (5 if i % 2 else 0)), float(rng.normal() * (3 if i % 2 else 1))) for i in range(200)]
    t = spark.createDataFrame(rows, "k long, batch string, x double, y double")
    fixed = batch.combat(t, ["k"], ["x", "y"], "batch")
    a, b = [r.m for r in fixed.groupBy("batch").agg(F.avg("x").alias("m")).orderBy("batch").collect()]
    assert abs(a - b) < 0.2
    eta = {r.feature: r.eta_squared for r in batch.effects(batch.long(t, ["k", "batch"], ["x", "y"]), "batch").collect()}
    assert 0 <= eta["y"] < 0.1 < eta["x"] <= 1


def test_permanova_of_all_rows(spark):
    rng = np.random.default_rng(8)
    v, g = rng.normal(size=(300, 2)), np.arange(300) % 3
    v[g == 1] += 1.0
    t = spark.createDataFrame([(i, f"b{g[i]}", float(v[i, 0]), float(v[i, 1])) for i in range(300)], "k long, batch string, x double, y double")
    r = one(batch.permanova(t, "k", ["x", "y"], "batch"))
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    r2 = sum((z[g == b].sum(0) ** 2).sum() / 100 for b in range(3)) / (z**2).sum()
    assert math.isclose(r.r2, r2, rel_tol=1e-9) and math.isclose(r.pseudo_f, (r2 / 2) / ((1 - r2) / 297), rel_tol=1e-9) and math.isclose(r.p, 1 / 500)
    mixed = t.withColumn("batch", F.concat(F.lit("b"), F.pmod(F.xxhash64("k"), F.lit(3))))
    assert one(batch.permanova(mixed, "k", ["x", "y"], "batch", permutations=99)).p > 0.02


def test_permutations_deal_every_label_as_often(spark):
    """Borders of hashes against sorting all of them, with one row for a label and many rows to a part."""
    n = 4000
    rows = spark.range(n).select(F.xxhash64("id").alias("h"))
    marks = batch._scrambled(np.arange(1, 20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = [1, 900, 901, 2500, 3999]
    h = np.array([r.h for r in rows.collect()], dtype=np.int64).view(np.uint64)
    for parts, few in ((32, 16), (2, 1), (8, 4000)):
        got = batch._borders(rows, ends, marks, parts, few)
        assert all(got[p].tolist() == np.sort(batch._scrambled(h ^ m))[np.array(ends) - 1].tolist() for p, m in enumerate(marks))
    one_label = spark.createDataFrame([(i, "b", float(i)) for i in range(5)], "k long, batch string, x double")
    assert one(batch.permanova(one_label, "k", ["x"], "batch")).p is None and one(batch.permanova(one_label, "k", ["x"], "batch")).pseudo_f is None


def test_what_is_not_finite_does_not_count(spark):
    t = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, None, float("nan"), float("inf"), float("-inf"))], "k string, v double")
    r = one(locomotion.snapshot(t, ["k"], "v"))
    assert (r.n, r.p50) == (3, 2.0) and math.isclose(r["mean"], 7 / 3)
    assert one(stats.quantiles(t, ["k"], "v", (0.0, 1.0)))["_q"] == [1.0, 4.0]


def test_two_modes(spark):
    rng = np.random.default_rng(5)
    rows = [("m", float(np.exp(v))) for v in np.concatenate([rng.normal(0, 0.3, 400), rng.normal(4, 0.3, 400)])]
    t = spark.createDataFrame(rows, "name string, v double")
    fit = one(mixtures.bimodal(t, "name", "v"))
    assert abs(np.log(fit.mean_low)) < 0.1 and abs(np.log(fit.mean_high) - 4) < 0.1 and abs(fit.weight_low - 0.5) < 0.05
    assert abs(one(mixtures.moving_share(t, mixtures.bimodal(t, "name", "v"), "name", "v")).moving - 0.5) < 0.05


def test_quad_to_square(spark):
    corners = [(20.0, 10.0), (120.0, 10.0), (120.0, 110.0), (20.0, 110.0)]
    a = registration.affine_of_corners([(F.lit(x), F.lit(y)) for x, y in corners], F.lit(100.0))
    got = one(spark.range(1).select((a[0] * 120 + a[1] * 110 + a[2]).alias("x"), (a[3] * 120 + a[4] * 110 + a[5]).alias("y")))
    assert math.isclose(got.x, 99) and math.isclose(got.y, 99)


def test_missing_values_never_become_nan(spark):
    t = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r.v for r in t.select(scalars.finite(F.col("v")).alias("v")).collect()] == [None, None, 1.0]


def test_few_frames_give_null_features(spark):
    t = spark.createDataFrame([(1, i, 1.0 if i < 2 else None, 1.0 if i < 2 else None, 5.0, 0.0, 0.1) for i in range(30)], "v long, frame_idx long, cx double, cy double, area double, orientation double, eccentricity double")
    r = one(features.object_features(t, ["v"], 30, 10))
    assert all(r[c] is None for c in features.OBJECT_FEATURES)


def test_constant_ranks_have_no_correlation(spark):
    """a division by 0 before."""
    t = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("d", 1.0, 3.0), ("d", 2.0, 1.0), ("d", 3.0, 0.0), ("e", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.n, r.rho) for r in stats.spearman(t, ["k"], "x", "y").collect()}
    assert got["c"][0] == 2 and math.isnan(got["c"][1])
    assert got["d"] == (3, pytest.approx(-1.0)) and got["e"] == (1, None)
    s = one(stats.summary(stats.spearman(t, ["k"], "x", "y"), [], "rho", nan=True))
    assert s.n == 2 and s.min == pytest.approx(-1.0) and math.isnan(s["mean"]) and math.isnan(s.max)
    assert one(stats.summary(stats.spearman(t, ["k"], "x", "y"), [], "rho")).n == 1


def test_shares_of_frames_are_decimal(spark):
    """0.7 times 90 was 62 in doubles, rounded down."""
    t = spark.range(90).select(F.lit(1).alias("v"), F.col("id").alias("frame_idx"))
    got = {r.split: r.n for r in report.split_frames(t, ["v"], 0.7, 5).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 63, "gap": 5, "eval": 22}
