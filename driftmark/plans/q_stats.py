"""Queries on summaries, tests, scaling and batch effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import batch, stats
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import _r, r6

COLUMNS = views.FEATURE_COLUMNS


def _long(spark, d):
    return batch.long(views.features(spark, d), ["vec_id", "batch", "group"], COLUMNS)


@register("numeric_summary", f"""WITH {views.LABELLED} SELECT batch, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25,
round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS min, max(value) AS max FROM labelled GROUP BY 1""")
def numeric_summary(spark, d):
    return r6(stats.summary(views.labelled(spark, d), ["batch"], "value"))


@register("average_ranks", f"WITH {views.LABELLED} SELECT doc_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank FROM labelled")
def average_ranks(spark, d):
    return stats.average_ranks(views.labelled(spark, d), [], "value").select("doc_id", "rank")


def _erfc(x):
    t = f"(1 / (1 + abs({x}) / 2))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {c})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


RANKED = """, r AS (SELECT feature, side, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY feature, value) AS ties FROM t),
u AS (SELECT feature, count(*) FILTER (side = 'g0') AS n_a, count(*) FILTER (side = 'g1') AS n_b, sum(rank) FILTER (side = 'g0') AS s, sum(ties * ties - 1.0) AS tie FROM r GROUP BY 1),
z AS (SELECT *, s - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM u),
q AS (SELECT *, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM z)"""


@register("mann_whitney", f"""WITH {views.LONG}, t AS (SELECT feature, "group" AS side, value FROM long){RANKED}
SELECT feature, n_a, n_b, u, round(z, 6) AS z, round(least(1, {_erfc("z / sqrt(2)")}), 6) AS p FROM q""")
def mann_whitney(spark, d):
    return _r(stats.mann_whitney(_long(spark, d), ["feature"], "value", "group", "g0", "g1"), z=6, p=6)


@register("mann_whitney_ties", f"""WITH {views.LABELLED}, t AS (SELECT batch AS feature, CASE WHEN side = 0 THEN 'g0' ELSE 'g1' END AS side, floor(value / 500) AS value FROM labelled){RANKED}
SELECT feature, n_a, n_b, u, round(z, 6) AS z, round(least(1, {_erfc("z / sqrt(2)")}), 6) AS p FROM q WHERE n_a > 0 AND n_b > 0""")
def mann_whitney_ties(spark, d):
    t = views.labelled(spark, d).select(F.col("batch").alias("feature"), F.when(F.col("side") == 0, "g0").otherwise("g1").alias("side"), F.floor(F.col("value") / 500).alias("value"))
    return _r(stats.mann_whitney(t, ["feature"], "value", "side", "g0", "g1", exact=0), z=6, p=6)


@register("signed_rank", f"""WITH {views.FEATURES}, t AS (SELECT batch, round(f0 - f1, 2) AS d FROM features), k AS (SELECT * FROM t WHERE d <> 0),
r AS (SELECT batch, d, rank() OVER (PARTITION BY batch ORDER BY abs(d)) + (count(*) OVER (PARTITION BY batch, abs(d)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY batch, abs(d)) AS ties FROM k),
s AS (SELECT batch, count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS plus, sum(ties * ties - 1.0) AS tie FROM r GROUP BY 1 HAVING count(*) >= 3)
SELECT batch, n, least(plus, n * (n + 1) / 2 - plus) AS w, round(abs(plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z,
round(least(1, {_erfc("abs(plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) / sqrt(2)")}), 6) AS p FROM s""")
def signed_rank(spark, d):
    t = views.features(spark, d).select("batch", F.round(F.col("f0") - F.col("f1"), 2).alias("x"), F.lit(0.0).alias("y"))
    return _r(stats.signed_rank(t, ["batch"], "x", "y", exact=0), z=6, p=6)


@register("fisher", f"""WITH {views.ETHOGRAM}, c AS (SELECT cluster, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS c, max(ta) AS ta, max(tc) AS tc FROM (SELECT cluster, "group" = 'g0' AS g, count(*) FILTER ("group" = 'g0') OVER () AS ta, count(*) FILTER ("group" <> 'g0') OVER () AS tc FROM ethogram) GROUP BY 1),
t AS (SELECT cluster, a, ta - a AS b, c, tc - c AS d FROM c),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x, a + b AS rw, a + c AS cl, a + b + c + d AS n FROM t),
l AS (SELECT cluster, a, b, c, d, x, lgamma(rw + 1) - lgamma(x + 1) - lgamma(rw - x + 1) + lgamma(n - rw + 1) - lgamma(cl - x + 1) - lgamma(n - rw - cl + x + 1) + lgamma(cl + 1) + lgamma(n - cl + 1) - lgamma(n + 1) AS lp FROM x),
o AS (SELECT cluster, lp AS own FROM l WHERE x = a)
SELECT l.cluster, a, b, c, d, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS odds_ratio, round(least(1, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM l JOIN o ON l.cluster = o.cluster GROUP BY ALL""")
def fisher(spark, d):
    e = views.ethogram(spark, d)
    labels = e.select(F.col("cluster").alias("key")).distinct()
    crossed = e.join(F.broadcast(labels))  # of a handful of labels
    counts = stats.two_by_two(crossed, ["key"], F.col("group") == "g0", F.col("cluster") == F.col("key"))
    return r6(stats.fisher(counts).withColumnRenamed("key", "cluster"))


@register("enrichment", f"""WITH {views.LONG}, m AS (SELECT feature, median(value) AS median FROM long GROUP BY 1),
s AS (SELECT l.feature, any_value(median) AS median, count(*) FILTER ("group" = 'g0') AS n_a, count(*) FILTER ("group" = 'g1') AS n_b, avg(value) FILTER ("group" = 'g0') AS mean_a, avg(value) FILTER ("group" = 'g1') AS mean_b,
    var_samp(value) FILTER ("group" = 'g0') AS va, var_samp(value) FILTER ("group" = 'g1') AS vb, count(*) FILTER ("group" = 'g0' AND value > median) AS a, count(*) FILTER ("group" = 'g0' AND value <= median) AS b,
    count(*) FILTER ("group" = 'g1' AND value > median) AS c, count(*) FILTER ("group" = 'g1' AND value <= median) AS d FROM long l JOIN m ON l.feature = m.feature GROUP BY 1),
k AS (SELECT *, abs(least(mean_a, mean_b, median)) + 1 AS shift FROM s),
x AS (SELECT feature, a, a + b AS rw, a + c AS cl, a + b + c + d AS n, unnest(range(greatest(0, a - d), a + least(b, c) + 1)) AS x FROM s),
y AS (SELECT feature, x = a AS seen, lgamma(rw + 1) - lgamma(x + 1) - lgamma(rw - x + 1) + lgamma(n - rw + 1) - lgamma(cl - x + 1) - lgamma(n - rw - cl + x + 1) + lgamma(cl + 1) + lgamma(n - cl + 1) - lgamma(n + 1) AS lp FROM x),
p AS (SELECT feature, least(1, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)) AS fisher_p FROM (SELECT *, max(CASE WHEN seen THEN lp END) OVER (PARTITION BY feature) AS own FROM y) GROUP BY 1)
SELECT k.feature, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(median, 6) AS median, round((mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS cohens_d,
round(log2((mean_a + shift) / (mean_b + shift)), 6) AS log2_fold, CASE WHEN mean_a > mean_b THEN 'up' ELSE 'down' END AS direction, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS odds_ratio, round(fisher_p, 6) AS fisher_p FROM k JOIN p ON k.feature = p.feature""")
def enrichment(spark, d):
    return r6(stats.enrichment(_long(spark, d), ["feature"], "value", "group", "g0", "g1"))


@register("top_effects", f"""WITH {views.LONG}, s AS (SELECT feature, count(*) FILTER ("group" = 'g0') AS n_a, count(*) FILTER ("group" = 'g1') AS n_b, avg(value) FILTER ("group" = 'g0') - avg(value) FILTER ("group" = 'g1') AS d, var_samp(value) FILTER ("group" = 'g0') AS va, var_samp(value) FILTER ("group" = 'g1') AS vb FROM long GROUP BY 1)
SELECT feature, round(d / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS cohens_d FROM s ORDER BY abs(cohens_d) DESC, feature LIMIT 3""")
def top_effects(spark, d):
    out = stats.enrichment(_long(spark, d), ["feature"], "value", "group", "g0", "g1").select("feature", "cohens_d")
    return r6(out).orderBy(F.desc(F.abs("cohens_d")), "feature").limit(3)


@register("welch", f"""WITH {views.LONG}, s AS (SELECT feature, count(*) FILTER ("group" = 'g0') AS n_a, count(*) FILTER ("group" = 'g1') AS n_b, avg(value) FILTER ("group" = 'g0') AS ma, avg(value) FILTER ("group" = 'g1') AS mb, var_samp(value) FILTER ("group" = 'g0') AS va, var_samp(value) FILTER ("group" = 'g1') AS vb FROM long GROUP BY 1),
k AS (SELECT *, va / n_a AS sa, vb / n_b AS sb FROM s) SELECT feature, n_a, n_b, round((ma - mb) / sqrt(sa + sb), 6) AS t, round((sa + sb) ** 2 / (sa ** 2 / (n_a - 1) + sb ** 2 / (n_b - 1)), 6) AS df FROM k""")
def welch(spark, d):
    return r6(stats.welch(_long(spark, d), ["feature"], "value", "group", "g0", "g1").drop("p"))


@register("spearman", f"""WITH {views.FEATURES}, r AS (SELECT batch, rank() OVER (PARTITION BY batch ORDER BY f0) + (count(*) OVER (PARTITION BY batch, f0) - 1) / 2 AS a, rank() OVER (PARTITION BY batch ORDER BY f1) + (count(*) OVER (PARTITION BY batch, f1) - 1) / 2 AS b FROM features)
SELECT batch, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    return r6(stats.spearman(views.features(spark, d), ["batch"], "f0", "f1"))


@register("histogram", f"""WITH {views.LABELLED}, e AS (SELECT batch, min(value) AS lo, max(value) AS hi, count(*) AS n FROM labelled GROUP BY 1),
b AS (SELECT l.batch, CAST(CASE WHEN hi > lo THEN least(19, floor((value - lo) / ((hi - lo) / 20))) ELSE 0 END AS INT) AS bin, lo, (hi - lo) / 20 AS w, e.n AS total FROM labelled l JOIN e ON l.batch = e.batch)
SELECT batch, bin, round(lo + bin * w, 6) AS edge, count(*) AS n, round(count(*) / nullif(total * w, 0), 9) AS density FROM b GROUP BY batch, bin, lo, w, total""")
def histogram(spark, d):
    return _r(stats.histogram(views.labelled(spark, d), ["batch"], "value", 20), edge=6, density=9)


@register("ecdf", f"WITH {views.LABELLED} SELECT DISTINCT batch, value, round(cume_dist() OVER (PARTITION BY batch ORDER BY value), 6) AS share FROM labelled")
def ecdf(spark, d):
    return r6(stats.ecdf(views.labelled(spark, d), ["batch"], "value"))


@register("box_stats", f"""WITH {views.LABELLED}, q AS (SELECT batch, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM labelled GROUP BY 1)
SELECT l.batch, q1, median, q3, min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_low, max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers, count(*) AS n FROM labelled l JOIN q ON l.batch = q.batch GROUP BY l.batch, q1, median, q3""")
def box_stats(spark, d):
    return stats.box_stats(views.labelled(spark, d), ["batch"], "value")


@register("clipped", f"WITH {views.LABELLED}, q AS (SELECT quantile_cont(value, 0.99) AS l FROM labelled) SELECT round(l, 6) AS \"limit\", count(*) FILTER (value <= l) AS kept, count(*) FILTER (value > l) AS clipped FROM labelled, q GROUP BY l")
def clipped(spark, d):
    return r6(stats.clipped(views.labelled(spark, d), "value"))


GAPS = ", ".join(f"CASE WHEN vec_id % {i + 5} = 0 THEN NULL ELSE f{i} END AS f{i}" for i in range(8))


@register("impute_median", f"WITH {views.FEATURES}, g AS (SELECT vec_id, {GAPS} FROM features), m AS (SELECT " + ", ".join(f"median(f{i}) AS m{i}" for i in range(8)) + " FROM g) SELECT vec_id, " + ", ".join(f"round(coalesce(f{i}, m{i}), 6) AS f{i}" for i in range(8)) + " FROM g, m")
def impute_median(spark, d):
    f = views.features(spark, d)
    gaps = f.select("vec_id", *[F.when(F.col("vec_id") % (i + 5) == 0, None).otherwise(F.col(f"f{i}")).alias(f"f{i}") for i in range(8)])
    return r6(batch.impute_median(gaps, COLUMNS))


@register("zscore", f"WITH {views.FEATURES} SELECT vec_id, " + ", ".join(f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 6) AS f{i}" for i in range(8)) + " FROM features")
def zscore(spark, d):
    return r6(batch.zscore(views.features(spark, d).drop("batch", "group"), COLUMNS))


@register("robust_scale", f"WITH {views.FEATURES}, q AS (SELECT " + ", ".join(f"median(f{i}) AS m{i}, quantile_cont(f{i}, 0.75) - quantile_cont(f{i}, 0.25) AS r{i}" for i in range(8)) + " FROM features) SELECT vec_id, " + ", ".join(f"round((f{i} - m{i}) / r{i}, 6) AS f{i}" for i in range(8)) + " FROM features, q")
def robust_scale(spark, d):
    return r6(batch.robust(views.features(spark, d).drop("batch", "group"), COLUMNS))


@register("minmax_scale", f"WITH {views.FEATURES} SELECT vec_id, " + ", ".join(f"round((f{i} - min(f{i}) OVER ()) / (max(f{i}) OVER () - min(f{i}) OVER ()), 6) AS f{i}" for i in range(8)) + " FROM features")
def minmax_scale(spark, d):
    return r6(batch.minmax(views.features(spark, d).drop("batch", "group"), COLUMNS))


@register("zscore_by_batch", f"WITH {views.FEATURES}, b AS (SELECT vec_id, " + ", ".join(f"(f{i} - avg(f{i}) OVER (PARTITION BY batch)) / stddev_pop(f{i}) OVER (PARTITION BY batch) AS f{i}" for i in range(8)) + " FROM features) SELECT vec_id, " + ", ".join(f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 5) AS f{i}" for i in range(8)) + " FROM b")
def zscore_by_batch(spark, d):
    return _r(batch.zscore_by_batch(views.features(spark, d).drop("group"), COLUMNS, "batch").drop("batch"), **{c: 5 for c in COLUMNS})


EFFECTS = views.LONG + """,
b AS (SELECT feature, batch, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM long GROUP BY 1, 2),
e AS (SELECT feature, sum(n) AS n, sum(ss) - sum(s) ** 2 / sum(n) AS sst, sum(CASE WHEN n >= 2 THEN n * (s / n - mean) ** 2 END) AS ssb, count(CASE WHEN n >= 2 THEN 1 END) AS groups, sum(CASE WHEN n >= 2 THEN n END) AS m
    FROM (SELECT *, sum(s) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS mean FROM b) GROUP BY 1)"""


@register("batch_effects", f"WITH {EFFECTS} SELECT feature, CAST(n AS BIGINT) AS n, groups, round(least(1, ssb / sst), 6) AS eta_squared, round((ssb / (groups - 1)) / ((sst - ssb) / (m - groups)), 5) AS f FROM e")
def batch_effects(spark, d):
    return _r(batch.effects(_long(spark, d), "batch").drop("p"), eta_squared=6, f=5)


@register("largest_effects", f"WITH {EFFECTS} SELECT feature, round(least(1, ssb / sst), 6) AS eta_squared, place FROM (SELECT *, row_number() OVER (ORDER BY round(least(1, ssb / sst), 9) DESC, feature) AS place FROM e) WHERE place <= 5")
def largest_effects(spark, d):
    """The five of eight features whose variance the batches explain best."""
    shares = batch.effects(_long(spark, d), "batch").withColumn("eta_squared", F.round("eta_squared", 9))
    return _r(batch.largest_effects(shares, 5).select("feature", "eta_squared", "place"), eta_squared=6)


@register("effect_summary", f"WITH {EFFECTS}, x AS (SELECT ssb / sst AS v FROM e) SELECT count(*) AS features, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, count(*) FILTER (v > 0.1) AS above_10, count(*) FILTER (v > 0.25) AS above_25 FROM x")
def effect_summary(spark, d):
    return r6(batch.effect_summary(batch.effects(_long(spark, d), "batch")))


@register("batch_centroids", f"WITH {views.FEATURES}, z AS (SELECT batch, " + ", ".join(f"(f{i} - avg(f{i}) OVER ()) / stddev_samp(f{i}) OVER () AS f{i}" for i in range(8)) + " FROM features) SELECT batch, count(*) AS n, " + ", ".join(f"round(avg(f{i}), 6) AS f{i}" for i in range(8)) + " FROM z GROUP BY 1")
def batch_centroids(spark, d):
    return r6(batch.batch_centroids(views.features(spark, d).drop("vec_id", "group"), COLUMNS, "batch"))


@register("batch_crosstab", f"WITH {views.FEATURES} SELECT batch, count(*) FILTER (\"group\" = 'g0') AS g0, count(*) FILTER (\"group\" = 'g1') AS g1 FROM features GROUP BY 1")
def batch_crosstab(spark, d):
    return views.features(spark, d).groupBy("batch").pivot("group", ["g0", "g1"]).agg(F.count(F.lit(1))).na.fill(0)


@register("combat")
def combat(spark, d):
    return _r(batch.combat(views.features(spark, d), ["vec_id"], COLUMNS, "batch"), **{c: 4 for c in COLUMNS})


@register("combat_effects")
def combat_effects(spark, d):
    f = views.features(spark, d)
    fixed = batch.combat(f, ["vec_id"], COLUMNS, "batch")
    return r6(batch.effect_change(batch.effects(_long(spark, d), "batch"), batch.effects(batch.long(fixed, ["vec_id", "batch"], COLUMNS), "batch")))


@register("pca")
def pca(spark, d):
    return _r(batch.pca(views.features(spark, d), ["vec_id"], COLUMNS), pc1=4, pc2=4)


@register("stratified_sample", f"""WITH {views.FEATURES}, r AS (SELECT vec_id, batch, md5(CAST(vec_id AS VARCHAR) || ':42') AS mark, row_number() OVER (PARTITION BY batch ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) AS r FROM features)
SELECT vec_id, batch FROM r WHERE r <= greatest(2, 200 // (SELECT count(DISTINCT batch) FROM features)) ORDER BY mark, vec_id LIMIT 200""")
def stratified_sample(spark, d):
    return batch.stratified(views.features(spark, d), "vec_id", "batch", 200).select("vec_id", "batch")


@register("permanova")
def permanova(spark, d):
    return r6(batch.permanova(views.features(spark, d), "vec_id", COLUMNS, "batch"))
