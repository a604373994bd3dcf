"""Queries that compare groups of windows, labels and animals."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import batch, compare, report
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_stats import _erfc, _long
from driftmark.plans.q_tracks import _r, r6

COLUMNS = views.FEATURE_COLUMNS


def fisher_sql(table: str, keys: str, out: str) -> str:
    """CTEs that end with `out`: keys and p of the 2 x 2 counts a, b, c, d of a table."""
    return f"""
{out}_x AS (SELECT {keys}, a, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS x, a + b AS rw, a + c AS cl, a + b + c + d AS n FROM {table}),
{out}_l AS (SELECT {keys}, a, x, lgamma(rw + 1) - lgamma(x + 1) - lgamma(rw - x + 1) + lgamma(n - rw + 1) - lgamma(cl - x + 1) - lgamma(n - rw - cl + x + 1) + lgamma(cl + 1) + lgamma(n - cl + 1) - lgamma(n + 1) AS lp FROM {out}_x),
{out}_o AS (SELECT *, max(CASE WHEN x = a THEN lp END) OVER (PARTITION BY {keys}) AS own FROM {out}_l),
{out} AS (SELECT {keys}, least(1, sum(CASE WHEN lp <= own + 1e-7 THEN exp(lp) ELSE 0 END)) AS p FROM {out}_o GROUP BY ALL)"""


def tests_sql(table: str, keys: str, medians: str) -> str:
    """SQL of all tests of sides a and b by keys and feature; medians has feature, median."""
    on = lambda x: " AND ".join(f"s.{k.strip()} = {x}.{k.strip()}" for k in keys.split(","))
    return f"""
s AS (SELECT {keys.replace("feature", "t.feature")}, any_value(median) AS median, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, avg(value) FILTER (side = 'a') AS mean_a, avg(value) FILTER (side = 'b') AS mean_b, stddev_samp(value) FILTER (side = 'a') AS sd_a, stddev_samp(value) FILTER (side = 'b') AS sd_b,
    count(*) FILTER (side = 'a' AND value > median) AS a, count(*) FILTER (side = 'a' AND value <= median) AS b, count(*) FILTER (side = 'b' AND value > median) AS c, count(*) FILTER (side = 'b' AND value <= median) AS d FROM {table} t JOIN {medians} m ON t.feature = m.feature GROUP BY ALL),
{fisher_sql("s", keys, "fp")},
r AS (SELECT {keys}, side, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY {keys}, value) AS ties FROM {table}),
u AS (SELECT {keys}, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, sum(rank) FILTER (side = 'a') AS rs, sum(ties * ties - 1.0) AS tie FROM r GROUP BY ALL),
z AS (SELECT *, rs - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM u),
q AS (SELECT *, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM z)
SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, s.n_a, s.n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(median, 6) AS median, round(sd_a, 6) AS sd_a, round(sd_b, 6) AS sd_b,
    round((mean_a - mean_b) / sqrt(((s.n_a - 1) * sd_a ** 2 + (s.n_b - 1) * sd_b ** 2) / (s.n_a + s.n_b - 2)), 6) AS cohens_d,
    round(log2((mean_a + abs(least(mean_a, mean_b, median)) + 1) / (mean_b + abs(least(mean_a, mean_b, median)) + 1)), 6) AS log2_fold, CASE WHEN mean_a > mean_b THEN 'up' WHEN mean_a < mean_b THEN 'down' ELSE 'same' END AS direction,
    round(CASE WHEN b * c > 0 THEN CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c) END, 6) AS odds_ratio, round(fp.p, 6) AS fisher_p, u, round(least(1, {_erfc("q.z / sqrt(2)")}), 6) AS p
FROM s JOIN fp ON {on("fp")} JOIN q ON {on("q")}"""


@register("feature_tests", f"WITH {views.LONG}, t AS (SELECT feature, CASE WHEN \"group\" = 'g0' THEN 'a' ELSE 'b' END AS side, value FROM long), med AS (SELECT feature, median(value) AS median FROM long GROUP BY 1), {tests_sql('t', 'feature', 'med')}")
def feature_tests(spark, d):
    return r6(compare.features(_long(spark, d), [], "feature", "value", "group", "g0", "g1"))


@register("feature_pairs", f"""WITH {views.LONG}, med AS (SELECT feature, median(value) AS median FROM long GROUP BY 1), g AS (SELECT DISTINCT batch FROM long), w AS (SELECT x.batch AS group_a, y.batch AS group_b FROM g x JOIN g y ON x.batch < y.batch),
t AS (SELECT group_a, group_b, feature, CASE WHEN batch = group_a THEN 'a' ELSE 'b' END AS side, value FROM long JOIN w ON batch = group_a OR batch = group_b), k AS (WITH {tests_sql('t', 'group_a, group_b, feature', 'med').lstrip()})
SELECT *, CAST(NULL AS VARCHAR) AS note FROM k""")
def feature_pairs(spark, d):
    """Of all pairs of batches; their SQL takes batches of nine rows or more for granted, as they have here."""
    return r6(compare.feature_pairs(_long(spark, d), "feature", "value", "batch"))


@register("label_pairs", f"""WITH {views.ETHOGRAM}, c AS (SELECT "group" AS g, cluster, count(*) AS n FROM ethogram GROUP BY ALL), n AS (SELECT g, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1), l AS (SELECT DISTINCT cluster FROM c),
t AS (SELECT x.g AS group_a, y.g AS group_b, l.cluster, x.total AS n_a, y.total AS n_b, coalesce(ca.n, 0) AS a, coalesce(cb.n, 0) AS b, x.total - coalesce(ca.n, 0) AS c, y.total - coalesce(cb.n, 0) AS d FROM n x JOIN n y ON x.g < y.g CROSS JOIN l
    LEFT JOIN c ca ON ca.g = x.g AND ca.cluster = l.cluster LEFT JOIN c cb ON cb.g = y.g AND cb.cluster = l.cluster), {fisher_sql('t', 'group_a, group_b, cluster', 'fp')}
SELECT t.group_a, t.group_b, t.cluster, n_a, n_b, a AS a_in, b AS b_in, round(a / n_a, 6) AS a_share, round(b / n_b, 6) AS b_share, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS odds_ratio, round(p, 6) AS p, CAST(NULL AS VARCHAR) AS note FROM t JOIN fp USING (group_a, group_b, cluster)""")
def label_pairs(spark, d):
    return r6(compare.label_pairs(views.ethogram(spark, d), "group"))


#: Windows of two animals: conditions by the user's id, a third kind unknown.
WINDOWS = views.ETHOGRAM + """,
kinds AS (SELECT *, CASE WHEN video_id % 5 = 0 THEN 'isolated' WHEN video_id % 11 = 0 THEN 'unknown' ELSE 'group-housed' END AS a, CASE WHEN video_id % 3 = 0 THEN 'isolated' ELSE 'group-housed' END AS b FROM ethogram),
windows AS (SELECT *, least(a, b) || '_' || greatest(a, b) AS kind FROM kinds)"""


def _windows(spark, d):
    v = F.col("video_id")
    w = views.ethogram(spark, d).withColumn("a", F.when(v % 5 == 0, "isolated").when(v % 11 == 0, "unknown").otherwise("group-housed")).withColumn("b", F.when(v % 3 == 0, "isolated").otherwise("group-housed"))
    return w.withColumn("kind", F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b")))


@register("housing_labels", f"""WITH {WINDOWS}, m AS (SELECT cluster, kind NOT LIKE '%unknown%' AS ok, a = 'isolated' OR b = 'isolated' AS iso FROM windows), k AS (SELECT cluster, count(*) AS size, count(*) FILTER (ok AND iso) AS a, count(*) FILTER (ok AND NOT iso) AS b FROM m GROUP BY 1),
t AS (SELECT *, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d, size / sum(size) OVER () AS share FROM k), {fisher_sql('t', 'cluster', 'fp')}
SELECT t.cluster, size, round(share, 6) AS share, a AS isolated_in, b AS group_in, c AS isolated_out, d AS group_out, round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS odds_ratio, round(p, 6) AS p FROM t JOIN fp USING (cluster)""")
def housing_labels(spark, d):
    return r6(compare.housing_labels(_windows(spark, d), "a", "b", "kind"))


@register("condition_counts", f"WITH {WINDOWS}, u AS (SELECT cluster, a AS condition FROM windows UNION ALL SELECT cluster, b FROM windows), c AS (SELECT cluster, condition, count(*) AS n FROM u GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS share FROM c")
def condition_counts(spark, d):
    return r6(compare.condition_counts(_windows(spark, d), "a", "b"))


@register("first_two_kinds", f"""WITH {WINDOWS}, k AS (SELECT DISTINCT kind FROM windows WHERE kind NOT LIKE '%unknown%' ORDER BY kind LIMIT 2), t AS (SELECT 'value' AS feature, CASE WHEN kind = (SELECT min(kind) FROM k) THEN 'a' ELSE 'b' END AS side, value FROM windows WHERE kind IN (SELECT kind FROM k)),
med AS (SELECT 'value' AS feature, median(value) AS median FROM windows), o AS (WITH {tests_sql('t', 'feature', 'med').lstrip()}) SELECT *, (SELECT min(kind) FROM k) AS kind_a, (SELECT max(kind) FROM k) AS kind_b FROM o""")
def first_two_kinds(spark, d):
    return r6(compare.first_two_kinds(_windows(spark, d).withColumn("feature", F.lit("value")), "kind", "feature", "value"))


@register("label_description", f"WITH {WINDOWS}, c AS (SELECT cluster, kind, count(*) AS n FROM windows GROUP BY ALL) SELECT cluster, CAST(sum(n) AS BIGINT) AS size, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM c GROUP BY 1")
def label_description(spark, d):
    out = compare.describe(_windows(spark, d), "kind")
    said = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return r6(out.withColumn("kinds", said))


MEANS = views.FEATURES + """,
alone AS (SELECT vec_id % 60 AS mouse, """ + ", ".join(f"avg(f{i}) AS f{i}" for i in range(8)) + """ FROM features WHERE "group" = 'g0' GROUP BY 1),
paired AS (SELECT vec_id % 60 - 1 AS mouse, """ + ", ".join(f"avg(f{i}) AS f{i}" for i in range(8)) + " FROM features WHERE \"group\" = 'g1' GROUP BY 1),\nla AS (" + " UNION ALL ".join(f"SELECT mouse, 'f{i}' AS feature, f{i} AS value FROM alone" for i in range(8)) + "),\nlp AS (" + " UNION ALL ".join(f"SELECT mouse, 'f{i}' AS feature, f{i} AS value FROM paired" for i in range(8)) + ")"


def _means(spark, d):
    f = views.features(spark, d)
    side = lambda g, k: compare.animal_means(f.where(F.col("group") == g).withColumn("mouse", F.col("vec_id") % 60 - k), ["mouse"], COLUMNS)
    return side("g0", 0), side("g1", 1)


@register("animal_means", f"WITH {MEANS} SELECT mouse, " + ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(8)) + " FROM alone")
def animal_means(spark, d):
    return r6(_means(spark, d)[0])


@register("alone_against_paired", f"""WITH {MEANS}, j AS (SELECT mouse, la.feature, la.value AS x, lp.value AS y FROM la JOIN lp USING (mouse, feature)), t AS (SELECT feature, 'a' AS side, x AS value FROM j UNION ALL SELECT feature, 'b', y FROM j),
m AS (SELECT feature, count(*) AS n, avg(x) AS mean_alone, avg(y) AS mean_paired FROM j GROUP BY 1), e AS (SELECT feature, x - y AS d, rank() OVER (PARTITION BY feature ORDER BY abs(x - y)) AS r FROM j), w AS (SELECT feature, count(*) AS k, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus FROM e GROUP BY 1),
r AS (SELECT feature, side, rank() OVER (PARTITION BY feature ORDER BY value) AS rank FROM t), u AS (SELECT feature, sum(rank) FILTER (side = 'a') AS rs, count(*) FILTER (side = 'a') AS n_a FROM r GROUP BY 1)
SELECT m.feature, n, round(mean_alone, 6) AS mean_alone, round(mean_paired, 6) AS mean_paired, round(mean_paired - mean_alone, 6) AS diff, CAST(least(plus, k * (k + 1) / 2 - plus) AS DOUBLE) AS w, CAST(rs - n_a * (n_a + 1) / 2 AS DOUBLE) AS u FROM m JOIN w USING (feature) JOIN u USING (feature)""")
def alone_against_paired(spark, d):
    alone, paired = (batch.long(x, ["mouse"], COLUMNS) for x in _means(spark, d))
    return r6(compare.alone_against_paired(alone, paired, "mouse").drop("w_p", "u_p").withColumn("w", F.col("w").cast("double")).withColumn("u", F.col("u").cast("double")))


@register("alone_by_housing", f"""WITH {MEANS}, t AS (SELECT feature, CASE WHEN mouse % 4 = 0 THEN 'a' ELSE 'b' END AS side, value FROM la), r AS (SELECT feature, side, value, rank() OVER (PARTITION BY feature ORDER BY value) AS rank FROM t)
SELECT feature, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, round(avg(value) FILTER (side = 'a'), 6) AS mean_a, round(avg(value) FILTER (side = 'b'), 6) AS mean_b, CAST(sum(rank) FILTER (side = 'a') - count(*) FILTER (side = 'a') * (count(*) FILTER (side = 'a') + 1) / 2 AS DOUBLE) AS u FROM r GROUP BY 1""")
def alone_by_housing(spark, d):
    alone = batch.long(_means(spark, d)[0], ["mouse"], COLUMNS).withColumn("housing", F.when(F.col("mouse") % 4 == 0, "SH").otherwise("GH"))
    return r6(compare.alone_by_housing(alone, "housing").drop("z", "p").withColumn("u", F.col("u").cast("double")))


@register("tests_by_p", f"WITH {views.LONG}, t AS (SELECT feature, CASE WHEN \"group\" = 'g0' THEN 'a' ELSE 'b' END AS side, value FROM long), med AS (SELECT feature, median(value) AS median FROM long GROUP BY 1), o AS (WITH {tests_sql('t', 'feature', 'med').lstrip()}) SELECT feature, row_number() OVER (ORDER BY p NULLS LAST, feature) AS place FROM o")
def tests_by_p(spark, d):
    tests = feature_tests(spark, d)
    return compare.by_p(tests, ties=["feature"]).select("feature", F.col("place").cast("long").alias("place"))


@register("run_summary", f"""WITH {views.ETHOGRAM}, c AS (SELECT cluster, count(*) AS n FROM ethogram GROUP BY 1), g AS (SELECT "group" AS g, count(*) AS n FROM ethogram GROUP BY 1), s AS (SELECT lead(cluster) OVER (PARTITION BY video_id ORDER BY start_frame) AS t FROM ethogram)
SELECT (SELECT count(*) FROM ethogram) AS n_windows, (SELECT count(*) FROM c) AS n_cluster, (SELECT string_agg(cluster || ':' || n, ',' ORDER BY cluster) FROM c) AS cluster_sizes, (SELECT count(*) FROM g) AS n_group, (SELECT string_agg(g || ':' || n, ',' ORDER BY g) FROM g) AS group_sizes, (SELECT count(t) FROM s) AS n_transitions, (SELECT count(*) * (count(*) - 1) // 2 FROM g) AS n_pairs""")
def run_summary(spark, d):
    return compare.run_summary(views.ethogram(spark, d), "group")


@register("name_order", "SELECT n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_name) AS place FROM nation")
def name_order(spark, d):
    return compare.name_order(views.table(spark, d, "nation").select(F.col("n_name").alias("name")), "name").withColumn("place", F.col("place").cast("long"))


@register("largest_blobs", "WITH b AS (SELECT l_orderkey AS frame_idx, l_linenumber AS blob, max(l_quantity) AS area, max(l_discount) AS cx FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, blob) AS r FROM b) SELECT frame_idx, blob, row_number() OVER (PARTITION BY frame_idx ORDER BY cx, blob) AS place FROM r WHERE r <= 4")
def largest_blobs(spark, d):
    blobs = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").alias("blob")).agg(F.max("l_quantity").alias("area"), F.max("l_discount").alias("cx"))
    return compare.largest_blobs(blobs, ["frame_idx"], "area", "cx", "blob").select("frame_idx", "blob", F.col("place").cast("long").alias("place"))


@register("listed_names", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'project ' || o_orderstatus END AS project_name, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN CAST(o_custkey % 7 AS VARCHAR) ELSE o_orderpriority END AS video_name FROM orders""")
def listed_names(spark, d):
    o = views.table(spark, d, "orders")
    video = F.struct(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise((F.col("o_custkey") % 7).cast("string")).alias("id"), F.col("o_orderpriority").alias("name"))
    state = F.to_json(F.struct(F.concat(F.lit("project "), "o_orderstatus").alias("project_name"), F.array(F.struct(F.lit("other").alias("id"), F.lit("x").alias("name")), video).alias("videos")))
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), (F.col("o_custkey") % 7).alias("video_id"), F.when(F.col("o_orderkey") % 3 == 0, "no json").otherwise(state).alias("state_json"))
    return compare.listed_names(runs).select("id", "project_name", "video_name")


@register("first_existing", "SELECT l_orderkey AS run, arg_min(l_partkey, struct_pack(n := l_linenumber, p := l_partkey)) FILTER (p_size < 10) AS path FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def first_existing(spark, d):
    """Lines as candidates in their order, small parts as what exists."""
    candidates = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("path"), "l_linenumber")
    existing = views.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("path"))
    return report.first_existing(candidates, existing, ["run"], "path", F.struct("l_linenumber", "path"))
