"""Queries on identities, roles and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import registry
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import _r

#: Customers as entries of a registry; a pair of recorded animals for each order. Experiments and housings come from their keys.
REGISTRY = """
registry AS (SELECT c_nationkey AS experiment, c_mktsegment AS session, c_custkey % 10 AS box, CASE WHEN c_custkey % 3 = 0 THEN 'Head-Shaved' WHEN c_custkey % 3 = 1 THEN 'no shave' ELSE 'BackShave' END AS pattern, c_name AS animal, c_custkey AS number FROM customer WHERE c_nationkey < 20),
keyed AS (SELECT * FROM (SELECT *, regexp_replace(translate(lower(pattern), ' -_', ''), 'shaved$', 'shave') AS key, row_number() OVER (PARTITION BY experiment, session, box, regexp_replace(translate(lower(pattern), ' -_', ''), 'shaved$', 'shave') ORDER BY number DESC) AS r FROM registry) WHERE r = 1),
pairs AS (SELECT o_orderkey AS id, CAST(o_orderkey % 25 AS INT) AS experiment, c_mktsegment AS session, o_orderkey % 10 AS box, CASE WHEN o_orderkey % 2 = 0 THEN 'headshave' ELSE 'Noshave' END AS a_name, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'back shave' ELSE 'head_shaved' END AS b_name FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _registry(spark, d):
    c = views.table(spark, d, "customer").where("c_nationkey < 20")
    pattern = F.when(F.col("c_custkey") % 3 == 0, "Head-Shaved").when(F.col("c_custkey") % 3 == 1, "no shave").otherwise("BackShave")
    return c.select(F.col("c_nationkey").alias("experiment"), F.col("c_mktsegment").alias("session"), (F.col("c_custkey") % 10).alias("box"), pattern.alias("pattern"), F.col("c_name").alias("animal"), F.col("c_custkey").alias("number"))


def _pairs(spark, d):
    o = views.table(spark, d, "orders").join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), (k % 25).cast("int").alias("experiment"), F.col("c_mktsegment").alias("session"), (k % 10).alias("box"), F.when(k % 2 == 0, "headshave").otherwise("Noshave").alias("a_name"), F.when(k % 5 == 0, None).when(k % 3 == 0, "back shave").otherwise("head_shaved").alias("b_name"))


def _key(c):
    return f"regexp_replace(translate(lower({c}), ' -_', ''), 'shaved$', 'shave')"


@register("identities", f"""WITH {REGISTRY} SELECT id, CASE WHEN a.animal IS NOT NULL AND b.animal IS NOT NULL THEN a.animal END AS a_animal, CASE WHEN a.animal IS NOT NULL AND b.animal IS NOT NULL THEN b.animal END AS b_animal
FROM pairs p LEFT JOIN keyed a ON p.experiment = a.experiment AND p.session = a.session AND p.box = a.box AND {_key("a_name")} = a.key LEFT JOIN keyed b ON p.experiment = b.experiment AND p.session = b.session AND p.box = b.box AND {_key("b_name")} = b.key""")
def identities(spark, d):
    return registry.identities(_pairs(spark, d), _registry(spark, d)).select("id", "a_animal", "b_animal")


@register("single_identity", f"WITH {REGISTRY} SELECT id, a.animal AS a_animal FROM pairs p LEFT JOIN keyed a ON p.experiment = a.experiment AND p.session = a.session AND p.box = a.box AND {_key('a_name')} = a.key WHERE b_name IS NULL")
def single_identity(spark, d):
    return registry.single_identity(_pairs(spark, d).where("b_name IS NULL"), _registry(spark, d)).select("id", "a_animal")


@register("unresolved", f"""WITH {REGISTRY}, n AS (SELECT * FROM pairs WHERE a_name IS NOT NULL AND b_name IS NOT NULL)
SELECT id, 'a is not in the registry' AS reason FROM n p WHERE NOT EXISTS (SELECT 1 FROM keyed a WHERE p.experiment = a.experiment AND p.session = a.session AND p.box = a.box AND {_key("a_name")} = a.key)
UNION ALL SELECT id, 'b is not in the registry' FROM n p WHERE NOT EXISTS (SELECT 1 FROM keyed a WHERE p.experiment = a.experiment AND p.session = a.session AND p.box = a.box AND {_key("b_name")} = a.key)""")
def unresolved(spark, d):
    return registry.unresolved(_pairs(spark, d), _registry(spark, d)).select("id", "reason")


@register("alone_and_paired", """WITH a AS (SELECT o_custkey AS k, arg_max(o_totalprice, struct_pack(d := o_orderdate, o := o_orderkey)) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max(o_totalprice, struct_pack(d := o_orderdate, o := o_orderkey)) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT a.k AS animal, a.v AS alone, b.v AS paired FROM a JOIN b ON a.k = b.k""")
def alone_and_paired(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("animal"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return registry.alone_and_paired(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "animal", [F.col("o_orderdate"), F.col("o_orderkey")])


META = """
meta AS (SELECT o_orderkey AS id, ['hab', 'test_day', 'sh_intruder', 'other'][1 + o_orderkey % 4] AS e, CASE WHEN o_custkey % 3 = 0 THEN 'SH' WHEN o_custkey % 3 = 1 THEN 'GH' ELSE '' END AS ha, CASE WHEN o_custkey % 2 = 0 THEN 'SH' ELSE 'GH' END AS hb,
    CASE WHEN o_orderkey % 5 < 3 THEN 'resident' ELSE 'intruder' END AS ra, CASE WHEN o_orderkey % 5 < 3 THEN 'intruder' ELSE 'resident' END AS rb FROM orders)"""


def _meta(spark, d):
    o = views.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(x) for x in ("hab", "test_day", "sh_intruder", "other")])
    return o.select(k.alias("id"), F.element_at(names, (k % 4 + 1).cast("int")).alias("e"), F.when(c % 3 == 0, "SH").when(c % 3 == 1, "GH").otherwise("").alias("ha"), F.when(c % 2 == 0, "SH").otherwise("GH").alias("hb"), F.when(k % 5 < 3, "resident").otherwise("intruder").alias("ra"), F.when(k % 5 < 3, "intruder").otherwise("resident").alias("rb"))


@register("condition_groups", f"""WITH {META} SELECT id, CASE WHEN e = 'hab' THEN 'GH_littermate' WHEN e = 'test_day' AND (ha = 'SH' OR hb = 'SH') THEN 'SH_res_GH_int' WHEN e = 'test_day' THEN 'GH_res_GH_int' WHEN e = 'sh_intruder' THEN 'GH_res_SH_int' ELSE 'unknown' END AS "group",
CASE WHEN e = 'hab' THEN 'GH_littermate' WHEN e = 'test_day' AND ha = 'SH' AND ra = 'resident' THEN 'SH_resident' WHEN e = 'test_day' AND ha = 'GH' THEN 'GH_' || ra WHEN e = 'sh_intruder' AND ha = 'SH' THEN 'SH_intruder' WHEN e = 'sh_intruder' AND ha = 'GH' AND ra = 'resident' THEN 'GH_resident' ELSE 'unknown' END AS role FROM meta""")
def condition_groups(spark, d):
    return _meta(spark, d).select("id", registry.condition_group(F.col("e"), F.col("ha"), F.col("hb")).alias("group"), registry.focal_role(F.col("e"), F.col("ha"), F.col("ra")).alias("role"))


@register("pair_roles", f"""WITH {META} SELECT id, 'SH_resident' AS role FROM meta WHERE e = 'test_day' AND ((ra = 'resident' AND ha = 'SH') OR (rb = 'resident' AND hb = 'SH')) UNION ALL SELECT id, 'SH_intruder' FROM meta WHERE e = 'sh_intruder' AND (ha = 'SH' OR hb = 'SH')
UNION ALL SELECT id, 'GH_resident' FROM meta WHERE e IN ('test_day', 'sh_intruder') AND ((ra = 'resident' AND ha = 'GH') OR (rb = 'resident' AND hb = 'GH')) UNION ALL SELECT id, 'GH_intruder' FROM meta WHERE e = 'test_day' AND ((ra = 'intruder' AND ha = 'GH') OR (rb = 'intruder' AND hb = 'GH')) UNION ALL SELECT id, 'GH_littermate' FROM meta WHERE e = 'hab'""")
def pair_roles(spark, d):
    rules = registry.role_rules(F.col("ra"), F.col("ha"), F.col("rb"), F.col("hb"), F.col("e"))
    return registry.pair_roles(_meta(spark, d), rules).select("id", "role")


@register("conditions", "SELECT c_custkey AS id, nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END), '') AS housing, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS treatment FROM customer WHERE c_custkey % 4 <> 0 OR c_nationkey >= 5")
def conditions(spark, d):
    c = views.table(spark, d, "customer")
    raw = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("housing"), F.when(F.col("c_nationkey") < 5, "").otherwise(F.col("c_name")).alias("treatment"))
    return registry.conditions(raw, ["housing", "treatment"]).withColumn("id", F.col("id").cast("long"))


@register("condition_summary", "SELECT 'segment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2")
def condition_summary(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return registry.condition_summary(c, ["segment", "nation"])


@register("eligibility", """WITH v AS (SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AS anchored, o_orderkey % 6 = 0 AS propagated, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'complete' WHEN o_orderstatus = 'F' THEN ' failed ' END AS s, o_custkey % 2 = 0 AS stale, o_custkey % 4 AS prompts FROM orders)
SELECT id, CASE WHEN NOT anchored OR propagated THEN false WHEN s = 'running' THEN stale WHEN s = 'complete' OR prompts = 0 THEN false ELSE true END AS eligible,
CASE WHEN NOT anchored THEN 'anchor labeling incomplete' WHEN propagated THEN 'already tracked' WHEN s = 'running' AND stale THEN 'ready, the earlier run went silent' WHEN s = 'running' THEN 'running' WHEN s = 'complete' THEN 'complete without a full track' WHEN prompts = 0 THEN 'no point prompts' WHEN trim(s) = 'failed' THEN 'ready, a retry' ELSE 'ready' END AS reason FROM v""")
def eligibility(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = views.table(spark, d, "orders").select(k.alias("id"), (k % 7 != 0).alias("anchored"), (k % 6 == 0).alias("propagated"), F.when(F.col("o_orderstatus") == "P", "running").when(k % 11 == 0, "complete").when(F.col("o_orderstatus") == "F", " failed ").alias("status"), (c % 2 == 0).alias("stale"), (c % 4).alias("prompts"))
    return registry.eligibility(v).select("id", "eligible", "reason")


@register("stale_runs", "SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - greatest(coalesce(epoch_us(max(ts) FILTER (event_type = 'view')), epoch_us(max(ts) FILTER (event_type = 'click'))), coalesce(epoch_us(max(ts) FILTER (event_type = 'click')), epoch_us(max(ts) FILTER (event_type = 'view'))))) > 86400000000 AS stale FROM events GROUP BY 1")
def stale_runs(spark, d):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    e = views.table(spark, d, "events").groupBy("user_id").agg(last("view").alias("p"), last("click").alias("m"))
    return e.select("user_id", registry.stale(F.col("p"), F.col("m"), F.lit("2024-01-30 12:00:00").cast("timestamp"), 86400).alias("stale"))


@register("completeness", f"""WITH {views.TRACKS}, v AS (SELECT video_id, CAST(0 AS BIGINT) AS start, 60 + video_id % 20 AS n, video_id % 4 <> 0 AS flag FROM (SELECT DISTINCT video_id FROM tracks)),
m AS (SELECT v.video_id, v.n, flag, (SELECT count(*) FROM range(0, v.n) r(i) WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.video_id = v.video_id AND t.object_id = 'a' AND t.frame_idx = i AND cx IS NOT NULL)) AS missing FROM v)
SELECT video_id, missing, CASE WHEN NOT flag THEN 'incomplete' WHEN missing > 0 THEN 'missing masks' ELSE 'complete' END AS verdict FROM m""")
def completeness(spark, d):
    t = views.tracks(spark, d)
    v = t.select("video_id").distinct().select("video_id", F.lit(0).cast("long").alias("start"), (F.lit(60) + F.col("video_id") % 20).alias("n"), (F.col("video_id") % 4 != 0).alias("flag"))
    return registry.complete(v, t.where("object_id = 'a' AND cx IS NOT NULL")).select("video_id", "missing", "verdict")


@register("keep_first", "SELECT o_custkey AS video_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first(spark, d):
    o = views.table(spark, d, "orders")
    return registry.keep_first(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("video_id"), "o_orderkey")


@register("focal_roles", f"""WITH {META} SELECT id, 'SH_resident' AS role FROM meta WHERE e = 'test_day' AND ra = 'resident' AND ha = 'SH' UNION ALL SELECT id, 'SH_intruder' FROM meta WHERE e = 'sh_intruder' AND ha = 'SH'
UNION ALL SELECT id, 'GH_resident' FROM meta WHERE e IN ('test_day', 'sh_intruder') AND ra = 'resident' AND ha = 'GH' UNION ALL SELECT id, 'GH_intruder' FROM meta WHERE e = 'test_day' AND ra = 'intruder' AND ha = 'GH' UNION ALL SELECT id, 'GH_littermate' FROM meta WHERE e = 'hab'""")
def focal_roles(spark, d):
    return registry.pair_roles(_meta(spark, d), registry.focal_rules(F.col("ra"), F.col("ha"), F.col("e"))).select("id", "role")


@register("fast_completeness", "SELECT c_custkey AS video_id, CASE WHEN c_custkey % 4 = 0 THEN 'incomplete' WHEN c_nationkey = 3 THEN 'no folder' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no masks' ELSE 'complete' END AS verdict FROM customer")
def fast_completeness(spark, d):
    """Customers as videos; those with orders have stored masks."""
    k = F.col("c_custkey")
    videos = views.table(spark, d, "customer").select(k.alias("video_id"), (k % 4 != 0).alias("flag"), F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("folder"))
    return registry.fast_complete(videos, views.table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"))).select("video_id", "verdict")


NAMES = """
names AS (SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '.mp4' ELSE 'cam' || (o_orderkey % 4) || '_video_' || o_orderpriority || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_orderkey % 5 = 0 THEN '99' ELSE '123456' END || '.mp4' END AS name FROM orders),
probed AS (SELECT video_id, regexp_matches(name, '^(\\w+)_video_(.+)_(\\d{8})_(\\d{6})\\.mp4$') IS TRUE AS ok, name FROM names)"""


def _probed(spark, d):
    k = F.col("o_orderkey")
    full = F.concat(F.lit("cam"), k % 4, F.lit("_video_"), "o_orderpriority", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.when(k % 5 == 0, "99").otherwise("123456"), F.lit(".mp4"))
    videos = views.table(spark, d, "orders").select(k.alias("video_id"), F.when(k % 9 == 0, None).when(k % 7 == 0, F.concat("o_orderpriority", F.lit(".mp4"))).otherwise(full).alias("name"))
    return registry.probed(videos)


@register("probed_names", f"""WITH {NAMES} SELECT video_id, CASE WHEN ok THEN regexp_extract(name, '^(\\w+)_video_(.+)_(\\d{{8}})_(\\d{{6}})\\.mp4$', 1) END AS camera, CASE WHEN ok THEN regexp_extract(name, '^(\\w+)_video_(.+)_(\\d{{8}})_(\\d{{6}})\\.mp4$', 2) END AS session, CASE WHEN NOT ok THEN 'name is not camera_video_session_date_time.mp4' END AS reason FROM probed""")
def probed_names(spark, d):
    return _probed(spark, d).select("video_id", "camera", "session", "reason")


@register("all_resolved", f"WITH {NAMES} SELECT count(*) FILTER (ok) AS resolvable, count(*) FILTER (NOT ok) AS unresolved, count(*) FILTER (NOT ok) = 0 AND count(*) FILTER (ok) > 0 AS all_resolved FROM probed")
def all_resolved(spark, d):
    return registry.all_resolved(_probed(spark, d))
