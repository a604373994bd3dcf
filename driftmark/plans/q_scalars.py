"""Queries that apply the column expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.functions import scalars
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.plans.q_tracks import r6

NAMES = "n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'other.mp4' ELSE (1 + o_orderkey % 4) || 'A_video_test' || o_custkey || '_2026' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '01_090255.mp4' END AS name FROM orders)"


def _names(spark, d):
    k = F.col("o_orderkey")
    name = F.concat((1 + k % 4).cast("string"), F.lit("A_video_test"), F.col("o_custkey").cast("string"), F.lit("_2026"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("01_090255.mp4"))
    return views.table(spark, d, "orders").select(k.alias("id"), F.when(k % 9 == 0, "other.mp4").otherwise(name).alias("name"))


@register("video_names", rf"WITH {NAMES} SELECT id, CASE WHEN regexp_matches(name, '^(\w+)_video_(.+)_(\d{{8}})_(\d{{6}})\.mp4$') THEN regexp_extract(name, '^(\w+)_video_(.+)_(\d{{8}})_(\d{{6}})\.mp4$', 1) END AS camera, CASE WHEN regexp_matches(name, '_video_') THEN regexp_extract(name, '^(\w+)_video_(.+)_(\d{{8}})_(\d{{6}})\.mp4$', 2) ELSE 'unknown' END AS session, CASE WHEN name LIKE '%\_%' ESCAPE '\' THEN split_part(name, '_', 2) ELSE 'unknown' END AS view, TRY_CAST(left(name, 1) AS INT) AS box FROM n")
def video_names(spark, d):
    n = F.col("name")
    return _names(spark, d).select("id", scalars.video_camera(n).alias("camera"), scalars.video_session(n).alias("session"), scalars.camera_view(n).alias("view"), scalars.box_number(n).alias("box"))


PATTERNS = "p AS (SELECT c_custkey AS id, ['Head Shave', 'no-shave', 'BackShaved', 'plain', 'head_shaved'][1 + c_custkey % 5] AS a, CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE ['noshave', 'Head-Shaved', 'x'][1 + c_custkey % 3] END AS b FROM customer)"


def _patterns(spark, d):
    k = F.col("c_custkey")
    of = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return views.table(spark, d, "customer").select(k.alias("id"), of(("Head Shave", "no-shave", "BackShaved", "plain", "head_shaved"), k % 5).alias("a"), F.when(k % 7 == 0, "none").otherwise(of(("noshave", "Head-Shaved", "x"), k % 3)).alias("b"))


def _housing(c):
    return f"CASE WHEN translate(lower({c}), ' -_', '') IN ('headshave', 'headshaved') THEN 'isolated' WHEN translate(lower({c}), ' -_', '') IN ('noshave', 'backshave', 'backshaved') THEN 'group-housed' ELSE 'unknown' END"


@register("pattern_names", f"WITH {PATTERNS} SELECT id, regexp_replace(translate(lower(a), ' -_', ''), 'shaved$', 'shave') AS key, {_housing('a')} AS housing, CASE WHEN b = 'none' THEN 'single_animal' ELSE least({_housing('a')}, {_housing('b')}) || '+' || greatest({_housing('a')}, {_housing('b')}) END AS kind FROM p")
def pattern_names(spark, d):
    a, b = F.col("a"), F.col("b")
    return _patterns(spark, d).select("id", scalars.shave_key(a).alias("key"), scalars.housing(a).alias("housing"), scalars.pair_kind(a, b).alias("kind"))


@register("side_words", """SELECT p_partkey AS id, CASE WHEN contains(n, 'noshave') THEN 'left' WHEN contains(n, 'headshave') THEN 'right' WHEN contains(t, 'left side') THEN 'left' WHEN contains(t, 'far right') OR contains(t, 'water port') THEN 'right' END AS side, contains(t, 'far right') OR contains(t, 'water port') AS far
FROM (SELECT p_partkey, ['NoShave', 'mouse', 'Head Shave', ''][1 + p_partkey % 4] AS name0, lower(replace(['NoShave', 'mouse', 'Head Shave', ''][1 + p_partkey % 4], ' ', '')) AS n, ['on the floor', 'Left side', 'the far right one', 'near the Water Port'][1 + p_partkey // 4 % 4] AS t0, lower(['on the floor', 'Left side', 'the far right one', 'near the Water Port'][1 + p_partkey // 4 % 4]) AS t FROM part)""")
def side_words(spark, d):
    k = F.col("p_partkey")
    of = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    p = views.table(spark, d, "part").select(k.alias("id"), of(("NoShave", "mouse", "Head Shave", ""), k % 4).alias("n"), of(("on the floor", "Left side", "the far right one", "near the Water Port"), F.floor(k / 4) % 4).alias("t"))
    return p.select("id", scalars.preferred_side(F.col("t"), F.col("n"), F.lit(None).cast("string")).alias("side"), scalars.far_right(F.col("t"), F.lit("")).alias("far"))


@register("names_and_numbers", """SELECT o_orderkey AS id, CAST(greatest(10, least(10000, coalesce(TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey * 3 AS VARCHAR) END AS INT), 1000))) AS INT) AS size, split_part(o_orderkey || '_' || o_custkey, '_', 1) AS base,
CASE WHEN o_orderkey % 4 = 0 THEN 'unnamed' ELSE 'a_' || o_orderkey END AS safe FROM orders""")
def names_and_numbers(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "x").otherwise((k * 3).cast("string"))
    raw = F.when(k % 4 == 0, " ?? ").otherwise(F.concat(F.lit(" a/*"), k.cast("string"), F.lit("! ")))
    return views.table(spark, d, "orders").select(k.alias("id"), scalars.batch_size(text).alias("size"), scalars.base_id(F.concat_ws("_", k.cast("string"), F.col("o_custkey").cast("string"))).alias("base"), scalars.safe_name(raw).alias("safe"))


@register("experiments", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'hab' WHEN c_custkey % 3 = 1 THEN 'test_day' ELSE '' END AS experiment, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS number FROM customer")
def experiments(spark, d):
    k = F.col("c_custkey")
    folder = F.concat(F.when(k % 3 == 0, "185b3df6").when(k % 3 == 1, "3c9bddf2").otherwise("00000000"), F.lit("-some-name"))
    out = views.table(spark, d, "customer").select(k.alias("id"), scalars.lookup(F.split(folder, "-")[0], {"185b3df6": "hab", "3c9bddf2": "test_day"}, "").alias("experiment"))
    return out.withColumn("number", scalars.lookup(F.col("experiment"), {"hab": 1, "test_day": 2}, 0))


@register("p_texts", """SELECT l_orderkey AS id, l_linenumber AS line, l_discount AS p, CASE WHEN l_discount < 0.0001 THEN 'p<1e-4' ELSE 'p=' || printf('%.3f', l_discount) END AS said, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem""")
def p_texts(spark, d):
    p = F.col("l_discount")
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), p.alias("p"), scalars.p_text(p).alias("said"), scalars.stars(p).alias("stars"))


@register("angles", """SELECT event_id, round(v + pi() - 2 * pi() * floor((v + pi()) / (2 * pi())) - pi(), 6) AS wrapped, round(least(v - 2 * pi() * floor(v / (2 * pi())), 2 * pi() - (v - 2 * pi() * floor(v / (2 * pi())))), 6) AS heading, round(least(abs(v) - pi() * floor(abs(v) / pi()), pi() - (abs(v) - pi() * floor(abs(v) / pi()))), 6) AS axis FROM (SELECT event_id, value - 100 AS v FROM events)""")
def angles(spark, d):
    v = F.col("value") - 100
    return r6(views.table(spark, d, "events").select("event_id", scalars.wrap_pi(v).alias("wrapped"), scalars.fold_heading(v).alias("heading"), scalars.fold_axis(v).alias("axis")))


@register("finite_values", "SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE value END AS value, round(value / nullif(CAST(event_id % 4 AS DOUBLE), 0), 6) AS share FROM events")
def finite_values(spark, d):
    k = F.col("event_id") % 10
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return r6(views.table(spark, d, "events").select("event_id", scalars.finite(odd).alias("value"), scalars.ratio(F.col("value"), F.col("event_id") % 4).alias("share")))
