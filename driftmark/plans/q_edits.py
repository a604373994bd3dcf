"""Queries on edits of frame tables, and on reading them."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmark.operators import edits
from driftmark.plans import views
from driftmark.plans.base import register
from driftmark.sources import tables

LINES = "m AS (SELECT l_orderkey AS frame_idx, l_returnflag AS object_id, l_partkey AS mark FROM lineitem)"


def _masks(spark, d):
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), F.col("l_returnflag").alias("object_id"), F.col("l_partkey").alias("mark"))


@register("swap", f"WITH {LINES} SELECT object_id, count(*) AS n, CAST(sum(mark) AS BIGINT) AS marks FROM (SELECT CASE WHEN frame_idx BETWEEN 100 AND 5000 AND object_id = 'A' THEN 'R' WHEN frame_idx BETWEEN 100 AND 5000 AND object_id = 'R' THEN 'A' ELSE object_id END AS object_id, mark FROM m) GROUP BY 1")
def swap(spark, d):
    return edits.swapped(_masks(spark, d), "A", "R", 100, 5000).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("marks"))


@register("swap_twice", f"WITH {LINES} SELECT frame_idx, object_id, mark FROM m")
def swap_twice(spark, d):
    return edits.swapped(edits.swapped(_masks(spark, d), "A", "R", 100, 5000), "A", "R", 100, 5000)


@register("frames_touched", f"WITH {LINES} SELECT count(DISTINCT frame_idx) AS frames FROM m WHERE frame_idx BETWEEN 100 AND 5000 AND object_id IN ('A', 'R')")
def frames_touched(spark, d):
    return edits.frames_with(_masks(spark, d), ["A", "R"], 100, 5000)


@register("delete_range", f"WITH {LINES} SELECT object_id, count(*) AS n FROM m WHERE frame_idx < 2000 GROUP BY 1")
def delete_range(spark, d):
    return edits.without_range(_masks(spark, d), 2000, -1).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@register("delete_prompts", f"WITH {LINES} SELECT object_id, count(*) AS n FROM m WHERE NOT (frame_idx <= 3000 AND object_id IN ('N')) GROUP BY 1")
def delete_prompts(spark, d):
    return edits.without_prompts(_masks(spark, d), None, 3000, ["N"]).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


BASE = "base AS (SELECT o_orderkey AS id, o_totalprice AS box FROM orders WHERE o_orderkey % 3 <> 0), fresh AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS box FROM orders WHERE o_orderkey % 5 = 0)"


def _base(spark, d):
    o = views.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    fresh = o.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("o_totalprice") + 1).alias("box"))
    return o.where("id % 3 <> 0").select("id", F.col("o_totalprice").alias("box")), fresh


@register("upsert", f"WITH {BASE} SELECT id, box FROM base WHERE id % 5 <> 0 AND id % 7 <> 0 UNION ALL SELECT f.id, coalesce(f.box, b.box) FROM fresh f LEFT JOIN base b ON f.id = b.id")
def upsert(spark, d):
    base, fresh = _base(spark, d)
    return edits.upserted(base, fresh, base.where("id % 7 = 0").select("id"), ["id"])


@register("fallback_read", f"WITH {BASE} SELECT id, box FROM base UNION ALL SELECT id, box FROM fresh WHERE id % 3 = 0")
def fallback_read(spark, d):
    return edits.first_of(*_base(spark, d), ["id"])


@register("union_distinct", f"WITH {BASE} SELECT id FROM base UNION SELECT id FROM fresh")
def union_distinct(spark, d):
    base, fresh = _base(spark, d)
    return base.select("id").union(fresh.select("id")).distinct()


@register("intersect_keys", f"WITH {BASE} SELECT id FROM base INTERSECT SELECT id FROM fresh")
def intersect_keys(spark, d):
    base, fresh = _base(spark, d)
    return base.select("id").intersect(fresh.select("id"))


@register("missing_keys", f"WITH {BASE} SELECT id FROM fresh EXCEPT SELECT id FROM base")
def missing_keys(spark, d):
    base, fresh = _base(spark, d)
    return fresh.select("id").subtract(base.select("id"))


@register("migration", "SELECT o_orderkey AS id, CAST(o_custkey % 4 AS BIGINT) AS area, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS box FROM orders WHERE o_custkey % 4 > 0")
def migration(spark, d):
    return edits.migrated(*_migration(spark, d), ["id"])[0]


@register("migration_counts", "SELECT count(*) AS seen, count(*) FILTER (o_custkey % 4 > 0) AS imported, count(*) FILTER (o_orderkey % 3 = 0) AS box_missing FROM orders")
def migration_counts(spark, d):
    return edits.migrated(*_migration(spark, d), ["id"])[1]


def _migration(spark, d):
    o = views.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return o.select("id", (F.col("o_custkey") % 4).alias("area"), F.lit(-1.0).alias("derived")), o.where("id % 3 <> 0").select("id", F.col("o_totalprice").alias("box"))


@register("verify_migration", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'row missing' WHEN o_orderkey % 5 = 0 THEN 'mask differs' WHEN o_orderkey % 7 = 0 THEN 'box differs' ELSE 'same' END AS verdict FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0)")
def verify_migration(spark, d):
    o = views.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    old = o.where("id % 11 <> 0").select("id", F.col("o_custkey").alias("m"), F.col("o_totalprice").alias("b"))
    new = o.where("id % 13 <> 0").select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("o_custkey")).alias("m"), (F.col("o_totalprice") + F.when(F.col("id") % 7 == 0, 0.1).otherwise(0.0)).alias("b"))
    return edits.verified(old, new, ["id"], "m", "b")


@register("merge_projects", "SELECT new_id, video_id, name FROM (SELECT left(sha256('p1/' || c_custkey), 12) AS new_id, c_custkey AS video_id, c_name AS name FROM customer UNION ALL SELECT left(sha256('p2/' || s_suppkey), 12), s_suppkey, s_name FROM supplier)")
def merge_projects(spark, d):
    a = views.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("name"))
    b = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_name").alias("name"))
    return edits.merged_projects(a, b, "p1", "p2").select("new_id", "video_id", "name")


@register("united_labels", "SELECT 'p1' AS project, left(sha256('p1/' || c_custkey), 12) AS new_id, c_custkey AS video_id, o_orderkey AS start_frame, NULL::VARCHAR AS cluster FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'p2', left(sha256('p2/' || l_suppkey), 12), l_suppkey, l_orderkey, l_returnflag FROM lineitem")
def united_labels(spark, d):
    """The windows of two projects under the ids that their videos have in the merged project; only the second has labels."""
    o = views.table(spark, d, "orders").join(views.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("start_frame"))
    line = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("start_frame"), F.col("l_returnflag").alias("cluster"))
    return edits.united({"p1": o, "p2": line})


_KEYS = lambda name, a, b: f"""SELECT '{name}' AS pair, (SELECT count(*) FROM ({a})) AS n_a, (SELECT count(*) FROM ({b})) AS n_b, NOT EXISTS ({a} EXCEPT {b}) AND NOT EXISTS ({b} EXCEPT {a}) AS equal, NOT EXISTS ({a} EXCEPT {b}) AS a_in_b,
NOT EXISTS ({a} EXCEPT {b}) AND coalesce((SELECT max(k) FROM ({a})) < (SELECT min(k) FROM ({b} EXCEPT {a})), true) AS a_first"""  # noqa: E731
_SETS = {
    "all": ("SELECT DISTINCT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders"),
    "first": ("SELECT o_orderkey AS k FROM orders WHERE o_orderkey < 1000", "SELECT o_orderkey AS k FROM orders"),
    "part": ("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey AS k FROM orders"),
    "more": ("SELECT o_orderkey AS k FROM orders", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'"),
}


@register("key_sets", " UNION ALL ".join(_KEYS(name, *sides) for name, sides in _SETS.items()))
def key_sets(spark, d):
    """Sets of frames compared: equal ones, a prefix, a subset that is none, and a set that is too large."""
    orders = views.table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    sets = {"all": (lines, orders), "first": (orders.where("k < 1000"), orders), "part": (orders.where("o_orderstatus = 'F'"), orders), "more": (orders, orders.where("o_orderstatus <> 'P'"))}
    out = None
    for name, (a, b) in sets.items():
        one = edits.key_sets(a, b, ["k"]).select(F.lit(name).alias("pair"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("stale_caches", "SELECT o_orderkey AS video_id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 10 >= 5")
def stale_caches(spark, d):
    o = views.table(spark, d, "orders").withColumnRenamed("o_orderkey", "video_id")
    v = o.select("video_id", F.lit("s").alias("signature"), (F.col("video_id") % 10).alias("changed_at"))
    cache = o.where("video_id % 4 <> 0").select("video_id", F.when(F.col("video_id") % 3 == 0, "t").otherwise("s").alias("signature"), F.lit(4).alias("cached_at"))
    return edits.stale_caches(v, cache).select("video_id")


@register("frame_range", "SELECT l_orderkey AS frame_idx, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 500 AND 900")
def frame_range(spark, d):
    return tables.frames_between(views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_idx"), "l_linenumber"), 500, 900)


@register("box_rows", "SELECT o_orderkey AS frame_idx, 'k' AS object_id, CAST(o_custkey AS DOUBLE) AS x, 0.5::DOUBLE AS y, NULL::DOUBLE AS w FROM orders WHERE o_orderkey % 4 <> 0")
def box_rows(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, "not json").otherwise(F.concat(F.lit('{"k": ['), F.col("o_custkey").cast("string"), F.lit(", 0.5]}")))
    frames = views.table(spark, d, "orders").select(k.alias("frame_idx"), text.alias("bbox_json"))
    return tables.box_rows(frames, ["frame_idx"]).select("frame_idx", "object_id", "x", "y", "w")


@register("frame_sizes", "SELECT page_id, CAST(octet_length(encode(html)) AS INT) AS seg_bytes, CAST(page_id % 3 AS INT) AS objects FROM pages")
def frame_sizes(spark, d):
    boxes = F.element_at(F.array(F.lit("{}"), F.lit('{"1": [0.1]}'), F.lit('{"1": [0.1], "2": [0.2]}')), (F.col("page_id") % 3 + 1).cast("int"))
    frames = views.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("seg_blob"), boxes.alias("bbox_json"), F.lit("2026-01-30 09:00:00").alias("updated_at"))
    return tables.frame_sizes(frames, ["page_id"]).drop("updated_at")
