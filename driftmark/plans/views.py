"""The library's input tables as views over the driver's tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.scalars import millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two objects for each video: users 2v and 2v + 1, their events in order as frames; errors with k < 10 are frames without the object."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    lost = (F.col("event_type") == "error") & (k < 10)
    seen = lambda c: F.when(~lost, c)
    frame = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(
        F.floor(F.col("user_id") / 2).alias("video_id"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("object_id"), frame.alias("frame_idx"),
        seen(F.col("value")).alias("cx"), seen(k.cast("double")).alias("cy"), seen((F.lit(100) + F.col("event_id") % 37).cast("double")).alias("area"),
        seen((F.col("event_id") % 314) / 100 - 1.57).alias("orientation"), seen((F.col("event_id") % 100) / 100).alias("eccentricity"),
        F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), F.col("ts"), F.col("event_type").alias("label"),
    )


TRACKS = """
tracks AS (
    SELECT user_id // 2 AS video_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS object_id, frame_idx,
        CASE WHEN lost THEN NULL ELSE value END AS cx, CASE WHEN lost THEN NULL ELSE CAST(k AS DOUBLE) END AS cy,
        CASE WHEN lost THEN NULL ELSE CAST(100 + event_id % 37 AS DOUBLE) END AS area,
        CASE WHEN lost THEN NULL ELSE (event_id % 314) / 100.0 - 1.57 END AS orientation,
        CASE WHEN lost THEN NULL ELSE (event_id % 100) / 100.0 END AS eccentricity,
        CAST(640 AS DOUBLE) AS width, CAST(480 AS DOUBLE) AS height, ts, event_type AS label
    FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
            event_type = 'error' AND CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 10 AS lost,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events)
)"""

STEPS = (
    TRACKS
    + """,
stepped AS (
    SELECT *, sqrt((cx - lag(cx) OVER o) ** 2 + (cy - lag(cy) OVER o) ** 2) AS step, cx - lag(cx) OVER o AS dx, cy - lag(cy) OVER o AS dy,
        orientation - lag(orientation) OVER o AS turn, max(frame_idx) OVER (PARTITION BY video_id, object_id) + 1 AS len
    FROM tracks WINDOW o AS (PARTITION BY video_id, object_id ORDER BY frame_idx)
)"""
)

#: Each frame of a track once for every window of 30 frames, stride 10, that holds it.
WINDOWED = (
    STEPS
    + """,
windowed AS (
    SELECT s.*, w.start_frame FROM stepped s JOIN (
        SELECT DISTINCT video_id, object_id, unnest(range(0, len - 29, 10)) AS start_frame FROM stepped WHERE len >= 30
    ) w ON s.video_id = w.video_id AND s.object_id = w.object_id AND s.frame_idx >= w.start_frame AND s.frame_idx < w.start_frame + 30
)"""
)


def ethogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of labels for each video: a user's event types in order; group is user_id % 4."""
    e = table(spark, sf_dir, "events")
    start = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("video_id"), start.alias("start_frame"), F.col("event_type").alias("cluster"), F.concat(F.lit("g"), F.col("user_id") % 4).alias("group"), "value")


ETHOGRAM = """
ethogram AS (
    SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start_frame, event_type AS cluster, 'g' || (user_id % 4) AS "group", value FROM events
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask runs of columns: orders as frames, return flags as objects, lines as columns."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("frame_idx"), F.col("l_returnflag").alias("object_id"), F.col("l_linenumber").cast("long").alias("x"),
        F.floor("l_quantity").cast("long").alias("y0"), (F.lit(1) + F.floor(F.round(F.col("l_discount") * 100))).cast("long").alias("len"),
    )


PIXELS = """
pixels AS (
    SELECT DISTINCT l_orderkey AS frame_idx, l_returnflag AS object_id, CAST(l_linenumber AS BIGINT) AS x,
        unnest(range(CAST(floor(l_quantity) AS BIGINT), CAST(floor(l_quantity) AS BIGINT) + 1 + CAST(round(l_discount * 100) AS BIGINT))) AS y
    FROM lineitem
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised boxes of frames: orders as frames, lines as objects."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("frame_idx"), F.col("l_linenumber").cast("string").alias("object_id")).agg(
        (F.max("l_quantity") / 100).alias("x"), F.max("l_discount").alias("y"), (F.lit(0.05) + F.max("l_tax")).alias("w"), F.lit(0.1).alias("h"),
    )


BOXES = """
boxes AS (
    SELECT l_orderkey AS frame_idx, CAST(l_linenumber AS VARCHAR) AS object_id, max(l_quantity) / 100 AS x, max(l_discount) AS y, 0.05::DOUBLE + max(l_tax) AS w, 0.1::DOUBLE AS h FROM lineitem GROUP BY 1, 2
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight feature columns f0 to f7 of each vector, batch (its label) and group (odd or even id)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("b"), "label").alias("batch"), F.concat(F.lit("g"), F.col("vec_id") % 2).alias("group"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(8)])


FEATURE_COLUMNS = [f"f{i}" for i in range(8)]
FEATURES = (
    "\nfeatures AS (SELECT vec_id, 'b' || label AS batch, 'g' || (vec_id % 2) AS \"group\", "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(8))
    + " FROM embeddings)"
)
#: One row for each vector and feature.
LONG = FEATURES + ',\nlong AS (' + " UNION ALL ".join(f"SELECT vec_id, batch, \"group\", 'f{i}' AS feature, f{i} AS value FROM features" for i in range(8)) + ")"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of one measure: the lengths of documents by their quality label, with the language as a batch."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("value"), F.col("quality").alias("side"), F.col("lang").alias("batch"))


LABELLED = "\nlabelled AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS value, quality AS side, lang AS batch FROM documents JOIN labels USING (doc_id))"


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled anchor frames of videos: a customer's orders by day, the days since 1992 as frames; durations in milliseconds, every seventh unknown."""
    o = table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long")
    entered = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(millis(F.col("o_orderdate")))
    took = F.floor(F.col("o_totalprice") / 20).cast("long")
    return o.select(
        F.col("o_custkey").alias("video_id"), day.alias("frame_idx"), entered.alias("entered_ms"), (millis(F.col("o_orderdate")) + took).alias("committed_ms"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(took).alias("duration_ms"), F.col("o_orderkey").alias("order_id"),
    )


TIMING = """
timing AS (
    SELECT o_custkey AS video_id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS frame_idx, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE epoch_ms(o_orderdate) END AS entered_ms,
        epoch_ms(o_orderdate) + CAST(floor(o_totalprice / 20) AS BIGINT) AS committed_ms, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 20) AS BIGINT) END AS duration_ms, o_orderkey AS order_id
    FROM orders
)"""
