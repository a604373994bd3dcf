"""Readers and writers of the library's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.edits import in_range

#: Project files: dynamic ids are maps, and fields that a file lacks are null.
PROJECT = (
    "project_id string, name string, videos map<string, struct<name: string, num_frames: int, fps: double, width: int, height: int, start_frame: int, anchor_batch_size: string, propagation_complete: boolean, whole_video_inference: struct<status: string>, "
    "objects: map<string, struct<name: string, color: string, description: string>>, point_prompts: map<string, map<string, struct<points: array<array<double>>, labels: array<int>>>>, annotated_anchors: array<int>, "
    "anchor_labeling_timing: struct<frames: map<string, struct<entered_frontend_ms: bigint, committed_ms: bigint, duration_ms: bigint>>, "
    "video: struct<first_anchor_entered_ms: bigint, last_anchor_committed_ms: bigint, whole_video_labeling_wall_ms: bigint, sum_anchor_durations_ms: bigint>>>>"
)
REGISTRY = "experiment int, experiment_name string, session string, box int, mouse_id string, shave_pattern string, role string, housing string"


def projects(spark: SparkSession, path: str) -> DataFrame:
    """Project files, one JSON document each."""
    return spark.read.schema(PROJECT).json(path, multiLine=True)


def videos(project: DataFrame) -> DataFrame:
    """A row for each video, with defaults for what the file lacks."""
    v = project.select("project_id", F.explode("videos").alias("video_id", "v"))
    size = F.greatest(F.lit(10), F.least(F.lit(10000), F.coalesce(F.col("v.anchor_batch_size").try_cast("int"), F.lit(1000))))
    status = F.when(F.col("v.propagation_complete"), "complete").otherwise(F.coalesce("v.whole_video_inference.status", F.lit("none")))
    return v.select("project_id", "video_id", "v.name", F.coalesce("v.num_frames", F.lit(0)).alias("num_frames"), F.coalesce("v.fps", F.lit(30.0)).alias("fps"), "v.width", "v.height", F.coalesce("v.start_frame", F.lit(0)).alias("start_frame"), size.alias("anchor_batch_size"), F.coalesce("v.propagation_complete", F.lit(False)).alias("propagation_complete"), status.alias("status"))


def objects(project: DataFrame) -> DataFrame:
    v = project.select(F.explode("videos").alias("video_id", "v"))
    return v.select("video_id", F.explode("v.objects").alias("object_id", "o")).select("video_id", "object_id", "o.*")


def prompts(project: DataFrame) -> DataFrame:
    """A row for each object and frame with its points; frames that are no numbers are left out."""
    v = project.select(F.explode("videos").alias("video_id", "v"))
    by_object = v.select("video_id", F.explode("v.point_prompts").alias("object_id", "f"))
    rows = by_object.select("video_id", "object_id", F.explode("f").alias("frame", "p"))
    return rows.select("video_id", "object_id", F.col("frame").try_cast("int").alias("frame_idx"), "p.points", "p.labels").where("frame_idx IS NOT NULL")


def timing(project: DataFrame) -> DataFrame:
    """A row for each labelled frame; frames that are no numbers are left out."""
    v = project.select(F.explode("videos").alias("video_id", "v"))
    return v.select("video_id", F.explode("v.anchor_labeling_timing.frames").alias("frame", "t")).select("video_id", F.col("frame").try_cast("int").alias("frame_idx"), F.col("t.entered_frontend_ms").alias("entered_ms"), "t.committed_ms", "t.duration_ms").where("frame_idx IS NOT NULL")


def video_timing(project: DataFrame) -> DataFrame:
    """What the file says of each video's labelling: first entered, last committed, wall time and sum of durations."""
    v = project.select(F.explode("videos").alias("video_id", "v")).select("video_id", F.col("v.anchor_labeling_timing.video").alias("t")).where("t IS NOT NULL")
    return v.select("video_id", F.col("t.first_anchor_entered_ms").alias("first_ms"), F.col("t.last_anchor_committed_ms").alias("last_ms"), F.col("t.whole_video_labeling_wall_ms").alias("wall_ms"), F.col("t.sum_anchor_durations_ms").alias("total_ms"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file with a header."""
    return spark.read.csv(path, header=True, schema=REGISTRY)


def box_map(column: Column) -> Column:
    """A JSON text of boxes by object as a map; an empty one where the text isn't JSON."""
    return F.coalesce(F.from_json(column, "map<string, array<double>>"), F.create_map().cast("map<string, array<double>>"))


def box_rows(frames: DataFrame, keys: Sequence[str], column: str = "bbox_json") -> DataFrame:
    """A row for each object's box x, y, w, h, score."""
    rows = frames.select(*keys, F.explode(box_map(F.col(column))).alias("object_id", "_b"))
    return rows.select(*keys, "object_id", *[F.try_element_at("_b", F.lit(i + 1)).alias(n) for i, n in enumerate(("x", "y", "w", "h", "score"))])


def frames_between(frames: DataFrame, first: int, last: int = -1) -> DataFrame:
    """Frames of an inclusive range in order; -1 leaves the end open. The filter reaches the files."""
    return frames.where(in_range("frame_idx", first, last)).orderBy("frame_idx")


def frame_sizes(frames: DataFrame, keys: Sequence[str], blob: str = "seg_blob", boxes: str = "bbox_json") -> DataFrame:
    """Bytes of each frame's masks and its number of boxes, without reading more of the masks than their length."""
    return frames.select(*keys, F.coalesce(F.length(blob), F.lit(0)).alias("seg_bytes"), F.size(box_map(F.col(boxes))).alias("objects"), F.to_timestamp("updated_at").alias("updated_at"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Frame numbers of append-only progress files, one to a line; other lines are skipped."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").try_cast("int").alias("frame_idx")).where("frame_idx IS NOT NULL")


def samples(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """Values of a folder of CSV files by the files' stems; what is no number is left out."""
    raw = spark.read.csv(path, header=True, schema=f"`{column}` string")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return raw.select(stem.alias("name"), F.col(column).try_cast("double").alias("value")).where("value IS NOT NULL")


def write_partitioned(table: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet by key; only the keys that the table holds are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_features(spark: SparkSession, path: str, metadata: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A stored feature table: the columns asked for that it has, in their order; others it may hold are ignored."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found.select(*[c for c in [*metadata, *features] if c in found.columns])


#: Columns of a conditions table, in the order in which it is written.
CONDITIONS = ("video_id", "video_name", "condition", "group", "role", "housing", "treatment", "notes")


def conditions_template(videos_: DataFrame, path: str) -> None:
    """A conditions table to be filled in: a row for each video, its labels empty."""
    empty = [F.lit(None).cast("string").alias(c) for c in CONDITIONS[2:]]
    videos_.select("video_id", F.col("name").alias("video_name"), *empty).write.mode("overwrite").csv(path, header=True)


def conditions_file(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in conditions table: texts trimmed, blanks null, rows without any label left out."""
    from driftmark.operators.registry import conditions

    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in CONDITIONS))
    return conditions(raw, CONDITIONS[2:7])


def project_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files of a folder's subfolders as one table, with the subfolder's name as video_id; files without rows add none."""
    raw = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema=schema)
    return raw.withColumn("video_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def save_results(tables_: dict[str, DataFrame], path: str) -> None:
    """Each named result as Parquet under path, and as CSV where its columns allow it."""
    for name, table in tables_.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        if not any(t.startswith(("array", "map", "struct", "binary")) for _, t in table.dtypes):
            table.write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
