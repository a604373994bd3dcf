"""Identities and conditions of recorded animals, looked up in a small registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmark.functions.scalars import micros, shave_key, video_camera, video_session


def keep_last(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in an order."""
    return table.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc() for c in order]))).where("_r = 1").drop("_r")


def keep_first(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return table.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def identities(pairs: DataFrame, registry: DataFrame, place: Sequence[str] = ("experiment", "session", "box")) -> DataFrame:
    """Adds a_animal and b_animal, both null unless both pattern names a_name and b_name are known at the pair's place.

    registry: place, pattern, animal, number; of equal entries the one with the largest number counts.
    """
    known = keep_last(registry.withColumn("_key", shave_key(F.col("pattern"))), [*place, "_key"], [F.col("number")])
    out = pairs
    for side in "ab":
        names = known.select(*[F.col(c).alias(f"_{side}_{c}") for c in place], F.col("_key").alias(f"_{side}_key"), F.col("animal").alias(f"_{side}"))
        on = [F.col(c) == F.col(f"_{side}_{c}") for c in place] + [shave_key(F.col(f"{side}_name")) == F.col(f"_{side}_key")]
        out = out.join(names, on, "left")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return out.select(*pairs.columns, F.when(both, F.col("_a")).alias("a_animal"), F.when(both, F.col("_b")).alias("b_animal"))


def single_identity(rows: DataFrame, registry: DataFrame, place: Sequence[str] = ("experiment", "session", "box")) -> DataFrame:
    """Adds a_animal for rows of one animal."""
    known = keep_last(registry.withColumn("_key", shave_key(F.col("pattern"))), [*place, "_key"], [F.col("number")])
    names = known.select(*place, F.col("_key"), F.col("animal").alias("a_animal"))
    return rows.withColumn("_key", shave_key(F.col("a_name"))).join(names, [*place, "_key"], "left").drop("_key")


def unresolved(pairs: DataFrame, registry: DataFrame, place: Sequence[str] = ("experiment", "session", "box")) -> DataFrame:
    """Pairs with an unknown side and the reason; rows without two names are left out."""
    known = registry.select(*place, shave_key(F.col("pattern")).alias("_key")).distinct()
    out = None
    for side in "ab":
        missed = pairs.where("a_name IS NOT NULL AND b_name IS NOT NULL").withColumn("_key", shave_key(F.col(f"{side}_name"))).join(known, [*place, "_key"], "left_anti")
        part = missed.select(*pairs.columns, F.lit(f"{side} is not in the registry").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def alone_and_paired(alone: DataFrame, paired: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Animals recorded both ways, the last recording of each kind: key, alone, paired. Inputs have the key, a value and what the order needs."""
    a = keep_last(alone, [key], order).select(key, F.col("value").alias("alone"))
    return a.join(keep_last(paired, [key], order).select(key, F.col("value").alias("paired")), key)


def condition_group(experiment: Column, housing_a: Column, housing_b: Column) -> Column:
    """One of four condition groups, or unknown."""
    single = F.coalesce((housing_a == "SH") | (housing_b == "SH"), F.lit(False))
    return F.when(experiment == "hab", "GH_littermate").when((experiment == "test_day") & single, "SH_res_GH_int").when(experiment == "test_day", "GH_res_GH_int").when(experiment == "sh_intruder", "GH_res_SH_int").otherwise("unknown")


def focal_role(experiment: Column, housing: Column, role: Column) -> Column:
    """One of five roles of a focal animal, or unknown."""
    day, intruders = experiment == "test_day", experiment == "sh_intruder"
    return (
        F.when(experiment == "hab", "GH_littermate")
        .when(day & (housing == "SH") & (role == "resident"), "SH_resident").when(day & (housing == "GH") & (role == "resident"), "GH_resident").when(day & (housing == "GH") & (role == "intruder"), "GH_intruder")
        .when(intruders & (housing == "SH"), "SH_intruder").when(intruders & (housing == "GH") & (role == "resident"), "GH_resident").otherwise("unknown")
    )


def pair_roles(table: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row for each row and role whose rule holds; roles may overlap, and rows of none disappear."""
    held = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return table.withColumn("role", F.explode(held))


def role_rules(a_role: Column, a_housing: Column, b_role: Column, b_housing: Column, experiment: Column) -> dict[str, Column]:
    """The rules of the five roles of a pair."""
    either = lambda role, housing: ((a_role == role) & (a_housing == housing)) | ((b_role == role) & (b_housing == housing))
    return {
        "SH_resident": (experiment == "test_day") & either("resident", "SH"), "SH_intruder": (experiment == "sh_intruder") & ((a_housing == "SH") | (b_housing == "SH")),
        "GH_resident": experiment.isin("test_day", "sh_intruder") & either("resident", "GH"), "GH_intruder": (experiment == "test_day") & either("intruder", "GH"), "GH_littermate": experiment == "hab",
    }


def focal_rules(role: Column, housing: Column, experiment: Column) -> dict[str, Column]:
    """The rules of the five roles of a focal animal, for `pair_roles`; unlike `focal_role`, an animal may have several or none."""
    return {
        "SH_resident": (experiment == "test_day") & (role == "resident") & (housing == "SH"), "SH_intruder": (experiment == "sh_intruder") & (housing == "SH"),
        "GH_resident": experiment.isin("test_day", "sh_intruder") & (role == "resident") & (housing == "GH"), "GH_intruder": (experiment == "test_day") & (role == "intruder") & (housing == "GH"), "GH_littermate": experiment == "hab",
    }


def probed(videos: DataFrame, name: str = "name") -> DataFrame:
    """Adds camera and session of each video's name and, where the name tells neither, both null and a reason."""
    camera = video_camera(F.col(name))
    out = videos.withColumn("camera", camera).withColumn("session", F.when(F.col("camera").isNotNull(), video_session(F.col(name))))
    return out.withColumn("reason", F.when(F.col("camera").isNull(), "name is not camera_video_session_date_time.mp4"))


def all_resolved(probed_: DataFrame) -> DataFrame:
    """One row: names that tell their conditions, those that don't, and whether there are names and all do."""
    counts = probed_.agg(F.count_if(F.col("reason").isNull()).alias("resolvable"), F.count_if(F.col("reason").isNotNull()).alias("unresolved"))
    return counts.withColumn("all_resolved", (F.col("unresolved") == 0) & (F.col("resolvable") > 0))


def conditions(raw: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of a conditions table with blanks as null, that have one of the fields at least."""
    clean = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns])
    return clean.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


def condition_summary(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows by field and value."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")).select("f.*")
    return long.where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def eligibility(videos: DataFrame) -> DataFrame:
    """Whether a video may be queued, and why: the first rule that holds decides.

    Columns: anchored, propagated, status, stale, prompts.
    """
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("none"))
    rules = [
        (~F.coalesce("anchored", F.lit(False)), False, "anchor labeling incomplete"), (F.coalesce("propagated", F.lit(False)), False, "already tracked"),
        ((status == "running") & F.coalesce("stale", F.lit(True)), True, "ready, the earlier run went silent"), (status == "running", False, "running"),
        (status == "complete", False, "complete without a full track"), (F.coalesce("prompts", F.lit(0)) == 0, False, "no point prompts"), (status == "failed", True, "ready, a retry"),
    ]
    ok, why = F.lit(True), F.lit("ready")
    for rule, verdict, reason in reversed(rules):
        ok, why = F.when(rule, verdict).otherwise(ok), F.when(rule, reason).otherwise(why)
    return videos.withColumn("eligible", ok).withColumn("reason", why)


def stale(progress: Column, masks: Column, now: Column, seconds: float = 300) -> Column:
    """Whether the newer of two times is older than a limit; true if there is none."""
    newest = F.greatest(progress, masks)
    return F.coalesce(micros(now) - micros(newest) > F.lit(int(seconds * 1_000_000)), F.lit(True))


def complete(videos: DataFrame, frames: DataFrame, video: str = "video_id") -> DataFrame:
    """Videos with the missing frames of [start, n) and a verdict: incomplete, missing masks or complete. videos: start, n, flag."""
    spine = videos.where("n > start").select(video, F.explode(F.sequence(F.col("start"), F.col("n") - 1)).alias("frame_idx"))
    missing = spine.join(frames.select(video, "frame_idx").distinct(), [video, "frame_idx"], "left_anti").groupBy(video).agg(F.count(F.lit(1)).alias("missing"))
    out = videos.join(missing, video, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.withColumn("verdict", F.when(~F.col("flag"), "incomplete").when(F.col("missing") > 0, "missing masks").otherwise("complete"))


def fast_complete(videos: DataFrame, stores: DataFrame, video: str = "video_id") -> DataFrame:
    """Videos with a verdict that trusts their flag and looks for stored masks without reading frames. videos: flag, folder; stores: a row or more for each video with masks."""
    found = stores.select(video).distinct().withColumn("_found", F.lit(True))
    rules = F.when(~F.coalesce("flag", F.lit(False)), "incomplete").when(F.col("folder").isNull(), "no folder").when(F.col("_found").isNull(), "no masks")
    return videos.join(found, video, "left").withColumn("verdict", rules.otherwise("complete")).drop("_found")
