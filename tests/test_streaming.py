"""The streaming operators on a stream of files."""

import datetime
import math
import os
import random

from driftmark.operators import registration
from driftmark.streaming import live


def run(spark, df, path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql("SELECT * FROM out").collect()


def test_steps_go_on_across_batches(spark, tmp_path):
    schema = "video_id long, object_id string, frame_idx long, cx double, cy double"
    for i, rows in enumerate(([(1, "a", 0, 0.0, 0.0), (1, "a", 1, 3.0, 4.0)], [(1, "a", 2, 3.0, 10.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.frame_idx, r.step) for r in run(spark, live.deltas(stream), tmp_path / "c"))
    assert sorted(x[0] for x in got) == [0, 1, 2] and sum(s is None for _, s in got) == 1


def test_transition_counts_grow(spark, tmp_path):
    schema = "video_id long, start_frame long, cluster string"
    spark.createDataFrame([(1, i, c) for i, c in enumerate("AABA")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r.from_label, r.to_label): r.n for r in run(spark, live.transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "c", "update")}
    assert got == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 1}


def test_rows_of_a_batch_are_taken_in_the_order_of_frames(spark, tmp_path):
    """Also where a track's rows reach Python in several chunks."""
    schema = "video_id long, object_id string, frame_idx long, cx double, cy double"
    rows = [(1, "a", i, float(i), 0.0) for i in (7, 2, 9, 0, 5, 1, 8, 3, 6, 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = run(spark, live.deltas(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "c")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.frame_idx, r.step) for r in got if r.step is not None) == [(i, 1.0) for i in range(1, 10)]


def test_poses_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Frames of two objects shuffled over micro-batches, late by less than the watermark; one row is too late and is dropped."""
    ref = [("a", "nose", 0.0, 0.0), ("a", "mid", 10.0, 0.0), ("a", "tail", 20.0, 1.0), ("b", "one", 0.0, 0.0)]
    rng = random.Random(4)
    rows = []
    for f in range(60):
        for o, part, x, y in ref:
            gone = rng.random() < 0.1
            z = complex(x, y) * (1 + 0.3 * math.sin(f / 5)) * complex(math.cos(0.1 * f), math.sin(0.1 * f)) + complex(2 * f, rng.gauss(0, 1))
            rows.append((1, o, part, f, None if gone else z.real, None if gone else z.imag, rng.random() < 0.8, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=f)))
    schema = "video_id long, object_id string, part_id string, frame_idx long, x double, y double, visible boolean, ts timestamp"
    tracks = spark.createDataFrame(rows, schema)
    want = {(r.object_id, r.part_id, r.frame_idx): (r.x, r.y) for r in registration.regular_poses(tracks, spark.createDataFrame(ref, "object_id string, part_id string, x double, y double")).collect()}
    order = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 15))
    end = [(9, "z", "one", 0, 0.0, 0.0, True, datetime.datetime(2024, 1, 2))]
    batches = [order[:60], order[60:130], order[130:], end, [(1, "a", "nose", 3, 0.0, 0.0, True, datetime.datetime(2024, 1, 1, 0, 0, 3))]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"one{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"one{i}").glob("*.parquet"))
        target = tmp_path / "in" / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [r for r in run(spark, live.poses(stream, ref, late="20 seconds"), tmp_path / "c") if r.video_id == 1]
    assert len(got) == len(want)
    close = lambda p, q: (p is None or p != p) if q is None or q != q else math.isclose(p, q, abs_tol=1e-9)
    assert all(close(r.x, want[r.object_id, r.part_id, r.frame_idx][0]) and close(r.y, want[r.object_id, r.part_id, r.frame_idx][1]) for r in got)
