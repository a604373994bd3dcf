"""Readers and writers on files of their own."""

import json

from driftmark.sources import tables

PROJECT = {
    "project_id": "p", "name": "n",
    "videos": {
        "v1": {"name": "a.mp4", "num_frames": 10, "anchor_batch_size": "x", "objects": {"1": {"name": "noshave"}}, "point_prompts": {"1": {"3": {"points": [[1.0, 2.0], [3.0, 4.0]], "labels": [1, 0]}, "bad": {"points": []}}}, "propagation_complete": True, "whole_video_inference": {"status": "running", "updated_at": None, "host": "h"},
            "anchor_labeling_timing": {"frames": {"3": {"entered_frontend_ms": 5, "committed_ms": 9}, "x": {"entered_frontend_ms": 1}, "4": {"entered_frontend_ms": 7, "committed_ms": 11, "duration_ms": 4}}, "video": {"first_anchor_entered_ms": 5, "last_anchor_committed_ms": 11, "whole_video_labeling_wall_ms": 6, "sum_anchor_durations_ms": 4}}},
        "v2": {"name": "b.mp4", "anchor_batch_size": "5", "whole_video_inference": {"status": "running"}}, "v3": {"name": "c.mp4"},
    },
}


def test_project_file(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps(PROJECT))
    p = tables.projects(spark, str(tmp_path / "config.json"))
    videos = {r.video_id: r for r in tables.videos(p).collect()}
    assert (videos["v1"].anchor_batch_size, videos["v2"].anchor_batch_size, videos["v2"].num_frames, videos["v1"].fps, *[videos[v].status for v in ("v1", "v2", "v3")]) == (1000, 10, 0, 30.0, "complete", "running", "none")
    prompts = tables.prompts(p).collect()
    assert [(r.frame_idx, len(r.points)) for r in prompts] == [(3, 2)]
    assert [r.name for r in tables.objects(p).collect()] == ["noshave"]
    assert [(r.frame_idx, r.entered_ms, r.duration_ms) for r in tables.timing(p).orderBy("frame_idx").collect()] == [(3, 5, None), (4, 7, 4)]
    assert [tuple(r) for r in tables.video_timing(p).collect()] == [("v1", 5, 11, 6, 4)]


def test_progress_lines_that_are_no_numbers_are_skipped(spark, tmp_path):
    (tmp_path / "progress.txt").write_text("1\n 2 \nx\n\n3\n")
    assert sorted(r.frame_idx for r in tables.progress(spark, str(tmp_path / "progress.txt")).collect()) == [1, 2, 3]


def test_samples_by_stem(spark, tmp_path):
    (tmp_path / "a.csv").write_text("value\n1.5\nx\n")
    (tmp_path / "b.csv").write_text("value\n2\n")
    assert sorted((r.name, r.value) for r in tables.samples(spark, str(tmp_path)).collect()) == [("a", 1.5), ("b", 2.0)]


def test_registry_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("experiment,experiment_name,session,box,mouse_id,shave_pattern,role,housing\n1,hab,s,3,m1,noshave,resident,GH\n")
    assert tables.registry(spark, str(tmp_path / "r.csv")).first().box == 3


def test_conditions_come_back_from_their_template(spark, tmp_path):
    v = spark.createDataFrame([("v1", "a.mp4"), ("v2", "b.mp4")], "video_id string, name string")
    tables.conditions_template(v, str(tmp_path / "t"))
    assert tables.conditions_file(spark, str(tmp_path / "t")).count() == 0
    (tmp_path / "c.csv").write_text(",".join(tables.CONDITIONS) + "\nv1,a.mp4, x ,,,,,\nv2,b.mp4,,  ,,,,note\n")
    assert [(r.video_id, r.condition) for r in tables.conditions_file(spark, str(tmp_path / "c.csv")).collect()] == [("v1", "x")]


def test_only_written_keys_are_replaced(spark, tmp_path):
    path = str(tmp_path / "f")
    t = spark.createDataFrame([("v1", 1.0), ("v2", 2.0)], "video_id string, x double")
    tables.write_partitioned(t, path, ["video_id"])
    tables.write_partitioned(spark.createDataFrame([("v2", 5.0)], "video_id string, x double"), path, ["video_id"])
    got = tables.read_features(spark, path, ["video_id", "absent"], ["x"])
    assert got.columns == ["video_id", "x"] and sorted(map(tuple, got.collect())) == [("v1", 1.0), ("v2", 5.0)]


def test_tables_of_many_videos(spark, tmp_path):
    for v, rows in (("v1", "1\n2\n"), ("v2", "")):
        (tmp_path / v).mkdir()
        (tmp_path / v / "t.csv").write_text("n\n" + rows)
    assert sorted((r.video_id, r.n) for r in tables.project_tables(spark, str(tmp_path), "n int").collect()) == [("v1", 1), ("v1", 2)]
    tables.save_results({"a": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/a.parquet")).count() == 3
