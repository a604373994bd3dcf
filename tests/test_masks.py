"""Stored masks, warps and poses on small cases."""

import math
import pickle
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.operators import masks as shapes
from driftmark.operators import registration
from driftmark.sources import masks, stored


def packed(dense):
    """A mask as a compressed run-length text, by the public format."""
    flat = dense.T.ravel()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat, [2]])))
    counts = np.diff(np.concatenate([[0], edges])).tolist()
    text = b""
    for i, n in enumerate(counts):
        n -= counts[i - 2] if i > 2 else 0
        while True:
            bits, n = n & 31, n >> 5
            more = not (n == 0 and not bits & 16 or n == -1 and bits & 16)
            text += bytes([48 + (bits | 32 * more)])
            if not more:
                break
    return text


def store(path, frames):
    path.parent.mkdir()
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")  # as stores are written
    con.execute("CREATE TABLE frame_segmentation (frame_idx INTEGER NOT NULL PRIMARY KEY, seg_blob BLOB NOT NULL, bbox_json TEXT NOT NULL DEFAULT '{}', updated_at TEXT NOT NULL DEFAULT (datetime('now')))")
    for f, held in frames.items():
        rles = {k: {"size": list(m.shape), "counts": packed(m)} for k, m in held.items()}
        h, w = next(iter(held.values())).shape if held else (0, 0)
        blob = masks.MAGIC + masks.VERSION.to_bytes(4, "big") + zlib.compress(pickle.dumps({"h": h, "w": w, "rles": rles}, protocol=4))
        con.execute("INSERT INTO frame_segmentation (frame_idx, seg_blob) VALUES (?, ?)", (f, blob))
    con.commit()
    con.close()


def test_stored_masks_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    blob = np.zeros((120, 90), dtype=np.uint8)
    blob[10:90, 20:70] = 1
    videos = {"v1": {0: {"1": rng.integers(0, 2, (30, 20)).astype(np.uint8), "2": np.zeros((30, 20), np.uint8)}, 7: {"1": np.ones((30, 20), np.uint8)}, 9: {}}, "v2": {3: {"5": blob}}}
    for v, frames in videos.items():
        store(tmp_path / v / "masks.sqlite", frames)
    found = masks.stores(spark, str(tmp_path / "*" / "masks.sqlite"))
    got = {(r.video_id, r.frame_idx, r.object_id, r.x, r.y) for r in shapes.pixels(masks.mask_runs(found), ["video_id", "frame_idx", "object_id"]).collect()}
    assert got == {(v, f, o, int(x), int(y)) for v, frames in videos.items() for f, held in frames.items() for o, m in held.items() for y, x in np.argwhere(m)}
    assert sorted((r.video_id, r.frame_idx) for r in masks.frame_rows(found).collect()) == [("v1", 0), ("v1", 7), ("v1", 9), ("v2", 3)]


def masks_of_videos():
    rng = np.random.default_rng(1)
    return {v: {f: {o: rng.integers(0, 2, (9, 7)).astype(np.uint8) for o in ("1", "2", "x'y")[: 1 + f % 3]} for f in range(0, 60, 1 + i)} for i, v in enumerate(("v 1%", "v2", "v3"))}


def runs_of(videos):
    return sorted((v, f, o, int(x), int(y), 1) for v, frames in videos.items() for f, held in frames.items() for o, m in held.items() for y, x in np.argwhere(m))


def test_shares_of_a_store_are_read_apart(spark, tmp_path):
    videos = masks_of_videos()
    for v, frames in videos.items():
        store(tmp_path / v / "masks.sqlite", frames)
    got = stored.read(spark, str(tmp_path / "*" / "masks.sqlite"), bytes_per_task=4_096)
    assert got.rdd.getNumPartitions() > 6
    pixels = lambda df: sorted(tuple(r) for r in df.selectExpr("video_id", "frame_idx", "object_id", "x", "explode(sequence(y0, y0 + len - 1)) AS y", "1L AS n").collect())
    every = runs_of(videos)
    assert pixels(got) == every
    part = lambda **wanted: stored.read(spark, str(tmp_path / "*" / "masks.sqlite"), bytes_per_task=4_096, **wanted)
    for wanted, keep in (
        ({"start": 10, "stop": 20}, lambda r: 10 <= r[1] <= 20), ({"start": 55}, lambda r: r[1] >= 55), ({"stop": 0}, lambda r: r[1] == 0), ({"start": 5, "stop": 4}, lambda r: False), ({"start": 1000}, lambda r: False),
        ({"videos": ["v 1%", "none"], "objects": ["1", "x'y"]}, lambda r: r[0] == "v 1%" and r[2] != "2"), ({"videos": []}, lambda r: False), ({"objects": []}, lambda r: False),
    ):
        assert pixels(part(**wanted)) == [r for r in every if keep(r)], wanted
    both = pixels(got.where("frame_idx = 2").union(got.where("frame_idx = 4")))  # scans of one DataFrame don't disturb each other
    assert both == [r for r in every if r[1] in (2, 4)] and pixels(got) == every
    frames = stored.read(spark, str(tmp_path / "*" / "masks.sqlite"), "frames", ["frame_idx", "video_id"])
    assert sorted((r.video_id, r.frame_idx) for r in frames.where("frame_idx >= 30").collect()) == sorted((v, f) for v, held in videos.items() for f in held if f >= 30)
    assert frames.where("frame_idx IS NULL").count() == 0
    whole = stored.read(spark, str(tmp_path / "v2" / "masks.sqlite"), "frames").where("frame_idx = 4").first()
    assert (whole.video_id, whole.bbox_json, whole.seg_bytes > 12, len(whole.updated_at)) == ("v2", "{}", True, 19)
    assert stored.read(spark, str(tmp_path / "none" / "*")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "masks.sqlite").write_bytes(b"no store")
    with pytest.raises(Exception, match="file is not a database"):
        stored.read(spark, str(tmp_path / "bad" / "masks.sqlite")).count()


def test_only_what_is_wanted_is_read(tmp_path):
    store(tmp_path / "v" / "masks.sqlite", {f: {"1": np.ones((4, 4), np.uint8), "2": np.ones((4, 4), np.uint8)} for f in range(100)})
    path = str(tmp_path / "v" / "masks.sqlite")
    reader = stored.StoredReader(path, "runs", masks.RUN_NAMES, 1_000, stored.Wanted(low=40, high=43, objects=frozenset({"2"})))
    shares = reader.partitions()
    assert len(shares) == 4  # no more than frames
    assert [[f for f, _ in reader._rows(s, "frame_idx, seg_blob")] for s in shares] == [[40], [41], [42], [43]]
    assert {o for s in shares for b in reader.read(s) for o in b.column("object_id").to_pylist()} == {"2"}
    assert [s.path for s in stored.StoredReader(path, "runs", masks.RUN_NAMES, 1_000, stored.Wanted(videos=frozenset({"w"}))).partitions()] == [""]


def test_rows_in_the_log_are_seen(tmp_path):
    path = tmp_path / "v" / "masks.sqlite"
    store(path, {1: {"1": np.ones((2, 2), np.uint8)}})
    writer = sqlite3.connect(path)
    writer.execute("INSERT INTO frame_segmentation (frame_idx, seg_blob) SELECT 2, seg_blob FROM frame_segmentation")
    writer.commit()
    reader = stored.StoredReader(str(path), "frames", ["frame_idx"], 1 << 20)
    assert [f for s in reader.partitions() for b in reader.read(s) for f in b.column("frame_idx").to_pylist()] == [1, 2]
    writer.close()


def test_packed_stores_come_back(spark):
    videos = masks_of_videos()
    rows = runs_of(videos) + [("v2", 0, "1", 0, 0, 3), ("v2", 0, "1", 0, 2, 4), (None, 1, "1", 0, 0, 1), ("v2", None, "1", 0, 0, 1), ("n", -5, "1", 2, 0, 9)]
    packed_ = masks.packed_stores(spark.createDataFrame(rows, masks.RUNS), height=9, frames=7)
    assert packed_.where("video_id = 'v2'").count() == 9
    got = {(r.video_id, r.frame_idx, r.object_id, r.x, r.y) for r in masks.mask_runs(packed_).selectExpr("video_id", "frame_idx", "object_id", "x", "explode(sequence(y0, y0 + len - 1)) AS y").collect()}
    assert got == {(v, f, o, x, y0 + i) for v, f, o, x, y0, n in rows if v is not None and f is not None for i in range(n)}
    assert masks.mask_runs(masks.packed_stores(spark.createDataFrame([], masks.RUNS), height=9)).count() == 0
    with pytest.raises(Exception, match="leaves its column"):
        masks.packed_stores(spark.createDataFrame([("v", 0, "1", 0, 5, 5)], masks.RUNS), height=9).count()


def test_payloads_that_name_code_are_refused():
    class Bad:
        def __reduce__(self):
            return print, ("run",)

    blob = masks.MAGIC + masks.VERSION.to_bytes(4, "big") + zlib.compress(pickle.dumps(Bad()))
    for bad in (blob, b"", b"other"):
        try:
            masks.payload(bad)
        except (ValueError, pickle.UnpicklingError):
            continue
        raise AssertionError("was read")


def test_a_pixel_moves_by_the_canvas_offset(spark):
    runs = spark.createDataFrame([(0, "1", 0, 0, 1), (0, "2", 4, 3, 5)], "frame_idx long, object_id string, x long, y0 long, len long")
    h = [F.lit(float(v)) for v in (1, 0, 3, 0, 1, 2, 0, 0, 1)]
    got = {(r.object_id, r.x, r.y0, r.len) for r in registration.warp(runs, h, 15, 14).collect()}
    assert got == {("1", 3, 2, 1), ("2", 7, 5, 5)}


def test_a_quad_fills_the_square(spark):
    """A mask of the quadrilateral that the homography takes to the square of 100 covers nearly all of it."""
    corners, side = [(20.0, 10.0), (90.0, 20.0), (80.0, 90.0), (10.0, 80.0)], 100
    goal = [(0, 0), (side - 1, 0), (side - 1, side - 1), (0, side - 1)]
    rows = [r for (x, y), (u, v) in zip(corners, goal) for r in ((x, y, 1, 0, 0, 0, -u * x, -u * y), (0, 0, 0, x, y, 1, -v * x, -v * y))]
    h = np.append(np.linalg.solve(np.array(rows), np.array(goal, float).ravel()), 1.0)
    inside = lambda x, y: all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for a, b in zip(corners, corners[1:] + corners[:1]))
    pixels = spark.createDataFrame([(0, "1", x, y) for x in range(100) for y in range(100) if inside(x, y)], "frame_idx long, object_id string, x long, y long")
    out = registration.warp(shapes.runs_of(pixels), [F.lit(float(v)) for v in h], side, side)
    assert out.agg(F.sum("len")).first()[0] > 9500


def test_poses_keep_their_shape(spark):
    ref = {"nose": (0.0, 0.0), "mid": (10.0, 0.0), "tail": (20.0, 1.0)}
    turn = lambda p, a, dx, dy: (p[0] * math.cos(a) - p[1] * math.sin(a) + dx, p[0] * math.sin(a) + p[1] * math.cos(a) + dy)
    rows = []
    for f in range(30):
        for part, p in ref.items():
            x, y = turn(p, 0.05 * f, 3.0 * f, 50.0)
            rows.append((1, "a", part, f, None if (part, f) == ("mid", 12) else x, None if (part, f) == ("mid", 12) else y + (6.0 if (part, f) == ("tail", 20) else 0.0), part != "tail" or f != 25))
    rows.append((1, "b", "one", 0, 5.0, 5.0, True))
    tracks = spark.createDataFrame(rows, "video_id long, object_id string, part_id string, frame_idx long, x double, y double, visible boolean")
    shape = spark.createDataFrame([("a", k, *v) for k, v in ref.items()] + [("b", "one", 0.0, 0.0)], "object_id string, part_id string, x double, y double")
    got = {(r.object_id, r.part_id, r.frame_idx): (r.x, r.y) for r in registration.regular_poses(tracks, shape).collect()}
    assert len(got) == len(rows) and got["b", "one", 0] == (5.0, 5.0)
    true = lambda part, f: turn(ref[part], 0.05 * f, 3.0 * f, 50.0)
    assert np.allclose(got["a", "nose", 10], true("nose", 10), atol=1e-6)
    assert np.allclose(got["a", "mid", 12], true("mid", 12), atol=0.5)  # from the other two
    assert abs(got["a", "tail", 20][1] - true("tail", 20)[1]) < 4.0  # drawn back


def random_masks(seed, count=12, width=14, height=12):
    """Pixels of masks with holes, diagonals and single pixels."""
    rng = np.random.default_rng(seed)
    return {(m % 4, f"o{m // 4}"): {(x, y) for x in range(width) for y in range(height) if rng.random() < (0.2, 0.45, 0.6, 0.9)[m % 4]} for m in range(count)}


def as_runs(spark, found):
    pixels = spark.createDataFrame([(*k, x, y) for k, p in found.items() for x, y in p], "frame_idx long, object_id string, x long, y long")
    return shapes.runs_of(pixels).select("frame_idx", "object_id", "x", "y0", "len")


def test_borders_and_parts_of_random_masks(spark):
    found = random_masks(21)
    runs = as_runs(spark, found)
    want = {(*k, x, y) for k, p in found.items() for x, y in p if not {(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)} <= p}
    assert {tuple(r) for r in shapes.boundary(runs).select("frame_idx", "object_id", "x", "y").collect()} == want
    inner = shapes.boundary_runs(runs).withColumn("end", F.col("y0") + F.col("len"))
    assert inner.agg(F.sum("len")).first()[0] == len(want)
    by = {}
    for r in shapes.components(runs).collect():
        for y in range(r.y0, r.y0 + r.len):
            by[r.frame_idx, r.object_id, r.x, y] = r.part
    for k, p in found.items():
        left, number = sorted(p), {}
        for start in left:
            if start not in number:
                todo = [start]
                number[start] = start
                while todo:
                    x, y = todo.pop()
                    for q in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if q in p and q not in number:
                            number[q] = start
                            todo.append(q)
        assert len({(by[(*k, *q)], number[q]) for q in p}) == len({by[(*k, *q)] for q in p}) == len(set(number.values()))


def test_nearest_points_of_sampled_contours(spark):
    found = random_masks(22)
    sample = shapes.contour_sample(shapes.boundary(as_runs(spark, found)), 20)
    points = {}
    for r in sample.collect():
        points.setdefault((r.frame_idx, r.object_id), []).append((r.x, r.y))
    assert max(map(len, points.values())) <= 20
    want = {(f, a, b): min(math.dist(p, q) for p in points[f, a] for q in points[f, b]) for f in range(4) for a in ("o0", "o1", "o2") for b in ("o0", "o1", "o2") if a < b and (f, a) in points and (f, b) in points}
    got = {(r.frame_idx, r.a, r.b): r.distance for r in shapes.contour_distances(sample).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("h", [(1.3, 0.2, 2, -0.4, 1.1, 6, 0.01, -0.008, 1), (-1.03, 0.13, 20, 0.21, -1.41, 22, 0, 0.01, 1), (0.5, 0, 1, 0, 0.5, 1, 0, 0, 1), (2.0, 0, 0, 0, 2.0, 0, 0, 0, 1), (13, 2, 20, -4, 11, 60, 0.1, -0.08, 10), (-1.3, -0.2, -2, 0.4, -1.1, -6, -0.01, 0.008, -1)])
def test_warps_are_those_of_every_pixel(spark, h):
    found = random_masks(23)
    inverse = np.linalg.inv(np.array(h, float).reshape(3, 3))
    forward = np.array(h, float).reshape(3, 3)
    want = set()
    for k, p in found.items():
        for x in range(30):
            for y in range(30):
                back = inverse @ (x, y, 1)
                sx, sy = back[:2] / back[2]
                if (int(np.rint(sx)), int(np.rint(sy))) in p and (forward @ (sx, sy, 1))[2] * (forward @ (7, 6, 1))[2] > 0:
                    want.add((*k, x, y))
    out = shapes.pixels(registration.warp(as_runs(spark, found), [F.lit(float(v)) for v in h], 30, 30))
    got = [tuple(r) for r in out.select("frame_idx", "object_id", "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("batch, most_pairs", [(3, 5), (10_000, 1_000_000)])
def test_distances_of_runs_are_those_of_their_pixels(spark, batch, most_pairs):
    """Frames across batches and pairs in pieces; a frame of one object and rows without a frame give no pair."""
    rng = np.random.default_rng(3)
    rows = [(f, o, int(x), int(y), int(n)) for f in range(6) for o in "abc"[: 1 + f % 3] for x, y, n in zip(rng.integers(0, 40, 5), rng.integers(0, 40, 5), rng.integers(1, 6, 5))]
    schema = "frame_idx long, object_id string, x long, y0 long, len long"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.frame_idx, r.a, r.b): r.distance for r in shapes.contour_distances(spark.createDataFrame([*rows, (None, "a", 1, 1, 1), (None, "b", 1, 1, 1)], schema), most_pairs=most_pairs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    points = {}
    for f, o, x, y, n in rows:
        points.setdefault((f, o), []).extend((x, y + i) for i in range(n))
    want = {(f, a, b): min(math.dist(p, q) for p in points[f, a] for q in points[g, b]) for f, a in points for g, b in points if f == g and a < b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_warped_runs_need_not_be_joined_to_be_disjoint(spark):
    """Lines in small pieces, and a mask whose homography is missing, which gives no rows."""
    rng = np.random.default_rng(4)
    rows = [(0, o, int(x), int(y), 3) for o in "ab" for x, y in {(x, 4 * y) for x, y in zip(rng.integers(0, 12, 20).tolist(), rng.integers(0, 4, 20).tolist())}]
    runs = spark.createDataFrame(rows, "frame_idx long, object_id string, x long, y0 long, len long")
    h = [F.when(F.col("object_id") == "a", F.lit(float(v))) for v in (1.6, 0.2, 1, 0.1, 1.3, 2, 0.001, 0.002, 1)]
    listed = lambda df: sorted((r.object_id, r.x, r.y) for r in shapes.pixels(df).collect())
    apart = listed(registration.warp(runs, h, 30, 30, joined=False, most_lines=7))
    assert apart and len(apart) == len(set(apart)) and {r[0] for r in apart} == {"a"}
    assert apart == listed(registration.warp(runs, h, 30, 30))


def test_reference_frames_stay_in_the_tasks_of_their_videos(spark):
    rows = [(1, "o", "p", 3), (1, "o", "q", 3), (1, "o", "p", 9), (1, "o", "q", 9), (1, "o", "q", 9), (1, "o", "p", 6), (2, "o", "p", 8), (3, "o", "p", 1), (3, "o", "q", 2), (None, "o", "p", 6)]
    dealt = spark.createDataFrame(rows, "video_id long, object_id string, part_id string, frame_idx long").repartition(7, "video_id")
    out = registration.reference_frames(dealt, 6)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in out.collect()} == {(1, 3, 2), (2, 8, 1)}


def test_nearest_frames_across_chunks(spark):
    rng = np.random.default_rng(31)
    frames = [(int(v), int(f)) for v in range(5) for f in rng.choice(4000, 12, replace=False)] + [(0, 7), (0, 7)]
    wanted = [(int(v), int(s), i) for i, (v, s) in enumerate(zip(rng.integers(0, 7, 300), rng.integers(-50, 4100, 300)))] + [(1, None, 300), (0, 7, 301), (0, 7, 301)]
    w = spark.createDataFrame(wanted, "video_id long, start long, _k long")
    f = spark.createDataFrame(frames, "video_id long, frame_idx long")
    by = {v: sorted({x for u, x in frames if u == v}) for v in range(7)}
    want = sorted((i, min(by[v], key=lambda x: (abs(x - s), x)) if s is not None and by[v] else None) for v, s, i in wanted)
    for chunk in (50, 100_000):
        got = registration.nearest_frames(w, f, chunk=chunk)
        assert got.columns == ["video_id", "start", "_k", "nearest"] and sorted((r["_k"], r.nearest) for r in got.collect()) == want


def test_merged_runs_are_the_pixels_in_small_tasks(spark):
    """A task's rows are bounded by `task_rows`, whatever the table's size."""
    rng = np.random.default_rng(5)
    rows = [(int(f), "ab"[o], int(x), int(y), int(n)) for f, o, x, y, n in zip(rng.integers(0, 60, 3000), rng.integers(0, 2, 3000), rng.integers(0, 4, 3000), rng.integers(0, 40, 3000), rng.integers(0, 5, 3000))]
    runs = spark.createDataFrame(rows, "frame_idx long, object_id string, x long, y0 long, len long")
    out = shapes.merged(runs, task_rows=100)
    assert out.rdd.getNumPartitions() == 30
    got = out.collect()
    assert {(r.frame_idx, r.object_id, r.x, y) for r in got for y in range(r.y0, r.y0 + r.len)} == {(f, o, x, y + i) for f, o, x, y, n in rows for i in range(n)}
    ends = {(r.frame_idx, r.object_id, r.x, r.y0 + r.len) for r in got}
    assert len(ends) == len(got) and not any((r.frame_idx, r.object_id, r.x, r.y0) in ends for r in got)
    assert sorted(map(tuple, shapes.merged(runs, task_rows=None).collect())) == sorted(map(tuple, got))


def test_tasks_of_masks_grow_in_number_and_not_in_size(spark):
    """A task sorts at most about 200,000 rows from small tables on."""
    many = spark.range(900_000).selectExpr("id DIV 4 AS frame_idx", "CASE WHEN id % 8 < 4 THEN 'A' ELSE 'N' END AS object_id", "id % 4 AS x", "id % 9 AS y0", "3L AS len")
    assert shapes.merged(many).rdd.getNumPartitions() == 5
    found = shapes.large_components(shapes.merged(many.where("id < 4000")), least=3, together=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    apart = shapes.components(shapes.merged(many.where("id < 4000"))).groupBy("frame_idx", "part").count().groupBy("frame_idx").count()
    assert {r.frame_idx: r.components for r in found.collect()} == {r[0]: r[1] for r in apart.collect()}


def test_many_tasks_of_masks_are_dealt_without_a_sort(spark):
    """past 200 partitions a task that deals rows out sorts all it reads; up to 6 times as many rows go to a task before that."""
    runs = spark.range(3000).selectExpr("id DIV 6 AS frame_idx", "CASE WHEN id % 6 < 3 THEN 'A' ELSE 'N' END AS object_id", "id % 3 AS x", "id % 9 AS y0", "3L AS len")
    for task_rows, tasks in ((20, 150), (10, 200), (3, 200), (1, 500)):
        out = shapes.merged(runs, task_rows=task_rows)
        assert out.rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, runs.collect()))
