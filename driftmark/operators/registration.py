"""Registration of points into a common square, as column expressions over a video's matrix, and pose annotations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def project(x: Column, y: Column, h: Sequence[Column], dx: Column | float = 0.0, dy: Column | float = 0.0) -> tuple[Column, Column]:
    """A point through a homography of nine columns, moved by a canvas offset; null where the denominator vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w + dx, (h[3] * x + h[4] * y + h[5]) / w + dy


def affine_of_corners(corners: Sequence[tuple[Column, Column]], side: Column) -> list[Column]:
    """Six columns of the least-squares affine map of four corners (TL, TR, BR, BL) onto a square of a side, by the normal equations."""
    goal = [(F.lit(0.0), F.lit(0.0)), (side - 1, F.lit(0.0)), (side - 1, side - 1), (F.lit(0.0), side - 1)]
    total = lambda xs: sum(xs[1:], xs[0])
    mx, my = total([c[0] for c in corners]) / 4, total([c[1] for c in corners]) / 4
    u = [(c[0] - mx, c[1] - my) for c in corners]
    sxx, syy, sxy = total([a * a for a, _ in u]), total([b * b for _, b in u]), total([a * b for a, b in u])
    det = sxx * syy - sxy * sxy
    out = []
    for i in (0, 1):
        mean = total([g[i] for g in goal]) / 4
        tx, ty = total([a * g[i] for (a, _), g in zip(u, goal)]), total([b * g[i] for (_, b), g in zip(u, goal)])
        p, q = (tx * syy - ty * sxy) / det, (ty * sxx - tx * sxy) / det
        out += [p, q, mean - p * mx - q * my]
    return out


def ordered_corners(points: DataFrame, key: str) -> DataFrame:
    """Top left, top right, bottom right, bottom left of four points x, y of each key, by their sums and differences."""
    p, s, d = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("y") - F.col("x")
    return points.groupBy(key).agg(F.min_by(p, s).alias("tl"), F.min_by(p, d).alias("tr"), F.max_by(p, s).alias("br"), F.max_by(p, d).alias("bl"))


def canvas(points: DataFrame, side: int, limit: int = 20000) -> DataFrame:
    """Whole bounds of all points and the square of a side: x0, y0, x1, y1, and whether both sides are within a limit."""
    out = points.agg(F.least(F.floor(F.min("x")), F.lit(0)).alias("x0"), F.least(F.floor(F.min("y")), F.lit(0)).alias("y0"), F.greatest(F.ceil(F.max("x")), F.lit(side)).alias("x1"), F.greatest(F.ceil(F.max("y")), F.lit(side)).alias("y1"))
    return out.withColumn("ok", (F.col("x1") - F.col("x0") <= limit) & (F.col("y1") - F.col("y0") <= limit))


def known_registration(videos: DataFrame, registrations: DataFrame, video: str = "video_id", width: int = 640, height: int = 480) -> DataFrame:
    """Videos with their homography, null unless registered, and frame sides with defaults."""
    out = videos.join(registrations, video, "left")
    good = F.coalesce("registered", F.lit(False)) & F.col("h").isNotNull()
    return out.select(*videos.columns, F.when(good, F.col("h")).alias("h"), F.coalesce("frame_width", F.lit(width)).alias("frame_width"), F.coalesce("frame_height", F.lit(height)).alias("frame_height"))


def pose_rows(poses: DataFrame, video: str = "video_id", nested: str = "poses") -> DataFrame:
    """A nested map object > part > frame > (visible, x, y) as rows; frames that are no numbers are left out."""
    by_object = poses.select(video, F.explode(nested).alias("object_id", "_parts"))
    by_part = by_object.select(video, "object_id", F.explode("_parts").alias("part_id", "_frames"))
    rows = by_part.select(video, "object_id", "part_id", F.explode("_frames").alias("_frame", "_p"))
    return rows.select(video, "object_id", "part_id", F.col("_frame").try_cast("long").alias("frame_idx"), "_p.x", "_p.y", "_p.visible").where("frame_idx IS NOT NULL")


def reference_frames(rows: DataFrame, start: int, video: str = "video_id") -> DataFrame:
    """Of each video the fully labelled frame (all of its parts) nearest to start, the earlier of two. Rows that lie in tasks by video stay there; a task holds the parts of one video, not its frames."""
    marked = rows.select(video, "frame_idx", F.concat_ws("/", "object_id", "part_id").alias("k")).distinct()
    counted = marked.withColumn("parts", F.size(F.collect_set("k").over(W.partitionBy(video)))).where(F.col(video).isNotNull())
    full = counted.groupBy(video, "frame_idx", "parts").agg(F.count(F.lit(1)).alias("n")).where("n = parts")
    return full.groupBy(video).agg(F.min_by("frame_idx", F.struct(F.abs(F.col("frame_idx") - start), "frame_idx")).alias("reference"), F.count(F.lit(1)).alias("full_frames"))


def nearest_frames(wanted: DataFrame, frames: DataFrame, video: str = "video_id", at: str = "start", frame: str = "frame_idx", chunk: int = 100_000) -> DataFrame:
    """wanted with the nearest of its video's frames as `nearest`, the earlier of two; null where the video has none. Many places may be wanted of one video.

    Both sides are merged in the order of frames inside chunks of `chunk` frames; the last frame before a chunk and the first one after it are carried over from a
    table of one row for each video and chunk, so that no task holds a video. Rows without a place keep null. Repeated rows stay.
    """
    asked = wanted.select(F.struct(*[F.col(c) for c in wanted.columns]).alias("_row"), F.col(video).alias("_v"), F.col(at).cast("double").alias("_k"), F.lit(1).alias("_q"))
    held = frames.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(video).alias("_v"), F.col(frame).cast("double").alias("_k"), F.lit(0).alias("_q")).where("_k IS NOT NULL").distinct()
    both = asked.unionByName(held).withColumn("_c", F.floor(F.col("_k") / chunk))
    is_frame = F.when(F.col("_q") == 0, F.col("_k"))
    chunks = both.groupBy(F.col("_v").alias("_v2"), F.col("_c").alias("_c2")).agg(F.min(is_frame).alias("_first"), F.max(is_frame).alias("_last"))
    order = W.partitionBy("_v2").orderBy("_c2")
    carried = chunks.select("_v2", "_c2", F.max("_last").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inside = W.partitionBy("_v", "_c").orderBy("_k", "_q")
    merged_ = both.withColumn("_p", F.max(is_frame).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.min(is_frame).over(inside.rowsBetween(0, W.unboundedFollowing))).where("_q = 1")
    out = merged_.join(carried, F.col("_v").eqNullSafe(F.col("_v2")) & F.col("_c").eqNullSafe(F.col("_c2")), "left")
    low, high = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    nearest = F.when(F.col("_k").isNull(), None).when(high.isNull() | (F.col("_k") - low <= high - F.col("_k")), low).otherwise(high)
    return out.select("_row.*", nearest.cast("long").alias("nearest"))


def memory_weights(anchors: DataFrame, video: str = "video_id", part: str = "part_id", previous: float = 0.6) -> DataFrame:
    """Weight of each visible anchor of a part: what the previous frame leaves, shared; anchors: has_previous, visible."""
    n = F.count(F.when(F.col("visible"), 1)).over(W.partitionBy(video, part))
    share = F.when(F.col("has_previous"), 1 - previous).otherwise(1.0)
    return anchors.withColumn("weight", F.when(F.col("visible"), share / n))


def _eased(v: Column) -> Column:
    """A ramp from 0 to 1 with level ends."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return v * v * (3 - 2 * v)


def outside_distance(x: Column, y: Column, corners: Sequence[tuple[Column, Column]]) -> Column:
    """Distance of a point from a convex quadrilateral; 0 inside and on its border."""
    sides, signs = [], []
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        ex, ey = bx - ax, by - ay
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey)))
        sides.append(F.hypot(x - ax - along * ex, y - ay - along * ey))
        signs.append(ex * (y - ay) - ey * (x - ax))
    inside = (F.least(*signs) >= 0) | (F.greatest(*signs) <= 0)
    return F.when(inside, 0.0).otherwise(F.least(*sides))


def blended(x: Column, y: Column, h: Sequence[Column], corners: Sequence[tuple[Column, Column]], side: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point through a homography near the floor and through the affine map of its corners further out.

    The homography's weight falls with the distance from the floor, to nothing at 0.45 frame diagonals, and where its
    denominator is small beside the corners' or has the other sign; there the affine map, which is bounded, takes over.
    """
    bottom = lambda px, py: h[6] * px + h[7] * py + h[8]
    own, at_corners = bottom(x, y), [bottom(cx, cy) for cx, cy in corners]
    least = F.greatest(F.least(*[F.abs(w) for w in at_corners]), F.lit(1e-9))
    middle = F.sort_array(F.array(*at_corners))
    same = F.signum(own) == F.signum((middle[1] + middle[2]) / 2)
    reach = F.greatest(0.45 * F.hypot(width, height), F.lit(1.0))
    weight = _eased(1 - outside_distance(x, y, corners) / reach) * _eased((F.abs(own) - 0.15 * least) / (0.35 * least)) * F.when(same, 1.0).otherwise(0.0)
    px, py = project(x, y, h)
    a = affine_of_corners(corners, side)
    near = lambda p, q: F.when(weight > 0, weight * p).otherwise(0.0) + (1 - weight) * q
    return near(px, a[0] * x + a[1] * y + a[2]), near(py, a[3] * x + a[4] * y + a[5])


def warp(runs: DataFrame, h: Sequence[Column], width: int, height: int, keys: Sequence[str] = ("frame_idx", "object_id"), joined: bool = True, most_lines: int = 200_000) -> DataFrame:
    """Masks through a homography of nine columns onto a canvas, by nearest neighbour, as disjoint runs where the runs are disjoint.

    A canvas pixel is set if its place, taken back through the inverse and rounded, falls on a run. On a canvas column that place moves along a line, so that the
    pixels of one run are an interval: four inequalities that are linear in the row bound it, and only the pixels at its ends are taken back. Each run meets the
    canvas columns that it can reach, `most_lines` at a time, and not each pixel. Where a run's corners lie on both sides of the horizon all columns are tried.
    With `joined` runs that touch on the canvas become one.
    """
    import numpy as np
    import pyarrow as pa

    from driftmark.operators.masks import merged

    of = [f"_h{i}" for i in range(9)]
    rows = runs.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("x", "y0", "len")], *[(c * F.lit(1.0)).alias(n) for c, n in zip(h, of)]).dropna(subset=["x", "y0", "len", *of])
    names = [*keys, "x", "y0", "len"]

    def inverse(h):
        """The inverse, up to a factor, and the determinant."""
        cross = lambda i, j, k, m: h[i] * h[m] - h[j] * h[k]
        back = [cross(4, 5, 7, 8), cross(2, 1, 8, 7), cross(1, 2, 4, 5), cross(5, 3, 8, 6), cross(0, 2, 6, 8), cross(2, 0, 5, 3), cross(3, 4, 6, 7), cross(1, 0, 7, 6), cross(0, 1, 3, 4)]
        return back, cross(0, 1, 3, 4) * h[8] - cross(0, 2, 3, 5) * h[7] + cross(1, 2, 4, 5) * h[6]

    def moved(px, row, h):
        w = h[6] * px + h[7] * row + h[8]
        w = np.where(np.abs(w) > 1e-12, w, np.nan)
        return (h[0] * px + h[1] * row + h[2]) / w, (h[3] * px + h[4] * row + h[5]) / w

    def intervals(at, px, x, y0, y1, back, sign):
        """Which of the lines have pixels, and their first and last rows."""
        back, x, y0, y1, sign = [c[at] for c in back], x[at], y0[at], y1[at], sign[at]
        along = lambda i: (back[i] * px + back[i + 2], back[i + 1])  # noqa: E731  # constant and slope in the row
        (nx, mx), (ny, my), (nd, md) = along(0), along(3), along(6)
        begin, end = np.full(len(at), -1e18), np.full(len(at), 1e18)
        for n, m, low, high in ((nx, mx, x - 0.5, x + 0.5), (ny, my, y0 - 0.5, y1 + 0.5)):
            for p, q in ((sign * (n - low * nd), sign * (m - low * md)), (sign * (high * nd - n), sign * (high * md - m))):
                begin = np.maximum(begin, np.where(q > 0, -p / q, np.where((q == 0) & (p < -1e-9), 1e18, -1e18)))
                end = np.minimum(end, np.where(q < 0, -p / q, 1e18))
        first, last = np.maximum(0.0, np.ceil(begin - 1e-6)), np.minimum(height - 1.0, np.floor(end + 1e-6))
        reached = np.flatnonzero(first <= last)
        back, x, y0, y1, px, first, last = [c[reached] for c in back], x[reached], y0[reached], y1[reached], px[reached], first[reached], last[reached]

        def hit(row):
            sx, sy = moved(px, row, back)
            return (np.rint(sx) == x) & (np.rint(sy) >= y0) & (np.rint(sy) <= y1)

        first, last = np.where(hit(first), first, first + 1), np.where(hit(last), last, last - 1)
        kept = (first <= last) & hit(first) & hit(last)  # where the line runs along a border of the run, all its places are on one side
        return reached[kept], first[kept].astype(np.int64), last[kept].astype(np.int64)

    def run(batches):
        for batch in batches:
            x, y0, n, *h = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y0", "len", *of))
            y1 = y0 + n - 1
            corners = [(a, b) for a in (x - 1, x + 1) for b in (y0 - 1, y1 + 1)]
            below = [h[6] * a + h[7] * b + h[8] for a, b in corners]
            across = [moved(a, b, h)[0] for a, b in corners]
            plain = (np.minimum.reduce(below) > 0) | (np.maximum.reduce(below) < 0)
            first = np.where(plain, np.clip(np.floor(np.fmin.reduce(across)), 0, width), 0)
            last = np.where(plain, np.clip(np.ceil(np.fmax.reduce(across)), -1, width - 1), width - 1)
            lines = np.nan_to_num(np.maximum(last - first + 1, 0)).astype(np.int64)
            first, before = np.nan_to_num(first), np.append(0, np.cumsum(lines))
            back, det = inverse(h)
            # What is seen from in front of the horizon has the sign of the determinant and of the run's own denominator.
            sign = np.sign(det) * np.sign(h[6] * x + h[7] * (y0 + y1) / 2 + h[8])
            begin = 0
            while begin < len(x):
                end = max(begin + 1, int(np.searchsorted(before, before[begin] + most_lines, "right")) - 1)
                at = np.repeat(np.arange(begin, end), lines[begin:end])
                px = first[at] + np.arange(before[begin], before[end]) - before[at]
                kept, low, high = intervals(at, px, x, y0, y1, back, sign)
                own = pa.array(at[kept])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in keys], pa.array(px[kept].astype(np.int64)), pa.array(low), pa.array(high - low + 1)], names=names)
                begin = end

    def quiet(batches):
        with np.errstate(all="ignore"):
            yield from run(batches)

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(quiet, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return merged(out, keys) if joined else out


#: Scale, angle and angular speed of a track without frames so far.
START = (1.0, 0.0, 0.0)


def pose_step(state: tuple[float, float, float], at, shape, visible, strength: float, scale_step: float, turn_step: float):
    """One frame of a track: its landmarks drawn towards the shape, and the track's scale, angle and angular speed after it. at and shape are arrays of complex numbers; a landmark that is nan is not tracked."""
    import numpy as np

    scale, angle, speed = state
    seen = np.isfinite(at)
    middle = shape[seen].mean() if seen.sum() >= 2 else shape.mean()
    centre = at[seen].mean() if seen.any() else middle
    fit, turn = scale, angle
    if seen.sum() >= 2:
        s, z = shape[seen] - middle, at[seen] - centre
        straight = (np.conj(s) * z).sum()
        fit, turn = max(abs(straight), abs((s * z).sum())) / max((abs(s) ** 2).sum(), 1e-8), np.angle(straight)
    if fit >= max(0.55, 0.65 * scale):
        step = float(np.clip((turn - angle + np.pi) % (2 * np.pi) - np.pi, -turn_step, turn_step))
        speed = 0.75 * speed + 0.25 * step
    else:
        step = float(np.clip(speed, -turn_step, turn_step))
    scale = float(np.clip(fit, max(0.75, scale * (1 - scale_step)), min(2.0, scale * (1 + scale_step))))
    angle += step
    fitted = centre + scale * np.exp(1j * angle) * (shape - middle)
    share = np.where(visible & seen, strength, 1.0)
    return (1 - share) * np.where(seen, at, 0) + share * fitted, (scale, float(angle), float(speed))


def regular_poses(tracks: DataFrame, reference: DataFrame, strength: float = 0.9, scale_step: float = 0.025, turn_step: float = math.radians(20), video: str = "video_id") -> DataFrame:
    """Tracked landmarks drawn towards their object's reference shape, moved, turned and scaled to fit.

    tracks: video, object_id, part_id, frame_idx, x, y (null: not tracked), visible; reference: object_id, part_id, x, y. A frame's shape is fitted to the landmarks that
    are tracked. Scale and turn follow the fit by `scale_step` and `turn_step` at most from frame to frame; where the landmarks have collapsed the turn goes
    on as before. Visible landmarks become `strength` of the fitted shape, others the shape itself. Objects of one landmark are left as they are.
    A track depends on its frames' order, so each one is gone through in one task; `streaming.live.poses` does the same on a stream.
    """
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_idx", "part_id"])
        columns = ["video_id", "object_id", "part_id", "frame_idx", "x", "y"]
        if pdf["part_id"].nunique() < 2:
            return pdf[columns]
        state, out = START, []
        for _, rows in pdf.groupby("frame_idx", sort=True):
            at = rows["x"].to_numpy(float) + 1j * rows["y"].to_numpy(float)
            shape = rows["rx"].to_numpy(float) + 1j * rows["ry"].to_numpy(float)
            new, state = pose_step(state, at, shape, rows["visible"].to_numpy(bool), strength, scale_step, turn_step)
            out.append(rows.assign(x=new.real, y=new.imag)[columns])
        return pd.concat(out)

    shapes = reference.select("object_id", "part_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    rows = tracks.select(F.col(video).alias("video_id"), "object_id", "part_id", "frame_idx", "x", "y", F.coalesce("visible", F.lit(False)).alias("visible")).join(shapes, ["object_id", "part_id"])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("video_id", "object_id", "part_id", "frame_idx")) + ", x double, y double"
    return rows.groupBy("video_id", "object_id").applyInPandas(walk, schema).withColumnRenamed("video_id", video)
