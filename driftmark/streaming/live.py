"""Streaming forms of the window, coverage and transition operators. Inputs are streaming (or batch) DataFrames with an event time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftmark.operators.registration import START, pose_step


def activity(steps: DataFrame, keys: tuple[str, ...], time: str = "ts", step: str = "step", length: str = "3 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Distance and frames of each key in sliding windows of event time; rows later than the watermark are dropped."""
    out = steps.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w"), *keys).agg(F.sum(step).alias("distance"), F.count(F.lit(1)).alias("frames"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "distance", "frames")


def coverage(progress: DataFrame, keys: tuple[str, ...], time: str = "ts", length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Progress rows and the highest frame of each key in tumbling windows."""
    out = progress.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("frames"), F.max("frame_idx").alias("last_frame"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "frames", "last_frame")


def sessions(progress: DataFrame, keys: tuple[str, ...], time: str = "ts", gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity that end when nothing comes for a gap: a run is stale from session_end on."""
    out = progress.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("frames"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "frames")


class Deltas(StatefulProcessor):
    """Keeps the last position of a track, and returns each row's step from it, shortened to a largest step if there is one."""

    def __init__(self, largest: float | None = None):
        self.largest = largest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.last.get() if self.last.exists() else None
        # A track's rows of one batch come in several frames of data, in no order.
        out = []
        for r in pd.concat(rows).sort_values("frame_idx").itertuples():
            x, y = float(r.cx), float(r.cy)
            if at is not None and self.largest is not None and (d := ((x - at[0]) ** 2 + (y - at[1]) ** 2) ** 0.5) > self.largest:
                x, y = at[0] + (x - at[0]) * self.largest / d, at[1] + (y - at[1]) * self.largest / d
            out.append((*key, r.frame_idx, x, y, None if at is None else ((x - at[0]) ** 2 + (y - at[1]) ** 2) ** 0.5))
            at = (x, y)
        yield pd.DataFrame(out, columns=["video_id", "object_id", "frame_idx", "x", "y", "step"])
        if at is not None:
            self.last.update(at)

    def close(self) -> None:
        pass


def deltas(tracks: DataFrame, largest: float | None = None) -> DataFrame:
    """Steps of each track across batches, by video_id and object_id; rows of a batch are taken in the order of their frames."""
    rows = tracks.where("cx IS NOT NULL AND cy IS NOT NULL").select("video_id", "object_id", "frame_idx", "cx", "cy")
    schema = "video_id long, object_id string, frame_idx long, x double, y double, step double"
    return rows.groupBy("video_id", "object_id").transformWithStateInPandas(Deltas(largest), schema, "append", "none")


POSES = "video_id long, object_id string, part_id string, frame_idx long, x double, y double"


class Poses(StatefulProcessor):
    """Smooths the landmarks of a track, frame after frame, although frames come in any order.

    Frames are held until the watermark has passed their time, when no earlier one can come any more; a timer for each time that is held releases them in the order of their
    numbers. Scale, angle and angular speed of the track are kept. `idle` milliseconds after its last row a track is forgotten.
    """

    def __init__(self, shapes: dict[str, dict[str, complex]], strength: float, scale_step: float, turn_step: float, idle: int):
        self.shapes, self.strength, self.scale_step, self.turn_step, self.idle = shapes, strength, scale_step, turn_step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pose = handle.getValueState("pose", "scale double, angle double, speed double, frame long, last long")
        self.held = handle.getListState("held", "frame_idx long, part_id string, x double, y double, visible boolean, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)
        state = self.pose.get() if self.pose.exists() else (*START, None, 0)
        if state[3] is not None:
            new = new[new["frame_idx"] > state[3]]  # a frame behind those that went out comes too late
        if len(new):
            x, y = new["x"].astype(float), new["y"].astype(float)
            self.held.appendList([(int(f), p, None if a != a else a, None if b != b else b, bool(v), int(t)) for f, p, a, b, v, t in zip(new["frame_idx"], new["part_id"], x.tolist(), y.tolist(), new["visible"], new["at"])])
            last = max(int(new["at"].max()), state[4])
            self.pose.update((*state[:4], last))
            for at in {int(t) for t in new["at"]} | {last + self.idle}:
                self.handle.registerTimer(at)
        yield pd.DataFrame([], columns=["video_id", "object_id", "part_id", "frame_idx", "x", "y"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.held.get()) if self.held.exists() else []
        due = [r for r in rows if r[5] <= now]
        out = []
        if due:
            state = self.pose.get()
            shape, moving = self.shapes.get(key[1], {}), tuple(state[:3])
            for frame, group in groupby(due, key=lambda r: r[0]):
                parts = [r for r in group if r[1] in shape]
                at = np.array([complex(np.nan if r[2] is None else r[2], np.nan if r[3] is None else r[3]) for r in parts])
                if len(shape) > 1 and parts:
                    at, moving = pose_step(moving, at, np.array([shape[r[1]] for r in parts]), np.array([r[4] for r in parts]), self.strength, self.scale_step, self.turn_step)
                out += [(*key, r[1], frame, z.real, z.imag) for r, z in zip(parts, at)]
            self.pose.update((*moving, due[-1][0], state[4]))
            left = [r for r in rows if r[5] > now]
            if left:
                self.held.put([tuple(r) for r in left])
            else:
                self.held.clear()
        elif not rows and self.pose.exists() and now >= self.pose.get()[4] + self.idle:
            self.pose.clear()
        yield pd.DataFrame(out, columns=["video_id", "object_id", "part_id", "frame_idx", "x", "y"])

    def close(self) -> None:
        pass


def poses(tracks: DataFrame, reference: list[tuple[str, str, float, float]], strength: float = 0.9, scale_step: float = 0.025, turn_step: float = math.radians(20), time: str = "ts", late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """The stream's twin of `registration.regular_poses`: video_id, object_id, part_id, frame_idx, x, y.

    tracks: video_id, object_id, part_id, frame_idx, x, y (null: not tracked), visible and an event time that grows with the frames; reference: object, part, x, y of each landmark. Rows
    come out when the watermark, `late` behind the latest time, has passed them; the result is the batch's if none is later than that. A row that is later, or whose
    frame is behind one that went out, is dropped. A track without rows for `idle` begins anew.
    """
    shapes: dict[str, dict[str, complex]] = {}
    for name, part, x, y in reference:
        shapes.setdefault(name, {})[part] = complex(x, y)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = tracks.where(F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select("video_id", "object_id", "part_id", "frame_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("visible", F.lit(False)).alias("visible"), F.unix_millis(time).alias("at"), time)
    return rows.groupBy("video_id", "object_id").transformWithStateInPandas(Poses(shapes, strength, scale_step, turn_step, idle_ms), POSES, "append", "eventTime")


class Transitions(StatefulProcessor):
    """Keeps the last label of a video and counts its transitions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "label string")
        self.counts = handle.getMapState("counts", "a string, b string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0] if self.last.exists() else None
        changed: dict[tuple[str, str], int] = {}
        for label in pd.concat(rows).sort_values("start_frame")["cluster"]:
            if at is not None:
                changed[at, label] = changed.get((at, label), 0) + 1
            at = label
        out = []
        for pair, n in changed.items():
            n += self.counts.getValue(pair)[0] if self.counts.containsKey(pair) else 0
            self.counts.updateValue(pair, (n,))
            out.append((*key, *pair, n))
        if at is not None:
            self.last.update((at,))
        yield pd.DataFrame(out, columns=["video_id", "from_label", "to_label", "n"])

    def close(self) -> None:
        pass


def transitions(labels: DataFrame) -> DataFrame:
    """Counts of transitions so far for each pair of labels that a batch has changed, by video_id."""
    rows = labels.select("video_id", "start_frame", "cluster")
    return rows.groupBy("video_id").transformWithStateInPandas(Transitions(), "video_id long, from_label string, to_label string, n long", "update", "none")
