"""Stored masks as a Spark data source: tasks by store and frame range; videos, frames and objects are chosen where the store is read.

    stored.read(spark, "/data/*/masks.sqlite", start=100, stop=200, objects=["1"])

What is wanted is an option of the read, not a filter that Spark hands down: in Spark 4.1 a reader that has taken filters
in serves every other scan of the same DataFrame too, so that `df.where(a).union(df.where(b))` gives the rows of b twice.
The driver only lists files. A store is dealt to as many tasks as its size asks for; each opens the file itself and reads
its share of the frame numbers by the primary key, so that stores of any size are read, and a lost task is read again.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftmark.sources import masks

NAME = "stored_masks"
#: Frame numbers of a store (bounds of its integer key).
LEAST, LARGEST = -(2**63), 2**63 - 1
TABLES = {"runs": masks.RUNS, "frames": masks.FRAMES}


@dataclass(frozen=True)
class Wanted:
    """Inclusive bounds of frames, and the videos and objects to be read (None: all)."""

    low: int = LEAST
    high: int = LARGEST
    videos: frozenset[str] | None = None
    objects: frozenset[str] | None = None


class Share(InputPartition):
    """One of `parts` equal ranges of a store's frame numbers."""

    def __init__(self, path: str, part: int, parts: int) -> None:
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


def opened(path: str) -> sqlite3.Connection:
    """A store for reading alone. With rows in its log a shared lock is needed to see them; without, none is taken, as file servers may have none."""
    log = f"{path}-wal"
    busy = os.path.exists(log) and os.path.getsize(log) > 0
    return sqlite3.connect(f"file:{quote(path)}?mode=ro" + ("" if busy else "&immutable=1"), uri=True)


def video_of(path: str) -> str:
    return os.path.basename(os.path.dirname(path))


class StoredReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], bytes_per_task: int, wanted: Wanted = Wanted()) -> None:
        self.path, self.table, self.names, self.bytes_per_task, self.wanted = path, table, names, bytes_per_task, wanted

    def partitions(self) -> list[InputPartition]:
        """A store for each file that the path or pattern names, cut by its size. Without any file or frame there is one empty task."""
        w = self.wanted
        out: list[InputPartition] = []
        for path in sorted(glob.glob(self.path)):
            if w.low > w.high or w.videos is not None and video_of(path) not in w.videos:
                continue
            parts = min(max(1, -(-os.path.getsize(path) // self.bytes_per_task)), w.high - w.low + 1)
            out += [Share(path, i, parts) for i in range(parts)]
        return out or [Share("", 0, 1)]

    def _rows(self, share: Share, columns: str) -> Iterator[tuple]:
        """Rows of a share of a store. The range is cut between the first and the last frame that are stored and wanted, both found by the key."""
        bounds = (self.wanted.low, self.wanted.high)
        ends = ", ".join(f"(SELECT {end}(frame_idx) FROM frame_segmentation WHERE frame_idx BETWEEN ? AND ?)" for end in ("min", "max"))
        store = opened(share.path)
        try:
            first, last = store.execute(f"SELECT {ends}", bounds * 2).fetchone()
            if first is None:
                return
            span = last - first + 1
            share_of = (first + span * share.part // share.parts, first + span * (share.part + 1) // share.parts - 1)
            yield from store.execute(f"SELECT {columns} FROM frame_segmentation WHERE frame_idx BETWEEN ? AND ? ORDER BY frame_idx", share_of)
        finally:
            store.close()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        video = video_of(partition.path)
        if self.table == "runs":
            frames = ((video, frame, blob) for frame, blob in self._rows(partition, "frame_idx, seg_blob"))
            for batch in masks.run_batches(frames, self.wanted.objects):
                yield batch.select(self.names)
            return
        sources = {"video_id": "NULL", "frame_idx": "frame_idx", "seg_bytes": "length(seg_blob)", "bbox_json": "bbox_json", "updated_at": "updated_at"}
        types = {"frame_idx": pa.int64(), "seg_bytes": pa.int64()}
        held: list[tuple] = []
        for row in self._rows(partition, ", ".join(sources[n] for n in self.names)):
            held.append(row)
            if len(held) == 10_000:
                yield self._batch(held, video, types)
                held = []
        if held:
            yield self._batch(held, video, types)

    def _batch(self, rows: list[tuple], video: str, types: dict) -> pa.RecordBatch:
        columns = [[video] * len(rows) if n == "video_id" else c for n, c in zip(self.names, zip(*rows))]
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(self.names, columns)], names=self.names)


class StoredMasks(DataSource):
    """Options: path (a file or pattern, open to every executor), table (`runs` or `frames`), bytesPerTask, low and high (frames), videos and objects (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TABLES[self.options.get("table", "runs")]

    def reader(self, schema) -> StoredReader:
        o = self.options
        names = lambda key: frozenset(json.loads(o[key])) if key in o else None
        wanted = Wanted(int(o.get("low", LEAST)), int(o.get("high", LARGEST)), names("videos"), names("objects"))
        return StoredReader(o["path"], o.get("table", "runs"), schema.fieldNames(), int(o.get("bytespertask", 64 << 20)), wanted)


def read(
    spark: SparkSession, path: str, table: str = "runs", columns: Sequence[str] | None = None, start: int = -1, stop: int = -1,
    videos: Sequence[str] | None = None, objects: Sequence[str] | None = None, bytes_per_task: int = 64 << 20,
) -> DataFrame:
    """Stored masks as runs of columns (`runs`) or a row for each saved frame (`frames`), of some columns if they are named.

    Frames go from start to stop, both with them; a negative one leaves its side open. Videos that aren't named are not
    opened, other frames not read and other objects not decoded. Frames without masks have no runs. A file that is no
    store raises; a path without files gives no rows.
    """
    if table == "frames" and objects is not None:
        raise ValueError("frames are rows of all their objects")
    spark.dataSource.register(StoredMasks)
    types = dict(c.split() for c in TABLES[table].split(", "))
    options = {"table": table, "bytesPerTask": bytes_per_task, "low": LEAST if start < 0 else start, "high": LARGEST if stop < 0 else stop}
    options |= {k: json.dumps(list(v)) for k, v in (("videos", videos), ("objects", objects)) if v is not None}
    return spark.read.format(NAME).schema(", ".join(f"{n} {types[n]}" for n in columns or types)).options(**options).load(path.removeprefix("file://"))
