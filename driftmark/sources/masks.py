"""Reading stored masks: one SQLite file for each video, a compressed payload of run lengths for each frame."""

from __future__ import annotations

import io
import pickle
import sqlite3
import zlib
from collections.abc import Iterable, Iterator, Sequence, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes and version of a payload (fixed values).
MAGIC, VERSION = b"SAM3WT01", 1
RUNS = "video_id string, frame_idx long, object_id string, x long, y0 long, len long"
RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]
#: The table of a store (fixed format).
TABLE = "CREATE TABLE frame_segmentation (frame_idx INTEGER NOT NULL PRIMARY KEY, seg_blob BLOB NOT NULL, bbox_json TEXT NOT NULL DEFAULT '{}', updated_at TEXT NOT NULL DEFAULT (datetime('now')))"
FRAMES = "video_id string, frame_idx long, seg_bytes long, bbox_json string, updated_at string"


class _Plain(pickle.Unpickler):
    """Reads plain data only: a payload that names any class or function is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"a payload must not name {module}.{name}")


def payload(blob: bytes) -> dict:
    """The content of a frame's blob; ValueError if it is none."""
    head = MAGIC + VERSION.to_bytes(4, "big")
    if not blob.startswith(head):
        raise ValueError("not a mask payload of a known version")
    return _Plain(io.BytesIO(zlib.decompress(blob[len(head) :]))).load()


def run_lengths(text: bytes | str) -> list[int]:
    """The numbers of a compressed run-length text of COCO masks: five bits a sign, low ones first, the sixth for more to come; from the fourth number on, each is stored less the one two before."""
    data = text.encode() if isinstance(text, str) else text
    out: list[int] = []
    value = shift = 0
    for sign in data:
        bits = sign - 48
        value |= (bits & 31) << shift
        shift += 5
        if bits & 32:
            continue
        if bits & 16:
            value -= 1 << shift
        out.append(value + (out[-2] if len(out) > 2 else 0))
        value = shift = 0
    return out


def column_runs(counts: Sequence[Sequence[int]], heights: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the mask, x, y0 and len of the runs of set pixels of many masks, whose counts alternate between clear and set, down one column after the other."""
    sizes = np.array([len(c) for c in counts], dtype=np.int64)
    flat = np.array([n for c in counts for n in c], dtype=np.int64)
    mask = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    ends = np.cumsum(flat)
    before = np.concatenate([[0], ends])[start]  # what the masks before it count
    held = ((np.arange(len(flat)) - start[mask]) % 2 == 1) & (flat > 0)  # every second count is of set pixels
    mask, flat = mask[held], flat[held]
    end = ends[held] - before[mask]
    first, height = end - flat, np.asarray(heights, dtype=np.int64)[mask]
    columns = (end - 1) // height - first // height + 1
    run = np.repeat(np.arange(len(first)), columns)
    height = height[run]
    x = first[run] // height + np.arange(len(run)) - (np.cumsum(columns) - columns)[run]
    y0 = np.maximum(first[run] - x * height, 0)
    return mask[run], x, y0, np.minimum(end[run] - x * height, height) - y0


def alternating(mask: np.ndarray, x: np.ndarray, y0: np.ndarray, length: np.ndarray, height: int) -> list[list[int]]:
    """For each mask (numbered from 0, every number used) the counts of which `column_runs` gives its runs. Runs may overlap; ValueError where one leaves its column."""
    if len(x) and (x.min() < 0 or y0.min() < 0 or length.min() < 0 or (y0 + length).max() > height):
        raise ValueError("a run leaves its column")
    if not len(x):
        return []
    key = x * height + y0
    offset = mask * (int((key + length).max()) + 2)  # no mask touches the next
    order = np.lexsort((key, mask))
    first = (key + offset)[order]
    end = np.maximum.accumulate(first + length[order])
    opens = np.append(True, first[1:] > end[:-1])
    of, base = mask[order][opens], offset[order][opens]
    first, end = first[opens] - base, end[np.append(opens[1:], True)] - base
    fresh = np.append(True, of[1:] != of[:-1])
    clear = first - np.where(fresh, 0, np.append(0, end[:-1]))
    flat = np.column_stack([clear, end - first]).ravel().tolist()
    cuts = [*(2 * np.flatnonzero(fresh)).tolist(), len(flat)]
    return [flat[i:j] for i, j in zip(cuts, cuts[1:])]


def masks_of(blob: bytes, wanted: Set[str] | None = None) -> Iterator[tuple[str, list[int], int, int]]:
    """Each object of a frame's blob with its counts, height and width; with `wanted`, only those objects are decoded."""
    for name, mask in (payload(blob).get("rles") or {}).items():
        if wanted is None or str(name) in wanted:
            counts = mask["counts"]
            yield str(name), counts if isinstance(counts, list) else run_lengths(counts), int(mask["size"][0]), int(mask["size"][1])


def _frames(content: bytes) -> Iterator[tuple[int, bytes, str, str]]:
    """The rows of a store, read from memory: stores may lie where only Spark reads.

    Stores are written with a write-ahead log, of which a database in memory knows nothing: bytes 18 and 19 of the
    header, which say so, become 1. What is still in the log file beside the store isn't seen.
    """
    store = sqlite3.connect(":memory:")
    try:
        if content[18:20] == b"\x02\x02":
            content = b"".join((content[:18], b"\x01\x01", memoryview(content)[20:]))
        store.deserialize(content)
        yield from store.execute("SELECT frame_idx, seg_blob, bbox_json, updated_at FROM frame_segmentation ORDER BY frame_idx")
    finally:
        store.close()


def stores(spark: SparkSession, path: str) -> DataFrame:
    """The stores under a path or pattern as video_id (the folder's name) and content.

    A store is read whole by one task, and must be below 2 GB; `stored.read` has no such bound, but needs a path that
    every executor can open.
    """
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -2).alias("video_id"), "content")


def run_batches(frames: Iterable[tuple[str, int, bytes]], wanted: Set[str] | None = None, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of RUNS of (video, frame, blob) rows. Masks are decoded together until their counts and widths, of which no mask has more runs, come to `most`."""

    def decoded() -> Iterator[pa.RecordBatch]:
        video, frame, name, counts, heights = map(list, zip(*held))
        mask, *runs = column_runs(counts, heights)
        keys = [pa.array(c, t).take(pa.array(mask)) for c, t in ((video, pa.string()), (frame, pa.int64()), (name, pa.string()))]
        if len(mask):
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(r, pa.int64()) for r in runs]], names=RUN_NAMES)

    held: list[tuple] = []
    size = 0
    for video, frame, blob in frames:
        for name, counts, height, width in masks_of(blob, wanted):
            held.append((video, frame, name, counts, height))
            size += len(counts) + width
            if size >= most:
                yield from decoded()
                held, size = [], 0
    if held:
        yield from decoded()


def mask_runs(stores_: DataFrame) -> DataFrame:
    """Every object's mask of every frame of the stores, as runs of columns. Empty frames and masks have no rows; a blob that can't be read raises ValueError."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content in zip(batch.column("video_id"), batch.column("content")):
                yield from run_batches((video.as_py(), frame, blob) for frame, blob, _, _ in _frames(content.as_py()))

    return stores_.mapInArrow(read, RUNS)


def packed_stores(runs: DataFrame, height: int, frames: int = 1_000) -> DataFrame:
    """Stores of runs of columns: video_id, first_frame and content, a store for every stretch of `frames` frame numbers of a video that has rows.

    The inverse of `mask_runs`. A task packs one stretch, so that what it holds is bounded by `frames` masks, however
    long a video is. Overlapping runs become one; rows with a null in any column are left out; equal masks give equal blobs.
    """
    names = [*RUN_NAMES, "first_frame"]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by([("frame_idx", "ascending"), ("object_id", "ascending")])
        frame, name = rows["frame_idx"].to_numpy(), rows["object_id"].to_pylist()
        x, y0, length = (rows[c].to_numpy() for c in ("x", "y0", "len"))
        codes = rows["object_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        fresh = np.append(True, (frame[1:] != frame[:-1]) | (codes[1:] != codes[:-1]))
        starts = np.flatnonzero(fresh)
        widths = (np.maximum.reduceat(x, starts) + 1).tolist()
        held: dict[int, dict] = {}
        for at, width, counts in zip(starts.tolist(), widths, alternating(np.cumsum(fresh) - 1, x, y0, length, height)):
            held.setdefault(int(frame[at]), {})[name[at]] = {"size": [height, width], "counts": counts}
        store = sqlite3.connect(":memory:")
        store.execute(TABLE)
        for at, rles in held.items():
            body = {"h": height, "w": max(m["size"][1] for m in rles.values()), "rles": rles}
            blob = MAGIC + VERSION.to_bytes(4, "big") + zlib.compress(pickle.dumps(body, protocol=4))
            store.execute("INSERT INTO frame_segmentation (frame_idx, seg_blob) VALUES (?, ?)", (at, blob))
        store.commit()
        content = store.serialize()
        store.close()
        return pa.table({"video_id": pa.array([rows["video_id"][0].as_py()]), "first_frame": pa.array([rows["first_frame"][0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    clean = runs.select(F.col("video_id").cast("string").alias("video_id"), *[F.col(c) for c in RUN_NAMES[1:]]).dropna()
    clean = clean.withColumn("first_frame", F.floor(F.col("frame_idx") / frames) * frames)
    return clean.groupBy("video_id", "first_frame").applyInArrow(pack, "video_id string, first_frame long, content binary")


def frame_rows(stores_: DataFrame) -> DataFrame:
    """A row for each saved frame: its blob's length, boxes as JSON text and time of saving."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content in zip(batch.column("video_id").to_pylist(), batch.column("content").to_pylist()):
                rows = [(video, frame, len(blob), boxes, at) for frame, blob, boxes, at in _frames(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names, types = [x.split()[0] for x in FRAMES.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return stores_.mapInArrow(read, FRAMES)
