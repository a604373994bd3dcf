"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 48 words; none is left out, so whole texts are scored. A passage is described by
the shares of its kinds of bytes, word lengths, repeated words and a hashed bag of words, and encoded by a learned
layer. Gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages; a logistic layer scores their weighted mean.
The labels of documents alone train all layers together, by Adam over a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec
from .common import cut, slices

PASSAGE, BUCKETS, ENCODED, GATE = 48, 48, 24, 12
#: Kind of each byte: every ASCII sign is its own kind; letters, digits, spaces and other bytes are classes.
KIND = np.zeros(256, dtype=np.int64)
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
KIND[_SIGNS] = np.arange(len(_SIGNS)) + 7
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[32] = 4
KIND[10] = 5
KIND[128:] = 6
KINDS = 7 + len(_SIGNS)
WIDTH = KINDS + 4 + BUCKETS
BASE = int(textvec.FACTOR)
INVERSE = pow(BASE, -1, 1 << 64)


def _hashes(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes from running sums, for the bag of words alone: words that collide share a bucket."""
    powers = np.full(len(raw) + 1, BASE, dtype=np.uint64)
    inverse = np.full(len(raw) + 1, INVERSE, dtype=np.uint64)
    powers[0] = inverse[0] = 1
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:-1], out=sums[1:])
    return textvec.mix((sums[b] - sums[a]) * np.cumprod(inverse)[a])


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a column of texts, and for each text its first passage's number. A text without words is one passage of zeros."""
    raw, offs = textvec.utf8(column)
    a, b, firsts = textvec.word_spans(raw, offs)
    counts = np.diff(firsts)
    own = np.maximum(-(-counts // PASSAGE), 1)
    starts = np.concatenate([[0], np.cumsum(own)])
    n = int(starts[-1])
    text = np.repeat(np.arange(len(counts)), counts)
    number = (np.arange(len(a)) - firsts[:-1][text]) // PASSAGE + starts[:-1][text]  # of each word's passage
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if not len(a):
        return out, starts
    # White space after a word belongs to its passage.
    ends = np.append(a[1:], len(raw))
    of_byte = np.repeat(number, ends - a)
    kinds = KIND[raw[a[0] :]]
    out[:, :KINDS] = np.bincount(of_byte * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    total = np.maximum(out[:, :KINDS].sum(axis=1, keepdims=True), 1)
    out[:, :KINDS] = np.sqrt(out[:, :KINDS] / total)
    words = np.maximum(np.bincount(number, minlength=n), 1).astype(np.float64)
    size = np.minimum(b - a, 100).astype(np.float64)
    mean = np.bincount(number, size, n) / words
    hashes = _hashes(raw, a, b)
    distinct = np.unique(number.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    out[:, KINDS] = mean / 10
    out[:, KINDS + 1] = np.sqrt(np.maximum(np.bincount(number, size * size, n) / words - mean**2, 0)) / 10
    out[:, KINDS + 2] = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n) / words
    out[:, KINDS + 3] = words / PASSAGE
    bag = np.bincount(number * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, KINDS + 4 :] = np.sqrt(bag / words[:, None])
    return out, starts


@dataclass
class Model:
    """The layers, as arrays by name, and the scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    @staticmethod
    def start(x: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        layers = {"W": draw(WIDTH, ENCODED), "b": np.zeros(ENCODED), "V": draw(ENCODED, GATE), "U": draw(ENCODED, GATE), "w": draw(GATE), "c": draw(ENCODED), "c0": np.zeros(1)}
        return Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), layers)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.layers
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        bag = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts[:-1])[bag])
        a = e / np.add.reduceat(e, starts[:-1])[bag]
        m = np.add.reduceat(a[:, None] * h, starts[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["c0"], -30, 30)))
        return {"z": z, "bag": bag, "h": h, "t": t, "s": s, "a": a, "m": m, "y": y}

    def slopes(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Gradient of the weighted mean log loss with a squared penalty."""
        p, f = self.layers, self.forward(x, starts)
        dy = (f["y"] - label) * weight / weight.sum()
        dm = dy[:, None] * p["c"]
        of = dm[f["bag"]]
        da = (of * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts[:-1])[f["bag"]])
        g = de[:, None] * p["w"]
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * of + dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - f["h"] ** 2)
        out = {"W": f["z"].T @ dz, "b": dz.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["m"].T @ dy, "c0": np.array([dy.sum()])}
        return {k: v + decay * p[k] for k, v in out.items()}


def train(x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam over shuffled batches of bags; the same rows in the same order give the same model."""
    model = Model.start(x, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.layers.items()}
    second = {k: np.zeros_like(v) for k, v in model.layers.items()}
    step, total = 0, epochs * -(-len(label) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = (starts[1:] - starts[:-1])[own]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
            slopes = model.slopes(x[rows], np.concatenate([[0], np.cumsum(sizes)]), label[own], weight[own], decay)
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.layers[k] = model.layers[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_of_a_class: int = 1500, most_passages: int = 400_000, seed: int = 5) -> Model | None:
    """Trains on at most `most_of_a_class` labelled documents of each class, those of the smallest hash, weighted to the classes' true shares.

    A training document gives all its passages. Documents of a class are taken in the order of the hash until they have half of
    `most_passages`, the first one always; this bounds what the driver holds.
    Labels other than 0 and 1 and null are left out; of several labels of a document the smallest counts, of several
    texts that of the least features. None unless documents of both labels are found: from one alone nothing can be told.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    sizes = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
    if not sizes:
        return None
    picked = None
    for value in sizes:
        some = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most_of_a_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(picked), "_id")  # 2 * most_of_a_class ids at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_body"):
                x, starts = passages(batch.column("_body"))
                parts = [x[a:b].astype("<f4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(parts, pa.binary())], names=["_id", "_label", "x"])

    described = cut(rows.mapInArrow(describe, "_id long, _label int, x binary").groupBy("_id", "_label").agg(F.min("x").alias("x")))
    order = W.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit(seed)), "_id").rowsBetween(W.unboundedPreceding, 0)
    upto = described.select("_id", F.sum(F.octet_length("x") / (4 * WIDTH)).over(order).alias("upto"), F.count(F.lit(1)).over(order).alias("place"))  # of 2 * most_of_a_class rows
    got = described.join(upto.where((F.col("upto") <= most_passages / 2) | (F.col("place") == 1)), "_id", "left_semi").orderBy("_id").collect()
    if not got:
        return None
    bags = [np.frombuffer(r.x, dtype="<f4").reshape(-1, WIDTH) for r in got]
    label = np.array([r._label for r in got], dtype=np.float64)
    found = {v: int((label == v).sum()) for v in (0, 1)}
    if not all(found.values()):
        return None
    weight = np.array([sizes[int(v)] / found[int(v)] for v in label])
    return train(np.concatenate(bags).astype(np.float64), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), label, weight / weight.mean(), seed=seed)


def _scores(batch: pa.RecordBatch, text_col: str, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(batch.num_rows, 0.5)
    x, starts = passages(batch.column(batch.schema.get_field_index(text_col)))
    return model.forward(x.astype(np.float64), starts)["y"]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and score, the probability of quality 1 (0.5 without a model).

    Null and empty texts are one passage without words and get its score. Equal texts get equal scores. Only the text is an input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, "body", model))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(run, "doc_id long, score double")


def good_rows(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns; they are filtered where they are read. Without a model all stay.

    Null and empty texts have the score of one passage without words, so that they stay or go together. Ties with `least` stay; repeated
    rows stay or go together. An empty table gives an empty table. Columns may have any names; only the text is an input.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(_scores(batch, text_col, model) >= least))

    return docs if model is None else docs.mapInArrow(keep, docs.schema)
