"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn after turn, as <|turn|>role<|says|>text<|end|>. The three markers are added to the
tokenizer as special tokens, so that a token lies inside a text or outside it. Roles and texts are escaped, "\\" as
"\\\\" and "<|" as "<\\|", so that they hold no marker and can be read back. The rendering is encoded once, with
offsets; the sorted spans of the texts under the loss are intersected with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: Sequence[tuple[str, str]], under_loss: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendering of (role, text) turns, and the spans of the texts of the role under the loss, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == under_loss and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendering."""
    out = []
    for piece in formatted.split(TURN)[1:]:
        role, text = piece.removesuffix(END).split(SAYS)
        out.append((unescape(role), unescape(text)))
    return out


def mask(spans: Sequence[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet a span, both in the order of the text."""
    out = np.zeros(len(starts), dtype=bool)
    for a, b in spans:
        out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return out


def text_under(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under a loss mask, unescaped. Tokens of one character (its bytes) count once."""
    out, at, parts = [], -1, []
    for a, b in zip(starts[loss].tolist(), ends[loss].tolist()):
        if a > at and parts:
            out.append(unescape("".join(parts)))
            parts = []
        parts.append(formatted[max(a, at) : b])
        at = max(at, b)
    return "".join([*out, unescape("".join(parts))])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([TURN, SAYS, END])
    return tokenizer


def format_chats(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", under_loss: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, ids, starts and ends (token offsets in code points), loss.

    Turns are ordered by turn (null first), equal ones by role and text. Null roles and texts are empty; an empty text is rendered
    and has no token under the loss. Rows of a null conv_id are one conversation. Repeated rows are turns of their own.
    Other columns are not read. An empty table gives an empty table. Conversations are sorted in their partition and
    read as a stream; the largest single one, which is encoded once, must fit into a task.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        names = [x.split()[0] for x in FORMATTED.split(", ")]
        out, held = [], 0
        for table in runs(batches, "key"):
            text, spans = render(list(zip(table.column("role").to_pylist(), table.column("text").to_pylist())), under_loss)
            code = encoder.encode(text, add_special_tokens=False)
            places = np.array(code.offsets, dtype=np.int32).reshape(-1, 2)
            out.append((table.column("conv_id")[0].as_py(), table.num_rows, text, np.array(code.ids, np.int32), places[:, 0], places[:, 1], mask(spans, places[:, 0], places[:, 1])))
            held += len(text)
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from the output of `format_chats`: its turns, and the text under its loss masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            edges = column("ids").offsets.to_numpy()
            edges = edges - edges[0]
            starts, ends, loss = (column(name).flatten().to_numpy(zero_copy_only=False) for name in ("starts", "ends", "loss"))
            out = []
            for i, (conv_id, text) in enumerate(zip(column("conv_id").to_pylist(), column("formatted").to_pylist())):
                own = slice(edges[i], edges[i + 1])
                turns = parse(text)
                under = text_under(text, starts[own], ends[own], loss[own])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text), int(edges[i + 1] - edges[i])))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in n else pa.int64()) for c, n in zip(columns, names)], names=names)

    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return formatted.mapInArrow(run, DIGESTS)
