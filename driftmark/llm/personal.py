"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, the "://" of schemes, plus signs before a digit, a digit with a
dot after it, two digits with at most one space or hyphen between them, and the words IBAN, SSN and account. At each anchor a parser of its kind goes left and right
over the characters that the kind allows, and then checks what it holds. A span that ends before an anchor's place is
never entered again, so that spans of a kind don't overlap and the leftmost counts.

Base kinds: email, ip, card (Luhn's check), phone. Two kinds come beside them: address, a URL that names a user; and account, the value
after one of the words (an IBAN of its country's length whose check digits are right, a social security number, or 6 to 17 digits).
A span of those inside a base span is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
DIGIT = frozenset("0123456789")
ALNUM = DIGIT | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
UPPER = DIGIT | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL, LABEL, DIAL = ALNUM | frozenset("._%+-"), ALNUM | {"-"}, DIGIT | frozenset(" ().-")
SCHEME, HOST = ALNUM | frozenset("+.-"), ALNUM | frozenset(".-")
#: Characters that end the user of a URL.
NO_USER = frozenset(" \t\n\v\f\r/?#@<>\"'")
FILL = frozenset(" :#=.")
#: Characters of an IBAN by country, as its registry has them.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: The words before an account, and the kind of value that follows.
CUES = {"iban": "iban", "ssn": "ssn", "account": "number", "acct": "number"}
MOST_DIGITS = 17


@lru_cache(maxsize=1)
def anchors():
    """The automaton: each anchor with its kind and length."""
    import ahocorasick

    found = {"@": "email", "://": "address"}
    for d in sorted(DIGIT):
        found |= {f"+{d}": "phone", f"{d}.": "ip"}
        found |= {f"{d}{sep}{e}": "card" for sep in ("", " ", "-") for e in DIGIT}
    for cue in CUES:
        found |= {form: cue for form in (cue, cue.capitalize(), cue.upper())}
    automaton = ahocorasick.Automaton()
    for text, kind in found.items():
        automaton.add_word(text, (kind, len(text)))
    automaton.make_automaton()
    return automaton


def right(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def left(text: str, at: int, least: int, allowed: frozenset) -> int:
    """Begin of the run of allowed characters that ends at a place, not before `least`."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: list[int]) -> bool:
    """Whether the last digit is the check digit of the others."""
    twice = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def _email(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: the at-sign. Its local part, a label, and one or more labels after dots."""
    begin = left(text, at, least, LOCAL)
    end = right(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (nxt := right(text, end + 1, LABEL)) > end + 1:
        end, dots = nxt, dots + 1
    return (begin, end, True) if dots else None


def _ip(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: the last digit before a dot. Four runs of digits, each at most 255."""
    begin = end = left(text, at, least, DIGIT)
    parts = []
    for k in range(4):
        if k and (end >= len(text) or text[end] != "."):
            return None
        a = end + (k > 0)
        end = right(text, a, DIGIT)
        if end == a:
            return None
        parts.append(text[a:end].lstrip("0"))
    return begin, end, all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def _card(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: a digit before another one. All digits with at most one space or hyphen between neighbours."""
    begin, end = at, at + 1
    digits = [int(text[at])]
    while True:
        a = end + (end < len(text) and text[end] in " -")
        if a >= len(text) or text[a] not in DIGIT:
            break
        digits.append(int(text[a]))
        end = a + 1
    return begin, end, 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: a plus sign before a digit. What may stand in a number, up to its last digit."""
    end = right(text, at + 2, DIAL)
    while end > at + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end < at + 4:
        return None
    digits = sum(c in DIGIT for c in text[at:end])
    return at, end, 9 <= digits <= 15


def _address(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: the colon of "://". A scheme, a user that an at-sign ends, and a host, with its port if there is one."""
    begin = left(text, at, least, SCHEME)
    while begin < at and (text[begin] in DIGIT or text[begin] not in ALNUM):
        begin += 1
    user = end = at + 3
    while end < len(text) and text[end] not in NO_USER:
        end += 1
    if begin == at or end == user or end >= len(text) or text[end] != "@":
        return None
    host = end + 1
    end = right(text, host, HOST)
    while end > host and text[end - 1] not in ALNUM:
        end -= 1
    if end == host:
        return None
    if end < len(text) and text[end] == ":" and (port := right(text, end + 1, DIGIT)) > end + 1:
        end = port
    return begin, end, True


def _iban(text: str, at: int) -> tuple[int, int] | None:
    size = IBAN_SIZES.get(text[at : at + 2])
    if not size:
        return None
    value, end = "", at
    while len(value) < size:
        a = end + (bool(value) and end < len(text) and text[end] == " ")
        if a >= len(text) or text[a] not in UPPER:
            return None
        value, end = value + text[a], a + 1
    whole = end == len(text) or text[end] not in ALNUM
    number = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return (at, end) if whole and value[2:4].isdigit() and int(number) % 97 == 1 else None


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    value = text[at : at + 11]
    shape = len(value) == 11 and all(c == "-" if i in (3, 6) else c in DIGIT for i, c in enumerate(value))
    if not shape or at + 11 < len(text) and text[at + 11] in DIGIT | {"-"}:
        return None
    area, group, serial = value.split("-")
    return (at, at + 11) if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000" else None


def _number(text: str, at: int) -> tuple[int, int] | None:
    end = at
    while end < len(text) and text[end] in DIGIT:
        end += 1
        if end + 1 < len(text) and text[end] == "-" and text[end + 1] in DIGIT:
            end += 1
    digits = sum(c in DIGIT for c in text[at:end])
    return (at, end) if 6 <= digits <= MOST_DIGITS else None


VALUES = {"iban": _iban, "ssn": _ssn, "number": _number}


def _account(text: str, end: int, value: str) -> tuple[int, int] | None:
    """end: of the word. The value after it, behind colons, hashes, equals signs, dots and spaces; "no" or "number" may stand before a number."""
    at = right(text, end, FILL)
    if value == "number" and at > end:
        for word in ("number", "Number", "no", "No"):
            if text.startswith(word, at) and (after := right(text, at + len(word), FILL)) > at + len(word):
                at = after
                break
    return VALUES[value](text, at) if at > end else None


PARSERS: dict[str, Callable[[str, int, int], tuple[int, int, bool] | None]] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "address": _address}


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in code points, by start and then by kind."""
    done = dict.fromkeys(PARSERS, 0)  # where the last span of a kind ends, whether it was kept or not
    base: list[tuple[int, int, str]] = []
    added: list[tuple[int, int, str]] = []
    for last, (kind, size) in anchors().iter(text):
        if kind in CUES:
            before = text[last - size : last - size + 1] if last >= size else ""
            span = _account(text, last + 1, CUES[kind]) if before not in ALNUM else None
            if span:
                added.append((*span, "account"))
            continue
        at = last - size + 1
        if at < done[kind]:
            continue
        got = PARSERS[kind](text, at, done[kind])
        if got is None:
            continue
        done[kind] = got[1]
        if got[2]:
            (base if kind in BASE else added).append((got[0], got[1], kind))
    base.sort()
    if added:
        base += [x for x in set(added) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return sorted(base, key=lambda x: (x[0], KINDS.index(x[2])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_spans array<struct<kind, start, end>>, in code points, end exclusive, by start and then by kind.

    Null and empty texts have none. Texts of any length are read whole. Rows of a null id and repeated rows are rows like others. Columns other
    than the id and the text are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                found = [find(t) if t else [] for t in batch.column("body").to_pylist()]
                flat = [x for f in found for x in f]
                start, end, kind = (list(x) for x in zip(*flat)) if flat else ([], [], [])
                rows = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["doc_id", "text_spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, text_spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with each stretch of overlapping spans replaced by its first span's kind in angle brackets. Null stays null; all columns are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                at = batch.schema.get_field_index(text_col)
                texts = [t and _without(t) for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _without(text: str) -> str:
    out, at = [], 0
    for a, b, kind in find(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
