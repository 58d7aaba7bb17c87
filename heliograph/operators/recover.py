"""Rows that fail to parse: an error-recovering grammar for capture lines.

    text    = { record line-end }
    record  = field SP field [ SP payload ]
    payload = object                               (RFC 8259, surrounded by blanks)

Each production is a procedure over token patterns.  A syntax error carries its
place and an error code; the parser then resumes at the next validated
record-start anchor, so a broken quote costs one record and not the rest of the
text.  Records come out typed, errors located.
"""

from __future__ import annotations

import datetime
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = re.compile(r"[ \t\n\r]*")
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
#: As much of a string as is well formed: names the place where it breaks.
STRING_PART = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
INTEGER = re.compile(r"-?(?:0|[1-9][0-9]*)\Z")
WORD = re.compile(r"true|false|null")
DIGITS = re.compile(r"[0-9]+\Z")
STAMP = re.compile(r"[0-9]{14}\Z")
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)")
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: Where a record may start: a key with a host part, a digit stamp, then a payload or the line's end.
ANCHOR = re.compile(r"(?:(?<=[\n\r\"} ])|^)[^\s\"{}]+\)[^\s\"{}]* (?=[0-9]{14}(?: *\{| *[\r\n]| *$))")
MOST = 2**63 - 1
REASONS = ("columns", "json", "timestamp", "offset")


class Wrong(Exception):
    def __init__(self, place: int, what: str):
        self.place, self.what = place, what


class Number(str):
    """A number as written; its text decides whether it is an integer."""


class Record(NamedTuple):
    start: int
    surt: str
    ts: str
    payload: str | None
    offset: int | None


class Fault(NamedTuple):
    start: int
    place: int
    reason: str
    detail: str


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), text)


class Grammar:
    """Procedures return the place behind what they read; ``top`` keeps the outermost members."""

    def __init__(self, text: str):
        self.text, self.top = text, {}

    def blank(self, at: int) -> int:
        return BLANK.match(self.text, at).end()

    def string(self, at: int) -> int:
        m = STRING.match(self.text, at)
        if m is None:
            part = STRING_PART.match(self.text, at)
            raise Wrong(part.end() if part else at, "string not closed" if part else "string expected")
        return m.end()

    def value(self, at: int) -> int:
        first = self.text[at : at + 1]
        if first == '"':
            return self.string(at)
        if first == "{":
            return self.object(at)
        if first == "[":
            return self.array(at)
        m = NUMBER.match(self.text, at) or WORD.match(self.text, at)
        if m is None:
            raise Wrong(at, "value expected")
        return m.end()

    def array(self, at: int) -> int:
        text, at = self.text, self.blank(at + 1)
        if text[at : at + 1] == "]":
            return at + 1
        while True:
            at = self.blank(self.value(at))
            sign = text[at : at + 1]
            if sign == "]":
                return at + 1
            if sign != ",":
                raise Wrong(at, "comma or ] expected")
            at = self.blank(at + 1)

    def object(self, at: int, outermost: bool = False) -> int:
        text, at = self.text, self.blank(at + 1)
        if text[at : at + 1] == "}":
            return at + 1
        while True:
            end = self.string(at)
            colon = self.blank(end)
            if text[colon : colon + 1] != ":":
                raise Wrong(colon, "colon expected")
            start = self.blank(colon + 1)
            over = self.value(start)
            if outermost:
                self.top[_unescape(text[at + 1 : end - 1])] = (start, over)
            at = self.blank(over)
            sign = text[at : at + 1]
            if sign == "}":
                return at + 1
            if sign != ",":
                raise Wrong(at, "comma or } expected")
            at = self.blank(at + 1)

    def payload(self) -> None:
        at = self.blank(0)
        if self.text[at : at + 1] != "{":
            raise Wrong(at, "object expected")
        deepest = len(self.text) + 1000
        if self.text.count("[") + self.text.count("{") > 300 and sys.getrecursionlimit() < deepest:
            sys.setrecursionlimit(deepest)  # Python-to-Python calls take heap, not stack
        at = self.blank(self.object(at, True))
        if at != len(self.text):
            raise Wrong(at, "text after the object")


def _offset(grammar: Grammar) -> int | None:
    span = grammar.top.get("offset")
    if span is None:
        return None
    start, raw = span[0], grammar.text[span[0] : span[1]]
    if raw == "null":
        return None
    digits = _unescape(raw[1:-1]) if raw[0] == '"' else raw
    if not (DIGITS if raw[0] == '"' else INTEGER).match(digits):
        raise Wrong(start, "offset is no integer")
    size = digits.lstrip("-").lstrip("0")
    if len(size) > 19 or int(size or 0) > MOST or (digits[0] == "-" and size):
        raise Wrong(start, "offset out of range")
    return int(size or 0)


def _real_time(ts: str) -> bool:
    if not STAMP.match(ts):
        return False
    try:
        datetime.datetime(int(ts[:4]), int(ts[4:6]), int(ts[6:8]), int(ts[8:10]), int(ts[10:12]), int(ts[12:]))
    except ValueError:
        return False
    return True


def parse_record(line: str, start: int = 0) -> Record | Fault | None:
    """One record; None for white space only.  The first reason that applies wins."""
    if line.endswith("\r\n"):
        line = line[:-2]
    elif line.endswith(("\n", "\r")):
        line = line[:-1]
    if not line.strip():
        return None
    parts = line.split(" ", 2)
    if len(parts) < 2 or not parts[0] or not parts[1]:
        return Fault(start, start + (len(parts[0]) if parts[0] else 0), "columns", "key and time expected")
    surt, ts, rest = parts[0], parts[1], parts[2] if len(parts) > 2 else ""
    shift = start + len(surt) + len(ts) + 2
    grammar, offset = None, None
    if rest.strip():
        if not rest.strip().startswith("{"):
            return Fault(start, shift, "columns", "payload is no object")
        grammar = Grammar(rest)
        try:
            grammar.payload()
        except Wrong as e:
            return Fault(start, shift + e.place, "json", e.what)
    if not _real_time(ts):
        return Fault(start, start + len(surt) + 1, "timestamp", "not a real 14-digit time")
    if grammar is not None:
        try:
            offset = _offset(grammar)
        except Wrong as e:
            return Fault(start, shift + e.place, "offset", e.what)
    return Record(start, surt, ts, rest.strip() if grammar else None, offset)


def parse_text(text: str) -> Iterator[Record | Fault]:
    """Every record of a text of many lines, and every located fault.

    After a fault inside a payload the parser looks for an anchor on the same line, where a
    record was glued to the broken one.  A broken quote may have swallowed the anchor
    before the fault shows, so the search starts with the payload; an anchor counts only
    if a whole record parses from it, up to another anchor or to the line's end.
    """
    at = 0
    for line in re.findall(r"[^\r\n]*(?:\r\n|\n|\r|\Z)", text):
        found = parse_record(line, at)
        if found is not None:
            yield found
            if isinstance(found, Fault) and found.reason == "json":
                yield from _resumed(line, at)
        at += len(line)


def _resumed(line: str, start: int) -> Iterator[Record]:
    behind = line.index("{")
    anchors = [m.start() for m in ANCHOR.finditer(line, behind)]
    ends = [at for at in anchors if line[max(at - 80, 0) : at].rstrip().endswith("}")]  # where a glued record may end
    done = behind
    for at in anchors:
        if at < done:
            continue
        for end in [*(e for e in ends if e > at), len(line)]:
            found = parse_record(line[at:end], start + at)
            if isinstance(found, Record) and (end == len(line) or found.payload is not None):
                yield found
                done = end
                break


_SCHEMA = "src_path string, {id}, surt string, ts string, json string, offset long, reason string, detail string, place long, recovered boolean"


def parse_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """Splits raw lines into typed records and located faults.

    Result: the id and, if present, ``src_path`` of the line; for a record ``surt, ts, json,
    offset`` and a null ``reason``; for a rejected line one of ``columns``, ``json``,
    ``timestamp``, ``offset`` with ``detail`` and ``place`` (a character position).  Records
    recovered from the rest of a rejected line have ``recovered`` true; they are
    additional to that line's own reason.  Null lines and lines of white space give no
    row; repeated lines are parsed as often as they occur; other columns are ignored.
    """
    source = F.col("src_path") if "src_path" in lines.columns else F.lit(None)
    picked = lines.select(source.cast("string").alias("src_path"), F.col(id_col).alias("id"), F.col(line_col).alias("text")).where("text is not null")
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(_parse_batches, _SCHEMA.format(id=f"id {kind}"))
    return out.withColumnRenamed("id", id_col)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        picked: list[int] = []
        for i, text in enumerate(batch["text"].to_pylist()):
            head, recovered = True, False
            for found in _one(text):
                recovered = not head
                if isinstance(found, Record):
                    rows.append((found.surt, found.ts, found.payload, found.offset, None, None, found.start, recovered))
                else:
                    rows.append((None, None, None, None, found.reason, found.detail, found.place, recovered))
                picked.append(i)
                head = False
        take = pa.array(picked, pa.int64())
        columns = [batch["src_path"].take(take), batch["id"].take(take)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        names = ["src_path", "id", "surt", "ts", "json", "offset", "reason", "detail", "place", "recovered"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _one(line: str) -> Iterator[Record | Fault]:
    """The record of one row; a line end within it is white space of its payload."""
    found = parse_record(line)
    if found is not None:
        yield found
        if isinstance(found, Fault) and found.reason == "json":
            yield from _resumed(line, 0)


def rejected(parsed: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per rejected line with the one reason for it."""
    return parsed.where("reason is not null and not recovered").select(id_col, "reason", "detail", "place")


def loaded(parsed: DataFrame, id_col: str = "line_id", with_recovered: bool = False) -> DataFrame:
    """The valid records; with ``with_recovered`` also those found behind a fault."""
    kept = parsed.where("reason is null")
    if not with_recovered:
        kept = kept.where("not recovered")
    return kept.select(id_col, "surt", "ts", "json", "offset")
