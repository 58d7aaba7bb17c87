"""Payload fields: adding, and extracting.

Rewriting a payload has to keep the order and the types of its members, which no
built-in function does.  Constant fields are appended to the text of a payload in the
JVM where that gives what writing it anew would give, which is nearly always; only the
other payloads, and those a function changes, go through Python's JSON in Arrow batches.
Reading scalars (``field_column``) stays in the JVM.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.binding import let
from heliograph.functions.cdxj import field_path, strict_object

RowFunction = Callable[[str, str, dict], dict]


def parse_line(line: str) -> tuple[str, str, dict | None]:
    """``(surt, ts, payload)``; ValueError for fewer than two parts or a broken payload."""
    parts = line.split(" ", 2)
    if len(parts) < 2:
        raise ValueError("a line has a key and a time")
    payload = None
    if len(parts) == 3 and parts[2].strip():
        payload = json.loads(parts[2])
        if not isinstance(payload, dict):
            raise ValueError("a payload is an object")
    return parts[0], parts[1], payload


def write_line(surt: str, ts: str, payload: dict) -> str:
    if not payload:
        return f"{surt} {ts}"
    return f"{surt} {ts} {json.dumps(payload, ensure_ascii=False, separators=(',', ':'))}"


def parse_assignments(assignments: list[str]) -> dict[str, str]:
    """``KEY=VALUE`` texts; the first ``=`` separates, later ones win."""
    found = {}
    for text in assignments:
        key, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"not of the form KEY=VALUE: {text!r}")
        found[key] = value
    return found


def load_function(path: str) -> RowFunction:
    """``addfield(surt, timestamp, payload) -> dict`` of a Python file."""
    spec = importlib.util.spec_from_file_location("heliograph_addfield", path)
    if spec is None or spec.loader is None:
        raise OSError(f"no Python file: {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, "addfield"):
        raise AttributeError(f"{path} defines no addfield")
    return module.addfield


def add_fields(lines: DataFrame, fields: dict[str, str] | None = None, function: RowFunction | None = None, column: str = "value") -> DataFrame:
    """``lines`` with fields set in every payload, and ``added``: whether the line was changed.

    Give either constant ``fields``, set in place or appended, or a ``function`` of key, time
    and payload.  Blank and malformed lines, and those for which the function raises
    ValueError, pass unchanged with ``added`` false; other exceptions end the job.
    """
    if bool(fields) == bool(function):
        raise ValueError("give either fields or a function")

    def change(line: str) -> tuple[str, bool]:
        try:
            surt, ts, payload = parse_line(line)
            payload = payload or {}
            if function:
                payload = function(surt, ts, payload)
            else:
                payload.update(fields)
            return write_line(surt, ts, payload), True
        except ValueError:
            return line, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [change(x) if x else (x, False) for x in batch[column].to_pylist()]
            place = batch.schema.get_field_index(column)
            batch = batch.set_column(place, column, pa.array([x for x, _ in done], pa.string()))
            yield batch.append_column("added", pa.array([x for _, x in done], pa.bool_()))

    lines = lines.drop("added")
    if fields:
        return _with_constants(lines, fields, change, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInArrow(run, schema + ", added boolean")


def _with_constants(lines: DataFrame, fields: dict[str, str], change: Callable[[str], tuple[str, bool]], column: str) -> DataFrame:
    """Lines with the fields appended in the JVM, or changed by Python where that would differ."""
    spliced = _spliced(F.col(column), fields)

    @F.arrow_udf("struct<line:string,added:boolean>")
    def changed(texts: pa.Array) -> pa.Array:
        done = [change(x) if x else (x, False) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.bool_())], names=["line", "added"])

    rows = lines.withColumn("hg_spliced", spliced)
    rows = rows.withColumn("hg_changed", changed(F.when(F.col("hg_spliced").isNull(), F.col(column))))
    line, added = F.coalesce("hg_spliced", "hg_changed.line"), F.col("hg_spliced").isNotNull() | F.col("hg_changed.added")
    return rows.select(*(line.alias(column) if c == column else F.col(f"`{c}`") for c in lines.columns), F.coalesce(added, F.lit(False)).alias("added"))


#: What Python's JSON would write in another way: escapes, fractions, exponents, minus zero.
REWRITTEN = r"[:,\[]-?[0-9]*[.eE]|[:,\[]-0"


def _spliced(line: F.Column, fields: dict[str, str]) -> F.Column:
    """The line with the fields at the end of its payload; null unless that is known to be what
    writing the payload anew gives: it is one object, has members but none of these fields,
    and nothing in it is written otherwise than Python's JSON writes it, white space
    between its tokens apart."""
    tail = json.dumps(fields, ensure_ascii=False, separators=(",", ":"))[1:]

    def of_parts(parts: F.Column) -> F.Column:
        payload = F.get(parts, F.lit(2))
        fresh = reduce(lambda a, b: a & b, (~payload.contains(json.dumps(k, ensure_ascii=False)) for k in fields))

        def of_tight(tight: F.Column) -> F.Column:
            whole = tight.startswith("{") & tight.endswith("}") & (F.length(tight) > 2) & ~tight.rlike(REWRITTEN)
            appended = F.concat(F.substring(tight, F.lit(1), F.length(tight) - 1), F.lit("," + tail))
            return F.when(whole & strict_object(payload), F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), appended))

        # Without escapes a string ends at the next quote, so white space outside of strings is found.
        return F.when(fresh & ~payload.contains("\\"), let(F.regexp_replace(payload, r'("[^"]*")|\s+', "$1"), of_tight))

    return let(F.split(line, " ", 3), of_parts)


def extracted(payload: dict | None, field: str, raw: bool = False, default: str = "") -> str:
    """A field as JSON, or ``raw`` as text; a missing one gives the default, null is ``null``."""
    if payload is None or field not in payload:
        return default
    value = payload[field]
    if not raw or value is None or isinstance(value, bool):
        return json.dumps(value, ensure_ascii=False)
    return value if isinstance(value, str) else str(value)


def extract_field(lines: DataFrame, field: str, raw: bool = False, default: str = "", column: str = "value") -> DataFrame:
    """``lines`` with ``extracted`` (null for a blank or malformed line) and ``outcome``:
    ``found``, ``missing``, ``blank`` or ``error``."""

    def one(line: str | None) -> tuple[str | None, str]:
        if line is None or not line.strip():
            return None, "blank"
        try:
            payload = parse_line(line)[2]
        except ValueError:
            return None, "error"
        return extracted(payload, field, raw, default), "found" if payload and field in payload else "missing"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(x) for x in batch[column].to_pylist()]
            batch = batch.append_column("extracted", pa.array([x for x, _ in done], pa.string()))
            yield batch.append_column("outcome", pa.array([x for _, x in done], pa.string()))

    lines = lines.drop("extracted", "outcome")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInArrow(run, schema + ", extracted string, outcome string")


def field_column(json_column, field: str, default: str | None = None) -> F.Column:
    """A scalar field as text in the JVM; null stays null, a missing field gives the default."""
    text = F.get_json_object(json_column, field_path(field))
    if default is None:
        return text
    present = F.coalesce(F.array_contains(F.json_object_keys(json_column), field), F.lit(False))
    return F.when(present, F.coalesce(text, F.lit("null"))).otherwise(F.lit(default))
