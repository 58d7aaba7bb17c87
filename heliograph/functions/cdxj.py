"""Capture lines: splitting, formatting and the keys derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What Python's ``str.strip`` removes and may occur in a line; Spark's trim takes blanks only.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(column) -> F.Column:
    return F.btrim(column, F.lit(WHITE))


def split_line(value) -> dict[str, F.Column]:
    """``surt``, ``ts`` and ``json`` of a line, split at its first two blanks.

    A line of fewer than two parts has none of them; a payload of white space only is
    null.  The payload is not checked here: ``parse_lines`` of the recovering grammar is.
    """
    parts = F.split(value, " ", 3)
    whole = F.size(parts) >= 2
    payload = stripped(F.get(parts, F.lit(2)))
    return {
        "surt": F.when(whole, F.get(parts, F.lit(0))),
        "ts": F.when(whole, F.get(parts, F.lit(1))),
        "json": F.when(payload != "", payload),
    }


def with_parts(lines: DataFrame) -> DataFrame:
    """``lines`` with ``surt, ts, json`` taken from ``value``."""
    return lines.withColumns(split_line(F.col("value")))


def surt_of_line(value) -> F.Column:
    """The text before the first blank; without a blank the whole line, stripped."""
    return F.when(F.contains(value, F.lit(" ")), F.substring_index(value, " ", 1)).otherwise(stripped(value))


def sort_key(value) -> F.Column:
    """Index key of a line: what stands before its payload, so key and time."""
    return F.when(F.contains(value, F.lit("{")), stripped(F.substring_index(value, "{", 1))).otherwise(stripped(value))


def format_line(surt, ts, json) -> F.Column:
    """A capture as a line; without payload, or with an empty one, two parts only."""
    bare = json.isNull() | json.rlike(r"^\s*\{\s*\}\s*$")
    return F.when(bare, F.concat_ws(" ", surt, ts)).otherwise(F.concat_ws(" ", surt, ts, json))


def strict_object(json) -> F.Column:
    """Whether a payload is exactly one JSON object that repeats no name.

    Spark's parsers do not look at what stands behind a value, so the payload is parsed as
    the one element of an array; a ``]`` of its own could close that, so where there is one
    it must also parse as a member of an object.
    """
    bare = stripped(json)
    listed = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), bare, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(bare.startswith("{") & listed.isNotNull() & alone & (~bare.contains("]") | member.isNotNull()), F.lit(False))


def payload_is_object(json) -> F.Column:
    """Whether a payload is exactly one JSON object.  Payloads that repeat a name, which are
    allowed, are taken as Spark's parser takes them, whatever stands behind them."""
    names = F.json_object_keys(json)
    repeated = names.isNotNull() & (F.size(F.array_distinct(names)) < F.size(names))
    return strict_object(json) | F.coalesce(repeated, F.lit(False))


def field_path(name: str) -> str:
    """JSON path of a top-level member, in whichever of its two spellings can hold the name."""
    if name and not set(name) & set("'?"):
        return f"$['{name}']"
    if name and not set(name) & set(".["):
        return f"$.{name}"
    raise ValueError(f"a JSON path cannot name the field {name!r}")


def field_text(json, name: str) -> F.Column:
    """A top-level field as text; null if it is missing or JSON null.

    true and false are written as predicates compare them, ``True`` and ``False``.
    """
    text = F.get_json_object(json, field_path(name))
    literal = rf'"{_escaped(name)}"\s*:\s*(?:true|false)\b'
    return F.when(text.isin("true", "false") & json.rlike(literal), F.initcap(text)).otherwise(text)


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)
