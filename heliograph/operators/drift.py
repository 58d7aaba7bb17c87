"""Schemas that drift between files.

The header schema of every file is read in parallel, the schemas are folded through
a lattice of types, every file is cast to the union schema, and the differences
between neighbouring files of a series are listed in order.

Two kinds of files are handled: Parquet files, whose footers hold the schema, and
capture files, whose schema is what their JSON payloads carry.  In payloads a field goes
by many names.  Some are known beforehand; others are told by what they hold: a name that
never stands beside the field, and mostly holds values the field holds elsewhere, is the
field renamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions.binding import let
from heliograph.runtime import materialise

# Names that are known to carry a field.  Names are compared without case,
# blanks, dots, hyphens and underscores.
FIELD_NAMES = {
    "status": ("status", "statuscode", "httpstatus", "httpstatuscode", "httpcode", "responsecode", "responsestatus", "sc"),
    "collection": ("collection", "collectionname", "collectionid", "coll", "collname", "collid", "col", "colname", "colid", "crawl", "crawlname", "crawlid"),
}
#: Share of a name's values that must be values of the field.
OVERLAP = 0.5
#: The lattice of types, bottom first; two of one rank but of different kinds meet at string.
RANKS = {"boolean": 0, "long": 1, "double": 2}


def promote(a: str | None, b: str | None) -> str | None:
    """Least type of the lattice that holds both; None (no value yet) is its bottom.

    boolean and long meet at long, long and double at double; everything else of two
    different kinds meets at string, the top.
    """
    if a is None or b is None or a == b:
        return a or b
    return max(a, b, key=RANKS.__getitem__) if a in RANKS and b in RANKS else "string"


def folded(kinds: F.Column) -> F.Column:
    """``promote`` over a group's kinds, as an aggregate: what a fold keeps is one type.

    A chain of the lattice folds to its highest; anything else of more than one kind to string.
    """
    rank = F.coalesce(*(F.when(kinds == k, r) for k, r in RANKS.items()))
    names = F.array(*(F.lit(k) for k in sorted(RANKS, key=RANKS.__getitem__)))
    alike = F.min(kinds) == F.max(kinds)
    chain = F.count(kinds) == F.count(rank)
    return F.when(alike, F.min(kinds)).when(chain, F.get(names, F.max(rank))).when(F.count(kinds) > 0, "string")


# ------------------------------------------------------------ Parquet files


def _kind(arrow_type) -> str:
    import pyarrow.types as t

    if t.is_boolean(arrow_type):
        return "boolean"
    if t.is_integer(arrow_type):
        return "long"
    if t.is_floating(arrow_type) or t.is_decimal(arrow_type):
        return "double"
    if t.is_timestamp(arrow_type) or t.is_date(arrow_type):
        return "timestamp"
    return "string"


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    from heliograph.sources.paths import filesystem

    for frame in frames:
        rows = []
        for order, path in zip(frame["file_order"], frame["path"]):
            system, inner = filesystem(path)
            schema = pq.read_schema(inner, filesystem=system)
            rows += [(order, path, i, f.name, _kind(f.type)) for i, f in enumerate(schema)]
        yield pd.DataFrame(rows, columns=["file_order", "path", "position", "field_name", "kind"])


def header_schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_order, path, position, field_name, kind`` of every file, read by the executors."""
    files = spark.createDataFrame(list(enumerate(paths)), "file_order int, path string")
    files = files.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)), "path")
    return files.mapInPandas(_headers, "file_order int, path string, position int, field_name string, kind string")


def read_drifting(spark: SparkSession, paths: list[str], renames: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One consistent table of Parquet files whose schemas differ, and the ordered changes.

    renames: name in a file -> name in the table.  Missing fields are null, values are
    cast to the promoted type (one that does not fit is null).  Files of one schema are
    scanned together.  The changes have ``file_order, path, field_name, change_kind, before,
    after``.  Without files both are empty.  The driver receives a row per column of the table
    and a row per distinct schema with its files; the log stays with the executors.
    """
    name = reduce(lambda found, pair: F.when(F.col("field_name") == pair[0], pair[1]).otherwise(found), (renames or {}).items(), F.col("field_name"))
    order = Window.partitionBy("file_order", "name").orderBy("position")
    headers = header_schemas(spark, paths).withColumn("name", name).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    headers = materialise(headers.drop("nth"), "headers")
    union = {r.name: r.kind for r in headers.groupBy("name").agg(folded(F.col("kind")).alias("kind"), F.min(F.struct("file_order", "position")).alias("at")).orderBy("at").collect()}
    per_file = headers.groupBy("file_order", "path").agg(F.array_sort(F.collect_list(F.struct("name", "field_name", "kind"))).alias("fields"))
    alike = per_file.groupBy("fields").agg(F.collect_list("path").alias("files"), F.min("file_order").alias("at")).orderBy("at").collect()
    bare = set(paths) - {p for r in alike for p in r.files}  # files without columns
    ddl = ", ".join(f"`{n}` {t}" for n, t in union.items()) or "nothing string"
    parts = []
    for fields, files in [*((r.fields, r.files) for r in alike), *([([], sorted(bare))] if bare else [])]:
        own, rows = {f.name: f.field_name for f in fields}, spark.read.parquet(*files)
        parts.append(rows.select(*((F.col(f"`{own[n]}`").try_cast(t) if n in own else F.lit(None).cast(t)).alias(n) for n, t in union.items())))
    whole = reduce(DataFrame.unionByName, parts) if parts and union else spark.createDataFrame([], ddl)
    return whole, _header_changes(spark, headers, paths)


def _header_changes(spark: SparkSession, headers: DataFrame, paths: list[str]) -> DataFrame:
    """Each file's header against the one before it, by two shuffles whatever their number."""
    held = headers.select("file_order", "name", F.struct("field_name", "kind").alias("now"))
    before = held.select((F.col("file_order") + 1).alias("file_order"), "name", F.col("now").alias("then")).where(F.col("file_order") < len(paths))
    both = held.where("file_order > 0").join(before, ["file_order", "name"], "full")
    none = F.lit(None).cast("string")
    found = _cases(F.col("now"), F.col("then"), "field_name", "kind", none)
    files = spark.createDataFrame(list(enumerate(paths)), "file_order int, path string")
    return both.select("file_order", F.col("name").alias("field_name"), F.explode(found).alias("x")).join(files, "file_order").select("file_order", "path", "field_name", "x.*")


def _cases(now: F.Column, then: F.Column, name: str, kind: str, none: F.Column, *extra: F.Column) -> F.Column:
    """The changes between two states of a field, null where it is absent."""

    def case(when: F.Column, what: str, before: F.Column, after: F.Column) -> F.Column:
        return F.when(when, F.struct(*extra, F.lit(what).alias("change_kind"), before.alias("before"), after.alias("after")))

    both = now.isNotNull() & then.isNotNull()
    return F.array_compact(F.array(
        case(now.isNotNull() & then.isNull(), "added", none, now[name]),
        case(now.isNull() & then.isNotNull(), "removed", then[name], none),
        case(both & (now[name] != then[name]), "renamed", then[name], now[name]),
        case(both & (now[kind] != then[kind]), "retyped", then[kind], now[kind]),
    ))


# ------------------------------------------------------------ capture files


def _plain(name) -> F.Column:
    return F.translate(F.lower(name), "._- ", "")


def _field_of(name) -> F.Column:
    plain, found = _plain(name), F.lit(None).cast("string")
    for field, names in FIELD_NAMES.items():
        found = F.when(plain.isin(*names), field).otherwise(found)
    return found


def _at(payload: F.Column, name: str) -> F.Column:
    """The member of a payload (a variant) with exactly this name, as a variant."""
    for quote in "\"'":
        if quote not in name and "\\" not in name:
            return F.try_variant_get(payload, f"$[{quote}{name}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(payload, "$", "map<string,variant>"), F.lit(name))


def _text(value: F.Column, shape: F.Column) -> F.Column:
    """A value as the table holds it."""
    written = F.try_variant_get(value, "$", "string")
    return (
        F.when(shape.startswith("ARRAY"), F.array_join(F.try_variant_get(value, "$", "array<string>"), ","))
        .when(shape.startswith("OBJECT"), F.coalesce(F.try_variant_get(value, "$.name", "string"), written))
        .otherwise(written)
    )


def _kind_of(shape: F.Column) -> F.Column:
    """The JSON type of a value of this shape; null for null."""
    return (
        F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object").when(shape != "VOID", "number")
    )


def field_names(captures: DataFrame) -> dict[str, str]:
    """Names that carry a field in these payloads -> the field.

    The names of a payload are read without its values, and a table has few different
    lists of names, so what is looked at further is small.  Besides the known names, a name is a
    field's if it never stands in one record with a known name of that field, and at least OVERLAP
    of its values are values held under known names.  What comes here is a row per name
    that carries a field.
    """
    keys = F.json_object_keys("json_data")
    lists = materialise(captures.select(keys.alias("names")).where("names is not null").groupBy("names").agg(F.count("*").alias("n")), "names")
    beside = [F.coalesce(F.array_contains(F.transform("names", _field_of), f), F.lit(False)).alias(f) for f in FIELD_NAMES]
    seen = lists.select(F.explode("names").alias("name"), *beside).groupBy("name").agg(*(F.bool_or(f).alias(f) for f in FIELD_NAMES))
    seen = seen.withColumn("field", _field_of(F.col("name")))
    open_ = F.col("field").isNull() & ~reduce(lambda a, b: a & b, (F.col(f) for f in FIELD_NAMES))
    found = {r.name: r.field for r in seen.where("field is not null").select("name", "field").collect()}
    asked = seen.where(open_)
    return found | _learned(captures, asked, found) if found and not asked.isEmpty() else found


def _learned(captures: DataFrame, asked: DataFrame, known: dict[str, str]) -> dict[str, str]:
    """Names among ``asked`` whose values are mostly those of a field they never stand beside."""
    payload = F.try_variant_get(F.try_parse_json("json_data"), "$", "map<string,variant>")
    members = captures.select(F.explode(payload).alias("name", "value")).join(asked.select("name", *FIELD_NAMES), "name").select("name", *FIELD_NAMES, _text(F.col("value"), F.schema_of_variant("value")).alias("text"))
    counted = materialise(members.where("text is not null").groupBy("name", *FIELD_NAMES, "text").agg(F.count("*").alias("n")), "asked-values")
    held = _with_members(captures, known).select(F.inline("members")).select("field_name", "text").where("text is not null").distinct()
    sizes = counted.groupBy("name").agg(F.sum("n").alias("size"))
    # A name that stands beside one field is asked for the others only.
    apart = reduce(lambda a, b: a | b, ((F.col("field_name") == f) & ~F.col(f) for f in FIELD_NAMES))
    met = counted.join(held, "text").where(apart).groupBy("name", "field_name").agg(F.sum("n").alias("met"))
    likely = met.join(sizes, "name").where(F.col("met") >= OVERLAP * F.col("size"))
    best = likely.groupBy("name").agg(F.max_by("field_name", F.struct("met", "field_name")).alias("field"))
    return {r.name: r.field for r in best.collect()}


def _with_members(captures: DataFrame, names: dict[str, str], *keep: str, texts: bool = True) -> DataFrame:
    """``captures`` with ``members``: of each payload those that carry a field, as
    ``field_name, name, kind`` and, with ``texts``, ``text``, in order of names.

    The payload is parsed once, and only the members in ``names`` are looked at.
    """
    parsed = captures.select(*keep, F.try_parse_json("json_data").alias("hg_payload"))
    looked = [F.struct(F.lit(names[n]).alias("field_name"), F.lit(n).alias("name"), _at(F.col("hg_payload"), n).alias("value")) for n in sorted(names)]
    held = F.filter(F.array(*looked), lambda e: e["value"].isNotNull()) if looked else F.array().cast("array<struct<field_name:string,name:string,value:variant>>")

    def member(e: F.Column) -> F.Column:
        value = e["value"]
        return let(F.schema_of_variant(value), lambda shape: F.struct(e["field_name"].alias("field_name"), e["name"].alias("name"), _kind_of(shape).alias("kind"), *([_text(value, shape).alias("text")] if texts else [])))

    return parsed.select(*keep, F.filter(F.transform(held, member), lambda m: m["kind"].isNotNull()).alias("members"))


def union_schema(schemas: DataFrame) -> DataFrame:
    """``field_name, kind``: the schemas of all files folded through the lattice."""
    arrow = F.when(F.col("kind") == "number", "double").otherwise(F.col("kind"))
    return schemas.groupBy("field_name").agg(folded(arrow).alias("kind"))


def file_schemas(captures: DataFrame) -> DataFrame:
    """Per file and field: the name and the JSON type of most of its non-null values.

    Result: ``src_path, field_name, name, kind``; a file without the field has no row.  Ties go
    to the name or type that sorts last.  Counts are combined on the map side, so a large
    file costs a few rows per map task.
    """
    captures = captures.where("src_path is not null")
    members = _with_members(captures, field_names(captures), "src_path", texts=False)
    # A file's records carry few different sets of members, so those are counted first.  inline
    # would have the optimizer filter rows by their members, which computes them once more.
    counted = members.groupBy("src_path", "members").agg(F.count("*").alias("n")).select("src_path", "n", F.inline_outer("members")).where("field_name is not null")
    counted = counted.groupBy("src_path", "field_name", "name", "kind").agg(F.sum("n").alias("n")).repartition("src_path")
    by = Window.partitionBy("src_path", "field_name", "name"), Window.partitionBy("src_path", "field_name", "kind")
    counted = counted.withColumns({"names": F.sum("n").over(by[0]), "kinds": F.sum("n").over(by[1])})
    return counted.groupBy("src_path", "field_name").agg(
        F.max_by("name", F.struct("names", "name")).alias("name"), F.max_by("kind", F.struct("kinds", "kind")).alias("kind")
    )


def schema_changes(captures: DataFrame) -> DataFrame:
    """Each change of a field from a file to the next of its series.

    Files of one folder form a series, ordered by the five-digit number that ends the
    WARC's name, then by path; a file whose name has no such number is in no series.
    Result: ``src_path, field_name, change_kind, before, after, series, file_number``.  A file
    that carries nothing still takes its place.  Payloads that are null, no object or
    repeat a name at the top level carry nothing.
    """
    files = captures.where("src_path is not null").select("src_path").distinct()
    states = file_schemas(captures).groupBy("src_path").agg(
        *(F.max(F.when(F.col("field_name") == f, F.struct("name", "kind"))).alias(f) for f in FIELD_NAMES)
    )
    number = F.regexp_extract("src_path", r"([0-9]{5})(?:\.[A-Za-z][^/]*)?$", 1)
    placed = (
        files.join(states, "src_path", "left").withColumn("number", number).where("number <> ''")
        .select("src_path", F.regexp_extract("src_path", r"^(.*)/[^/]*$", 1).alias("series"), F.col("number").cast("int").alias("file_number"), *FIELD_NAMES)
    )
    # Five digits bound a series to 100 000 places, whatever the number of captures.
    order = Window.partitionBy("series").orderBy("file_number", "src_path")
    lagged = placed.withColumns({f"{f}_before": F.lag(f).over(order) for f in FIELD_NAMES} | {"place": F.row_number().over(order)}).where("place > 1")
    none = F.lit(None).cast("string")
    found = F.concat(*(_cases(F.col(f), F.col(f"{f}_before"), "name", "kind", none, F.lit(f).alias("field_name")) for f in FIELD_NAMES))
    return lagged.select("src_path", "series", "file_number", F.explode(found).alias("x")).select("src_path", "x.*", "series", "file_number")


def consistent_table(captures: DataFrame) -> DataFrame:
    """The captures with one ``status`` and one ``collection`` column, both string.

    String is where the kinds of all files meet in the lattice unless all are of one kind;
    it is taken always, as the table is to have.  A number is written as JSON writes it, of an array the elements joined by commas, of
    an object its ``name`` (without one, its JSON text).  If a record carries a field under
    several names, the first non-null one counts.  Columns of ``captures`` called
    ``status`` or ``collection`` give way.
    """
    kept = [c for c in captures.columns if c not in FIELD_NAMES]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("hg_row")
    found = _with_members(captures.select("json_data", row), field_names(captures), "hg_row")

    def first(field: str) -> F.Column:
        return F.try_element_at(F.filter("members", lambda m: m["field_name"] == field), F.lit(1))["text"].alias(field)

    return found.select("hg_row", *map(first, FIELD_NAMES)).select("hg_row.*", *FIELD_NAMES)
