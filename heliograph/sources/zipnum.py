"""ZipNum clusters: block-compressed captures with a sparse index.

``.idx`` has a row per block (first key, shard, offset, length, shard number) in order of keys,
``.loc`` maps shards to files, and a shard is a row of gzip members.  The data source plans
slices of the index by their bytes; a task reads its slice and the blocks that it names.
For a key predicate a binary search over the bytes of the index finds the slice that may
hold the key, so the driver reads a few rows of an index of any size.
"""

from __future__ import annotations

import io
import os
import posixpath
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from heliograph.functions.cdxj import stripped
from heliograph.schema import IDX
from heliograph.sources.paths import filesystem, is_local, join, local

MAX_BLOCK = 512 << 20
#: Bytes of the index that a task reads, and most tasks of a scan: beyond that, slices grow.
SLICE, MOST_SLICES = 1 << 16, 100_000
# Endings of shards; a name without one gets the first whose file there is.
ENDINGS = (".cdx.gz", ".cdxj.gz")
_SCHEMA = "surt string, ts string, json string, value string, src_path string, src_block long, src_pos long, fault string"


def read_idx(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Index rows; comments, blank lines and lines of fewer than five columns are passed
    over, a number that does not parse is null."""
    parts = F.split("value", "\t")
    rows = spark.read.text(paths).where((stripped(F.col("value")) != "") & ~F.col("value").startswith("#") & (F.size(parts) >= 5))
    kinds = dict(zip(IDX.names, ("string", "string", "bigint", "bigint", "int")))
    return rows.select(*(F.get(parts, F.lit(i)).try_cast(kinds[n]).alias(n) for i, n in enumerate(IDX.names)))


def read_loc(spark: SparkSession, path: str) -> DataFrame:
    """``shard, path``; of repeated shards the last row counts."""
    from heliograph.sources.flat import content_lines, read_lines

    parts = F.split("value", "\t")
    rows = content_lines(read_lines(spark, path)).where(F.size(parts) >= 2)
    named = rows.select(F.get(parts, F.lit(0)).alias("shard"), F.get(parts, F.lit(1)).alias("path"), "src_block", "src_pos")
    return named.groupBy("shard").agg(F.max_by("path", F.struct("src_block", "src_pos")).alias("path"))


def parse_idx_line(line: str) -> tuple[str, str, int, int, int]:
    """One index row; ValueError if columns are missing or no numbers."""
    parts = line.rstrip("\r\n").split("\t")
    if len(parts) < 5:
        raise ValueError(f"an index row has five columns: {line!r}")
    return parts[0], parts[1], int(parts[2]), int(parts[3]), int(parts[4])


def loc_file(idx: str) -> str | None:
    path = os.path.splitext(idx)[0] + ".loc"
    system, inner = filesystem(path)
    return path if system.get_file_info(inner).is_file else None


def load_loc(path: str | None, wanted: set[str] | None = None) -> dict[str, str]:
    """Files of shards, or of the ``wanted`` ones only; of repeated shards the last row counts."""
    found: dict[str, str] = {}
    if path is None:
        return found
    system, inner = filesystem(path)
    with system.open_input_stream(inner, compression=None) as file:
        for line in io.TextIOWrapper(io.BufferedReader(file), encoding="utf-8"):
            parts = line.strip().split("\t")
            if len(parts) >= 2 and not parts[0].startswith("#") and (wanted is None or parts[0] in wanted):
                found[parts[0]] = parts[1]
    return found


def shard_path(shard: str, base_dir: str, loc: dict[str, str]) -> str:
    """The shard's file, which must lie within ``base_dir`` after links are followed."""
    name = loc.get(shard, shard)
    if shard not in loc and not shard.endswith(ENDINGS):
        paths = [_inside(shard, name + ending, base_dir) for ending in ENDINGS]
        return next((p for p in paths if _is_file(p)), paths[0])
    return _inside(shard, name, base_dir)


def _is_file(path: str) -> bool:
    system, inner = filesystem(path)
    return system.get_file_info(inner).is_file


def _inside(shard: str, name: str, base_dir: str) -> str:
    if is_local(base_dir):
        path, root = os.path.realpath(os.path.join(local(base_dir), local(name))), os.path.realpath(local(base_dir))
    else:
        path, root = (name if "://" in name else join(base_dir, name)), base_dir.rstrip("/")
        path = "://".join((path.split("://", 1)[0], posixpath.normpath(path.split("://", 1)[1])))
    if path != root and not path.startswith(root + "/"):
        raise ValueError(f"shard {shard!r} lies outside of {base_dir!r}")
    return path


def key_of(idx_key: str) -> str:
    """The SURT of an index key, which may be followed by a time."""
    return idx_key.split(" ", 1)[0]


def candidate_blocks(keys: list[str], wanted: str, prefix: bool) -> range:
    """Numbers of the blocks that may hold a key or prefix.

    The block before the first whose key is not below ``wanted`` may hold its beginning;
    then all follow whose first key is, or begins with, ``wanted``.
    """
    surts = [key_of(k) for k in keys]
    first = bisect_left(surts, wanted)
    end = first
    while end < len(surts) and (surts[end].startswith(wanted) if prefix else surts[end] == wanted):
        end += 1
    return range(max(first - 1, 0), end)


class IndexFile:
    """An open ``.idx`` whose rows are in order of keys."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def rows(self, start: int, end: int) -> Iterator[tuple[int, int, str]]:
        """Place, end and text of the rows that begin from ``start`` up to before ``end``."""
        at = start
        if start:  # the line that goes on there began before
            self.file.seek(start - 1)
            at = start - 1 + len(self._line(start - 1))
        while at < end:
            line = self._line(at)
            if not line:
                return
            if line.strip() and not line.startswith(b"#"):
                yield at, at + len(line), line.decode("utf-8", "surrogateescape")
            at += len(line)

    def _line(self, at: int) -> bytes:
        """A whole line; reads ahead in pieces, which are kept."""
        held, base = getattr(self, "_held", (b"", 0))
        if not base <= at < base + len(held):
            held, base = b"", at
        while True:
            cut = held.find(b"\n", at - base)
            if cut >= 0:
                self._held = held, base
                return held[at - base : cut + 1]
            self.file.seek(base + len(held))
            more = self.file.read(SLICE)
            if not more:
                self._held = held, base
                return held[at - base :]
            held, base = held[at - base :] + more, at

    def first(self, below) -> tuple[int, int | None]:
        """Where the rows begin that are not ``below``, which is true of the first rows and of no
        later one; and the place of the row before."""
        low, high, before = 0, self.size, None
        while low < high:
            middle = (low + high) // 2
            row = next(self.rows(middle, high), None)
            if row is not None and below(key_of(row[2].split("\t", 1)[0])):
                low, before = row[1], row[0]
            else:
                high = middle
        return low, before

    def candidates(self, wanted: str, prefix: bool) -> tuple[int, int]:
        """The bytes of the rows whose blocks may hold a key or prefix: those of
        ``candidate_blocks``, found by two binary searches."""
        start, before = self.first(lambda k: k < wanted)
        end, _ = self.first(lambda k: k < wanted or (k.startswith(wanted) if prefix else k == wanted))
        return start if before is None else before, end


@dataclass
class Slice(InputPartition):
    """Rows of the index that begin within these bytes."""

    start: int
    end: int

    def __init__(self, start: int, end: int):
        super().__init__(None)
        self.start, self.end = start, end


class ZipNumReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.idx = options["path"]
        self.base = options.get("base_dir") or os.path.dirname(os.path.abspath(local(self.idx)) if is_local(self.idx) else self.idx)
        self.loc = options.get("loc") or loc_file(self.idx)
        self.wanted: tuple[str, bool] | None = None

    def _open(self):
        system, inner = filesystem(self.idx)
        return system.open_input_file(inner)

    def partitions(self) -> list[Slice]:
        with self._open() as file:
            size = file.size()
            start, end = IndexFile(file, size).candidates(*self.wanted) if self.wanted else (0, size)
        step = max(SLICE, (end - start) // MOST_SLICES)
        return [Slice(at, min(at + step, end)) for at in range(start, end, step)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with self._open() as file:
            texts = [row for _, _, row in IndexFile(file, file.size()).rows(partition.start, partition.end)]
        rows, faults = [], []
        for text in texts:
            try:
                rows.append(parse_idx_line(text))
            except ValueError:
                faults.append((self.idx, None, None, "bad index row"))
        loc = load_loc(self.loc, {r[1] for r in rows})
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for _, shard, offset, length, number in sorted(rows, key=lambda r: (r[4], r[1], r[2])):
            spans.setdefault((number, shard), []).append((offset, length))
        for (number, shard), blocks in spans.items():
            path = shard_path(shard, self.base, loc)
            for offset, data, fault in read_blocks(path, blocks):
                place = number << 40 | offset
                if fault:
                    faults.append((path, place, None, fault))
                    continue
                found, broken = _records(data, path, place)
                faults += broken
                yield _batch(found)
        if faults:
            yield _batch([(None, None, None, None, *f) for f in faults])


def _records(data: bytes, path: str, place: int) -> tuple[list[tuple], list[tuple]]:
    """The captures of a block, and its lines that are no UTF-8."""
    found, broken = [], []
    try:
        lines = data.decode("utf-8").split("\n")
    except UnicodeDecodeError:
        lines = data.split(b"\n")
    for number, line in enumerate(lines):
        if isinstance(line, bytes):
            try:
                line = line.decode("utf-8")
            except UnicodeDecodeError:
                broken.append((path, place, number, "not UTF-8"))
                continue
        line = line.removesuffix("\r")
        if not line.strip():
            continue
        surt, _, rest = line.partition(" ")
        ts, _, payload = rest.partition(" ")
        whole = bool(rest)
        found.append((surt if whole else None, ts if whole else None, payload.strip() or None, line, path, place, number, None))
    return found, broken


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 5 + (pa.int64(),) * 2 + (pa.string(),)
    names = ["surt", "ts", "json", "value", "src_path", "src_block", "src_pos", "fault"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class PushingReader(ZipNumReader):
    """Spark accepts this method only while pushdown to Python sources is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A key or prefix selects blocks; every filter is also applied to the rows."""
        for f in filters:
            if isinstance(f, EqualTo | StringStartsWith) and f.attribute == ("surt",) and self.wanted is None and f.value:
                self.wanted = (f.value, isinstance(f, StringStartsWith))
            yield f


def read_blocks(path: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset and content of each block, or what is wrong with it.  A link in place of the
    file is refused."""
    system, inner = filesystem(path)
    if not system.get_file_info(inner).is_file:
        yield from ((offset, b"", "no such shard") for offset, _ in spans)
        return
    own = is_local(path)
    with os.fdopen(os.open(inner, os.O_RDONLY | os.O_NOFOLLOW), "rb") if own else system.open_input_file(inner) as file:
        for offset, length in spans:
            if not 0 < length <= MAX_BLOCK or offset < 0:
                yield offset, b"", "no possible block"
                continue
            file.seek(offset)
            try:
                yield offset, gunzip(file.read(length)), None
            except (zlib.error, EOFError):
                yield offset, b"", "broken block"


def gunzip(data: bytes) -> bytes:
    """All gzip members of ``data``."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data, MAX_BLOCK))
        if not member.eof:
            raise EOFError("a gzip member is cut")
        data = member.unused_data
    return b"".join(out)


class ZipNumSource(DataSource):
    """``spark.read.format("zipnum").load("x.idx")``; options ``base_dir``, ``loc``, ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "zipnum"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ZipNumReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ZipNumReader)(self.options)


def read_zipnum(spark: SparkSession, idx: str, base_dir: str | None = None, loc: str | None = None, faults: Observation | bool = False) -> DataFrame:
    """The captures of a cluster.

    Key predicates reach the reader if ``spark.sql.python.filterPushdown.enabled`` is true;
    without it all blocks are read and filtered.  What cannot be read is passed over: rows
    of the index that do not parse, shards that are missing, blocks that are broken and
    lines that are no UTF-8.  With ``faults=True`` just these come out, as ``src_path,
    src_block, src_pos, fault``; given an observation, their number is observed as ``n_faults``
    while the captures are read (which keeps predicates from reaching the reader).
    """
    spark.dataSource.register(ZipNumSource)
    reader = spark.read.format("zipnum").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, value in (("base_dir", base_dir), ("loc", loc)):
        if value:
            reader = reader.option(name, value)
    rows = reader.load(idx)
    if faults is True:
        return rows.where("fault is not null").select("src_path", "src_block", "src_pos", "fault")
    if faults:
        rows = rows.observe(faults, F.count("fault").alias("n_faults"))
    return rows.where("fault is null").drop("fault")
