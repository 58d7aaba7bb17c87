"""Deduplicating new batches against all history, by sorted-neighbourhood runs.

Accepted records live as runs in a folder that outlasts the session.  For each sort key the
key space is cut into ranges, and a run holds a Parquet file per range it reaches, sorted
by (key, second).  A new batch is cut at the same borders and sorted alike; a task walks its
ranges along their files, opening only row groups that overlap, and compares each new
record with the records inside its window.  What is accepted becomes a new run; ranges with
too many files are merged from time to time, each by one task, without a shuffle.  The history
is neither shuffled, nor sorted, nor read as a whole for a batch.

Keys are held as 128 bits of hash, so a range's border is three integers however long the
keys are.  A manifest lists ranges and files; it is replaced in one step, so a run that dies
leaves the former state.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.runtime import discard, materialise, parallelism, scratch_path
from heliograph.sinks.commits import Commits
from heliograph.sources.paths import filesystem

PLACE = ["a", "b", "second"]
PLACES = np.dtype([(c, "<i8") for c in PLACE])
#: Seconds of four-digit years lie within half of this on both sides of 1970.
WIDTH, HALF = 1 << 40, 1 << 39
DAY = 86400
ROW_GROUP = 1 << 17
_FILES = "uri string, rows long, a0 long, b0 long, s0 long, a1 long, b1 long, s1 long"
_ROWS = "id long, turn long, a long, b long, second long"


def _hashed(key: F.Column, bits: int) -> F.Column:
    return F.when(key.isNotNull(), F.xxhash64(F.lit(bits), key) if bits else F.xxhash64(key))


class SortedRuns:
    """The accepted records' keys as sorted runs in ``path`` (a scratch folder without one).

    Records are rows with string columns ``keys`` and a long ``second``; ``window`` is the
    greatest distance in seconds at which two records with an equal key count as repeats.
    A folder that holds runs is gone on with; it must have been made for the same keys and
    window (ValueError).  A record without a key or second is compared under its other keys
    only.  ``rows_read`` counts the rows of runs that were looked at.
    """

    def __init__(self, spark: SparkSession, window: int, keys: Sequence[str] = ("key",), path: str | None = None, compact_every: int = 4, rows_per_range: int = 1 << 20):
        self.spark, self.window, self.keys = spark, window, list(keys)
        self.compact_every, self.rows_per_range = compact_every, rows_per_range
        self.path = (path or scratch_path(spark, "runs")).rstrip("/")
        self.commits = Commits(spark, self.path)
        self.rows_read = spark.sparkContext.accumulator(0)
        held = self.commits.latest()
        if held and (held["keys"], held["window"]) != (self.keys, window):
            raise ValueError(f"the runs in {path} were made for keys {held['keys']} and window {held['window']}")
        self.version = held["version"] if held else 0
        #: Per key: borders between ranges, and files as (name, rows, low, high); a row per file.
        self.borders = {k: [tuple(x) for x in held["borders"][k]] if held else [] for k in self.keys}
        self.files = {k: [(n, rows, tuple(lo), tuple(hi)) for n, rows, lo, hi in held["files"][k]] if held else [] for k in self.keys}

    # ------------------------------------------------------------ writing

    def add(self, records: DataFrame) -> None:
        """Takes records without comparing them: writes a run and publishes it."""
        hashed = records.select(*(x for k in self.keys for x in (_hashed(F.col(k), 0).alias(f"a_{k}"), _hashed(F.col(k), 1).alias(f"b_{k}"))), "second")
        if len(self.keys) > 1:
            hashed = materialise(hashed, "records")
        self._add({k: hashed.select(F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b"), "second") for k in self.keys})

    def _add(self, places: dict[str, DataFrame]) -> None:
        stale: list[str] = []
        for key, rows in places.items():
            written = self._write(key, rows)
            if not self.files[key]:
                self.borders[key] = [low for _, _, low, _ in written[1:]]
            else:  # a range that this run alone fills is cut where its files begin
                ranges: dict[int, list[tuple]] = defaultdict(list)
                for _, n, low, _ in written:
                    ranges[bisect_right(self.borders[key], low)].append((n, low))
                cuts = [low for files in ranges.values() for n, low in files[1:] if n >= self.rows_per_range // 2]
                self.borders[key] = sorted(self.borders[key] + cuts)
            self.files[key] += written
            stale += self._merge(key)
        self.version += 1
        self.commits.publish(self.version, {"keys": self.keys, "window": self.window, "borders": self.borders, "files": self.files})
        self.commits.forget(self.version - 1)
        for name in stale:
            self.commits.remove(name)

    def _folder(self, key: str) -> str:
        name = self.commits.fresh(f"{self.keys.index(key)}-{self.version + 1}")
        system, inner = filesystem(f"{self.path}/{name}")
        system.create_dir(inner, recursive=True)
        return name

    def _write(self, key: str, rows: DataFrame) -> list[tuple]:
        """Repeated places become one, on the map side first.

        Tasks get quantiles of the places, so a hot key is written by several, and begin a
        file with each range; the first run's tasks are the ranges.
        """
        pairs = materialise(rows.where("a is not null and second is not null").distinct(), "pairs")
        parts = max(parallelism(self.spark), -(-pairs.count() // self.rows_per_range))
        if self.files[key]:
            ordered = self._routed(key, pairs, "a long, b long, second long").repartitionByRange(parts, *PLACE)
        else:
            ordered = pairs.repartitionByRange(parts, *PLACE).withColumn("range", F.spark_partition_id())
        written = self._written(ordered.sortWithinPartitions(*PLACE).mapInArrow(_write_ranges(self.path, self._folder(key)), _FILES))
        discard(pairs)
        return written

    @staticmethod
    def _written(files: DataFrame) -> list[tuple]:
        found = [(r.uri, r.rows, (r.a0, r.b0, r.s0), (r.a1, r.b1, r.s1)) for r in files.collect()]  # a row per file
        return sorted(found, key=lambda f: f[2])

    def _merge(self, key: str) -> list[str]:
        """Merges the files of every range that has too many; returns the files merged."""
        by_range: dict[int, list[str]] = defaultdict(list)
        for name, _, low, _ in self.files[key]:
            by_range[bisect_right(self.borders[key], low)].append(name)
        todo = [(r, names) for r, names in sorted(by_range.items()) if len(names) > self.compact_every]
        if not todo:
            return []
        ranges = self.spark.createDataFrame(todo, "range int, names array<string>").repartition(len(todo), "range")
        written = self._written(ranges.mapInArrow(_merge_ranges(self.path, self._folder(key), self.rows_per_range), _FILES))
        merged = {name for _, names in todo for name in names}
        self.files[key] = [f for f in self.files[key] if f[0] not in merged] + written
        # A range that has grown was written in pieces, which are ranges from now on.
        starts: dict[int, list[tuple]] = defaultdict(list)
        for _, _, low, _ in written:
            starts[bisect_right(self.borders[key], low)].append(low)
        self.borders[key] = sorted(self.borders[key] + [low for lows in starts.values() for low in lows[1:]])
        return sorted(merged)

    # ------------------------------------------------------------ comparing

    def _routed(self, key: str, rows: DataFrame, schema: str) -> DataFrame:
        """``rows`` with the number of their range.

        A range holds about rows_per_range records, so the borders, 24 bytes each, are
        some 25 MB for 1e12 records.
        """
        borders = self.spark.sparkContext.broadcast(np.array(self.borders[key], PLACES))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("range", pa.array(np.searchsorted(borders.value, _places(batch), "right").astype(np.int32)))

        return rows.mapInArrow(route, f"{schema}, range int")

    def known(self, key: str, rows: DataFrame) -> DataFrame:
        """``id, turn, a, b, second`` with ``known``: a run holds a record in its window."""
        near = []
        for name, _, (a0, b0, s0), (a1, b1, s1) in self.files[key]:
            first, last = bisect_right(self.borders[key], (a0, b0, s0 - self.window)), bisect_right(self.borders[key], (a1, b1, s1 + self.window))
            near += [(r, name) for r in range(first, last + 1)]
        routed = materialise(self._routed(key, rows.select("id", "turn", *PLACE), _ROWS), "routed")
        # Rows that crowd into a range are spread over several tasks by their hours, each with the range's files.
        crowded = routed.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > self.rows_per_range).collect()  # a row per task's fill
        parts = {r.range: -(-r.n // self.rows_per_range) for r in crowded}
        near = [(r, p, name) for r, name in near for p in range(parts.get(r, 1))]
        if parts:
            spread = F.broadcast(self.spark.createDataFrame(list(parts.items()), "range int, parts long"))
            part = F.pmod(F.xxhash64(F.floor(F.col("second") / 3600)), F.coalesce("parts", F.lit(1))).cast("int")
            routed_ = routed.join(spread, "range", "left").withColumn("part", part).drop("parts")
        else:
            routed_ = routed.withColumn("part", F.lit(0))
        files = self.spark.createDataFrame(near, "range int, part int, uri string")
        files = files.selectExpr(*(f"cast(null as long) as {c}" for c in ("id", "turn", *PLACE)), "range", "part", "uri")
        # The files of a range come before its rows.
        ordered = files.unionByName(routed_.withColumn("uri", F.lit(None).cast("string"))).repartition("range", "part")
        ordered = ordered.sortWithinPartitions("range", "part", F.desc_nulls_last("uri"), *PLACE)
        path, window, read = self.path, self.window, self.rows_read

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, opened = None, {}
            for batch in batches:
                number = batch["range"].to_numpy().astype(np.int64) << 31 | batch["part"].to_numpy()
                starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
                for first, end in zip(starts, np.append(starts[1:], len(number))):
                    part = batch.slice(first, end - first)
                    if number[first] != at:
                        at, opened = number[first], {}
                    opened |= dict.fromkeys(part["uri"].drop_null().to_pylist())
                    rows = part.filter(part["uri"].is_null())
                    if rows.num_rows:
                        yield rows.select(["id", "turn", *PLACE]).append_column("known", pa.array(_in_window(_places(rows), path, opened, window, read)))

        tested = materialise(ordered.mapInArrow(walk, f"{_ROWS}, known boolean"), "tested")
        discard(routed)
        return tested

    def absorb(self, batch: DataFrame) -> DataFrame:
        """Takes rows in order of (``turn``, ``id``): ``id, accepted`` of every row.

        ``batch`` has the ids, which are unique, ``turn`` (without it, all rows have one),
        the keys and ``second``.  Under each key in turn, a row is a repeat if a record of
        a run, or a row before it that is no repeat under this key, has its key and a second at
        most ``window`` away; it is accepted if it is no repeat under any key.  A row that
        cannot be compared under any key is accepted.
        """
        turn = F.col("turn").cast("long") if "turn" in batch.columns else F.lit(0).cast("long")
        hashes = [x for k in self.keys for x in (_hashed(F.col(k), 0).alias(f"a_{k}"), _hashed(F.col(k), 1).alias(f"b_{k}"))]
        rows = materialise(batch.select(F.col("id").cast("long").alias("id"), turn.alias("turn"), F.col("second").cast("long").alias("second"), *hashes), "incoming")
        alive = rows
        for key in self.keys:
            comparable = F.col(f"a_{key}").isNotNull() & F.col("second").isNotNull()
            mine = alive.where(comparable).select("id", "turn", F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), "second")
            tested = self.known(key, mine)
            fresh = tested.where("not known").groupBy(*PLACE).agg(F.min(F.struct("turn", "id")).alias("x")).select(*PLACE, "x.turn", "x.id")
            accepted = materialise(first_come(fresh, self.window), "accepted")
            before, alive = alive, materialise(alive.join(accepted.select("id"), "id", "left_semi").unionByName(alive.where(~comparable)), "alive")
            discard(tested, accepted, *([before] if before is not rows else []))
        self._add({k: alive.select(F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b"), "second") for k in self.keys})
        judged = rows.select("id").join(alive.select("id", F.lit(True).alias("accepted")), "id", "left")
        return judged.select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def _places(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    found = np.empty(batch.num_rows, PLACES)
    for c in PLACE:
        found[c] = batch[c].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[c].to_numpy()
    return found


def _save(path: str, name: str, places: np.ndarray) -> tuple:
    import pyarrow.parquet as pq

    system, inner = filesystem(f"{path}/{name}")
    pq.write_table(pa.table({c: np.ascontiguousarray(places[c]) for c in PLACE}), inner, filesystem=system, row_group_size=ROW_GROUP)
    return name, len(places), *places[0].tolist(), *places[-1].tolist()


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["uri", "rows", "a0", "b0", "s0", "a1", "b1", "s1"]
    kinds = (pa.string(),) + (pa.int64(),) * 7
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _write_ranges(path: str, folder: str):
    """Writes sorted rows, a file per range; names hold the attempt, so a task that is run
    again leaves nothing that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, at, held, rows = TaskContext.get().taskAttemptId(), None, [], []

        def close() -> None:
            if held:
                rows.append(_save(path, f"{folder}/{attempt}-{len(rows)}.parquet", np.concatenate(held)))
                held.clear()

        for batch in batches:
            number, places = batch["range"].to_numpy(), _places(batch)
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for first, end in zip(starts, np.append(starts[1:], len(number))):
                if number[first] != at:
                    close()
                    at = number[first]
                held.append(places[first:end])
        close()
        yield _file_rows(rows)

    return run


def _merge_ranges(path: str, folder: str, most: int):
    """Merges the sorted files of each range; a range that has doubled is written in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, rows = TaskContext.get().taskAttemptId(), []
        for batch in batches:
            for names in batch["names"].to_pylist():
                runs = np.concatenate([np.concatenate([_places(g) for g in RunFile(path, n).all()]) for n in names])
                # A stable sort of runs that are sorted is a merge.
                merged = runs[np.lexsort([runs[c] for c in reversed(PLACE)])]
                merged = merged[np.append(True, merged[1:] != merged[:-1])]
                pieces = max(1, len(merged) // most)
                rows += [_save(path, f"{folder}/{attempt}-{len(rows) + i}.parquet", p) for i, p in enumerate(np.array_split(merged, pieces))]
        yield _file_rows(rows)

    return run


class RunFile:
    """A file of a run, read by row group; the last row group stays in memory."""

    def __init__(self, folder: str, name: str):
        import pyarrow.parquet as pq

        system, path = filesystem(f"{folder}/{name}")
        self.file = pq.ParquetFile(path, filesystem=system)
        self.at, self.rows = -1, None
        meta = self.file.metadata
        self.stats = [[meta.row_group(g).column(i).statistics for i in (0, 2)] for g in range(meta.num_row_groups)]

    def all(self) -> Iterator[pa.Table]:
        for g in range(len(self.stats)):
            yield self.file.read_row_group(g, columns=PLACE)

    def groups(self, low: tuple[int, int], high: tuple[int, int]) -> Iterator[np.ndarray]:
        """Row groups that may hold places from ``low`` to ``high``, given as hash and second."""
        for g, (a, s) in enumerate(self.stats):
            # Seconds are in order only where there is one key.
            first, last = ((a.min, s.min), (a.max, s.max)) if a.min == a.max else ((a.min, -HALF), (a.max, HALF))
            if last < low or first > high:
                continue
            if g != self.at:
                self.at, self.rows = g, _places(self.file.read_row_group(g, columns=PLACE))
            yield self.rows


def _in_window(mine: np.ndarray, path: str, opened: dict[str, RunFile | None], window: int, read) -> np.ndarray:
    """Which of some sorted places have a run's record within the window."""
    known = np.zeros(len(mine), bool)
    wanted = np.unique(mine["a"])
    low, high = (int(mine["a"][0]), int(mine["second"][0]) - window), (int(mine["a"][-1]), int(mine["second"][-1]) + window)
    if low[0] != high[0]:
        low, high = (low[0], -HALF), (high[0], HALF)
    for name in opened:
        if opened[name] is None:
            opened[name] = RunFile(path, name)
        for theirs in opened[name].groups(low, high):
            read.add(len(theirs))
            theirs = theirs[wanted[np.minimum(np.searchsorted(wanted, theirs["a"]), len(wanted) - 1)] == theirs["a"]]
            if not len(theirs):
                continue
            number = np.unique(np.concatenate([mine[["a", "b"]], theirs[["a", "b"]]]), return_inverse=True)[1].reshape(-1)
            here, there = number[: len(mine)] * WIDTH + mine["second"], np.sort(number[len(mine) :] * WIDTH + theirs["second"])
            known |= np.searchsorted(there, here + window, "right") > np.searchsorted(there, here - window, "left")
    return known


# ---------------------------------------------------------------- within a batch


def first_come(rows: DataFrame, window: int) -> DataFrame:
    """Of ``a, b, second, turn, id`` with unique places: the rows accepted in order of (turn, id).

    A row is accepted unless one accepted before it has its key within ``window`` seconds.
    Rows more than ``window`` apart do not touch each other, so a key falls into chains.
    Keys are cut into days, which spreads a hot key over all tasks and bounds a chain to
    the seconds of a day.  Only rows whose fate hangs on the edge of a day, through rows
    that come before them, are left to a second pass over whole chains of such rows.
    """
    day = F.floor(F.col("second") / DAY)
    first = rows.withColumn("day", day).repartition("a", "b", "day").sortWithinPartitions(*PLACE).drop("day")
    schema = "a long, b long, second long, turn long, id long, state int"
    decided = materialise(first.mapInArrow(_decide(window, DAY), schema), "chains")
    rest = decided.where("state = 2").drop("state").repartition("a", "b").sortWithinPartitions(*PLACE)
    both = decided.where("state = 1").unionByName(rest.mapInArrow(_decide(window, None), schema).where("state = 1"))
    return both.drop("state")


def chain_states(seconds: np.ndarray, order: np.ndarray, edge: np.ndarray, window: int) -> np.ndarray:
    """0 repeat, 1 accepted, 2 not to be told: rows of a chain in the order in which they came.

    Rows on an edge may have neighbours elsewhere that came before them.
    """
    states, taken, unsure = np.zeros(len(order), np.int32), set(), set()
    for i in order:
        s = int(seconds[i])
        near = range(s - window, s + window + 1)
        if not taken.isdisjoint(near):
            continue
        if edge[i] or not unsure.isdisjoint(near):
            unsure.add(s)
            states[i] = 2
        else:
            taken.add(s)
            states[i] = 1
    return states


def _decide(window: int, day: int | None):
    names = [*PLACE, "turn", "id"]

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        places, turns, ids = _places(rows), rows["turn"].to_numpy(), rows["id"].to_numpy()
        starts = np.flatnonzero(_breaks(places, window, day))
        ends = np.append(starts[1:], len(ids))
        clock = places["second"] % (day or 1)
        edge = (clock < window) | (clock >= day - window) if day is not None else np.zeros(len(ids), bool)
        states = np.where(edge, np.int32(2), np.int32(1))
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            states[a:b] = chain_states(places["second"][a:b], np.lexsort((ids[a:b], turns[a:b])), edge[a:b], window)
        return rows.append_column("state", pa.array(states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(names)
            if not rows.num_rows:
                continue
            before = held[-1].slice(held[-1].num_rows - 1) if held else None
            places = _places(pa.concat_tables([before, rows]) if held else rows)
            starts = np.flatnonzero(_breaks(places, window, day))
            last = int(starts[-1]) - 1 if held else int(starts[-1])  # -1: the chain held goes on through all of this
            if held and last < 0:
                held.append(rows)
                continue
            whole = [*held, rows.slice(0, last)]
            if sum(x.num_rows for x in whole):
                yield from settle(pa.concat_tables(whole)).to_batches()
            held = [rows.slice(last)]  # the last chain may go on in the next batch
        if held:
            yield from settle(pa.concat_tables(held)).to_batches()

    return run


def _breaks(places: np.ndarray, window: int, day: int | None) -> np.ndarray:
    """True where a chain starts."""
    start = np.ones(len(places), bool)
    if len(places) > 1:
        a, b, s = (places[c] for c in PLACE)
        start[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] - s[:-1] > window)
        if day is not None:
            start[1:] |= s[1:] // day != s[:-1] // day
    return start


def screen_batches(
    history: DataFrame | None, incoming: DataFrame, batch_col: str, id_col: str, keys: dict[str, F.Column] | F.Column, second: F.Column, window: int, runs: SortedRuns | None = None
) -> DataFrame:
    """Takes batches in order: ``id, batch, accepted`` of every incoming row.

    They are held against ``runs`` (new ones without it) after ``history`` was added to them;
    ``history`` may be None where the runs hold it already.  ``keys`` and ``second`` are computed
    alike on both tables.  All batches are taken at once: what decides is the order of
    rows, by batch (null last), then id.  Ids are unique.
    """
    spark = incoming.sparkSession
    keys = keys if isinstance(keys, dict) else {"key": keys}
    runs = runs or SortedRuns(spark, window, tuple(keys))
    columns = [column.alias(name) for name, column in keys.items()]
    if history is not None:
        runs.add(history.select(*columns, second.alias("second")))
    rows = incoming.select(F.col(id_col).cast("long").alias("id"), F.col(batch_col).alias("batch"), *columns, second.alias("second"))
    numbers = [r[0] for r in incoming.select(batch_col).where(F.col(batch_col).isNotNull()).distinct().orderBy(batch_col).collect()]  # one per batch
    turn = F.coalesce(reduce(lambda w, i: w.when(F.col("batch") == F.lit(numbers[i]), i), range(len(numbers)), F.when(F.lit(False), 0)), F.lit(len(numbers)))
    judged = runs.absorb(rows.withColumn("turn", turn))
    return judged.join(rows.select("id", "batch"), "id")
