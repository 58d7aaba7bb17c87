"""References to records that do not exist.

Keys are range-partitioned on the leading bits of their 64-bit hash, as many bits as the
sizes ask for.  Per range the parents become sorted arrays (names, and per name the
intervals in which it stands); batches of references probe them by binary search, first for
the name, then for the instant.  A key that is too large for a range is a range of its own:
its references are split into parts that each get a copy of that one key's parents, and
if those are too many as well, both are cut at the same instants, each stretch of time with
one row that stands for all parents before it.  No task receives more than a bounded share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import materialise

#: Bits of the key hash that make a slot; the driver sees one row per slot at most.
FEWEST_BITS, MOST_BITS = 10, 20
#: Parts there are at most, as a power of two: beyond that, parts grow instead.
PART_BITS = 18
#: Stretches of time a key with too many parents is cut into.
STRETCHES = 256
REASONS = ("missing", "deleted", "late")
NEVER = np.iinfo(np.int64).max


def base_name(column, suffix: str | None = None) -> F.Column:
    """Trims spaces, keeps what follows the last ``/``, then drops ``suffix``."""
    name = F.substring_index(F.trim(column), "/", -1)
    if suffix is None:
        return name
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    *,
    rows_per_part: int = 250_000,
    parents_per_range: int = 50_000,
) -> DataFrame:
    """References for which no parent of the same key stands at their own time.

    references: ``ref_table, ref_id, key, at``; parents: ``key, loaded_at,
    removed_at``; other columns are ignored.  Result: ``ref_table, ref_id, key, at,
    reason``, where reason is ``missing`` (the key has no parent at all),
    ``deleted`` (some parent was loaded at or before ``at``) or ``late``.

    A null key refers to nothing and gives no row.  A reference without a time
    cannot be shown to be met: it is ``missing`` or ``late``.  A parent without
    ``loaded_at`` makes its key known but never stands; a null ``removed_at`` means it
    still stands; repeated parents count once.  Empty inputs are fine.  Repeated
    references are reported as often as they occur.
    """
    left, right = partitioned(references, parents, rows_per_part, parents_per_range)
    ref_type = left.schema["ref_id"].dataType.simpleString()
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(
        _probe, f"ref_table string, ref_id {ref_type}, key string, at timestamp_ntz, reason string"
    )


def partitioned(references: DataFrame, parents: DataFrame, rows_per_part: int, parents_per_range: int) -> tuple[DataFrame, DataFrame]:
    """References and parents with the ``part`` in which they meet."""
    spark = references.sparkSession
    refs = references.select("ref_table", "ref_id", "key", F.col("at").cast("timestamp_ntz").alias("at")).where("key is not null")
    refs = materialise(refs.withColumn("hash", F.xxhash64("key")), "references")
    owners = parents.select("key", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("removed_at").cast("timestamp_ntz").alias("removed_at"))
    # Of entries loaded at one instant the one that stands longest decides.
    longest = F.when(F.count("*") == F.count("removed_at"), F.max("removed_at"))
    owners = owners.where("key is not null").groupBy("key", "loaded_at").agg(longest.alias("removed_at"))
    owners = materialise(owners.withColumn("hash", F.xxhash64("key")), "parents")
    n_refs, n_owners = refs.count(), owners.count()
    rows_per_part, parents_per_range = max(rows_per_part, n_refs >> PART_BITS), max(parents_per_range, n_owners >> PART_BITS)
    wanted = max(n_refs / rows_per_part, n_owners / parents_per_range, 1)
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(wanted)) + 2))
    slot = F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("slot")
    sizes = _sizes(refs, owners, [slot], ["slot"]).orderBy("slot").collect()  # a row per slot
    large = [s.slot for s in sizes if s.r > rows_per_part or s.p > parents_per_range]
    units, keys = [], []
    if large:
        few = F.broadcast(spark.createDataFrame([(s,) for s in large], "slot int"))
        inside = [x.withColumn("slot", slot).join(few, "slot", "left_semi") for x in (refs, owners)]
        # At most twice as many keys as there are parts.
        heavy = _sizes(*inside, ["key"], ["key"]).where((F.col("r") > rows_per_part / 2) | (F.col("p") > parents_per_range / 2))
        keys = heavy.withColumn("slot", F.shiftrightunsigned(F.xxhash64("key"), 64 - bits).cast("int")).orderBy("key").collect()
    taken: dict[int, list[int]] = {}
    for k in keys:
        r, p = taken.get(k.slot, (0, 0))
        taken[k.slot] = [r + k.r, p + k.p]
    light = [(s.slot, s.r - taken.get(s.slot, (0, 0))[0], s.p - taken.get(s.slot, (0, 0))[1]) for s in sizes]
    layout = _layout(light, rows_per_part, parents_per_range)
    first = 1 + max((part for _, part in layout), default=-1)
    placed = F.broadcast(spark.createDataFrame(layout, "slot int, part int"))
    usual = ["key", "loaded_at", "removed_at"]
    if not keys:
        left, right = (x.withColumn("slot", slot).join(placed, "slot") for x in (refs, owners))
    else:
        cut = _stretches(owners, [k.key for k in keys if k.p > parents_per_range])
        named = spark.createDataFrame([(k.key, cut.get(k.key, [])) for k in keys], "key string, edges array<timestamp_ntz>")
        named = materialise(named, "heavy-keys")
        refs_of, owners_of = (_in_stretch(x.join(F.broadcast(named), "key"), at) for x, at in ((refs, "at"), (owners, "loaded_at")))
        units = refs_of.groupBy("key", "stretch").agg(F.count("*").alias("r")).orderBy("key", "stretch").collect()  # a row per heavy key and stretch
        spots = []
        for u in units:
            parts = -(-u.r // rows_per_part)
            spots.append((u.key, u.stretch, first, parts))
            first += parts
        spots = F.broadcast(spark.createDataFrame(spots, "key string, stretch int, first int, parts int"))
        spread = F.pmod(F.xxhash64("ref_id", "at"), F.col("parts")).cast("int")
        split = refs_of.join(spots, ["key", "stretch"]).withColumn("part", F.col("first") + spread)
        copied = _with_earlier(owners_of, named).join(spots, ["key", "stretch"]).withColumn("part", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
        left, right = (x.join(F.broadcast(named.select("key")), "key", "left_anti").withColumn("slot", slot).join(placed, "slot") for x in (refs, owners))
        left = left.select(*refs.columns, "part").unionByName(split.select(*refs.columns, "part"))
        right = right.select(*usual, "part").unionByName(copied.select(*usual, "part"))
    part = (F.col("part") + 0).alias("part")  # a column of its own on either side
    return left.select("ref_table", "ref_id", "key", "at", part), right.select(*usual, part)


def _sizes(refs: DataFrame, owners: DataFrame, by: list, names: list[str]) -> DataFrame:
    """``r`` references and ``p`` parents per group, counted on the map side first."""
    zero = F.lit(0).cast("long")
    a = refs.groupBy(*by).agg(F.count("*").alias("r")).withColumn("p", zero)
    b = owners.groupBy(*by).agg(F.count("*").alias("p")).withColumn("r", zero)
    return a.unionByName(b).groupBy(*names).agg(F.sum("r").alias("r"), F.sum("p").alias("p"))


def _layout(sizes: list[tuple[int, int, int]], rows_per_part: int, parents_per_range: int) -> list[tuple[int, int]]:
    """(slot, part): neighbouring slots packed into ranges."""
    layout, r, p, part = [], 0, 0, 0
    for slot, refs, owners in sizes:
        if (r or p) and (r + refs > rows_per_part or p + owners > parents_per_range):
            part, r, p = part + 1, 0, 0
        layout.append((slot, part))
        r, p = r + refs, p + owners
    return layout


def _stretches(owners: DataFrame, keys: list[str]) -> dict[str, list]:
    """Instants that cut the parents of each key into about equal numbers."""
    if not keys:
        return {}
    few = F.broadcast(owners.sparkSession.createDataFrame([(k,) for k in keys], "key string"))
    micros = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    cuts = F.percentile_approx(micros, [i / STRETCHES for i in range(1, STRETCHES)], 100_000)
    found = owners.join(few, "key").groupBy("key").agg(F.array_distinct(F.transform(cuts, lambda m: F.timestamp_micros(m).cast("timestamp_ntz"))).alias("edges"))
    return {r.key: r.edges or [] for r in found.collect()}


def _in_stretch(rows: DataFrame, at: str) -> DataFrame:
    """A row without a time is in the first stretch."""
    return rows.withColumn("stretch", F.size(F.filter("edges", lambda e: e <= F.col(at))))


def _with_earlier(owners: DataFrame, named: DataFrame) -> DataFrame:
    """Heavy keys' parents, and per stretch one that stands for all before it and one that
    makes the key known."""
    never = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
    until = F.max(F.coalesce("removed_at", never)).alias("until")
    sums = owners.where("loaded_at is not null").groupBy("key", "stretch").agg(F.min("loaded_at").alias("since"), until)
    before = sums.select("key", F.col("stretch").alias("earlier"), "since", "until")
    every = named.select("key", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("stretch"))
    # STRETCHES rows a key on both sides.
    past = every.join(before, "key").where("earlier < stretch").groupBy("key", "stretch").agg(F.min("since").alias("loaded_at"), F.max("until").alias("removed_at"))
    past = past.withColumn("removed_at", F.when(F.col("removed_at") < never, F.col("removed_at")))
    known = every.join(owners.select("key").distinct(), "key", "left_semi").select("key", "stretch", *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("loaded_at", "removed_at")))
    columns = ["key", "stretch", "loaded_at", "removed_at"]
    return owners.select(*columns).unionByName(past.select(*columns)).unionByName(known.select(*columns))


def _micros(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = column.combine_chunks().cast(pa.timestamp("us")).cast(pa.int64())
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False), pc.is_null(values).to_numpy(zero_copy_only=False)


class SortedParents:
    """The parents of one range as sorted arrays."""

    def __init__(self, table: pa.Table):
        keys = np.asarray(table["key"].to_pylist(), dtype=object)
        self.keys, slot = np.unique(keys, return_inverse=True) if len(keys) else (keys, np.zeros(0, np.int64))
        loaded, unknown = _micros(table["loaded_at"])
        removed, standing = _micros(table["removed_at"])
        removed = np.where(standing, NEVER, removed)
        slot, loaded, removed = slot[~unknown], loaded[~unknown], removed[~unknown]
        order = np.lexsort((removed, loaded, slot))
        slot, loaded, removed = slot[order], loaded[order], removed[order]
        # The latest end among a key's entries so far makes nested and overlapping
        # intervals harmless: an instant is covered if that end lies behind it.
        if len(slot):
            rank = np.unique(removed, return_inverse=True)[1]
            width = int(rank.max()) + 1
            best = np.maximum.accumulate(slot.astype(np.int64) * width + rank)
            removed = np.unique(removed)[best - slot.astype(np.int64) * width]
        self.instants = np.unique(loaded)
        self.scale = len(self.instants) + 1
        self.entry = slot.astype(np.int64) * self.scale + np.searchsorted(self.instants, loaded, "right")
        self.slot, self.until = slot, removed

    def reasons(self, keys: pa.ChunkedArray, at: np.ndarray, no_time: np.ndarray) -> np.ndarray:
        """0 for a reference that is met, else 1 + the index in REASONS."""
        coded = keys.combine_chunks().dictionary_encode()
        names = np.asarray(coded.dictionary.to_pylist(), dtype=object)
        if not len(self.keys):
            return np.ones(len(at), np.int8)
        place = np.searchsorted(self.keys, names)
        place[place == len(self.keys)] = 0
        known = self.keys[place] == names
        which = coded.indices.to_numpy(zero_copy_only=False)
        slot, known = place[which].astype(np.int64), known[which].astype(bool)
        result = np.where(known, np.int8(3), np.int8(1))
        if len(self.entry):
            rank = np.where(no_time, 0, np.searchsorted(self.instants, at, "right"))
            found = np.searchsorted(self.entry, slot * self.scale + rank, "right") - 1
            loaded = known & (found >= 0) & (self.slot[found] == slot) & ~no_time
            result[loaded] = np.where(self.until[found[loaded]] > at[loaded], 0, 2)
        return result


def _probe(references: pa.Table, parents: pa.Table) -> pa.Table:
    names = ["ref_table", "ref_id", "key", "at", "reason"]
    store = SortedParents(parents)
    at, no_time = _micros(references["at"])
    codes = store.reasons(references["key"], at, no_time) if references.num_rows else np.zeros(0, np.int8)
    missed = references.filter(pa.array(codes > 0)).select(names[:4])
    words = pa.array([*REASONS]).take(pa.array(codes[codes > 0].astype(np.int64) - 1))
    return missed.append_column("reason", words)


def orphan_report(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and month: references checked, and misses by reason.

    References without a time come under a null month.  Both sides are reduced to a
    row per table and month on the map side before anything is shuffled.
    """
    month = F.substring(F.col("at").cast("timestamp_ntz").cast("string"), 1, 7)
    checked = references.where("key is not null").groupBy("ref_table", month.alias("month")).agg(F.count("*").alias("checked"))
    missed = orphans.groupBy("ref_table", month.alias("month")).agg(*(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
    both = checked.alias("c").join(missed.alias("m"), (F.col("c.ref_table") == F.col("m.ref_table")) & F.col("c.month").eqNullSafe(F.col("m.month")), "left")
    return both.select(F.col("c.ref_table"), F.col("c.month"), "checked", *(F.coalesce(r, F.lit(0).cast("long")).alias(r) for r in REASONS))
