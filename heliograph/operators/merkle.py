"""Processing only new or changed records, by a Merkle tree over key ranges.

A state is a set of rows with a unique key.  Its tree has 256-way inner nodes over
leaves that are equal ranges of the 64-bit key hash.  A node's digest is its number of
members and two 64-bit sums (exclusive ors of hashes) over them, a leaf's of its rows, an
inner node's of its children's digests; such sums do not depend on order, so they are combined on the map side and
no node's members are ever gathered.  Comparing two states descends only where digests
differ and extracts the rows of changed leaves.

``StateStore`` publishes a run's output together with the state and tree it leaves behind,
and writes in proportion to the change.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.runtime import discard, materialise, scratch_path
from heliograph.sinks.commits import Commits

FANOUT_BITS = 8
ROWS_PER_LEAF = 64
LEAF = "hg_leaf"
#: 256 ** 5 leaves of 64 rows: 7e13 rows.
DEEPEST = 5
#: Versions whose changes are kept beside each other before the whole state is written again.
REBASE_AFTER = 8
DIGEST = ("members", "one", "two")
TREE = "level int, node long, members long, one long, two long"


def depth_for(rows: int) -> int:
    return min(DEEPEST, max(1, math.ceil(math.log(rows / ROWS_PER_LEAF, 1 << FANOUT_BITS)))) if rows > ROWS_PER_LEAF else 1


def with_leaf(state: DataFrame, keys: list[str], depth: int) -> DataFrame:
    return state.withColumn(LEAF, F.shiftrightunsigned(F.xxhash64(*keys), 64 - FANOUT_BITS * depth))


def _digests(members: DataFrame, node: F.Column, columns: list[str]) -> DataFrame:
    """``node, members, one, two`` of every node."""
    parts = []
    for c in columns:
        kind = members.schema[c].dataType
        # A null hashes to nothing, so whether a value is null is hashed, too.
        parts += [F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(kind, T.MapType | T.VariantType) else F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return members.groupBy(node.alias("node")).agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64(*parts)).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("two")
    )


def leaf_digests(leafed: DataFrame) -> DataFrame:
    return _digests(leafed, F.col(LEAF), [c for c in leafed.columns if c != LEAF])


def parents_of(nodes: DataFrame) -> DataFrame:
    """The digests one level up."""
    return _digests(nodes, F.shiftrightunsigned("node", FANOUT_BITS), ["node", *DIGEST])


def tree_of(leaves: DataFrame, depth: int) -> DataFrame:
    """``level, node`` and digest of every node above and of ``leaves``; level 0 is the root.

    ``leaves`` should be stored: every level is computed from them.
    """
    levels = [leaves]
    for _ in range(depth):
        levels.append(parents_of(levels[-1]))
    return reduce(DataFrame.unionByName, (x.select(F.lit(depth - i).alias("level"), "node", *DIGEST) for i, x in enumerate(levels)))


def tree(leafed: DataFrame, depth: int) -> DataFrame:
    """The tree of a state's rows with LEAF.  An empty state has no nodes."""
    return tree_of(materialise(leaf_digests(leafed), "leaves"), depth)


def changed_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """Leaves whose digests differ or that only one tree has.

    The descent is one plan: the root says no more than its at most 256 children, so it
    begins with them, and each level looks only at the children of nodes that differ.
    """
    differing = None
    for level in range(1, depth + 1):
        a = current.where(F.col("level") == level).select("node", F.struct(*DIGEST).alias("a"))
        b = saved.where(F.col("level") == level).select("node", F.struct(*DIGEST).alias("b"))
        if differing is not None:
            up = differing.withColumnRenamed("node", "parent")
            a, b = (x.join(up, F.shiftrightunsigned(x["node"], FANOUT_BITS) == up["parent"], "left_semi") for x in (a, b))
        differing = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return differing.select(F.col("node").alias(LEAF))


def state_changes(current: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` that are new or differ, and keys that are gone.

    Both have the same columns; keys are unique and compared null-safe.  Result: the
    columns (for a key that is gone those of ``saved``) and ``change``: ``added``,
    ``changed`` or ``removed``.  Either side may be empty.  ValueError if a state has a column
    called ``change``.
    """
    columns = _columns(current)
    now, then = materialise(current, "now"), materialise(saved.select(*columns), "then")
    depth = depth_for(max(now.count(), then.count()))
    now, then = with_leaf(now, keys, depth), with_leaf(then, keys, depth)
    return _extract(now, then, tree(now, depth), tree(then, depth), keys, columns, depth)


def _columns(state: DataFrame) -> list[str]:
    if {"change", LEAF, VERSION} & set(state.columns):
        raise ValueError(f"a state has no column called change, {LEAF} or {VERSION}")
    return state.columns


def _extract(now: DataFrame, then: DataFrame, now_tree: DataFrame, then_tree: DataFrame, keys: list[str], columns: list[str], depth: int) -> DataFrame:
    leaves = materialise(changed_leaves(now_tree, then_tree, depth), "changed-leaves")
    a, b = (x.join(leaves, LEAF, "left_semi") for x in (now, then))
    a = a.select(F.struct(*columns).alias("now"), *(F.col(k).alias(f"now_{i}") for i, k in enumerate(keys)))
    b = b.select(F.struct(*columns).alias("then"), *(F.col(k).alias(f"then_{i}") for i, k in enumerate(keys)))
    same = reduce(lambda x, y: x & y, (a[f"now_{i}"].eqNullSafe(b[f"then_{i}"]) for i in range(len(keys))))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    both = a.join(b, same, "full").where(~F.col("now").eqNullSafe(F.col("then")))
    return both.select(F.coalesce("now", "then").alias("row"), change.alias("change")).select("row.*", "change")


VERSION = "hg_version"


class StateStore:
    """Versions of a state with its tree and the output made from it.

    A version counts only once it is committed; a run that dies before that leaves the
    former version current, so its changes are found again and nothing is skipped or
    repeated.  A version holds the rows and tree nodes that changed; after REBASE_AFTER
    versions, or when the tree has to become deeper, the whole state is written again and
    the folders before it are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.commits = Commits(spark, self.path)

    def latest(self) -> dict | None:
        return self.commits.latest()

    def _folders(self, part: str, last: dict) -> DataFrame:
        """The rows that the versions since the last whole one left, with their version."""
        frames = [self.spark.read.parquet(f"{self.path}/{name}/{part}").withColumn(VERSION, F.lit(v)) for v, name in last["folders"]]
        return reduce(DataFrame.unionByName, frames)

    def _newest(self, rows: DataFrame, by: list[str]) -> DataFrame:
        others = [c for c in rows.columns if c not in by]
        newest = rows.groupBy(*by).agg(F.max_by(F.struct(*others), VERSION).alias("hg_row"))
        return newest.select(*by, *(F.col(f"hg_row.`{c}`").alias(c) for c in others))

    def state(self, last: dict | None = None) -> DataFrame:
        """The published rows, with the VERSION that last changed each of them."""
        last = last or self.latest()
        rows = self._folders("state", last)
        if len(last["folders"]) > 1:
            rows = self._newest(rows, self.keys)
        rows = rows.withColumn(VERSION, F.coalesce("hg_since", VERSION)).drop("hg_since")
        return rows.where("change <> 'removed'").drop("change", LEAF)

    def saved(self, schema: T.StructType) -> DataFrame:
        last = self.latest()
        return self.state(last).select(*schema.names) if last else self.spark.createDataFrame([], schema)

    def _tree(self, last: dict) -> DataFrame:
        nodes = self._folders("tree", last)
        if len(last["folders"]) > 1:
            nodes = self._newest(nodes, ["level", "node"])
        return nodes.where("members > 0").select("level", "node", *DIGEST)

    def changes(self, current: DataFrame) -> DataFrame:
        """What this run has to process, against the last published version."""
        return self._compared(current)[0]

    def _compared(self, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, dict | None]:
        """changes, stored current rows, stored digests of their leaves, depth, last version."""
        columns, last = _columns(current), self.latest()
        now = materialise(current, "now")
        depth = max(depth_for(now.count()), last["depth"] if last else 1)
        leafed = with_leaf(now, self.keys, depth)
        leaves = materialise(leaf_digests(leafed), "leaves")
        if last is None:
            return now.withColumn("change", F.lit("added")), now, leaves, depth, None
        then = with_leaf(self.state(last).select(*columns), self.keys, depth)
        # A state that has outgrown its tree is compared by a new tree of the saved rows.
        saved = self._tree(last) if depth == last["depth"] else tree(then, depth)
        return _extract(leafed, then, tree_of(leaves, depth), saved, self.keys, columns, depth), now, leaves, depth, last

    def advance(self, current: DataFrame, process=None) -> DataFrame:
        """Takes ``current`` as the new state and publishes what ``process(changes)`` makes of
        the changes (without it, the changes); returns the changes.

        ``process`` may return None for no output.  Nothing changed, nothing is published.
        """
        found, now, leaves, depth, last = self._compared(current)
        changes = materialise(found, "changes")
        if last is None or not changes.isEmpty():
            self._publish(now, changes, leaves, depth, last, process(changes) if process else changes)
        discard(now, leaves)
        return changes

    def publish(self, state: DataFrame, output: DataFrame | None = None) -> int:
        """Publishes output, state and tree together; returns the version."""
        found, now, leaves, depth, last = self._compared(state)
        version = self._publish(now, found, leaves, depth, last, output)
        discard(now, leaves)
        return version

    def _publish(self, now: DataFrame, changes: DataFrame, leaves: DataFrame, depth: int, last: dict | None, output: DataFrame | None) -> int:
        version = (last["version"] if last else 0) + 1
        name = self.commits.fresh(str(version))
        base = f"{self.path}/{name}"
        if output is not None:
            output.write.parquet(f"{base}/output")
        whole = last is None or depth != last["depth"] or len(last["folders"]) >= REBASE_AFTER
        nodes = tree_of(leaves, depth)
        if whole:
            rows = now.withColumn("change", F.lit("kept"))
            since = self.state(last).select(*(F.col(k).alias(f"hg_{i}") for i, k in enumerate(self.keys)), VERSION) if last else None
            if since is not None:  # which version last changed a row is not lost
                since = since.join(changes.select(*(F.col(k).alias(f"hg_{i}") for i, k in enumerate(self.keys))), [f"hg_{i}" for i in range(len(self.keys))], "left_anti")
                same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"hg_{i}")) for i, k in enumerate(self.keys)))
                rows = rows.join(since, same, "left").withColumnRenamed(VERSION, "hg_since").drop(*(f"hg_{i}" for i in range(len(self.keys))))
            else:
                rows = rows.withColumn("hg_since", F.lit(None).cast("int"))
        else:
            rows = changes.withColumn("hg_since", F.lit(None).cast("int"))
            before = self._tree(last).select("level", "node", *(F.col(c).alias(f"old_{c}") for c in DIGEST))
            both = nodes.join(before, ["level", "node"], "full")
            changed = ~reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in DIGEST))
            # A node that is gone has no members.
            nodes = both.where(changed).select("level", "node", F.coalesce("members", F.lit(0)).alias("members"), "one", "two")
        with_leaf(rows, self.keys, depth).sortWithinPartitions(LEAF).write.parquet(f"{base}/state")
        nodes.write.parquet(f"{base}/tree")
        folders = [[version, name]] if whole else [*last["folders"], [version, name]]
        outputs = [*(last["outputs"] if last else []), *([[version, name]] if output is not None else [])]
        self.commits.publish(version, {"depth": depth, "folders": folders, "outputs": outputs})
        if whole and last:
            for _, old in last["folders"]:
                for part in ("state", "tree"):
                    self.commits.remove(f"{old}/{part}")
        return version

    def output(self) -> DataFrame:
        """What the last version that had an output put out."""
        return self.spark.read.parquet(f"{self.path}/{self.latest()['outputs'][-1][1]}/output")

    def outputs(self) -> DataFrame:
        """The outputs of all versions, with their VERSION."""
        frames = [self.spark.read.parquet(f"{self.path}/{name}/output").withColumn(VERSION, F.lit(v)) for v, name in self.latest()["outputs"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_states(listing: DataFrame, log: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``warc_path, cdxj_path, warc_sha`` as the files are now, and as they were indexed.

    The current state of a file is its listing row seen last (ties: the higher
    ``list_id``); a null ``warc_sha`` means the file is gone.  A log row counts if its run
    and its own outcome are ``ok``; the content indexed for a file and target is that of
    the counting row whose run finished last (ties: logged last, higher ``log_id``).  A
    null path names no file; a null target was never indexed.
    """
    now = (
        listing.where("warc_path is not null").groupBy("warc_path")
        .agg(F.max_by(F.struct("cdxj_path", "warc_sha"), F.struct("seen_at", "list_id")).alias("x"))
        .select("warc_path", "x.cdxj_path", "x.warc_sha").where("warc_sha is not null")
    )
    good = runs.where("run_state = 'ok'").groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    indexed = (
        log.where("outcome = 'ok' and warc_path is not null and cdxj_path is not null")
        .select("run_id", "warc_path", "cdxj_path", "warc_sha", "logged_at", "log_id").join(good, "run_id")
        .groupBy("warc_path", "cdxj_path")
        .agg(F.max_by("warc_sha", F.struct("finished_at", "logged_at", "log_id")).alias("warc_sha"))
    )
    return now, indexed


def pending_files(listing: DataFrame, log: DataFrame, runs: DataFrame, store: StateStore | None = None) -> DataFrame:
    """``warc_path, cdxj_path, warc_sha, change`` of the files the next run has to read.

    The changes between the two states of ``file_states`` that leave something to read.
    What the log says was indexed is published to ``store`` (a scratch folder without one),
    whose saved tree the current state is then held against; the pending files are the
    output that is published together with the new state and its tree.  Empty tables are
    fine, repeated rows count once, other columns are ignored.
    """
    now, indexed = file_states(listing, log, runs)
    if store is None:
        store = StateStore(listing.sparkSession, scratch_path(listing.sparkSession, "index-state"), ["warc_path", "cdxj_path"])
    store.publish(indexed)
    found = store.advance(now, lambda changes: changes.where("change <> 'removed'"))
    pending = found.where("change <> 'removed'") if found.isEmpty() else store.output()
    return pending.select("warc_path", "cdxj_path", "warc_sha", "change")
