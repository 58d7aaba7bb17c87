"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents lie in the order of a seeded hash, a permutation, cut into blocks.
Its quota of tokens is so many whole passes over its blocks and a part of one more.
The block uses of all sources are shared out among output shards by a tree: each
node draws its left half's exact composition from a multivariate hypergeometric
distribution, so every shard is a random sample of the mixture and the parts add
up to the quotas.  A shard draws a run of each source's permuted blocks, disjoint from
those of all others, and is shuffled locally.  There are as many shards as the mixture's
tokens ask for, and so many blocks that each shard gets many of every source.

The driver sees, per source, one row of sums for each of a fixed number of cells of its
order, and holds where each shard begins in each source; never documents or blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.runtime import materialise, trimmed_lower

#: Cells of a source's order in which its quota's end is looked for, level by level.
BLOCK_BITS = 9
#: A cell that holds at most so many documents is looked at one by one.
FEW = 4096
ORDER_BITS = 63
#: Tokens of a shard, which one task shuffles: some 200 MB of text.
SHARD_TOKENS = 50_000_000
#: Block uses a shard gets of each source, about.
BLOCKS_IN_SHARD = 64
#: The plan has 8 bytes per shard and source and is broadcast; beyond this, shards grow.
PLAN_BYTES = 256 << 20
#: numpy draws from populations below 1e9.
MOST_BLOCKS = 900_000_000


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens each source has to give.

    Together as many as all its documents hold, shared by weight; a source that reaches
    its cap (its tokens times the permitted uses) leaves the rest to the others by
    weight, until all are at their caps.
    """
    caps = {s: float(tokens.get(s, 0)) * max(0, repeats) for s, (_, repeats) in targets.items()}
    left, quota = float(sum(tokens.get(s, 0) for s in targets)), dict.fromkeys(targets, 0.0)
    open_ = {s for s in targets if caps[s] > 0 and targets[s][0] > 0}
    while open_ and left > 0.5:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if caps[s] <= left * targets[s][0] / weight}
        for s in full or open_:
            quota[s] = caps[s] if full else left * targets[s][0] / weight
        if not full:
            break
        left -= sum(caps[s] for s in full)
        open_ -= full
    return quota


def split(composition: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact numbers of block uses per shard and source (rows: shards).

    The tree is walked level by level, all nodes of a level at once; a node's multivariate
    draw is a row of hypergeometric draws, source by source, of what is left.
    """
    result = np.zeros((shards, len(composition)), np.int64)
    first, count, have = np.zeros(1, np.int64), np.array([shards]), composition.astype(np.int64)[None, :]
    level = 0
    while len(first):
        leaf = count == 1
        result[first[leaf]] = have[leaf]
        first, count, have = first[~leaf], count[~leaf], have[~leaf]
        if not len(first):
            break
        rng = np.random.default_rng([seed, level])
        half, total = count // 2, have.sum(axis=1)
        draws = np.rint(total * (half / count)).astype(np.int64)
        part = np.zeros_like(have)
        for s in range(have.shape[1] - 1):
            total = total - have[:, s]
            part[:, s] = rng.hypergeometric(have[:, s], total, draws)
            draws = draws - part[:, s]
        part[:, -1] = draws
        first, count, have = np.concatenate([first, first + half]), np.concatenate([half, count - half]), np.concatenate([part, have - part])
        level += 1
    return result


class Mixture:
    """The drawn mixture of a corpus.

    documents: ``id_col, source, tokens_col``; targets: ``source, target_share, max_repeats``.
    Sources compare after trimming and lower-casing; rows of targets that name one source
    add their shares and keep the larger number of repeats.  Documents of other sources,
    of a null source, and without tokens are not used.  Repeated rows are documents of
    their own with the same fate.  A source whose documents are fewer than its blocks leaves
    some shards without it.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", tokens_col: str = "n_tokens", shards: int | None = None, seed: int = 0):
        spark = documents.sparkSession
        self.id_col, self.seed = id_col, seed
        named = targets.select(trimmed_lower(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
        wanted = named.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
        self.targets = {r.source: (float(r.share or 0), int(r.repeats or 0)) for r in wanted.collect()}  # a row per source
        order = F.xxhash64(F.lit(seed), F.col("id")).bitwiseAND(F.lit((1 << ORDER_BITS) - 1))
        usable = documents.select(F.col(id_col).alias("id"), trimmed_lower(F.col("source")).alias("source"), F.col(tokens_col).cast("long").alias("tokens"))
        usable = usable.where(F.col("source").isin(*self.targets)).withColumn("order", order)
        counted = materialise(usable.withColumn("block", F.shiftright("order", ORDER_BITS - BLOCK_BITS).cast("int")), "mixture")
        self.documents = counted.where("tokens > 0")  # only now: tokens may be costly to compute twice
        sums = self.documents.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect()  # at most 2 ** BLOCK_BITS rows a source
        self.blocks: dict[str, dict[int, int]] = {s: {} for s in self.targets}
        for r in sums:
            self.blocks[r.source][r.block] = r.tokens
        self.tokens = {s: sum(b.values()) for s, b in self.blocks.items()}
        self.quota = quotas(self.tokens, self.targets)
        self.passes = {s: min(self.targets[s][1], int(q // self.tokens[s])) if self.tokens[s] else 0 for s, q in self.quota.items()}
        self.threshold = self._thresholds()
        self.names = sorted(self.targets)
        most = PLAN_BYTES // (8 * max(1, len(self.names)))
        self.shards = shards or int(min(most, max(8, -(-sum(self.quota.values()) // SHARD_TOKENS))))

    def _thresholds(self) -> dict[str, int]:
        """The place in a source's order up to which documents serve once more."""
        rest = {s: q - self.passes[s] * self.tokens[s] for s, q in self.quota.items() if self.tokens[s] and self.passes[s] < self.targets[s][1]}
        sums = {s: self.blocks[s] for s in rest}
        base, bits, found = dict.fromkeys(rest, 0), BLOCK_BITS, {}
        while rest:
            cut = {}
            for s in list(rest):
                for b in sorted(sums[s]):
                    if sums[s][b] > rest[s]:
                        cut[s] = base[s] << BLOCK_BITS | b
                        break
                    rest[s] -= sums[s][b]
                if s not in cut:  # all of it fits
                    found[s] = (base[s] + 1 << ORDER_BITS - bits + BLOCK_BITS) - 1
                    rest.pop(s)
            if not cut:
                break
            inside = self.documents.where(" or ".join(["false"] + [f"(source = {_quoted(s)} and shiftright(order, {ORDER_BITS - bits}) = {p})" for s, p in cut.items()]))
            counts = {r.source: r["n"] for r in inside.groupBy("source").agg(F.count("*").alias("n")).collect()}
            few = [s for s in cut if counts[s] <= FEW or bits + BLOCK_BITS > ORDER_BITS]
            if few:
                # Documents of one place are one row: FEW a source at most, or one where the places are at an end.
                rows = inside.where(F.col("source").isin(*few)).groupBy("source", "order").agg(F.sum("tokens").alias("tokens")).orderBy("source", "order").collect()
                for s in few:
                    found[s] = _nearest([(r.order, r.tokens) for r in rows if r.source == s], rest.pop(s), (cut[s] << ORDER_BITS - bits) - 1)
                    cut.pop(s)
            if not cut:
                break
            base, bits = cut, bits + BLOCK_BITS
            finer = F.shiftright("order", ORDER_BITS - bits).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
            sums = {s: {} for s in cut}
            for r in inside.where(F.col("source").isin(*cut)).groupBy("source", finer.alias("b")).agg(F.sum("tokens").alias("t")).collect():
                sums[r.source][r.b] = r.t
        return found

    def _plan(self) -> tuple[dict[str, int], dict[str, np.ndarray]]:
        """Per source: bits of its blocks, and where each shard's run of block uses ends."""
        bits, uses = {}, []
        each = min(BLOCKS_IN_SHARD, max(1, MOST_BLOCKS // (self.shards * max(1, len(self.names)))))
        for s in self.names:
            quota, held = self.quota[s], max(1, self.tokens[s])
            # So many blocks a pass that the uses of all passes are about ``each`` a shard.
            wanted = each * self.shards * held / max(quota, 1)
            bits[s] = int(np.clip(np.ceil(np.log2(max(wanted, 1))), 0, 40))
            last = self.threshold.get(s, -1)
            part = (last >> ORDER_BITS - bits[s]) + 1 if last >= 0 else 0
            uses.append(self.passes[s] * (1 << bits[s]) + part if quota else 0)
        total = sum(uses)
        while total > MOST_BLOCKS:  # a source used hardly at all has few of many blocks; halve all
            bits = {s: max(0, b - 1) for s, b in bits.items()}
            uses = [-(-n // 2) for n in uses]
            total = sum(uses)
        ends = np.cumsum(split(np.array(uses, np.int64), self.shards, self.seed), axis=0) if self.names else np.zeros((self.shards, 0), np.int64)
        return bits, {s: np.ascontiguousarray(ends[:, i]) for i, s in enumerate(self.names)}

    def _used(self) -> DataFrame:
        """``documents`` with ``n_uses``: the whole passes, and one more up to the threshold."""
        passes, last = (F.create_map(*(x for s in self.names for x in (F.lit(s), F.lit(of(s))))) for of in (lambda s: self.passes[s], lambda s: self.threshold.get(s, -1)))
        if not self.names:
            return self.documents.limit(0).withColumn("n_uses", F.lit(0))
        more = (F.col("order") <= last[F.col("source")]).cast("int")
        return self.documents.withColumn("n_uses", passes[F.col("source")] + more).where("n_uses > 0")

    def draws(self) -> DataFrame:
        """Every use of every document: ``id, source, tokens, use, shard``.

        Nothing is shuffled: a task looks up where a document's block lies in the plan.
        """
        bits, ends = self._plan()
        plan = self.documents.sparkSession.sparkContext.broadcast((bits, ends))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, ends = plan.value
            for batch in batches:
                order, use = batch["order"].to_numpy(), batch["use"].to_numpy().astype(np.int64)
                coded = batch["source"].dictionary_encode()
                which, shard = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(order), np.int32)
                for i, s in enumerate(coded.dictionary.to_pylist()):
                    mine = which == i
                    block = (use[mine] - 1) * (1 << bits[s]) + (order[mine] >> ORDER_BITS - bits[s] if bits[s] else 0)
                    shard[mine] = np.minimum(np.searchsorted(ends[s], block, "right"), len(ends[s]) - 1)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "source", "tokens", "use")), pa.array(shard)], names=["id", "source", "tokens", "use", "shard"])

        uses = self._used().select("id", "source", "tokens", "order", F.explode(F.sequence(F.lit(1), "n_uses")).alias("use"))
        kind = self.documents.schema["id"].dataType.simpleString()
        return uses.mapInArrow(place, f"id {kind}, source string, tokens long, use int, shard int").withColumnRenamed("id", self.id_col)

    def shuffled(self) -> DataFrame:
        """The draws, each shard in one partition and in random order."""
        key = F.xxhash64(F.lit(self.seed + 1), F.col(self.id_col), F.col("use"))
        return self.draws().withColumn("key", key).repartition("shard").sortWithinPartitions("shard", "key").drop("key")

    def uses(self) -> DataFrame:
        """``id, source, n_uses`` of every document that is used; repeated rows of an id add up."""
        return self._used().groupBy(F.col("id").alias(self.id_col), "source").agg(F.sum("n_uses").alias("n_uses"))

    def shares(self) -> DataFrame:
        """Per target source: what was wanted, what it holds, and its actual share."""
        rows = [(s, share, repeats, self.tokens[s], int(round(self.quota[s]))) for s, (share, repeats) in sorted(self.targets.items())]
        wanted = self.documents.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, held_tokens long, quota_tokens long")
        drawn = self._used().groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("tokens"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("most_uses"))
        both = wanted.join(drawn, "source", "left").fillna(0, ["tokens", "n_uses", "most_uses"])
        whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per source
        return both.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _nearest(rows: list[tuple[int, int]], rest: float, before: int) -> int:
    """The last place at which the sum is nearest to ``rest``; ``before`` takes none."""
    best, place, total = abs(rest), before, 0
    for i, (order, tokens) in enumerate(rows):
        total += tokens
        tied = i + 1 < len(rows) and rows[i + 1][0] == order
        if not tied and abs(rest - total) < best:
            best, place = abs(rest - total), order
    return place
