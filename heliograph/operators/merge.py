"""Ordered merging, set operations and the check of an order."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.runtime import materialise


def merge_sorted(*inputs: DataFrame, column: str = "value") -> DataFrame:
    """All rows of all inputs in order of the whole line; repeated lines are kept.

    Inputs need not be sorted: a range exchange and a sort per partition do it.
    """
    if not inputs:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs).orderBy(column)


def merge_distinct(*inputs: DataFrame, column: str = "value") -> DataFrame:
    """As ``merge_sorted``, each line once; only the line column comes out."""
    return reduce(DataFrame.unionByName, (x.select(column) for x in inputs)).distinct().orderBy(column)


def order_violations(lines: DataFrame, order: list[str], column: str = "value") -> DataFrame:
    """Neighbours in the given order whose lines descend: ``before, after``.

    ``order`` names the columns of the place; a first column with several values (such as
    the file) cuts the lines into parts checked by themselves.  Each part is cut at range
    borders, so a long file is checked by many tasks; the borders are then compared.
    """
    part, place = order[0], order[1:]
    if not place:
        raise ValueError("an order needs a part and a place within it")
    rows = lines.select(F.col(part).cast("string").alias("part"), F.struct(*place).alias("place"), F.col(column).alias("line"))
    ranged = rows.repartitionByRange("part", "place").sortWithinPartitions("part", "place").withColumn("task", F.spark_partition_id())

    def walk(batches):
        last: dict | None = None
        edges: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, task = batch["line"], batch["task"][0].as_py()
            code = batch["part"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same = code[1:] == code[:-1]
            down = pc.fill_null(pc.greater(lines.slice(0, len(code) - 1), lines.slice(1)), False)
            at = np.flatnonzero(same & down.to_numpy(zero_copy_only=False))
            found = [("bad", task, None, lines[i].as_py(), lines[i + 1].as_py()) for i in at.tolist()]
            starts = np.append(0, np.flatnonzero(~same) + 1)
            for first, end in zip(starts.tolist(), np.append(starts[1:], len(code)).tolist()):
                p, line = batch["part"][first].as_py(), lines[first].as_py()
                if last is not None and last["part"] == p:
                    if last["line"] is not None and line is not None and last["line"] > line:
                        found.append(("bad", task, p, last["line"], line))
                else:
                    edges[p] = [task, line, None]
                last = {"part": p, "line": lines[end - 1].as_py()}
                edges[p][2] = last["line"]
            yield _edges(found)
        yield _edges([("edge", task, p, first, end) for p, (task, first, end) in edges.items()])

    checked = materialise(ranged.select("part", "line", "task").mapInArrow(walk, "kind string, task int, part string, a string, b string"), "order")
    edges = checked.where("kind = 'edge'")  # a row per task and part
    before = F.lag("b").over(Window.partitionBy("part").orderBy("task"))
    crossing = edges.withColumn("before", before).where(F.col("before") > F.col("a")).select("before", F.col("a").alias("after"))
    return checked.where("kind = 'bad'").select(F.col("a").alias("before"), F.col("b").alias("after")).unionByName(crossing)


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "task", "part", "a", "b"])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two tables differ, with their ``side`` and as often as they differ."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
