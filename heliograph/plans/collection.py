"""From archives to a finished cluster, as one lazy plan with a count per stage.

Stages: archives or capture files, a collection field, the blocklist, the removal of
excessive keys (which needs counts over everything), the cluster.  Filters stay narrow;
only the counts of keys and the final order shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.cdxj import with_parts
from heliograph.operators.blocklist import Blocklist, apply_blocklist
from heliograph.operators.excess import DEFAULT_THRESHOLD, excessive_auto
from heliograph.operators.merkle import VERSION, StateStore
from heliograph.operators.payload import add_fields
from heliograph.operators.reports import percent
from heliograph.runtime import materialise
from heliograph.sinks.zipnum import write_zipnum

STATE = "path string, modified timestamp, length long"


@dataclass
class Stages:
    """The frames of a run and what passed each of them."""

    captures: DataFrame
    counts: dict[str, Observation] = field(default_factory=dict)

    def observed(self, name: str, frame: DataFrame) -> DataFrame:
        seen = Observation(name)
        self.counts[name] = seen
        return frame.observe(seen, F.count(F.lit(1)).alias("n"))

    def report(self, spark: SparkSession) -> DataFrame:
        """``stage, n_captures, removed_percent``, after an action has run the plan."""
        rows, before = [], None
        for name, seen in self.counts.items():
            n = seen.get["n"]
            rows.append((name, n, percent(before - n, before) if before is not None else 0.0))
            before = n
        return spark.createDataFrame(rows, "stage string, n_captures long, removed_percent double")


def process(captures: DataFrame, *, collection: str | None = None, blocklist: Blocklist | None = None, threshold: int | None = DEFAULT_THRESHOLD) -> Stages:
    """Lines through all stages; a stage without its argument is left out."""
    stages = Stages(captures)
    frame = stages.observed("read", captures)
    if collection is not None:
        frame = stages.observed("field added", with_parts(add_fields(frame, {"collection": collection}).drop("added")))
    if blocklist is not None:
        frame = stages.observed("blocklist", apply_blocklist(frame, blocklist))
    if threshold is not None:
        # Stored once: the counts and the rows both come from here.
        frame = stages.observed("excessive keys", excessive_auto(materialise(frame, "filtered"), threshold))
    stages.captures = frame
    return stages


def file_state(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, modified, length`` of files, without reading them."""
    if not paths:
        return spark.createDataFrame([], STATE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


class Collection:
    """A collection's captures, kept up to date run by run.

    ``folder`` holds the published versions: the state of the archives and the captures
    read from them.  A run reads the archives that are new or changed and publishes their
    captures with the new state; captures read before are not written again, those of
    archives that have changed since, or are gone, no longer count.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.name = spark, name
        self.store = StateStore(spark, folder, ["path"])

    def update(self, paths: list[str], read) -> dict[str, int]:
        """``read(spark, paths)`` gives the captures of files; returns what was done."""
        done = dict.fromkeys(("added", "changed", "removed"), 0)

        def process(changes: DataFrame) -> DataFrame | None:
            done.update({r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()})
            # Spark plans a scan from the names of its files, so the changed ones come here.
            todo = [r.path for r in changes.where("change <> 'removed'").select("path").toLocalIterator()]
            return read(self.spark, todo) if todo or not self.store.latest() else None

        self.store.advance(file_state(self.spark, paths), process)
        return done

    def captures(self) -> DataFrame:
        """The captures of every archive as it was read last."""
        read_in = self.store.state().select(F.col("path").alias("hg_path"), VERSION)
        rows = self.store.outputs()
        current = (rows["src_path"] == read_in["hg_path"]) & (rows[VERSION] == read_in[VERSION])
        return rows.join(read_in, current, "left_semi").drop(VERSION)

    def build(self, output_dir: str, *, blocklist: Blocklist | None = None, threshold: int = DEFAULT_THRESHOLD, **zipnum) -> tuple[DataFrame, DataFrame]:
        """Writes the cluster of all captures; returns its index and the report of stages."""
        stages = process(self.captures(), collection=self.name, blocklist=blocklist, threshold=threshold)
        # Stored before it is ordered: finding range borders would run, and count, it twice.
        index = write_zipnum(materialise(stages.captures, "finished"), output_dir, **zipnum)
        return index, stages.report(self.spark)
