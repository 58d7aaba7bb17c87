"""Shared working storage and small planning helpers.

Intermediate tables are written below ``spark.checkpoint.dir``, the folder all
executors share, so that a lost executor costs a re-read and never a wrong
result.  Nothing here keeps data only in executor memory.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession, lasting: bool = False) -> str:
    """The session's shared folder; without one, a temporary folder if all executors are
    on this machine (``lasting``: one that later sessions find).  RuntimeError on a cluster,
    where they could not read each other's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and lasting and spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.gettempdir()
    if not root:
        root = spark.conf.get("heliograph.local.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        root = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        spark.conf.set("heliograph.local.dir", root)
        _made[root] = spark
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/heliograph/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    Cuts the lineage like ``checkpoint()``, but computes the rows once and stores
    them by column, so later readers fetch only what they select.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.hg_path = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Removes stored frames that nothing reads any more, before the driver exits."""
    for frame in frames:
        if path := vars(frame).get("hg_path"):
            delete_path(frame.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Removes everything this process wrote to the shared folder of ``spark``."""
    for path, owner in list(_made.items()):
        if owner is spark:
            try:
                delete_path(spark, path)
            except Exception:  # the session may be gone already
                _made.pop(path, None)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:
            pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed_lower(column) -> F.Column:
    return F.lower(F.trim(column))
