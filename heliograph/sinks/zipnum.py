"""Writing ZipNum clusters.

Lines are range-sorted; row counts per partition give every line its number, so chunks
of ``chunk_size`` consecutive lines are the same however Spark cuts the data.  Chunks are
compressed by the executors.  Shards are filled in order of the chunks, each group of
GROUP chunks by one task, which sees sizes and no data; each shard is then written by one
task.  The driver sees a row per group and the names of the shards.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import materialise
from heliograph.sources.paths import filesystem, is_local, join, local, put_text

#: Chunks whose shards are filled together: 1e8 lines and more.  A new group begins a new shard.
GROUP = 1 << 17


def fill_shards(sizes: list[int], shard_bytes: float) -> list[tuple[int, int]]:
    """(shard, offset) of each chunk: a shard is closed once it has reached its size, and
    none is left empty."""
    placed, shard, offset = [], 1, 0
    for size in sizes:
        if offset and offset >= shard_bytes:
            shard, offset = shard + 1, 0
        placed.append((shard, offset))
        offset += size
    return placed


def numbered(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line, number``: all lines in order, numbered from 0 without gaps.

    The sorted lines are stored once, with the partition they came from; the number of
    lines before each partition is a sum over as many rows as there are partitions.
    """
    ranged = lines.select(F.col(column).alias("line")).where("line is not null").repartitionByRange("line").sortWithinPartitions("line")
    kept = materialise(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted-lines")
    before, starts = 0, []
    for row in kept.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((row.part, before))
        before += row.n
    start = F.broadcast(lines.sparkSession.createDataFrame(starts, "part int, start long"))
    return kept.join(start, "part").select("line", (F.col("start") + F.col("place")).alias("number"))


def _compress(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def member() -> pa.RecordBatch:
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            data = packer.compress("".join(f"{x}\n" for x in held).encode("utf-8", "surrogatepass")) + packer.flush()
            key = held[0].split("{", 1)[0].strip()
            columns = [pa.array([chunk]), pa.array([key]), pa.array([data]), pa.array([len(data)]), pa.array([len(held)])]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "key", "data", "size", "n_lines"])

        for batch in batches:
            for number, line in zip(batch["chunk"].to_pylist(), batch["line"].to_pylist()):
                if number != chunk:
                    if held:
                        yield member()
                    chunk, held = number, []
                held.append(line)
        if held:
            yield member()

    return run


def _fill(shard_bytes: float):
    def run(chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("chunk")
        placed = fill_shards(chunks["size"].to_pylist(), shard_bytes)
        chunks = chunks.append_column("shard_in_group", pa.array([s for s, _ in placed], pa.int32()))
        return chunks.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return run


def write_zipnum(
    lines: DataFrame,
    output_dir: str,
    *,
    base: str | None = None,
    chunk_size: int = 3000,
    shard_size_mb: float = 100,
    single_shard: bool = False,
    compress_level: int = 6,
    idx_name: str | None = None,
    loc_name: str | None = None,
    column: str = "value",
    with_chunk: bool = False,
) -> DataFrame:
    """Writes shards, ``.idx`` and ``.loc`` to a folder all executors reach; returns the index rows
    (``with_chunk`` also with the number of their chunk).

    ``base`` defaults to the folder's name; a single shard is called ``base.cdx.gz`` in all
    three places, several ``base-01.cdx.gz`` and so on.  Files appear under their names only
    when complete.  Null lines are left out; without lines the index is empty and there is
    no shard.
    """
    if chunk_size < 1 or not 0 <= compress_level <= 9:
        raise ValueError("chunk_size is 1 or more, compress_level 0 (stored) to 9")
    output_dir = os.path.abspath(local(output_dir)) if is_local(output_dir) else output_dir.rstrip("/")
    base = base or output_dir.rsplit("/", 1)[-1]
    system, inner = filesystem(output_dir)
    system.create_dir(inner, recursive=True)
    chunked = numbered(lines, column).select(F.floor(F.col("number") / chunk_size).alias("chunk"), "number", "line")
    chunked = chunked.repartitionByRange("chunk").sortWithinPartitions("chunk", "number").select("chunk", "line")
    packed = materialise(chunked.mapInArrow(_compress(compress_level), "chunk long, key string, data binary, size long, n_lines long"), "chunks")
    sizes = packed.select(F.floor(F.col("chunk") / GROUP).alias("group"), "chunk", "key", "size")
    shard_bytes = float("inf") if single_shard else shard_size_mb * (1 << 20)
    filled = sizes.groupBy("group").applyInArrow(_fill(shard_bytes), "group long, chunk long, key string, size long, shard_in_group int, offset long")
    placed = materialise(filled, "places")
    starts, count, before = [], 0, 0
    for row in placed.groupBy("group").agg(F.max("shard_in_group").alias("n"), F.sum("size").alias("size")).orderBy("group").collect():  # a row per group
        # Of a single shard a group goes on where the one before it ends.
        starts.append((row.group, 0 if single_shard else count, before if single_shard else 0))
        count, before = 1 if single_shard else count + row.n, before + row["size"]
    start = F.broadcast(lines.sparkSession.createDataFrame(starts, "group long, start int, start_offset long"))
    numbered_ = placed.join(start, "group").withColumn("shard_num", F.col("start") + F.col("shard_in_group")).withColumn("offset", F.col("offset") + F.col("start_offset"))
    names = {n: f"{base}.cdx.gz" if count == 1 else f"{base}-{n:02d}.cdx.gz" for n in range(1, count + 1)}
    width = F.lpad(F.col("shard_num").cast("string"), F.greatest(F.lit(2), F.length(F.col("shard_num").cast("string"))), F.lit("0"))
    shard = F.lit(f"{base}.cdx.gz") if count == 1 else F.concat(F.lit(f"{base}-"), width, F.lit(".cdx.gz"))
    index = numbered_.select("key", shard.alias("shard"), "offset", F.col("size").alias("length"), F.col("shard_num").cast("int"), *(["chunk"] if with_chunk else []))
    if count:
        data = packed.select("chunk", "data").join(numbered_.select("chunk", "shard_num"), "chunk")
        # Written shard by shard: chunks of a shard stream through one task in order.
        ordered = data.repartition(min(count, 20_000), "shard_num").sortWithinPartitions("shard_num", "chunk").select("shard_num", "data")
        ordered.mapInArrow(_write(output_dir, base, count), "shard int").write.format("noop").mode("overwrite").save()
    rows = index.orderBy("shard_num", "offset").toLocalIterator(prefetchPartitions=True)
    put_text(join(output_dir, idx_name or f"{base}.idx"), (f"{r.key}\t{r.shard}\t{r.offset}\t{r.length}\t{r.shard_num}\n" for r in rows))
    put_text(join(output_dir, loc_name or f"{base}.loc"), (f"{n}\t{join(output_dir, n)}\n" for n in names.values()))
    return index


def _write(folder: str, base: str, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        system, inner = filesystem(folder)
        shard, out, name, done = None, None, "", []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{inner}/.{name}.{attempt}.tmp", f"{inner}/{name}")
                done.append(shard)

        for batch in batches:
            for number, data in zip(batch["shard_num"].to_pylist(), batch["data"]):
                if number != shard:
                    close()
                    shard, name = number, f"{base}.cdx.gz" if count == 1 else f"{base}-{number:02d}.cdx.gz"
                    out = system.open_output_stream(f"{inner}/.{name}.{attempt}.tmp")
                out.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    return run
