"""Structured Streaming over event and trace files: totals, windows, sessions, incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import Scratch


def event_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, a few files a trigger; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def trace_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of a folder as a stream; a line that does not fit is kept as it is in ``_rejected``."""
    return spark.readStream.schema(f"{schema}, _rejected string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(folder)


def windowed_totals(events: DataFrame, at: str, kind: str, value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and kind; rows later than the watermark are dropped."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions per actor: events with no gap longer than ``gap``."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_to_end(stream: DataFrame, mode: str, scratch: Scratch, name: str) -> DataFrame:
    """Run a stream over what is there and give its last state.

    In complete mode each batch replaces the table; in append mode batches are added. A batch is
    written under its own number, so a retried batch overwrites itself.
    """
    spark, root = scratch.spark, f"{scratch.root}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{0 if mode == 'complete' else number:06d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(root)


#: Parts of the state of an upsert stream; a batch rewrites those whose keys it holds.
BUCKETS = 32


def _current_parts(spark: SparkSession, root: str, below: int | None = None) -> dict[str, str]:
    """The newest finished version of every part of the state, before batch ``below``; found in storage, not in memory."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts: dict[str, str] = {}
    if not fs.exists(base):
        return parts
    versions = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().isdigit())
    for v in versions:
        if (below is None or int(v) < below) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{v}/_SUCCESS")):
            for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{v}")):
                if s.getPath().getName().startswith("_part="):
                    parts[s.getPath().getName()] = f"{root}/{v}/{s.getPath().getName()}"
    return parts


def upsert_state(spark: SparkSession, root: str, schema) -> DataFrame:
    """What an upsert stream has written to ``root`` so far."""
    paths = list(_current_parts(spark, root).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, key: list[str], order: str, scratch: Scratch, name: str, root: str | None = None) -> DataFrame:
    """The latest row per key, kept up by micro-batches; equal to the batch result over all rows.

    ``root`` is where state and checkpoint lie; a later run with the same folder goes on from there
    (without one the scratch folder serves). The state is split by key hash and a batch rewrites
    only the parts it touches, under its own number, so that a retried batch overwrites itself.
    """
    from codeweft.operators.store import upsert

    root = root or f"{scratch.root}/{name}"
    spark = scratch.spark

    def merge(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)))
        touched = {f"_part={r[0]}" for r in marked.select("_part").distinct().collect()}
        before = [p for part, p in _current_parts(spark, root, number).items() if part in touched]
        base = spark.read.schema(batch.schema).parquet(*before) if before else batch.limit(0)
        merged = upsert(base, batch, key, order).withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)))
        merged.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{root}/{number:09d}")

    q = stream.writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return upsert_state(spark, root, stream.schema)
