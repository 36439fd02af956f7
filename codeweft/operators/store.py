"""Generations of a table: content-addressed payloads, copying, upsert, pruning, renames, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def payloads(rows: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Memberships (key, payload_hash) and distinct payloads (payload_hash, payload as sorted JSON)."""
    ordered = sorted(columns)
    hashed = rows.select(key, F.to_json(F.struct(*ordered)).alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))
    return hashed.select(key, "payload_hash"), hashed.groupBy("payload_hash").agg(F.first("payload").alias("payload"))


def copy_unaffected(previous: DataFrame, changed: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """The next generation: rows of the previous one outside the changed paths, and the new rows."""
    return previous.join(changed.select(path).distinct(), path, "left_anti").unionByName(new)


def copy_unaffected_edges(previous: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """The same for edges (source_path, target_path): both ends must lie outside the changed paths."""
    c = changed.select("path").distinct()
    kept = previous.join(c, previous["source_path"] == c["path"], "left_anti").join(c, previous["target_path"] == c["path"], "left_anti")
    return kept.unionByName(new)


def upsert(base: DataFrame, delta: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row per key of both; of equal times the delta wins, then the greatest row."""
    rest = [c for c in base.columns if c not in key]
    both = base.withColumn("_d", F.lit(0)).unionByName(delta.select(*base.columns).withColumn("_d", F.lit(1)))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), "_d", *rest)).alias("r"))
    return last.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def newest_generations(generations: DataFrame, keep: int) -> DataFrame:
    """Ids of the newest ``keep`` committed generations."""
    return generations.where("state = 'committed'").orderBy(F.desc("id")).limit(keep).select("id")


def prune(rows: DataFrame, generations: DataFrame, keep: int, column: str = "generation_id") -> DataFrame:
    """Rows of the newest ``keep`` committed generations (a bounded list, so the filter is broadcast)."""
    ids = newest_generations(generations, keep).withColumnRenamed("id", column)
    return rows.join(F.broadcast(ids), column, "left_semi")


def unused_payloads(memberships: DataFrame, payload: DataFrame) -> DataFrame:
    """Payloads that no membership names any more."""
    return payload.join(memberships.select("payload_hash").distinct(), "payload_hash", "left_anti")


def renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files renamed with their content: old_path, new_path, content_hash.

    A hash counts only when exactly one removed and one added path has it.
    """
    gone = before.join(after.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.min("path").alias("old_path"), F.count(F.lit(1)).alias("n"))
    come = after.join(before.select("path"), "path", "left_anti").groupBy("content_hash").agg(F.min("path").alias("new_path"), F.count(F.lit(1)).alias("m"))
    return gone.join(come, "content_hash").where("n = 1 and m = 1").select("old_path", "new_path", "content_hash")


def reconcile(indexed: DataFrame, current: DataFrame, compare: list[str]) -> DataFrame:
    """Full comparison by path: path, state (added, deleted, modified); equal rows are left out."""
    a, b = indexed.select("path", F.struct(*compare).alias("a")), current.select("path", F.struct(*compare).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def ratchet(current: DataFrame, baseline: DataFrame, added: DataFrame, known: DataFrame) -> DataFrame:
    """Ids that became a finding since a baseline, were not added since, and were known then."""
    return current.select("id").distinct().join(baseline.select("id"), "id", "left_anti").join(added.select("id"), "id", "left_anti").join(known.select("id"), "id", "left_semi")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one of two tables only, with side ``a`` or ``b``; nulls compare equal."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def unique_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Later rows of one id get a discriminator (#L<line>:<kind>, then a number): new_id and all columns."""
    w = Window.partitionBy(key).orderBy("ordinal")
    again = F.concat(F.col(key), F.lit("#L"), F.col("line").cast("string"), F.lit(":"), F.col("kind"))
    first = rows.withColumn("_k", F.row_number().over(w)).withColumn("_id", F.when(F.col("_k") == 1, F.col(key)).otherwise(again))
    clash = F.row_number().over(Window.partitionBy("_id").orderBy("ordinal"))
    return first.withColumn("new_id", F.when(clash == 1, F.col("_id")).otherwise(F.concat_ws(":", "_id", clash.cast("string")))).drop("_k", "_id")


def evict_oldest(entries: DataFrame, cap: int) -> DataFrame:
    """The entries that stay when sizes may sum to ``cap``: all, else without the oldest quarter.

    ``entries`` has key, size, created_at. The quarter is found as an exact quantile, not by a sort.
    """
    n = entries.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not n["n"] or n["size"] <= cap:
        return entries
    drop = n["n"] // 4
    gone = entries.orderBy("created_at", "key").limit(drop).select("key")
    return entries.join(gone, "key", "left_anti")


def publish(tables: dict[str, DataFrame], root: str, generation: int) -> None:
    """Write a generation of several tables and make it the current one in a single step.

    The tables go to a folder of their own, which nobody reads before the pointer names it; the
    pointer is a file that is written beside and renamed, so that readers see one whole generation
    or the one before. A generation that failed half-way is written anew under its number.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/generation={generation}/{name}")
    jvm = spark.sparkContext._jvm
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/_next-{generation}"), jvm.org.apache.hadoop.fs.Path(f"{root}/current-{generation:012d}")
    fs = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(",".join(sorted(tables)).encode())
    out.close()
    fs.delete(pointer, False)
    if not fs.rename(fresh, pointer):
        raise OSError(f"generation {generation} could not be published")


def published_generation(spark: SparkSession, root: str) -> int | None:
    """The newest published generation, or None."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return max((int(n[8:]) for n in names if n.startswith("current-")), default=None)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published generation."""
    generation = published_generation(spark, root)
    if generation is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/generation={generation}/{name}")


def sync(root: str, changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
    """The next generation of a published graph after some paths changed; its number.

    ``nodes`` (path) and ``edges`` (source_path, target_path) hold the new rows of the changed
    paths; what does not touch a changed path is copied, and all is published at once.
    """
    spark = nodes.sparkSession
    generation = (published_generation(spark, root) or 0) + 1
    if generation == 1:
        publish({"nodes": nodes, "edges": edges}, root, generation)
        return generation
    keep = copy_unaffected(published(spark, root, "nodes"), changed, nodes.select(*published(spark, root, "nodes").columns))
    old = published(spark, root, "edges")
    publish({"nodes": keep.select(*nodes.columns), "edges": copy_unaffected_edges(old, changed, edges.select(*old.columns)).select(*edges.columns)}, root, generation)
    return generation


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported graph document: {"nodes": [...], "edges": [...]}, one document a file."""
    node = "id string, kind string, path string, name string, line int, end_line int"
    edge = "source string, target string, kind string, confidence string"
    doc = spark.read.schema(f"nodes array<struct<{node.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{edge.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))
