"""Full snapshots: current rows, validity intervals and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.ids import content_key


def committed_generations(generations: DataFrame) -> DataFrame:
    """Committed generations in order of id: generation_id, snapshot (1, 2, ...).

    One row per snapshot; numbering them takes a single task, which their number allows.
    """
    w = Window.orderBy("generation_id")
    ids = generations.where(F.lower(F.trim("state")) == "committed").select(F.col("id").alias("generation_id")).where("generation_id is not null").distinct()
    return ids.withColumn("snapshot", F.row_number().over(w))


def newest_generation(generations: DataFrame) -> int | None:
    """The greatest id of the committed generations, or None."""
    return generations.where(F.lower(F.trim("state")) == "committed").agg(F.max("id")).first()[0]


def current_files(files: DataFrame, generation: int | None, columns: list[str]) -> DataFrame:
    """The files of one generation, one row per path: of several rows the one ingested last.

    ``columns`` are those wanted besides path. Rows without a path are left out; a null ingested_at
    is older than any other; equal times are decided by the greatest values, so the result does
    not depend on the order of rows. The generation is filtered in the scan, and repeated rows of a
    path meet in a partial aggregate before the shuffle.
    """
    rank = F.struct(F.col("ingested_at").isNotNull(), "ingested_at", *[F.col(c).isNotNull() for c in columns], *columns)
    rows = files.where((F.col("generation_id") == F.lit(generation)) & F.col("path").isNotNull())
    last = rows.groupBy("path").agg(F.max_by(F.struct(*columns), rank).alias("_r"))
    return last.select("path", *[F.col("_r")[c].alias(c) for c in columns])


def validity_intervals(rows: DataFrame, key: list[str]) -> DataFrame:
    """Gaps and islands over key and row hash: key columns, row_hash, first_snapshot, last_snapshot.

    ``rows`` has the key, row_hash and snapshot, one row per key and snapshot. A stretch of
    consecutive snapshots with one hash is an interval; a null hash equals only a null hash.
    """
    w = Window.partitionBy(*key).orderBy("snapshot")
    breaks = F.lag("snapshot").over(w).isNull() | (F.lag("snapshot").over(w) != F.col("snapshot") - 1) | ~F.lag("row_hash").over(w).eqNullSafe(F.col("row_hash"))
    marked = rows.withColumn("_new", breaks.cast("int")).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*key, "_island").agg(
        F.first("row_hash").alias("row_hash"), F.min("snapshot").alias("first_snapshot"), F.max("snapshot").alias("last_snapshot")
    ).drop("_island")


def interval_changes(intervals: DataFrame, key: list[str], last: int) -> DataFrame:
    """Change events from validity intervals: key columns, snapshot, change.

    A start that touches the end of an earlier interval is ``changed``, any other start after
    snapshot 1 is ``added``, an end before snapshot ``last`` that nothing follows is ``removed``.
    """
    w = Window.partitionBy(*key).orderBy("first_snapshot")
    i = intervals.withColumn("_before", F.lag("last_snapshot").over(w)).withColumn("_after", F.lead("first_snapshot").over(w))
    start = F.when(F.col("_before") == F.col("first_snapshot") - 1, F.lit("changed")).when(F.col("first_snapshot") > 1, F.lit("added"))
    ends = (F.col("last_snapshot") < F.lit(last)) & (F.col("_after").isNull() | (F.col("_after") > F.col("last_snapshot") + 1))
    events = F.array(
        F.struct(F.col("first_snapshot").alias("snapshot"), start.alias("change")),
        F.struct((F.col("last_snapshot") + 1).alias("snapshot"), F.when(ends, F.lit("removed")).alias("change")),
    )
    return i.select(*key, F.explode(events).alias("_e")).select(*key, "_e.snapshot", "_e.change").where("change is not null")


def snapshot_rows(files: DataFrame, generations: DataFrame) -> DataFrame:
    """One row per path and committed snapshot: path, snapshot, row_hash (latest delivery counts)."""
    committed = committed_generations(generations)
    ids = {r["generation_id"]: r["snapshot"] for r in committed.collect()}
    number = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]) if ids else F.create_map(F.lit(-1), F.lit(0))
    rows = files.where(F.col("generation_id").isin(list(ids)) & F.col("path").isNotNull())
    return (
        rows.select("path", number[F.col("generation_id")].alias("snapshot"), "ingested_at", content_key("content_hash", "content").alias("row_hash"))
        .groupBy("path", "snapshot")
        .agg(F.max_by("row_hash", F.struct(F.col("ingested_at").isNotNull(), "ingested_at", F.col("row_hash").isNotNull(), "row_hash")).alias("row_hash"))
    )


def file_intervals(files: DataFrame, generations: DataFrame) -> DataFrame:
    """Validity intervals of the files table, in generation ids: path, row_hash, first_generation, last_generation."""
    ids = {r["snapshot"]: r["generation_id"] for r in committed_generations(generations).collect()}
    back = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]) if ids else F.create_map(F.lit(0), F.lit(-1))
    i = validity_intervals(snapshot_rows(files, generations), ["path"])
    return i.select("path", "row_hash", back[F.col("first_snapshot")].cast("long").alias("first_generation"), back[F.col("last_snapshot")].cast("long").alias("last_generation"))


def file_changes(files: DataFrame, generations: DataFrame) -> DataFrame:
    """What changed between consecutive committed generations: generation_id, path, change.

    Contents are compared by hash in one notation, computed from the content where it is missing;
    two rows with neither count as equal. Fewer than two committed generations give no change.
    The number of snapshots is small; their ids are read by the driver, the files are not.
    """
    ids = {r["snapshot"]: r["generation_id"] for r in committed_generations(generations).collect()}
    back = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]) if ids else F.create_map(F.lit(0), F.lit(-1))
    changes = interval_changes(validity_intervals(snapshot_rows(files, generations), ["path"]), ["path"], len(ids))
    return changes.select(back[F.col("snapshot")].cast("long").alias("generation_id"), "path", "change")
