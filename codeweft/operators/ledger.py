"""Ledger and event aggregates: rollups, running totals, percentiles, latest rows, sessions, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNATTRIBUTED = "(unattributed)"


def attributed(c: Column | str) -> Column:
    """A grouping key; null and empty go to one bucket."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(UNATTRIBUTED))


def rollup(records: DataFrame, keys: list[str], amount: str, units: str) -> DataFrame:
    """Totals of each key by itself and overall, in one pass of grouping sets: dimension, key, n, amount, units."""
    keyed = records.select(*[attributed(k).alias(k) for k in keys], amount, units)
    dims = F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("key")), *[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("key")) for k in keys])).alias("d")
    out = keyed.select(dims, amount, units).groupBy("d.dimension", "d.key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 4).alias("amount"), F.sum(units).alias("units"))
    return out


def crossings(records: DataFrame, by: str, order: list[str], amount: str, budget: float) -> DataFrame:
    """The record at which a running total first reaches a budget, per key: all columns, before, after."""
    w = Window.partitionBy(by).orderBy(*order)
    total = records.withColumn("after", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col(amount))
    return total.where((F.col("before") < budget) & (F.col("after") >= budget))


def nearest_rank(records: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Nearest-rank percentiles per key, by the histogram selection: keys, n, p, quantile (value is an integer)."""
    from codeweft.operators.selection import exact_quantiles
    from codeweft.session import Scratch

    scratch = Scratch(records.sparkSession, "percentiles")
    return exact_quantiles(scratch.save(records.select(*by, value)), by, probabilities, value, scratch=scratch)


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, by a partial aggregate rather than a sort."""
    rest = [c for c in rows.columns if c not in by]
    out = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return out.select(*by, *[F.col("r")[c].alias(c) for c in rest])


def kept_by_debounce(events: DataFrame, by: str, at: str, seconds: float) -> DataFrame:
    """First events of gap-separated runs: an event is dropped that follows any other within the window."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at, "event_id"))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= F.lit(int(seconds * 1_000_000)))).drop("_gap")


def transitions(events: DataFrame, by: str, order: list[str], kind: str) -> DataFrame:
    """Observed runtime edges: consecutive kinds of one actor: source, target, n, last_seen."""
    w = Window.partitionBy(by).orderBy(*order)
    e = events.select(F.lag(kind).over(w).alias("source"), F.col(kind).alias("target"), F.col(order[0]).alias("at")).where("source is not null")
    return e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_seen"))


def merge_runtime(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Static edges and those runtime edges that are not among them (source, target, kind, origin).

    One aggregate: a join walks every static row of its key again for each runtime edge when part of the edge is a constant.
    """
    key = ["source", "target", "kind"]
    both = static.select(*key, F.lit(True).alias("_s")).unionByName(runtime.select(*key, F.lit(False).alias("_s")))
    return both.groupBy(*key).agg(F.max("_s").alias("_s")).select(*key, F.when(F.col("_s"), "static").otherwise("runtime").alias("origin"))


def confusion(judged: DataFrame, by: list[str], truth: str, verdict: str) -> DataFrame:
    """Counts and rates of boolean verdicts against truths: keys, n, tp, fp, fn, tn, accuracy."""
    t, v = F.col(truth), F.col(verdict)
    cell = lambda c: F.count(F.when(c, 1))
    out = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cell(t & v).alias("tp"), cell(~t & v).alias("fp"), cell(t & ~v).alias("fn"), cell(~t & ~v).alias("tn"))
    return out.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / F.col("n"), 6))


def majority(votes: DataFrame, by: str, choice: str) -> DataFrame:
    """The choice of more than half of the votes per key, else null: key, choice, votes."""
    n = votes.groupBy(by, choice).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(by).agg(F.max_by(choice, F.struct("n", choice)).alias("c"), F.max("n").alias("top"), F.sum("n").alias("votes"))
    return best.select(by, F.when(F.col("top") * 2 > F.col("votes"), F.col("c")).alias("choice"), "votes")


def array_matrix(left: DataFrame, left_key: str, right: DataFrame, members: str) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose array ``members`` holds their key; unmatched ones stay."""
    taken = right.withColumn("_m", F.explode(F.array_distinct(members)))
    return left.join(taken, left[left_key] == taken["_m"], "left").drop("_m")


def split_by_hash(rows: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """A stable split: all columns and part (train or validation), by the SHA-256 of seed and key."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return rows.withColumn("part", F.when(share < fraction, "validation").otherwise("train"))
