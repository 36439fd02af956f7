"""References to records that do not exist.

Parent ids get sorted integers by a range partitioning, and these compress into contiguous runs: a
run ends where ids are referenced that no parent has. Every referenced id is as-of matched to the
preceding run start and does not exist beyond that run's end. For ids that do exist the instants
at which they are live are integer keys again (microseconds), compressed into runs, and a
reference is an orphan when it lies in none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.ids import plain_id
from codeweft.operators.skew import hot_keys, join_on_skewed
from codeweft.session import Scratch

FOREVER = (1 << 63) - 1
#: Groups of a hot id over which its references are spread.
SALTS = 32
#: An id with this share of the references is hot; there are at most 1,000.
HOT_SHARE = 0.001
#: Alias chains of up to 2**PAIR_ROUNDS steps are closed as pairs.
PAIR_ROUNDS = 4
#: Integer keys of a block; runs do not cross blocks, so no task sees more of them at once.
BLOCK_BITS = 16
#: Live runs that travel with their id; ids with more are matched by a sort of runs and references.
CARRIED_RUNS = 16


def compress_runs(keys: DataFrame, by: str = "id") -> DataFrame:
    """Contiguous runs of integer parent keys: columns ``by``, run_start, run_end (inclusive).

    ``keys`` has ``by``, first and last (inclusive ends of a stretch of keys; a single key has
    first = last). Stretches that overlap or touch become one run. Repeated rows change nothing;
    rows with a null or with last < first hold no key. ``by`` separates key spaces; for a plain
    integer key it is the key's block, so that runs never cross a block and no task sees them all.
    """
    w = Window.partitionBy(by).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = reach.isNull() | ((F.col("first") > reach) & (F.col("first") - 1 > reach))
    return (
        keys.where(F.col(by).isNotNull() & (F.col("last") >= F.col("first")))
        .select(by, "first", "last").distinct()
        .withColumn("_new", starts.cast("int"))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(by, "_run")
        .agg(F.min("first").alias("run_start"), F.max("last").alias("run_end"))
        .drop("_run")
    )


def beyond_runs(refs: DataFrame, runs: DataFrame, by: str = "id", pos: str = "pos", hot: list | None = None) -> DataFrame:
    """The rows of ``refs`` whose key (``by``, ``pos``) lies in no run; all columns of refs are kept.

    One sort of runs and references together per ``by`` gives the as-of match. References of hot
    ``by`` values are salted over ``SALTS`` groups, each of which gets a copy of that value's runs.
    A null ``pos`` matches nothing, so the reference is reported. Refs with null ``by`` are dropped.
    ``hot`` lists the hot values where they are known; else they are counted.
    """
    hot = hot_keys(refs, by) if hot is None else hot
    cols = [c for c in refs.columns if c not in (by, pos)]
    refs = refs.where(F.col(by).isNotNull())
    is_hot = F.lit(False)
    if hot:
        names = refs.sparkSession.createDataFrame([(h, True) for h in hot], refs.select(by).schema.add("_hot", "boolean"))
        refs, runs = refs.join(F.broadcast(names), by, "left"), runs.join(F.broadcast(names), by, "left")
        is_hot = F.coalesce("_hot", F.lit(False))
    spread = F.when(is_hot, F.pmod(F.xxhash64(pos, *cols), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = refs.select(by, F.col(pos).alias("_pos"), spread.alias("_salt"), F.lit(1).alias("_ref"), F.lit(None).cast("long").alias("_end"), F.struct(*(cols or [by])).alias("_row"))
    right = runs.select(by, F.col("run_start").alias("_pos"), F.explode(copies).alias("_salt"), F.lit(0).alias("_ref"), F.col("run_end").alias("_end"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(by, "_salt").orderBy(F.col("_pos").asc_nulls_first(), "_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = left.unionByName(right).withColumn("_run_end", F.last("_end", ignorenulls=True).over(w))
    lost = F.col("_run_end").isNull() | F.col("_pos").isNull() | (F.col("_pos") > F.col("_run_end"))
    return matched.where((F.col("_ref") == 1) & lost).select(by, F.col("_pos").alias(pos), *[F.col("_row")[c].alias(c) for c in cols])


def live_stays(nodes: DataFrame) -> DataFrame:
    """Stretches of instants at which an id is live: id, first, last (microseconds, inclusive)."""
    return nodes.select(
        plain_id("id").alias("id"),
        F.unix_micros("added_at").alias("first"),
        F.when(F.col("deleted_at").isNull(), F.lit(FOREVER)).otherwise(F.unix_micros("deleted_at") - 1).alias("last"),
    ).where("id is not null and first is not null and last >= first")


def runs_through_aliases(stays: DataFrame, aliases: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of instants at which an id that a renamed id leads to, in any number of steps, is live: id, first, last.

    Chains of up to 2**PAIR_ROUNDS steps are closed as pairs by doubling. What is longer goes on by
    pointer doubling: after round k an id holds the runs of all it reaches in fewer than 2**k steps
    and points to what it reaches in exactly 2**k, so a chain costs its length times the logarithm
    of its length, and not all pairs of it are formed. Cycles, repeated rows, self-renames, several
    new ids and names that do not exist are allowed.
    """
    step = scratch.save(
        aliases.select(plain_id("old_id").alias("old_id"), plain_id("new_id").alias("new_id"))
        .where("old_id is not null and new_id is not null and old_id <> new_id").distinct()
    )
    reach, n = step, step.count()
    for _ in range(PAIR_ROUNDS):
        wider = scratch.save(reach.unionByName(_compose(reach, reach).where("old_id <> new_id")).distinct())
        reach, before, n = wider, n, wider.count()
        if n == before:
            return _over(reach, stays)
    return _through_pointers(stays, step, scratch)


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").hint("merge").join(b.alias("b").hint("merge"), F.col("a.new_id") == F.col("b.old_id")).select("a.old_id", "b.new_id")


def _over(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """What the ids that ``pairs`` point to hold: id, first, last."""
    p, r = pairs.alias("p").hint("merge"), runs.alias("r").hint("merge")
    return p.join(r, F.col("p.new_id") == F.col("r.id")).select(F.col("p.old_id").alias("id"), "r.first", "r.last")


def _through_pointers(stays: DataFrame, step: DataFrame, scratch: Scratch) -> DataFrame:
    ids = step.select(F.explode(F.array("old_id", "new_id")).alias("id")).distinct()
    left = ids.count().bit_length()
    ends = [F.col("run_start").alias("first"), F.col("run_end").alias("last")]
    runs = scratch.save(compress_runs(stays.hint("merge").join(ids.hint("merge"), "id", "left_semi")).select("id", *ends))
    while left and step.limit(1).count():
        wider = scratch.save(compress_runs(runs.unionByName(_over(step, runs))).select("id", *ends))
        further = scratch.save(_compose(step, step).distinct())
        scratch.drop(runs, step)
        runs, step, left = wider, further, left - 1
    return runs


def live_runs(nodes: DataFrame, aliases: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of instants at which an id, or an id it was renamed to in any number of steps, is live."""
    stays = scratch.save(live_stays(nodes))
    return compress_runs(stays.unionByName(runs_through_aliases(stays, aliases, scratch)))


def numbered(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (one row per id) with num: sorted integers, consecutive within each range of ids.

    A range partitioning sorts the ids; the number of a row is its partition's and its place there,
    so no task sees all of them. The result is written, which fixes the numbers.
    """
    return scratch.save(scratch.save(ids).repartitionByRange("id").sortWithinPartitions("id").withColumn("num", F.monotonically_increasing_id()))


def missing_keys(keys: DataFrame) -> DataFrame:
    """Of ``keys`` (num, referenced, parent) the numbers that are referenced and lie beyond the runs of parents: num."""
    block = F.shiftright("num", BLOCK_BITS).alias("block")
    parents = keys.where("parent").select(block, F.col("num").alias("first"), F.col("num").alias("last"))
    asked = keys.where("referenced").select(block, F.col("num").alias("pos"))
    return beyond_runs(asked, compress_runs(parents, "block"), "block", hot=[]).select(F.col("pos").alias("num"))


def edge_references(edges: DataFrame) -> DataFrame:
    """One row per non-empty endpoint: ordinal, side, id, pos (microseconds of seen_at)."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), plain_id(s).alias("id")) for s in ("source", "target")])
    return (
        edges.select("ordinal", F.unix_micros("seen_at").alias("pos"), F.explode(ends).alias("e"))
        .select("ordinal", "e.side", "e.id", "pos").where("id is not null")
    )


def _orphans(refs: DataFrame, nodes: DataFrame, aliases: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``refs``, a written table, that name no live record."""
    runs = scratch.save(live_runs(nodes, aliases, scratch))
    of_id = _carried(runs)
    asked = refs.groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"))
    ids = asked.hint("merge").join(of_id.hint("merge"), "id", "full").select("id", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "runs")
    keys = numbered(ids, scratch)
    missing = missing_keys(keys.select("num", (F.col("n_refs") > 0).alias("referenced"), (F.col("n_runs") > 0).alias("parent")))
    known = scratch.save(keys.where("n_refs > 0").hint("merge").join(missing.withColumn("missing", F.lit(True)).hint("merge"), "num", "left"))
    total = refs.count()
    hot = [r["id"] for r in known.where(F.col("n_refs") >= F.lit(max(1, total * HOT_SHARE))).select("id").collect()]
    found = join_on_skewed(refs, known.select("id", "n_runs", "runs", "missing"), "id", hot=hot)
    live = F.exists("runs", lambda r: (F.col("pos") >= r["run_start"]) & (F.col("pos") <= r["run_end"]))
    carried = F.col("missing").isNotNull() | F.col("pos").isNull() | ((F.col("n_runs") <= CARRIED_RUNS) & ~F.coalesce(live, F.lit(False)))
    lost = found.where(carried).select("ordinal", "side", "id", "pos")
    if not known.where(F.col("n_runs") > CARRIED_RUNS).limit(1).count():
        return lost
    many = scratch.save(found.where(F.col("missing").isNull() & F.col("pos").isNotNull() & (F.col("n_runs") > CARRIED_RUNS)).select("ordinal", "side", "id", "pos"))
    return lost.unionByName(beyond_runs(many, runs).select("ordinal", "side", "id", "pos"))


def _carried(runs: DataFrame) -> DataFrame:
    """One row per id: id, n_runs, runs (null where there are more than CARRIED_RUNS)."""
    w = Window.partitionBy("id").orderBy("run_start")
    first = runs.withColumn("_k", F.row_number().over(w))
    kept = F.collect_list(F.when(F.col("_k") <= CARRIED_RUNS, F.struct("run_start", "run_end")))
    return first.groupBy("id").agg(F.count(F.lit(1)).alias("n_runs"), kept.alias("runs")).withColumn("runs", F.when(F.col("n_runs") <= CARRIED_RUNS, F.col("runs")))


def orphan_references(edges: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Endpoints that name no live record: ordinal, side, id, seen_at; one row per (ordinal, side).

    Copies of a record (same ordinal) count once. Null and empty endpoints are no references.
    An edge without seen_at matches no stay and is reported. Nodes without added_at are never live;
    repeated nodes and aliases change nothing. Empty nodes make every reference an orphan; empty
    edges give an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(edges.sparkSession, "orphans")
    return _one_each(_orphans(scratch.save(edge_references(edges)), nodes, aliases, scratch))


def _one_each(lost: DataFrame) -> DataFrame:
    return lost.groupBy("ordinal", "side").agg(F.min("id").alias("id"), F.timestamp_micros(F.min("pos")).alias("seen_at"))


def orphan_report(edges: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Orphans and all references by side and month of seen_at: side, month, references, orphans, rate.

    A null month holds the references without a time.
    """
    scratch = Scratch(edges.sparkSession, "orphans")
    refs = scratch.save(edge_references(edges))
    month = F.date_format(F.timestamp_micros("pos"), "yyyy-MM").alias("month")
    total = refs.groupBy("side", month).agg(F.countDistinct("ordinal").alias("references"))
    lost = _one_each(_orphans(refs, nodes, aliases, scratch)).groupBy("side", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
    on = (total["side"] == lost["side"]) & total["month"].eqNullSafe(lost["month"])
    n = F.coalesce(lost["orphans"], F.lit(0))
    return total.join(lost, on, "left").select(total["side"], total["month"], "references", n.alias("orphans"), F.round(n / F.col("references"), 6).alias("rate"))


def orphan_keys(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """References by an integer key to another table: key, references; only keys that no parent has.

    Parent keys, distinct by partial aggregation, compress into runs of consecutive integers per
    block of 2**BLOCK_BITS; the distinct referenced keys are as-of matched to them. Null keys are no
    references; repeated rows of either side are allowed; without parents every key is an orphan.
    """
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    asked = children.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("references"))
    held = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).cast("long").alias("pos")).distinct()
    runs = compress_runs(held.select(block, F.col("pos").alias("first"), F.col("pos").alias("last")), "block")
    return beyond_runs(asked.select(block, "pos", "references"), runs, "block", hot=[]).select(F.col("pos").alias("key"), "references")
