"""Parent-child links to full hierarchies by tree contraction.

A round rakes all leaves and splices out unary nodes (those whose lot of the round beats their
parent's and their child's, so that no two neighbours go at once). Each removal is recorded with the
parent the node had then, the distance to it and what hung below. Trees vanish in a logarithmic
number of rounds whatever their depth; a cycle shrinks until a node is its own parent, which
exposes it. The records, read backwards, give every node its root, depth, path and number of
descendants. A round removes a constant share of the nodes, so that reading all earlier results
in every backward step adds up to a constant number of readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.ids import plain_id, plain_word
from codeweft.operators.skew import hot_keys, join_on_skewed, union_all
from codeweft.session import Scratch

KEEP, RAKE, SPLICE, CYCLE = 0, 1, 2, 3


def _lot(c: str) -> Column:
    return F.xxhash64(F.col(c), F.col("turn"))


def contains_links(edges: DataFrame) -> DataFrame:
    """The distinct (parent, child) pairs of contains edges with two non-empty endpoints."""
    return (
        edges.where(plain_word("kind") == "contains")
        .select(plain_id("source").alias("parent"), plain_id("target").alias("node"))
        .where("parent is not null and node is not null").distinct()
    )


def _contract(first: DataFrame, with_paths: bool, scratch: Scratch) -> list[DataFrame]:
    """The records of all rounds: node, parent, w, hops, carry, acc, child, child_carry, op.

    ``w`` and ``hops`` lead from the parent to the node; ``carry`` counts the nodes spliced out
    between them and all that was raked into those, ``acc`` the nodes raked into the node itself.
    """
    rounds: list[DataFrame] = []
    # op and turn are columns, not literals, so that every round runs the code compiled for the first
    step = first
    while True:
        active = step.where(F.col("op") == KEEP)
        if not active.limit(1).count():
            return rounds
        kept, raked = F.col("op") == KEEP, F.col("op") == RAKE
        below = step.where(kept | raked).groupBy("parent").agg(
            F.count(F.when(kept, 1)).alias("n"), F.min(F.when(kept, F.col("node"))).alias("child"), F.max(F.when(kept, F.col("carry"))).alias("child_carry"),
            F.coalesce(F.sum(F.when(raked, F.col("acc") + F.col("carry") + 1)), F.lit(0)).alias("more"),
        ).withColumnRenamed("parent", "_p")
        n = F.coalesce("n", F.lit(0))
        op = (
            F.when(F.col("node") == F.col("parent"), CYCLE).when(n == 0, RAKE)
            .when((n == 1) & (_lot("node") > _lot("parent")) & (_lot("node") > _lot("child")), SPLICE).otherwise(KEEP)
        )
        seen = active.drop("op", "child", "child_carry").hint("merge").join(below.hint("merge"), F.col("node") == F.col("_p"), "left")
        seen = seen.withColumn("op", op).withColumn("acc", F.col("acc") + F.coalesce("more", F.lit(0)))
        spliced = seen.where(F.col("op") == SPLICE).select(
            F.col("child").alias("_c"), F.col("parent").alias("_parent"), F.col("w").alias("_w"), F.col("hops").alias("_hops"), (F.col("carry") + F.col("acc") + 1).alias("_carry")
        )
        gone = F.col("_c").isNotNull() & (F.col("op") != SPLICE) & (F.col("op") != CYCLE)
        step = scratch.save(
            seen.hint("merge").join(spliced.hint("merge"), F.col("node") == F.col("_c"), "left").select(
                "node",
                F.when(gone, F.col("_parent")).otherwise(F.col("parent")).alias("parent"),
                F.when(gone, F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"),
                (F.when(gone, F.concat("_hops", "hops")).otherwise(F.col("hops")) if with_paths else F.col("hops")).alias("hops"),
                F.when(gone, F.col("carry") + F.col("_carry")).otherwise(F.col("carry")).alias("carry"),
                "acc", "child", "child_carry", "op", (F.col("turn") + 1).alias("turn"),
            )
        )
        rounds.append(step)


def _start(links: DataFrame, with_paths: bool, scratch: Scratch) -> DataFrame:
    hops = F.array("node") if with_paths else F.lit(None).cast("array<string>")
    start = links.where("parent is not null and node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    none = F.lit(None)
    return scratch.save(start.select(
        "node", "parent", F.lit(1).cast("long").alias("w"), hops.alias("hops"), F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("acc"),
        none.cast("string").alias("child"), none.cast("long").alias("child_carry"), F.lit(0).alias("op"), F.lit(0).alias("turn"),
    ))


def hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root and depth of every id in ``links`` (parent, node): node_id, root_id, depth[, path].

    A root has depth 0 and itself as root. Ids on or below a cycle (a self-link is one) have root
    '' and depth -1, and with paths a null path; otherwise the path is the array of ids from the
    root to the node. No child may have two parents; if one does, the least parent counts. Rows
    with a null are no links; repeated rows change nothing; no links give no rows.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    first = _start(links, with_paths, scratch)
    return _expand(first, _contract(first, with_paths, scratch), with_paths, scratch)


def _expand(first: DataFrame, rounds: list[DataFrame], with_paths: bool, scratch: Scratch) -> DataFrame:
    """Roots, depths and paths from the records, the last round first."""
    # parents only lose children, so that those hot at the start are all that ever are
    hot = hot_keys(first, "parent")
    own = F.array("node_id") if with_paths else F.lit(None).cast("array<string>")
    tops = first.select(F.col("parent").alias("node_id")).distinct().hint("merge").join(first.select(F.col("node").alias("node_id")).hint("merge"), "node_id", "left_anti")
    known = [scratch.save(tops.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).cast("long").alias("depth"), own.alias("path")))]
    if rounds:
        cores = [r.where(F.col("op") == CYCLE).select(F.col("node").alias("node_id"), F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")) for r in rounds]
        known.append(scratch.save(union_all(cores)))
    for step in reversed(rounds):
        above = union_all(known).select(F.col("node_id").alias("parent"), "root_id", F.col("depth").alias("_d"), F.col("path").alias("_path"))
        below = step.where((F.col("op") == RAKE) | (F.col("op") == SPLICE)).select("node", "parent", "w", "hops")
        found = join_on_skewed(below, above, "parent", hot=hot)
        known.append(scratch.save(found.select(
            F.col("node").alias("node_id"), "root_id",
            F.when(F.col("_d") < 0, F.lit(-1).cast("long")).otherwise(F.col("_d") + F.col("w")).alias("depth"),
            (F.concat("_path", "hops") if with_paths else F.col("hops")).alias("path"),
        )))
    out = union_all(known)
    return out if with_paths else out.drop("path")


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs with their distance, from a hierarchy with paths.

    The pairs come from each node's own path, without a join: ancestor_id, node_id, distance >= 1.
    Nodes on or below a cycle have no path and no pairs.
    """
    up = tree.where("depth > 0").select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return up.where("at < depth").select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def subtree_sizes(links: DataFrame) -> DataFrame:
    """Number of descendants per node: node_id, n_descendants (0 for leaves, null on or below a cycle).

    Sums through the recorded contractions: a raked node's descendants have all been raked into it;
    a spliced node has its own and those of the child it left behind. No pair is formed.
    """
    scratch = Scratch(links.sparkSession, "subtrees")
    first = _start(links, False, scratch)
    rounds = _contract(first, False, scratch)
    tree = scratch.save(_expand(first, rounds, False, scratch))
    tops = tree.where("depth >= 0").groupBy("root_id").agg((F.count(F.lit(1)) - 1).alias("n")).select(F.col("root_id").alias("_id"), "n")
    sizes = [tops]
    if rounds:
        sizes.append(union_all([r.where(F.col("op") == RAKE).select(F.col("node").alias("_id"), F.col("acc").alias("n")) for r in rounds]))
    for step in reversed(rounds):
        lower = step.where(F.col("op") == SPLICE).select("node", "child", (F.col("acc") + F.col("child_carry") + 1).alias("_n"))
        found = lower.hint("merge").join(union_all(sizes).hint("merge"), F.col("child") == F.col("_id"), "left")
        sizes.append(scratch.save(found.select(F.col("node").alias("_id"), (F.col("_n") + F.col("n")).alias("n"))))
    joined = tree.hint("merge").join(union_all(sizes).hint("merge"), F.col("node_id") == F.col("_id"), "left")
    return joined.select("node_id", F.when(F.col("depth") >= 0, F.col("n")).alias("n_descendants"))
