"""Iterative graph algorithms: PageRank, strong components, label propagation, topological levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import HOT_SHARE, hot_keys, join_on_skewed
from codeweft.session import Scratch


def pagerank(links: DataFrame, iterations: int = 10, alpha: float = 0.85, tolerance: float = 0.0) -> DataFrame:
    """PageRank over distinct (src, dst): id, rank. Rank of nodes without links goes to all alike.

    Stops early when the ranks move by less than ``tolerance`` times the number of nodes.
    """
    scratch = Scratch(links.sparkSession, "pagerank")
    named = scratch.save(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    numbers, pairs = _numbered(named, scratch)
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    pairs = scratch.save(pairs.hint("merge").join(out.hint("merge"), "src"))
    ids = scratch.save(numbers.select(F.col("num").alias("id")).hint("merge").join(out.select(F.col("src").alias("id"), "out").hint("merge"), "id", "left"))
    n = ids.count()
    if not n:
        return numbers.select("id", F.lit(0.0).alias("rank"))
    # sources of many links are known from the start; their links never move
    hot = [r["id"] for r in ids.where(F.col("out") >= F.lit(max(1.0, pairs.count() * HOT_SHARE))).select("id").collect()]
    rank = scratch.save(ids.select("id", "out", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        lost = rank.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        shared = join_on_skewed(pairs, rank.select(F.col("id").alias("src"), "rank"), "src", hot=hot)
        given = shared.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ids.hint("merge").join(given.hint("merge"), "id", "left").crossJoin(F.broadcast(lost)).select("id", "out", ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        before, rank = rank, scratch.save(new)
        if tolerance:
            moved = rank.hint("merge").join(before.select("id", F.col("rank").alias("was")).hint("merge"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if moved < tolerance * n:
                break
        scratch.drop(before)
    return numbers.hint("merge").join(rank.select(F.col("id").alias("num"), "rank").hint("merge"), "num").select("id", "rank")


def _numbered(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Numbers of the ids in ``links`` (id, num), and the links in numbers (src, dst); rounds then move numbers, not texts."""
    ids = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    numbers = scratch.save(ids.withColumn("num", F.monotonically_increasing_id()))
    hot = [hot_keys(links, c) for c in ("src", "dst")]
    a = join_on_skewed(links, numbers.select(F.col("id").alias("src"), F.col("num").alias("a")), "src", hot=hot[0])
    b = join_on_skewed(a.drop("src"), numbers.select(F.col("id").alias("dst"), F.col("num").alias("b")), "dst", hot=hot[1])
    return numbers, scratch.save(b.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def louvain(links: DataFrame, levels: int = 4, rounds: int = 6) -> DataFrame:
    """Communities of the undirected graph by modularity: id, community (least id of its members).

    Local moving, then the communities become nodes and moving goes on, up to ``levels`` times. In a
    round one half of the nodes, drawn by hash, may move, each to the neighbouring community of the
    greatest gain (ties to the least); the other half stands still, so that neighbours do not change
    places for ever. Self-links and directions do not count; links given twice weigh once.
    """
    scratch = Scratch(links.sparkSession, "louvain")
    named = scratch.save(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct())
    numbers, pairs = _numbered(named, scratch)
    edges = scratch.save(pairs.select("src", "dst", F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w"))))
    member = numbers.select(F.col("num"), F.col("num").alias("c"))
    for _ in range(levels):
        moved = _move(edges, rounds, scratch)
        if moved is None:
            break
        member = scratch.save(member.hint("merge").join(moved.select(F.col("id").alias("c"), F.col("c").alias("to")).hint("merge"), "c", "left").select("num", F.coalesce("to", "c").alias("c")))
        a = edges.hint("merge").join(moved.select(F.col("id").alias("src"), F.col("c").alias("cs")).hint("merge"), "src")
        b = a.hint("merge").join(moved.select(F.col("id").alias("dst"), F.col("c").alias("cd")).hint("merge"), "dst")
        edges = scratch.save(b.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
    whole = numbers.hint("merge").join(member.hint("merge"), "num")
    names = whole.groupBy("c").agg(F.min("id").alias("community"))
    return join_on_skewed(whole.select("id", "c"), names, "c").select("id", "community")


def _move(edges: DataFrame, rounds: int, scratch: Scratch) -> DataFrame | None:
    """One level of local moving over (src, dst, w), both directions: id, c; None when nothing moves."""
    degree = scratch.save(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0]
    if not total:
        return None
    at = scratch.save(degree.select("id", "k", F.col("id").alias("c")))
    least, any_moved = at.count() * 0.001, False
    for turn in range(rounds):
        tot = at.groupBy("c").agg(F.sum("k").alias("tot"))
        near = edges.where("src <> dst").hint("merge").join(at.select(F.col("id").alias("dst"), "c").hint("merge"), "dst")
        into = near.groupBy(F.col("src").alias("id"), F.col("c").alias("to")).agg(F.sum("w").alias("win"))
        may = at.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        # a node's own community is a candidate even without a link into it
        options = into.unionByName(may.select("id", F.col("c").alias("to"), F.lit(0.0).alias("win"))).groupBy("id", "to").agg(F.sum("win").alias("win"))
        rated = options.hint("merge").join(may.hint("merge"), "id").hint("merge").join(tot.select(F.col("c").alias("to"), "tot").hint("merge"), "to")
        own = F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("win") - F.col("k") * (F.col("tot") - own) / F.lit(total), 9)
        best = rated.groupBy("id").agg(F.min_by("to", F.struct(-gain, (F.col("to") != F.col("c")).alias("other"), "to")).alias("to"))
        new = scratch.save(at.hint("merge").join(best.hint("merge"), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), (F.coalesce("to", "c") != F.col("c")).alias("moved")))
        n = new.where("moved").count()
        scratch.drop(at)
        at, any_moved = new.drop("moved"), any_moved or n > 0
        if turn and n <= least:
            break
    return at.select("id", "c") if any_moved else None


def modularity(links: DataFrame, communities: DataFrame) -> DataFrame:
    """Modularity of a partition (id, community) of the undirected graph: one row, modularity."""
    pairs = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    j = pairs.hint("merge").join(communities.select(F.col("id").alias("src"), F.col("community").alias("a")).hint("merge"), "src").hint("merge").join(communities.select(F.col("id").alias("dst"), F.col("community").alias("b")).hint("merge"), "dst")
    ends = j.select("a", "b", F.explode(F.array("a", "b")).alias("c"))
    per = ends.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.count_if((F.col("a") == F.col("b"))).alias("twice"))
    m2 = F.sum("k")
    return per.agg(F.round(F.sum("twice") / m2 - F.sum(F.col("k") * F.col("k")) / (m2 * m2), 6).alias("modularity"))


def strong_components(links: DataFrame) -> DataFrame:
    """Strongly connected components of (src, dst): id, component (least id); every endpoint has one.

    Forward-backward colouring: nodes without in- or out-links are trimmed, then the least id that
    reaches a node is its colour, and what reaches the colour's root within the colour is a component.
    """
    scratch = Scratch(links.sparkSession, "components")
    rest = scratch.save(links.select("src", "dst").where("src <> dst").distinct())
    every = scratch.save(links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).where("id is not null").distinct())
    found = []
    while True:
        n = rest.count()
        while n:  # trim
            inner = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed = scratch.save(inner.select("src", "dst"))
            m = trimmed.count()
            scratch.drop(rest)
            rest = trimmed
            if m == n:
                break
            n = m
        if not n:
            break
        colour = scratch.save(rest.select(F.col("src").alias("id")).union(rest.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id")))
        while True:  # least id that reaches each node
            come = rest.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = scratch.save(colour.join(come, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            scratch.drop(colour)
            colour = new
            if not moved:
                break
        coloured = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
        within = scratch.save(coloured.where("cs = cd").select("src", "dst"))
        frontier = scratch.save(colour.where("id = c").select("id", "c"))
        parts = [frontier]
        while True:  # backwards from each root within its colour
            seen = parts[0].select("id")
            for p in parts[1:]:
                seen = seen.unionByName(p.select("id"))
            back = within.join(parts[-1].select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            fresh = scratch.save(back.join(seen, "id", "left_anti"))
            if not fresh.limit(1).count():
                break
            parts.append(fresh)
        done = parts[0]
        for p in parts[1:]:
            done = done.unionByName(p)
        done = scratch.save(done)
        found.append(done)
        gone = done.select("id")
        rest = scratch.save(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    if not found:
        return every.select("id", F.col("id").alias("component"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return every.join(out.select("id", F.col("c").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def import_cycles(links: DataFrame, limit: int = 50) -> DataFrame:
    """Components of two or more: component, size, members (sorted); by size, then name, the first ``limit``."""
    c = strong_components(links)
    grouped = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("id")).alias("members")).where("size > 1")
    return grouped.orderBy("size", "component").limit(limit)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the undirected graph: id, component (least id). Least labels spread and jump."""
    scratch = Scratch(links.sparkSession, "connected")
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()
    both = scratch.save(both)
    label = scratch.save(both.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        step = label.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        jump = label.select(F.col("id").alias("m"), F.col("c").alias("cc"))
        new = scratch.save(step.join(jump, "m", "left").select("id", F.least("m", F.coalesce("cc", "m")).alias("c"), (F.least("m", F.coalesce("cc", "m")) < F.col("c")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        scratch.drop(label)
        label = new
        if not moved:
            return label.select("id", F.col("c").alias("component"))


def propagate_labels(links: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities by label propagation: id, community. Each round a node takes its neighbours' most common label, ties least."""
    scratch = Scratch(links.sparkSession, "labels")
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = scratch.save(both)
    label = scratch.save(both.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("id").alias("src"), "c"), "src").groupBy("dst", "c").agg(F.count(F.lit(1)).alias("n"))
        before, label = label, scratch.save(votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("c", F.struct(-F.col("n"), "c")).alias("c")))
        scratch.drop(before)
    return label.select("id", F.col("c").alias("community"))


def topological_levels(links: DataFrame) -> DataFrame:
    """Levels of (src before dst): id, level = longest way from a source; -1 on or behind a cycle.

    Kahn's algorithm, a whole level a round.
    """
    scratch = Scratch(links.sparkSession, "levels")
    rest = scratch.save(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    left = scratch.save(rest.select(F.col("src").alias("id")).union(rest.select(F.col("dst").alias("id"))).distinct())
    parts, level = [], 0
    while True:
        free = scratch.save(left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if not free.limit(1).count():
            parts.append(left.withColumn("level", F.lit(-1)))
            break
        parts.append(free)
        gone = free.select("id")
        a = scratch.save(left.join(gone, "id", "left_anti"))
        b = scratch.save(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"))
        scratch.drop(left, rest)
        left, rest, level = a, b, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
