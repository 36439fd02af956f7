"""Breadth-first closures over edge tables: layers, impact, paths, reachability, liveness.

Each step joins the frontier with the edges and removes what was seen; both are written tables,
so that plans stay small and a lost executor costs a re-read. Only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.skew import union_all
from codeweft.session import Scratch
from codeweft.sources.graph import STRUCTURAL_KINDS, file_of, is_file_node, is_test_path, metric_edges


def layers(links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Ids reached from seeds along links (src, dst, rank): id, depth, rank.

    Depth is the least number of steps; rank the highest confidence among the links that reach the
    id at that depth (null for seeds). Without ``max_depth`` the whole closure. Links whose end has
    been seen are of no more use: they are taken out whenever the ids reached since the last time
    make up a fair part of the links, so that a step reads what is still open and not all that was seen.
    """
    scratch = Scratch(links.sparkSession, "layers")
    seed = seeds.select("id").where("id is not null").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("rank"))
    parts = [scratch.save(seed)]
    recent, since = [parts[0]], parts[0].count()
    still, n = links.select("src", "dst", "rank"), None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if n is None or since * 8 >= n:
            still, old = scratch.save(_not_in(still, recent)), still
            scratch.drop(old)
            recent, since, n = [], 0, still.count()
        if not n:
            break
        frontier = parts[-1].select(F.col("id").alias("src"))
        reached = still.hint("merge").join(frontier.hint("merge"), "src").groupBy("dst").agg(F.max("rank").cast("int").alias("rank"))
        fresh = scratch.save(_not_in(reached, recent).select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), "rank"))
        found = fresh.count()
        if not found:
            break
        parts.append(fresh)
        recent.append(fresh)
        since += found
    return union_all(parts)


def _not_in(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return rows
    seen = union_all([p.select(F.col("id").alias("dst")) for p in parts])
    return rows.hint("merge").join(seen.hint("merge"), "dst", "left_anti")


def inbound(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), "rank")


def outbound(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "rank")


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """What depends on the seeds over all edges, by layer up to 8: id, depth, rank."""
    return layers(inbound(edges), seeds, max(1, min(8, max_depth))).where("depth > 0")


def impact_layers(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Size and lowest confidence of every impact layer: depth, nodes, confidence."""
    grouped = impact(edges, seeds, max_depth).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("rank").alias("r"))
    return grouped.select("depth", "nodes", F.element_at(F.array(*map(F.lit, ("ambiguous", "inferred", "extracted"))), F.col("r") + 1).alias("confidence"))


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Dependents over metric edges, by layer up to 3: id, depth, label."""
    label = F.element_at(F.array(*map(F.lit, ("direct", "indirect", "transitive"))), F.col("depth"))
    return layers(inbound(metric_edges(edges)), seeds, max(1, min(3, max_depth))).where("depth > 0").select("id", "depth", label.alias("label"))


def affected_tests(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Test files among the seeds and what depends on them: path."""
    closure = layers(inbound(edges), seeds, max(1, min(8, max_depth)))
    return closure.where(is_test_path("id")).select(file_of("id").alias("path")).distinct()


def path_lengths(edges: DataFrame, seeds: DataFrame, max_depth: int = 32) -> DataFrame:
    """Length of the shortest path from the seeds: forward on every edge, backward on structural ones."""
    back = edges.where(F.col("kind").isin(*STRUCTURAL_KINDS))
    return layers(outbound(edges).unionByName(inbound(back)), seeds, max_depth).select("id", "depth")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 32) -> DataFrame:
    """One shortest path, by least predecessor ids: step, id, kind of the edge taken; empty if there is none.

    The layers are found forwards; the path is then read backwards, one small join a step.
    """
    spark = edges.sparkSession
    back = edges.where(F.col("kind").isin(*STRUCTURAL_KINDS))
    both = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "rank", "kind").unionByName(back.select(F.col("target").alias("src"), F.col("source").alias("dst"), "rank", "kind"))
    seen = layers(both.select("src", "dst", "rank"), spark.createDataFrame([(source,)], "id string"), max_depth)
    end = seen.where(F.col("id") == target).select("depth").first()
    steps = []
    at = target
    for d in range(end["depth"], 0, -1) if end else ():
        before = seen.where(F.col("depth") == d - 1).select(F.col("id").alias("src"))
        taken = both.where(F.col("dst") == at).join(before, "src").orderBy("src", "kind").select("src", "kind").first()
        steps.append((d, at, taken["kind"]))
        at = taken["src"]
    if end:
        steps.append((0, source, None))
    return spark.createDataFrame(steps[::-1], "step int, id string, kind string")


def unwired_files(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Non-test files that no non-test file other than themselves imports and that are no roots: id."""
    importers = edges.where((F.col("kind") == "imports") & ~is_test_path("source")).select(file_of("source").alias("a"), file_of("target").alias("id")).where("a <> id")
    files = nodes.where(is_file_node() & ~is_test_path("id")).select("id")
    return files.join(importers, "id", "left_anti").join(roots.select("id"), "id", "left_anti")


def unreachable_files(nodes: DataFrame, edges: DataFrame, roots: DataFrame, gate: float | None = None) -> DataFrame:
    """Non-test files outside the forward closure of the roots over file-level links: id.

    With ``gate`` the list is withheld (empty) when it has five rows or more and makes up at least
    that share of the files: the roots are not to be relied on then.
    """
    links = edges.where(F.col("rank") >= 1).select(file_of("source").alias("src"), file_of("target").alias("dst"), "rank").where("src <> dst").distinct()
    reached = layers(links, roots)
    files = nodes.where(is_file_node() & ~is_test_path("id")).select("id")
    lost = files.join(reached.select("id"), "id", "left_anti")
    if gate is not None:
        n, total = lost.count(), files.count()
        if n >= 5 and n / max(1, total) >= gate:
            return lost.limit(0)
    return lost


def dead_symbols(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Symbols outside the liveness fixed point: id, tier, reason.

    Live: symbols of root files, exported ones, and what live symbols and files refer to over
    calls, imports, inheritance, decoration and overriding; members of a live container stay open.
    The rest is ``extracted`` when nothing refers to it, ``inferred`` when only dead code does.
    """
    uses = edges.where(F.col("kind").isin("calls", "imports", "inherits", "implements", "decorates"))
    over = edges.where(F.col("kind") == "overrides").select(F.col("target").alias("src"), F.col("source").alias("dst"), "rank")
    links = outbound(uses).unionByName(over)
    seeds = nodes.where(is_file_node() | F.coalesce("exported", F.lit(False))).select("id").unionByName(nodes.join(roots.select(F.col("id").alias("_r")), file_of("id") == F.col("_r"), "left_semi").select("id"))
    live = layers(links, seeds)
    dead = nodes.where(~is_file_node() & ~is_test_path("id") & F.col("kind").isin("function", "method", "class")).select("id").join(live.select("id"), "id", "left_anti")
    referred = uses.where("source <> target").select(F.col("target").alias("id")).distinct().withColumn("_used", F.lit(True))
    tier = F.when(F.col("_used"), "inferred").otherwise("extracted")
    reason = F.when(F.col("_used"), "only dead code refers to it").otherwise("nothing refers to it")
    return dead.join(referred, "id", "left").select("id", tier.alias("tier"), reason.alias("reason"))


def call_processes(edges: DataFrame, entries: DataFrame, max_depth: int = 6) -> DataFrame:
    """Call flows from entries: entry, depth (longest layer), steps (nodes reached, itself aside).

    All entries walk at once; the frontier is keyed by entry.
    """
    scratch = Scratch(edges.sparkSession, "processes")
    calls = scratch.save(edges.where((F.col("kind") == "calls") & (F.col("rank") >= 1)).select(F.col("source").alias("src"), F.col("target").alias("dst")))
    parts = [scratch.save(entries.select(F.col("id").alias("entry"), "id").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_depth + 1):
        seen = parts[0].select("entry", "id")
        for p in parts[1:]:
            seen = seen.unionByName(p.select("entry", "id"))
        step = parts[-1].join(calls, F.col("id") == F.col("src")).select("entry", F.col("dst").alias("id")).distinct()
        fresh = scratch.save(step.join(seen, ["entry", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not fresh.limit(1).count():
            break
        parts.append(fresh)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entry").agg(F.max("depth").alias("depth"), (F.count(F.lit(1)) - 1).alias("steps"))
