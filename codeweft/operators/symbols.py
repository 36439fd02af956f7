"""Symbol lookup, symbol views and structural predicates over the current graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.sources.graph import CONFIDENCE_SCORE, STRUCTURAL_KINDS, file_of, is_file_node, is_test_path


def match_symbols(nodes: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Exact, then partial matches, case-insensitive: id, tier (0 exact, 1 partial), ordinal.

    Exact: the whole id, path or name, or the part after '::'. Partial: a substring of the id or
    name. Tiers come first, then graph order; ``limit`` keeps the first rows of that order.
    """
    q = F.lit(query.lower())
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("id", "path", "name")]
    exact = (low[0] == q) | (low[1] == q) | (low[2] == q) | low[0].endswith("::" + query.lower())
    tier = F.when(exact, 0).when(low[0].contains(query.lower()) | low[2].contains(query.lower()), 1)
    out = nodes.select("id", tier.alias("tier"), "ordinal").where("tier is not null")
    return out.orderBy("tier", "ordinal", "id").limit(limit) if limit else out


def symbol_view(nodes: DataFrame, edges: DataFrame, name: str, definitions: int = 20, width: int = 50) -> DataFrame:
    """The view around each definition of a name: callers, callees, importers, imports.

    At most ``definitions`` of them in graph order; each list is distinct, sorted and cut to ``width``.
    """
    found = nodes.where(F.lower("name") == name.lower()).orderBy("ordinal", "id").limit(definitions).select("id")
    out = found
    for column, kind, own, other in (("callers", "calls", "target", "source"), ("callees", "calls", "source", "target"), ("importers", "imports", "target", "source"), ("imports", "imports", "source", "target")):
        ends = edges.where(F.col("kind") == kind).select(F.col(own).alias("id"), F.col(other).alias("end")).join(F.broadcast(found), "id")
        listed = ends.distinct().groupBy("id").agg(F.slice(F.sort_array(F.collect_set("end")), 1, width).alias(column))
        out = out.join(listed, "id", "left")
    return out.select("id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("callers", "callees", "importers", "imports")])


def non_test_inbound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of nodes that a non-test source other than themselves refers to, structural kinds aside."""
    real = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS) & ~is_test_path("source") & (F.col("source") != F.col("target")))
    return nodes.join(real.select(F.col("target").alias("id")), "id", "left_semi").select("id")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an endpoint of which is not in the graph: source, target, kind, missing."""
    ids = nodes.select("id")
    s = edges.join(ids, edges["source"] == ids["id"], "left_anti").select("source", "target", "kind", F.lit("source").alias("missing"))
    t = edges.join(ids, edges["target"] == ids["id"], "left_anti").select("source", "target", "kind", F.lit("target").alias("missing"))
    return s.unionByName(t)


def edge_records(edges: DataFrame) -> DataFrame:
    """Edges as transfer rows: source, target, kind, score (0..1), provenance."""
    names = {0: "ambiguous", 1: "inferred", 2: "extracted"}
    provenance = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("rank")]
    score = F.create_map(*[F.lit(x) for k, v in CONFIDENCE_SCORE.items() for x in (k, v)])[provenance]
    return edges.select("source", "target", "kind", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"), provenance.alias("provenance"))


def level_projection(nodes: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """The graph at file or symbol level: id, label, weight, dead, test.

    Weight is the degree over the level's edges, at least 1; a node is dead when nothing refers to it.
    """
    if level == "file":
        kept = nodes.where(is_file_node())
        links = edges.where("kind = 'imports'").select(file_of("source").alias("source"), file_of("target").alias("target")).where("source <> target").distinct()
    else:
        kept = nodes.where(~is_file_node())
        links = edges.where(~F.col("kind").isin(*STRUCTURAL_KINDS)).select("source", "target").where("source <> target").distinct()
    degree = links.select(F.col("source").alias("id"), F.lit(0).alias("inward")).unionByName(links.select(F.col("target").alias("id"), F.lit(1).alias("inward")))
    counts = degree.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("inward").alias("inward"))
    d, i = F.coalesce("degree", F.lit(0)), F.coalesce("inward", F.lit(0))
    return kept.join(counts, "id", "left").select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("label"), F.greatest(F.lit(1), d).cast("long").alias("weight"), (i == 0).alias("dead"), is_test_path("id").alias("test"))
