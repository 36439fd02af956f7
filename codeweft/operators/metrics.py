"""Degrees, hotspots, labels and other aggregates of the current graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.sources.graph import file_of, is_test_path, metric_edges


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out and degree over metric edges: id, degree, fan_in, fan_out; test nodes left out after counting."""
    m = metric_edges(edges)
    ends = m.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.count(F.lit(1)).alias("degree"), F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return counted.where(~is_test_path("id"))


def god_nodes(edges: DataFrame, n: int = 15) -> DataFrame:
    """The nodes of highest degree, ties by id."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def file_in_degree(edges: DataFrame, n: int = 8) -> DataFrame:
    """The files most imported by other files: path, importers."""
    links = edges.where("kind = 'imports'").select(file_of("source").alias("a"), file_of("target").alias("path")).where("a <> path").distinct()
    return links.groupBy("path").agg(F.count(F.lit(1)).alias("importers")).orderBy(F.desc("importers"), "path").limit(n)


def hotspots(changes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """Churn times coupling per file: path, churn, fan_in, score = churn * (1 + ln(1 + fan_in)), two decimals."""
    churn = changes.groupBy("path").agg(F.count(F.lit(1)).alias("churn"))
    fan_in = metric_edges(edges).select(file_of("source").alias("a"), file_of("target").alias("path")).where("a <> path").groupBy("path").agg(F.countDistinct("a").alias("fan_in"))
    f = F.coalesce("fan_in", F.lit(0))
    scored = churn.join(fan_in, "path", "left").select("path", "churn", f.alias("fan_in"), F.round(F.col("churn") * (1 + F.log1p(f)), 2).alias("score"))
    return scored.orderBy(F.desc("score"), "path").limit(n)


def community_labels(nodes: DataFrame) -> DataFrame:
    """Communities by their most common two-segment path prefix: community, label, nodes.

    A label used before (by communities in order of size, then name) gets #2, #3 and so on.
    """
    prefix = F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2))
    rows = nodes.where("community <> ''").select("community", prefix.alias("prefix"))
    counted = rows.groupBy("community", "prefix").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("community").agg(F.min_by("prefix", F.struct(-F.col("n"), "prefix")).alias("label"), F.sum("n").alias("nodes"))
    w = Window.partitionBy("label").orderBy(F.desc("nodes"), "community")
    k = F.row_number().over(w)
    return best.select("community", F.when(k == 1, F.col("label")).otherwise(F.concat_ws("#", "label", k.cast("string"))).alias("label"), "nodes")


def area_summary(nodes: DataFrame, edges: DataFrame, neighbours: int = 6) -> DataFrame:
    """Per area: files, symbols, and the names of neighbouring areas (sorted, at most so many)."""
    sized = nodes.where("area <> ''").groupBy("area").agg(F.countDistinct(file_of("id")).alias("files"), F.sum((F.col("id").contains("::")).cast("long")).alias("symbols"))
    where = nodes.where("area <> ''").select("id", "area")
    a = edges.join(where.select(F.col("id").alias("source"), F.col("area").alias("a")), "source")
    b = a.join(where.select(F.col("id").alias("target"), F.col("area").alias("b")), "target")
    pairs = b.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b").distinct()
    listed = pairs.groupBy(F.col("a").alias("area")).agg(F.slice(F.sort_array(F.collect_set("b")), 1, neighbours).alias("near"))
    return sized.join(listed, "area", "left").select("area", "files", "symbols", F.coalesce(F.concat_ws(",", "near"), F.lit("")).alias("near"))


def crossing_areas(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """Unordered pairs of areas with edges between them: area_a < area_b, edges."""
    where = nodes.where("area <> ''").select("id", "area")
    a = edges.join(where.select(F.col("id").alias("source"), F.col("area").alias("x")), "source")
    b = a.join(where.select(F.col("id").alias("target"), F.col("area").alias("y")), "target").where("x <> y")
    return b.groupBy(F.least("x", "y").alias("area_a"), F.greatest("x", "y").alias("area_b")).agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") >= least)


def kind_counts(edges: DataFrame) -> DataFrame:
    """Edges by kind and confidence with subtotals (grouping sets): kind, rank, edges."""
    return edges.cube("kind", "rank").agg(F.count(F.lit(1)).alias("edges"))
