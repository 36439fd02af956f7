"""The property graph as DataFrames: current nodes and edges in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.ids import plain_id, plain_word

#: Order of confidence, and the default score of each.
CONFIDENCE_RANK = {"ambiguous": 0, "inferred": 1, "extracted": 2}
CONFIDENCE_SCORE = {"ambiguous": 0.4, "inferred": 0.7, "extracted": 1.0}
#: Edge kinds that carry dependencies, and kinds that only give structure.
METRIC_KINDS = ("calls", "imports")
STRUCTURAL_KINDS = ("contains", "documents")


def mapped(c: Column | str, table: dict, default=None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]
    return out if default is None else F.coalesce(out, F.lit(default))


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are in the graph now, one row per id: the stay with the least ordinal that has not ended."""
    columns = ("kind", "path", "name", "line", "end_line", "area", "language", "exported", "community", "ordinal")
    rows = nodes.select(plain_id("id").alias("id"), *columns, "deleted_at").where("id is not null and deleted_at is null")
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns), F.coalesce("ordinal", F.lit((1 << 63) - 1))).alias("r"))
    return first.select("id", *[F.col("r")[c].alias(c) for c in columns])


def current_edges(edges: DataFrame) -> DataFrame:
    """Edges with two endpoints, one row per (source, target, kind): highest confidence, least ordinal."""
    rank = mapped(plain_word("confidence"), CONFIDENCE_RANK)
    rows = edges.select(plain_id("source").alias("source"), plain_id("target").alias("target"), plain_word("kind").alias("kind"), rank.alias("rank"), "ordinal")
    kept = rows.where("source is not null and target is not null and kind is not null")
    return kept.groupBy("source", "target", "kind").agg(F.coalesce(F.max("rank"), F.lit(0)).alias("rank"), F.min("ordinal").alias("ordinal"))


def metric_edges(edges: DataFrame) -> DataFrame:
    """Edges that count for metrics: calls and imports that are extracted or inferred."""
    return edges.where(F.col("kind").isin(*METRIC_KINDS) & (F.col("rank") >= 1))


def confidence_floor(edges: DataFrame, least: str) -> DataFrame:
    """Edges of at least a confidence."""
    return edges.where(F.col("rank") >= CONFIDENCE_RANK[least])


def file_of(c: Column | str) -> Column:
    """The path part of an id: the text before '::'."""
    return F.substring_index(F.col(c) if isinstance(c, str) else c, "::", 1)


def is_test_path(c: Column | str) -> Column:
    """Whether a path (or id) is test code: a tests directory or a test file name."""
    p = F.lower(file_of(c))
    return p.rlike(r"(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(^|/)(test_[^/]*|[^/]*(_test|\.test|\.spec)\.[a-z]+|conftest\.py)$")


def is_file_node() -> Column:
    """Kind file, or an id without '::' and without a name."""
    return (F.col("kind") == "file") | (~F.col("id").contains("::") & (F.coalesce("name", F.lit("")) == ""))
