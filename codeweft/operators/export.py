"""Exports of the graph as rows of text, and bounded JSON with tiers of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import escape_xml, slug


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements, one a row, to be written between a fixed head and foot: part (node, edge), id, xml."""
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), escape_xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>"))
    n = nodes.select(F.lit("node").alias("part"), "id", F.concat(F.lit('<node id="'), escape_xml("id"), F.lit('">'), data("kind", "kind"), data("name", "name"), F.lit("</node>")).alias("xml"))
    e = edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "source", "target", "kind").alias("id"), F.concat(F.lit('<edge source="'), escape_xml("source"), F.lit('" target="'), escape_xml("target"), F.lit('">'), data("kind", "kind"), F.lit("</edge>")).alias("xml"))
    return n.unionByName(e)


#: Columns of each tier, from full detail to the least.
TIERS = {"full": ["id", "kind", "path", "name", "line", "end_line", "area", "language", "exported", "community"], "slim": ["id", "kind", "path", "name", "line"], "compact": ["id", "kind"], "stub": ["id"]}


def json_tiers(nodes: DataFrame) -> DataFrame:
    """Bytes of the nodes as JSON in every tier, in one pass: tier, bytes, rows."""
    sizes = F.array(*[F.struct(F.lit(t).alias("tier"), F.octet_length(F.to_json(F.struct(*c))).cast("long").alias("b")) for t, c in TIERS.items()])
    return nodes.select(F.explode(sizes).alias("s")).groupBy("s.tier").agg(F.sum("s.b").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def bounded_json(nodes: DataFrame, cap: int) -> tuple[str, DataFrame]:
    """The most detailed tier whose JSON fits ``cap`` bytes (else the least), and its rows: id, json."""
    sizes = {r["tier"]: r["bytes"] for r in json_tiers(nodes).collect()}
    tier = next((t for t in TIERS if sizes.get(t, 0) <= cap), "stub")
    return tier, nodes.select("id", F.to_json(F.struct(*TIERS[tier])).alias("json"))


def markdown_pages(nodes: DataFrame) -> DataFrame:
    """One Markdown page per area listing its files: area, slug, page."""
    files = nodes.where("kind = 'file' and area <> ''").select("area", "path").distinct()
    listed = files.groupBy("area").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    lines = F.concat_ws("\n", F.transform("paths", lambda p: F.concat(F.lit("- "), p)))
    return listed.select("area", slug("area").alias("slug"), F.concat(F.lit("# "), F.col("area"), F.lit("\n\n"), lines).alias("page"))


def semantic_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols (path, what, name, owner, exported) added, removed or changed in export: path, name, owner, change."""
    key = ["path", "name", "owner"]
    a = before.groupBy(*key).agg(F.max(F.struct("what", "exported")).alias("a"))
    b = after.groupBy(*key).agg(F.max(F.struct("what", "exported")).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change")).where("change is not null")
