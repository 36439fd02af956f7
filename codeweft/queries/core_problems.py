"""Queries of the general data problems (p1, p3, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import hierarchy as H
from codeweft.operators import orphans as O
from codeweft.operators import selection as S
from codeweft.operators import snapshots as N
from codeweft.operators.skew import union_all


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(*[table(spark, d, t) for t in ("edges", "nodes", "aliases")]).select("ordinal", "side")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(*[table(spark, d, t) for t in ("edges", "nodes", "aliases")])


#: Child table, its key, parent table, its key.
REFERENCES = (
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"),
)


def p1_table_references(spark: SparkSession, d: str) -> DataFrame:
    """Integer references between tables that have no parent row, orders without lines among them."""
    t = lambda n: table(spark, d, n)
    parts = [O.orphan_keys(t(a), x, t(b), y).select(F.lit(f"{a}.{x}").alias("reference"), F.lit(f"{b}.{y}").alias("parent"), "key", "references") for a, x, b, y in REFERENCES]
    return union_all(parts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(H.contains_links(table(spark, d, "edges")))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(H.contains_links(table(spark, d, "edges")), with_paths=True)
    return tree.select("node_id", "root_id", "depth", F.concat_ws(" > ", "path").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(H.contains_links(table(spark, d, "edges")), with_paths=True))


def p3_subtrees(spark: SparkSession, d: str) -> DataFrame:
    return H.subtree_sizes(H.contains_links(table(spark, d, "edges")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return N.file_changes(table(spark, d, "files"), table(spark, d, "generations"))


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    return N.file_intervals(table(spark, d, "files"), table(spark, d, "generations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return S.heavy_edge_keys(table(spark, d, "edges")).select("target", "kind")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.key_counts(table(spark, d, "edges"))


def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = S.key_profile(table(spark, d, "edges"))
    return q.select("target", "kind", "n", "share", "p", F.unix_micros("seen_at").alias("seen_at_us"))


def p6_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return S.key_quantiles(table(spark, d, "edges")).select("target", "kind", "n", "p", F.unix_micros("seen_at").alias("seen_at_us"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_table_references, p3_found, p3_hierarchy, p3_descendants, p3_subtrees, p5_found, p5_intervals, p6_found, p6_counts, p6_quantiles, p6_key_quantiles)}

_ID = "nullif(regexp_replace(trim(translate({0}, '\\', '/'), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)), '^(\\./+)+', ''), '')"
_WORD = "nullif(lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160))), '')"

_P1 = f"""
WITH RECURSIVE
  step AS (SELECT DISTINCT {_ID.format('old_id')} a, {_ID.format('new_id')} b FROM aliases),
  reach(a, b) AS (SELECT a, b FROM step WHERE a <> b UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
  stays AS (SELECT {_ID.format('id')} id, added_at, deleted_at FROM nodes),
  live AS (SELECT * FROM stays UNION SELECT r.a, s.added_at, s.deleted_at FROM reach r JOIN stays s ON r.b = s.id),
  refs AS (
    SELECT ordinal, 'source' side, {_ID.format('source')} id, seen_at FROM edges
    UNION SELECT ordinal, 'target', {_ID.format('target')}, seen_at FROM edges),
  found AS (
    SELECT DISTINCT ordinal, side, seen_at FROM refs r WHERE id IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM live l WHERE l.id = r.id AND l.added_at <= r.seen_at AND (l.deleted_at IS NULL OR l.deleted_at > r.seen_at)))
"""

_LINKS = f"""
WITH RECURSIVE
  links AS (SELECT DISTINCT {_ID.format('source')} parent, {_ID.format('target')} node FROM edges WHERE {_WORD.format('kind')} = 'contains'),
  good AS (SELECT * FROM links WHERE parent IS NOT NULL AND node IS NOT NULL),
  ids AS (SELECT parent id FROM good UNION SELECT node FROM good),
  tops AS (SELECT id FROM ids WHERE id NOT IN (SELECT node FROM good)),
  down AS (
    SELECT id node_id, id root_id, 0::BIGINT depth, id::VARCHAR path FROM tops
    UNION ALL SELECT g.node, d.root_id, d.depth + 1, d.path || ' > ' || g.node FROM down d JOIN good g ON g.parent = d.node_id)
"""

_FILES = """
WITH gens AS (SELECT id, row_number() OVER (ORDER BY id) k FROM generations WHERE state = 'committed'),
  last AS (
    SELECT g.k, f.path, coalesce(nullif(regexp_replace(lower(trim(f.content_hash)), '^sha256:', ''), ''), sha256(f.content)) h
    FROM files f JOIN gens g ON g.id = f.generation_id WHERE f.path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY g.k, f.path ORDER BY f.ingested_at DESC) = 1)
"""

_KEYS = f"""
WITH rec AS (SELECT ordinal, max({_ID.format('target')}) target, max({_WORD.format('kind')}) kind, max(seen_at) seen_at FROM edges GROUP BY ordinal),
  n AS (SELECT target, kind, count(*) n FROM rec WHERE target IS NOT NULL GROUP BY target, kind),
  heavy AS (SELECT * FROM n WHERE n >= 0.01 * (SELECT count(*) FROM rec))
"""

def _orphan_sql(a: str, x: str, b: str, y: str) -> str:
    return f"SELECT '{a}.{x}' AS reference, '{b}.{y}' AS parent, {x}::BIGINT AS key, count(*) AS \"references\" FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL) GROUP BY {x}"


ORACLES = {
    "p1_table_references": " UNION ALL ".join(
        _orphan_sql(*p)
        for p in REFERENCES
    ),
    "p1_found": _P1 + "SELECT ordinal, side FROM found",
    "p1_report": _P1
    + """, t AS (SELECT side, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(DISTINCT ordinal) AS refs FROM refs WHERE id IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT side, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(DISTINCT ordinal) n FROM found GROUP BY 1, 2)
    SELECT t.side, t.month, t.refs AS "references", coalesce(f.n, 0) AS orphans, round(coalesce(f.n, 0) / t.refs, 6) AS rate
    FROM t LEFT JOIN f ON f.side = t.side AND f.month IS NOT DISTINCT FROM t.month""",
    "p3_found": _LINKS + "SELECT i.id AS node_id, coalesce(d.root_id, '') AS root_id, coalesce(d.depth, -1) AS depth FROM ids i LEFT JOIN down d ON d.node_id = i.id",
    "p3_hierarchy": _LINKS + "SELECT i.id AS node_id, coalesce(d.root_id, '') AS root_id, coalesce(d.depth, -1) AS depth, coalesce(d.path, '') AS path FROM ids i LEFT JOIN down d ON d.node_id = i.id",
    "p3_descendants": _LINKS + """, up AS (
    SELECT node_id ancestor_id, node_id, 0::BIGINT distance FROM down
    UNION ALL SELECT u.ancestor_id, g.node, u.distance + 1 FROM up u JOIN good g ON g.parent = u.node_id)
    SELECT * FROM up WHERE distance > 0""",
    "p3_subtrees": _LINKS + """, up AS (
    SELECT node_id ancestor_id, node_id FROM down UNION ALL SELECT u.ancestor_id, g.node FROM up u JOIN good g ON g.parent = u.node_id)
    SELECT i.id AS node_id, n.n AS n_descendants FROM ids i LEFT JOIN (SELECT ancestor_id, count(*) - 1 AS n FROM up GROUP BY 1) n ON n.ancestor_id = i.id""",
    "p5_found": _FILES + """, o AS (SELECT max(k) m FROM gens),
    pair AS (SELECT coalesce(b.k, a.k + 1) k, coalesce(a.path, b.path) path, a.h ah, b.h bh, a.path ap, b.path bp FROM last a FULL JOIN last b ON a.path = b.path AND b.k = a.k + 1)
    SELECT g.id AS generation_id, path, CASE WHEN ap IS NULL THEN 'added' WHEN bp IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM pair JOIN gens g ON g.k = pair.k, o WHERE pair.k > 1 AND pair.k <= o.m AND (ap IS NULL OR bp IS NULL OR ah IS DISTINCT FROM bh)""",
    "p5_intervals": _FILES + """, marked AS (
      SELECT *, k - row_number() OVER (PARTITION BY path, h ORDER BY k) island FROM last)
    SELECT m.path, m.h AS row_hash, a.id AS first_generation, b.id AS last_generation
    FROM (SELECT path, h, island, min(k) k1, max(k) k2 FROM marked GROUP BY ALL) m JOIN gens a ON a.k = m.k1 JOIN gens b ON b.k = m.k2""",
    "p6_found": _KEYS + "SELECT target, kind FROM heavy",
    "p6_counts": _KEYS + "SELECT * FROM n",
    "p6_key_quantiles": _KEYS + """, ranked AS (
      SELECT target, kind, seen_at, count(*) OVER w n, count(seen_at) OVER w m, row_number() OVER (PARTITION BY target, kind ORDER BY seen_at NULLS LAST) rk
      FROM rec WHERE target IS NOT NULL WINDOW w AS (PARTITION BY target, kind)),
      ps AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) p)
    SELECT target, kind, n, p, CASE WHEN m > 0 THEN epoch_us(seen_at) END AS seen_at_us FROM ranked, ps WHERE rk = greatest(1, ceil(p * m))""",
    "p6_quantiles": _KEYS + """, ranked AS (
      SELECT r.target, r.kind, r.seen_at, h.n, row_number() OVER (PARTITION BY r.target, r.kind ORDER BY r.seen_at) rk
      FROM rec r JOIN heavy h ON h.target = r.target AND h.kind IS NOT DISTINCT FROM r.kind),
      ps AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) p)
    SELECT target, kind, n, round(n / (SELECT count(*) FROM rec), 6) AS share, p, epoch_us(seen_at) AS seen_at_us FROM ranked, ps WHERE rk = greatest(1, ceil(p * n))""",
}
