"""Queries over the property graph (tables nodes, edges, files) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import cypher as C
from codeweft.operators import metrics as M
from codeweft.operators import ranking as R
from codeweft.operators import snapshots as N
from codeweft.operators import symbols as S
from codeweft.operators import traversal as T
from codeweft.queries.core_problems import _ID, _WORD, table
from codeweft.queries.core_problems import ORACLES as _P
from codeweft.sources import graph as G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Start of the impact queries, name of the symbol views, and root files of the reachability queries.
SEED = "platform-core/runtime/log.py::emit"
NAME = "emit"
ROOTS = "%/index.%"

_LAST = "regexp_matches(lower(split_part({0}, '::', 1)), '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(lower(split_part({0}, '::', 1)), '(^|/)(test_[^/]*|[^/]*(_test|\\.test|\\.spec)\\.[a-z]+|conftest\\.py)$')"
_TEST = "(" + _LAST + ")"
_FILE = "split_part({0}, '::', 1)"
_SQL = f"""
WITH RECURSIVE
  n AS (
    SELECT {_ID.format('id')} AS id, kind, path, name, line, end_line, area, language, exported, community, ordinal FROM nodes
    WHERE deleted_at IS NULL AND {_ID.format('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_ID.format('id')} ORDER BY ordinal) = 1),
  e AS (
    SELECT {_ID.format('source')} AS source, {_ID.format('target')} AS target, {_WORD.format('kind')} AS kind,
      coalesce(max(CASE {_WORD.format('confidence')} WHEN 'extracted' THEN 2 WHEN 'inferred' THEN 1 WHEN 'ambiguous' THEN 0 END), 0) AS rank, min(ordinal) AS ordinal
    FROM edges GROUP BY 1, 2, 3 HAVING {_ID.format('source')} IS NOT NULL AND {_ID.format('target')} IS NOT NULL AND {_WORD.format('kind')} IS NOT NULL),
  m AS (SELECT * FROM e WHERE kind IN ('calls', 'imports') AND rank >= 1)
"""
_SQL = _SQL.replace("GROUP BY 1, 2, 3 HAVING " + f"{_ID.format('source')} IS NOT NULL AND {_ID.format('target')} IS NOT NULL AND {_WORD.format('kind')} IS NOT NULL", "GROUP BY 1, 2, 3")
_SQL = _SQL.replace("  m AS (SELECT * FROM e WHERE", "  ee AS (SELECT * FROM e WHERE source IS NOT NULL AND target IS NOT NULL AND kind IS NOT NULL),\n  m AS (SELECT * FROM ee WHERE")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.current_nodes(table(spark, d, "nodes")), G.current_edges(table(spark, d, "edges"))


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SEED,)], "id string")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(G.is_file_node() & F.col("id").like(ROOTS)).select("id")


@query(_SQL + "SELECT * FROM n")
def graph_nodes(spark, d):
    return graph(spark, d)[0]


@query(_SQL + "SELECT * FROM ee")
def graph_edges(spark, d):
    return graph(spark, d)[1]


@query(_SQL + "SELECT source, target, kind, CASE rank WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS score, CASE rank WHEN 2 THEN 'extracted' WHEN 1 THEN 'inferred' ELSE 'ambiguous' END AS provenance FROM ee")
def edge_records(spark, d):
    return S.edge_records(graph(spark, d)[1])


_DEGREE = _SQL + f""", x AS (SELECT source AS id, 1 AS o, 0 AS i FROM m UNION ALL SELECT target, 0, 1 FROM m),
  deg AS (SELECT id, count(*) AS degree, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM x GROUP BY id HAVING NOT {_TEST.format('id')}) """


@query(_DEGREE + "SELECT * FROM deg")
def fan_in_fan_out(spark, d):
    return M.degrees(graph(spark, d)[1])


@query(_DEGREE + "SELECT * FROM deg ORDER BY degree DESC, id LIMIT 15")
def god_nodes_top15(spark, d):
    return M.god_nodes(graph(spark, d)[1])


_IMPORTS = f"SELECT DISTINCT {_FILE.format('source')} AS a, {_FILE.format('target')} AS b FROM ee WHERE kind = 'imports' AND {_FILE.format('source')} <> {_FILE.format('target')}"


@query(_SQL + f"SELECT b AS path, count(*) AS importers FROM ({_IMPORTS}) GROUP BY b ORDER BY importers DESC, path LIMIT 8")
def file_in_degree_top8(spark, d):
    return M.file_in_degree(graph(spark, d)[1])


@query(
    _SQL
    + f""", chg AS ({_P['p5_found'].replace('WITH gens', 'WITH RECURSIVE gens')}), c AS (SELECT path, count(*) AS churn FROM chg GROUP BY path),
    f AS (SELECT {_FILE.format('target')} AS path, count(DISTINCT {_FILE.format('source')}) AS fan_in FROM m WHERE {_FILE.format('source')} <> {_FILE.format('target')} GROUP BY 1)
    SELECT c.path, c.churn, coalesce(f.fan_in, 0) AS fan_in, round(c.churn * (1 + ln(1 + coalesce(f.fan_in, 0))), 2) AS score
    FROM c LEFT JOIN f ON f.path = c.path ORDER BY score DESC, path LIMIT 20"""
)
def hotspots(spark, d):
    return M.hotspots(N.file_changes(table(spark, d, "files"), table(spark, d, "generations")), graph(spark, d)[1])


@query(
    _SQL
    + """, r AS (SELECT community, array_to_string(string_split(path, '/')[1:2], '/') AS prefix FROM n WHERE community <> ''),
    k AS (SELECT community, prefix, count(*) AS c FROM r GROUP BY ALL),
    b AS (SELECT community, first(prefix ORDER BY c DESC, prefix) AS label, sum(c)::BIGINT AS nodes FROM k GROUP BY community),
    w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY nodes DESC, community) AS k FROM b)
    SELECT community, CASE WHEN k = 1 THEN label ELSE label || '#' || k END AS label, nodes FROM w"""
)
def community_labels(spark, d):
    return M.community_labels(graph(spark, d)[0])


_AREAS = ", ar AS (SELECT id, area FROM n WHERE area <> ''), cr AS (SELECT s.area AS x, t.area AS y FROM ee JOIN ar s ON s.id = ee.source JOIN ar t ON t.id = ee.target WHERE s.area <> t.area) "


@query(
    _SQL + _AREAS
    + f""", z AS (SELECT area, count(DISTINCT {_FILE.format('id')}) AS files, count(*) FILTER (id LIKE '%::%') AS symbols FROM n WHERE area <> '' GROUP BY area),
    p AS (SELECT x AS area, y AS b FROM cr UNION SELECT y, x FROM cr), l AS (SELECT area, array_to_string(list_sort(list(b))[1:6], ',') AS near FROM p GROUP BY area)
    SELECT z.area, files, symbols, coalesce(near, '') AS near FROM z LEFT JOIN l ON l.area = z.area"""
)
def area_summary(spark, d):
    return M.area_summary(*graph(spark, d))


@query(_SQL + _AREAS + "SELECT least(x, y) AS area_a, greatest(x, y) AS area_b, count(*) AS edges FROM cr GROUP BY 1, 2")
def crossing_areas(spark, d):
    return M.crossing_areas(*graph(spark, d))


@query(_SQL + "SELECT kind, rank, count(*) AS edges FROM ee GROUP BY CUBE (kind, rank)")
def edge_kind_cube(spark, d):
    return M.kind_counts(graph(spark, d)[1])


@query(
    _SQL
    + f"""SELECT id, CASE WHEN lower(id) = '{NAME}' OR lower(coalesce(path, '')) = '{NAME}' OR lower(coalesce(name, '')) = '{NAME}' OR lower(id) LIKE '%::{NAME}' THEN 0 ELSE 1 END AS tier, ordinal
    FROM n WHERE lower(id) LIKE '%{NAME}%' OR lower(coalesce(name, '')) LIKE '%{NAME}%' OR lower(coalesce(path, '')) = '{NAME}'"""
)
def symbol_match_tiers(spark, d):
    return S.match_symbols(graph(spark, d)[0], NAME)


_ENDS = "array_to_string(list_sort(list(DISTINCT {0}))[1:50], ',')"


@query(
    _SQL
    + f""", f AS (SELECT id FROM n WHERE lower(name) = '{NAME}' ORDER BY ordinal, id LIMIT 20)
    SELECT f.id, coalesce((SELECT {_ENDS.format('source')} FROM ee WHERE target = f.id AND kind = 'calls'), '') AS callers,
      coalesce((SELECT {_ENDS.format('target')} FROM ee WHERE source = f.id AND kind = 'calls'), '') AS callees,
      coalesce((SELECT {_ENDS.format('source')} FROM ee WHERE target = f.id AND kind = 'imports'), '') AS importers,
      coalesce((SELECT {_ENDS.format('target')} FROM ee WHERE source = f.id AND kind = 'imports'), '') AS imports FROM f"""
)
def symbol_view(spark, d):
    v = S.symbol_view(*graph(spark, d), NAME)
    return v.select("id", *[F.concat_ws(",", c).alias(c) for c in ("callers", "callees", "importers", "imports")])


@query(_SQL + f"SELECT id FROM n WHERE id IN (SELECT target FROM ee WHERE kind NOT IN ('contains', 'documents') AND NOT {_TEST.format('source')} AND source <> target)")
def non_test_inbound(spark, d):
    return S.non_test_inbound(*graph(spark, d))


@query(
    _SQL
    + """SELECT source, target, kind, 'source' AS missing FROM ee WHERE source NOT IN (SELECT id FROM n)
    UNION ALL SELECT source, target, kind, 'target' FROM ee WHERE target NOT IN (SELECT id FROM n)"""
)
def dangling_edges(spark, d):
    return S.dangling_edges(*graph(spark, d))


def _projection(kept: str, links: str) -> str:
    return (
        _SQL
        + f""", l AS ({links}), x AS (SELECT source AS id, 0 AS i FROM l UNION ALL SELECT target, 1 FROM l), k AS (SELECT id, count(*) AS deg, sum(i) AS inn FROM x GROUP BY id)
    SELECT n.id, coalesce(nullif(n.name, ''), n.id) AS label, greatest(1, coalesce(k.deg, 0)) AS weight, coalesce(k.inn, 0) = 0 AS dead, {_TEST.format('n.id')} AS test
    FROM n LEFT JOIN k ON k.id = n.id WHERE {kept}"""
    )


_IS_FILE = "(n.kind = 'file' OR (n.id NOT LIKE '%::%' AND coalesce(n.name, '') = ''))"


@query(_projection(_IS_FILE, _IMPORTS.replace("AS a", "AS source").replace("AS b", "AS target")))
def file_level(spark, d):
    return S.level_projection(*graph(spark, d), "file")


@query(_projection("NOT " + _IS_FILE, "SELECT DISTINCT source, target FROM ee WHERE kind NOT IN ('contains', 'documents') AND source <> target"))
def symbol_level(spark, d):
    return S.level_projection(*graph(spark, d), "symbol")


_AB = "a.id AS a_id, a.name AS a_name, a.path AS a_path, a.kind AS a_kind"
_JOINED = f"SELECT {_AB}, ee.kind, b.id AS b_id, b.name AS b_name, b.path AS b_path, b.kind AS b_kind FROM ee JOIN n a ON a.id = ee.source JOIN n b ON b.id = ee.target"


@query(_SQL + _JOINED + " WHERE ee.kind = 'calls' ORDER BY ee.ordinal, a.id, b.id, ee.kind LIMIT 50")
def cypher_calls(spark, d):
    return C.run("MATCH (a)-[r:CALLS]->(b) RETURN a, b", *graph(spark, d))


@query(_SQL + _JOINED + " WHERE ee.kind IN ('imports', 'implements') AND lower(a.name) LIKE '%report%' ORDER BY ee.ordinal, a.id, b.id, ee.kind LIMIT 1000")
def cypher_contains(spark, d):
    return C.run("MATCH (a)-[r:IMPORTS|IMPLEMENTS]->(b) WHERE contains(a.name, 'Report') RETURN a, b LIMIT 1000", *graph(spark, d))


@query(_SQL + f"SELECT {_AB} FROM n a WHERE starts_with(a.path, 'platform-core/') ORDER BY a.ordinal, a.id LIMIT 100")
def cypher_nodes(spark, d):
    return C.run("MATCH (a) WHERE starts with(a.path, 'platform-core/') RETURN a LIMIT 100", *graph(spark, d))


def _layers(links: str, seed: str, deepest: int | None) -> str:
    bound = f" AND w.depth < {deepest}" if deepest else ""
    return f", lk AS ({links}), sd AS ({seed}), w AS (SELECT id, 0 AS depth FROM sd UNION SELECT lk.dst, w.depth + 1 FROM w JOIN lk ON lk.src = w.id WHERE true{bound}), b AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) "


_ONE = f"SELECT '{SEED}' AS id"
_IN = "SELECT DISTINCT target AS src, source AS dst FROM {0}"


@query(
    _SQL + _layers(_IN.format("ee"), _ONE, 3)
    + """, r AS (SELECT b.id, b.depth, max(ee.rank) AS rank FROM b JOIN ee ON ee.source = b.id JOIN b p ON p.id = ee.target AND p.depth = b.depth - 1 WHERE b.depth > 0 GROUP BY ALL)
    SELECT depth, count(*) AS nodes, CASE min(rank) WHEN 2 THEN 'extracted' WHEN 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM r GROUP BY depth"""
)
def impact_layers(spark, d):
    return T.impact_layers(graph(spark, d)[1], seeds(spark))


@query(_SQL + _layers(_IN.format("m"), _ONE, 3) + "SELECT id, depth, CASE depth WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'transitive' END AS label FROM b WHERE depth > 0")
def blast_radius(spark, d):
    return T.blast_radius(graph(spark, d)[1], seeds(spark))


@query(_SQL + _layers(_IN.format("ee"), _ONE, 3) + f"SELECT DISTINCT {_FILE.format('id')} AS path FROM b WHERE {_TEST.format('id')}")
def affected_tests(spark, d):
    return T.affected_tests(graph(spark, d)[1], seeds(spark))


@query(
    _SQL
    + _layers("SELECT source AS src, target AS dst FROM ee UNION SELECT target, source FROM ee WHERE kind IN ('contains', 'documents')", _ONE, 32)
    + "SELECT id, depth FROM b"
)
def path_lengths(spark, d):
    return T.path_lengths(graph(spark, d)[1], seeds(spark))


_ROOTS = f"SELECT id FROM n WHERE {_IS_FILE} AND id LIKE '{ROOTS}'"


@query(
    _SQL
    + f"SELECT id FROM n WHERE {_IS_FILE} AND NOT {_TEST.format('id')} AND id NOT IN (SELECT {_FILE.format('target')} FROM ee WHERE kind = 'imports' AND NOT {_TEST.format('source')} AND {_FILE.format('source')} <> {_FILE.format('target')}) AND id NOT IN ({_ROOTS})"
)
def unwired_files(spark, d):
    n, e = graph(spark, d)
    return T.unwired_files(n, e, roots(n))


@query(
    _SQL
    + f""", lk AS (SELECT DISTINCT {_FILE.format('source')} AS src, {_FILE.format('target')} AS dst FROM ee WHERE rank >= 1 AND {_FILE.format('source')} <> {_FILE.format('target')}),
    w AS ({_ROOTS} UNION SELECT lk.dst FROM w JOIN lk ON lk.src = w.id) SELECT id FROM n WHERE {_IS_FILE} AND NOT {_TEST.format('id')} AND id NOT IN (SELECT id FROM w)"""
)
def unreachable_files(spark, d):
    n, e = graph(spark, d)
    return T.unreachable_files(n, e, roots(n))


@query(
    _SQL
    + f""", us AS (SELECT * FROM ee WHERE kind IN ('calls', 'imports', 'inherits', 'implements', 'decorates')),
    lk AS (SELECT source AS src, target AS dst FROM us UNION SELECT target, source FROM ee WHERE kind = 'overrides'),
    w AS (SELECT id FROM n WHERE {_IS_FILE} OR coalesce(exported, false) OR {_FILE.format('id')} IN ({_ROOTS}) UNION SELECT lk.dst FROM w JOIN lk ON lk.src = w.id)
    SELECT n.id, CASE WHEN u.id IS NULL THEN 'extracted' ELSE 'inferred' END AS tier, CASE WHEN u.id IS NULL THEN 'nothing refers to it' ELSE 'only dead code refers to it' END AS reason
    FROM n LEFT JOIN (SELECT DISTINCT target AS id FROM us WHERE source <> target) u ON u.id = n.id
    WHERE NOT {_IS_FILE} AND NOT {_TEST.format('n.id')} AND n.kind IN ('function', 'method', 'class') AND n.id NOT IN (SELECT id FROM w)"""
)
def dead_symbols(spark, d):
    n, e = graph(spark, d)
    return T.dead_symbols(n, e, roots(n))


@query(
    _SQL
    + f""", cl AS (SELECT DISTINCT source AS src, target AS dst FROM ee WHERE kind = 'calls' AND rank >= 1), en AS (SELECT id FROM n WHERE NOT {_IS_FILE}),
    w AS (SELECT id AS entry, id, 0 AS depth FROM en UNION SELECT w.entry, cl.dst, w.depth + 1 FROM w JOIN cl ON cl.src = w.id WHERE w.depth < 6),
    b AS (SELECT entry, id, min(depth) AS depth FROM w GROUP BY ALL) SELECT entry, max(depth) AS depth, count(*) - 1 AS steps FROM b GROUP BY entry"""
)
def call_processes(spark, d):
    n, e = graph(spark, d)
    return T.call_processes(e, n.where(~G.is_file_node()))


def _pagerank(rounds: int) -> str:
    sql = _SQL + """, pr AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM m), od AS (SELECT src AS id, count(*) AS o FROM pr GROUP BY src),
    v AS MATERIALIZED (SELECT id, o FROM (SELECT src AS id FROM pr UNION SELECT dst FROM pr) x LEFT JOIN od USING (id)), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, o, 1 / c.n AS r FROM v, c)"""  # fmt: skip
    for k in range(1, rounds + 1):
        sql += f""", l{k} AS (SELECT coalesce(sum(r), 0) AS l FROM r{k - 1} WHERE o IS NULL), g{k} AS (SELECT pr.dst AS id, sum(r / o) AS g FROM pr JOIN r{k - 1} q ON q.id = pr.src GROUP BY pr.dst),
        r{k} AS MATERIALIZED (SELECT v.id, v.o, 0.15 / c.n + 0.85 * (coalesce(g.g, 0) + l.l / c.n) AS r FROM v LEFT JOIN g{k} g USING (id), l{k} l, c)"""
    return sql + f" SELECT id, round(r, 7) AS rank FROM r{rounds}"


@query(_pagerank(10))
def pagerank_10(spark, d):
    m = G.metric_edges(graph(spark, d)[1])
    return R.pagerank(m.select(F.col("source").alias("src"), F.col("target").alias("dst"))).select("id", F.round("rank", 7).alias("rank"))


def _file_links(e: DataFrame) -> DataFrame:
    pairs = e.where("kind in ('calls', 'imports')").select(G.file_of("source").alias("src"), G.file_of("target").alias("dst"))
    return pairs.where("src <> dst").distinct()


_LK = f", lk AS MATERIALIZED (SELECT DISTINCT {_FILE.format('source')} AS src, {_FILE.format('target')} AS dst FROM ee WHERE kind IN ('calls', 'imports') AND {_FILE.format('source')} <> {_FILE.format('target')})"
_REACH = ", rc AS MATERIALIZED (SELECT src, dst FROM lk UNION SELECT rc.src, lk.dst FROM rc JOIN lk ON lk.src = rc.dst)"


@query(_SQL + _LK + _REACH + ", ids AS (SELECT src AS id FROM lk UNION SELECT dst FROM lk), mu AS (SELECT a.src AS id, min(a.dst) AS c FROM rc a JOIN rc b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src) SELECT ids.id, least(ids.id, coalesce(mu.c, ids.id)) AS component FROM ids LEFT JOIN mu USING (id)")
def import_components(spark, d):
    return R.strong_components(_file_links(graph(spark, d)[1]))


@query(f"SELECT component, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members FROM ({ORACLES['import_components']}) GROUP BY component HAVING count(*) > 1 ORDER BY size, component LIMIT 50")
def import_cycles(spark, d):
    return R.import_cycles(_file_links(graph(spark, d)[1])).select("component", "size", F.concat_ws(",", "members").alias("members"))


@query(
    _SQL + _LK
    + """, bo AS (SELECT src, dst FROM lk UNION SELECT dst, src FROM lk), ids AS (SELECT DISTINCT src AS id FROM bo),
    w AS (SELECT id, id AS c FROM ids UNION SELECT bo.dst, least(w.c, bo.dst) FROM w JOIN bo ON bo.src = w.id WHERE w.c < bo.dst)
    SELECT id, min(c) AS component FROM w GROUP BY id"""
)
def connected_files(spark, d):
    return R.connected_components(_file_links(graph(spark, d)[1]))


@query()
def label_communities(spark, d):
    return R.propagate_labels(_file_links(graph(spark, d)[1]))


@query()
def louvain_communities(spark, d):
    return R.louvain(_file_links(graph(spark, d)[1]))


@query()
def community_modularity(spark, d):
    """How well both ways of finding communities divide the files."""
    links = _file_links(graph(spark, d)[1])
    a = R.modularity(links, R.louvain(links)).select(F.lit("louvain").alias("method"), "modularity")
    return a.unionByName(R.modularity(links, R.propagate_labels(links)).select(F.lit("labels").alias("method"), "modularity"))


_CONTAINS = ", lk AS (SELECT DISTINCT source AS src, target AS dst FROM ee WHERE kind = 'contains')"


@query(
    _SQL + _CONTAINS
    + """, ids AS (SELECT src AS id FROM lk UNION SELECT dst FROM lk), w AS (SELECT id, 0 AS level FROM ids WHERE id NOT IN (SELECT dst FROM lk) UNION SELECT lk.dst, w.level + 1 FROM w JOIN lk ON lk.src = w.id)
    SELECT ids.id, coalesce(max(w.level), -1) AS level FROM ids LEFT JOIN w USING (id) GROUP BY ids.id"""
)
def topological_levels(spark, d):
    e = graph(spark, d)[1].where("kind = 'contains'")
    return R.topological_levels(e.select(F.col("source").alias("src"), F.col("target").alias("dst")))
