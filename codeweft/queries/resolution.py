"""Queries of name and path resolution, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import resolution as R
from codeweft.queries.core_problems import table
from codeweft.queries.graph import _FILE, _IMPORTS, _IN, _IS_FILE, _SQL, _TEST, _layers, graph
from codeweft.queries.sources import contents
from codeweft.queries.text import _LINES
from codeweft.sources import extract as E
from codeweft.sources import graph as G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CHANGED = "platform-core/runtime/%"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_SQL + f", i AS ({_IMPORTS}), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a) AS k FROM i) SELECT b AS path, string_agg(a, ',' ORDER BY a) FILTER (k <= 8) AS importers, count(*) AS total FROM r GROUP BY b")
def file_dependents(spark, d):
    return R.dependents(graph(spark, d)[1]).select("path", F.concat_ws(",", "importers").alias("importers"), "total")


@query(_SQL + _layers(_IN.format("m"), f"SELECT id FROM n WHERE path LIKE '{CHANGED}'", 3) + "SELECT id, depth FROM b WHERE depth > 0")
def changed_impact(spark, d):
    n, e = graph(spark, d)
    return R.changed_impact(n, e, n.where(F.col("path").like(CHANGED)))


@query(
    _SQL
    + f""", k AS (SELECT DISTINCT path FROM n WHERE {_IS_FILE} AND path <> ''), p AS (SELECT DISTINCT {_FILE.format('source')} AS path FROM ee UNION SELECT 'elsewhere/' || string_split(path, '/')[-1] FROM k),
    o AS (SELECT string_split(path, '/')[-1] AS b, min(path) AS other FROM k GROUP BY 1 HAVING count(*) = 1)
    SELECT p.path, CASE WHEN k.path IS NOT NULL THEN p.path ELSE coalesce(o.other, p.path) END AS repaired, CASE WHEN k.path IS NOT NULL THEN 'known' WHEN o.other IS NOT NULL THEN 'basename' ELSE 'unknown' END AS how
    FROM p LEFT JOIN k ON k.path = p.path LEFT JOIN o ON o.b = string_split(p.path, '/')[-1]"""
)
def path_repair(spark, d):
    n, e = graph(spark, d)
    known = n.where(G.is_file_node() & (F.col("path") != "")).select("path")
    moved = known.select(F.concat(F.lit("elsewhere/"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    return R.repair_paths(e.select(G.file_of("source").alias("path")).unionByName(moved), known)


@query()
def import_targets(spark, d):
    c = contents(spark, d)
    return R.resolve_imports(E.extract(c).where("what = 'import'").select("path", "name"), c.select("path"))


@query(
    "WITH RECURSIVE " + _SQL.split("WITH RECURSIVE", 1)[1] + ", " + _LINES.split("WITH", 1)[1]
    + """, s AS (SELECT id, path, name, line, end_line FROM n WHERE kind IN ('function', 'class', 'method') AND path <> '' AND name <> ''),
    t AS (SELECT DISTINCT path AS in_path, line AS at, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS name FROM l)
    SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT s.id FROM s JOIN t USING (name) WHERE t.in_path <> s.path OR t.at < s.line OR t.at > greatest(s.line, s.end_line))"""
)
def unmentioned_symbols(spark, d):
    n = graph(spark, d)[0].where(F.col("kind").isin("function", "class", "method") & (F.col("path") != "") & (F.col("name") != ""))
    return R.unmentioned_symbols(n.select("id", "path", "name", "line", "end_line"), contents(spark, d).select("path", "content"))


_STEM_OF = "regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.[A-Za-z.]+$', '', 'g'), '^test_|_test$|\\.test$|\\.spec$', '', 'g')"


@query(
    "WITH f AS (SELECT DISTINCT path FROM files WHERE generation_id = (SELECT max(id) FROM generations WHERE state = 'committed') AND path IS NOT NULL QUALIFY arg_max(content, ingested_at) OVER (PARTITION BY path) IS NOT NULL), "
    + f"x AS (SELECT path, {_STEM_OF} AS stem, {_TEST.format('path')} AS test FROM f) SELECT DISTINCT a.path, b.path AS test FROM x a JOIN x b ON a.stem = b.stem AND NOT a.test AND b.test"
)
def suggested_tests(spark, d):
    files = contents(spark, d).select("path")
    return R.suggested_tests(files, files)
