"""Queries of typed edges, liveness inputs and change closures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import linking as K
from codeweft.operators import routes as RT
from codeweft.operators import snapshots as N
from codeweft.operators import store as ST
from codeweft.operators import traversal as T
from codeweft.queries import graph as Q
from codeweft.queries import resolution as RQ
from codeweft.queries.core_problems import _FILES, _ID, table
from codeweft.queries.graph import _FILE, _IS_FILE, _SQL, _TEST, graph, roots
from codeweft.queries.resolution import CHANGED
from codeweft.queries.sources import contents
from codeweft.session import Scratch
from codeweft.sources import extract as E
from codeweft.sources.graph import file_of
from codeweft.sources.reports import framework_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KINDS = ("class", "interface", "struct")
_NAME = "regexp_extract({0}, '([A-Za-z_$0-9]+)$', 1)"
_TYPES = ", s AS (SELECT id, split_part(id, '::', 1) AS path, name FROM n WHERE kind IN ('class', 'interface', 'struct') AND coalesce(name, '') <> '')"
_CALLED = ", s AS (SELECT id, split_part(id, '::', 1) AS path, name FROM n WHERE kind IN ('class', 'function', 'method') AND coalesce(name, '') <> '')"
_REFS = ", r AS (SELECT DISTINCT source, " + _NAME.format("target") + " AS name, split_part(source, '::', 1) AS path FROM ee WHERE kind IN ({0}) AND " + _NAME.format("target") + " <> '')"
_BOTH = ", l AS (SELECT path, name, min(id) AS li, count(*) AS ln FROM s GROUP BY ALL), g AS (SELECT name, min(id) AS gi, count(*) AS gn, list_sort(list(id)) AS ids FROM s GROUP BY name)"


def _symbols(n, *kinds):
    return n.where(F.col("kind").isin(*kinds) & (F.coalesce("name", F.lit("")) != "")).select("id", file_of("id").alias("path"), "name")


def _refs(e, *kinds):
    return e.where(F.col("kind").isin(*kinds)).select("source", K.bare_name("target").alias("name"))


@query(
    _SQL + _TYPES + _REFS.format("'inherits', 'implements'") + _BOTH
    + """ SELECT r.source, r.name, CASE WHEN ln = 1 THEN li ELSE gi END AS target, CASE WHEN ln = 1 THEN 'extracted' WHEN gn = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence,
    CASE WHEN coalesce(ln, 0) <> 1 AND gn > 1 THEN array_to_string(ids[1:8], ',') ELSE '' END AS candidates FROM r JOIN g USING (name) LEFT JOIN l ON l.path = r.path AND l.name = r.name"""
)
def parent_types(spark, d):
    n, e = graph(spark, d)
    found = K.resolve_parents(_refs(e, "inherits", "implements"), _symbols(n, *_KINDS))
    return found.select("source", "name", "target", "confidence", F.concat_ws(",", "candidates").alias("candidates"))


@query(
    _SQL + _CALLED + _REFS.format("'decorates'") + _BOTH
    + """ SELECT r.source, r.name, coalesce(li, gi) AS target, CASE WHEN li IS NOT NULL THEN 'extracted' ELSE 'inferred' END AS confidence
    FROM r JOIN g USING (name) LEFT JOIN l ON l.path = r.path AND l.name = r.name WHERE li IS NOT NULL OR gn = 1"""
)
def decorator_targets(spark, d):
    n, e = graph(spark, d)
    return K.resolve_decorators(_refs(e, "decorates"), _symbols(n, "class", "function", "method"))


_OWNER = "nullif(regexp_extract(id, '^(.+::.+)\\.[^.]+$', 1), '')"


@query(
    _SQL
    + f""", o AS (SELECT id, name, {_OWNER} AS owner FROM n WHERE kind IN ('method', 'function') AND {_OWNER} IS NOT NULL)
    SELECT DISTINCT c.id AS source, p.id AS target FROM (SELECT source, target FROM ee WHERE kind IN ('contains', 'inherits')) i JOIN o c ON c.owner = i.source JOIN o p ON p.owner = i.target AND p.name = c.name WHERE c.id <> p.id"""
)
def override_pairs(spark, d):
    """Methods of the same name on both sides of a class link (inheritance, and nesting, which the test data has more of)."""
    n, e = graph(spark, d)
    return K.override_edges(e.where(F.col("kind").isin("contains", "inherits")).select("source", "target"), n.where(F.col("kind").isin("method", "function")).select("id", "name"))


_FILE_IMPORTS = f", im AS (SELECT DISTINCT {_FILE.format('source')} AS path, {_FILE.format('target')} AS imported FROM ee WHERE kind = 'imports' AND {_FILE.format('source')} <> {_FILE.format('target')})"
_THROUGH = ", th AS (SELECT r.source, r.name, min_by(s.id, (CASE WHEN regexp_extract(s.path, '([^/.]+)[^/]*$', 1) <> s.name THEN '1' ELSE '0' END) || s.id) AS target FROM r JOIN im ON im.path = r.path JOIN s ON s.path = im.imported AND s.name = r.name GROUP BY r.source, r.name)"


def _imports(e):
    return e.where("kind = 'imports'").select(file_of("source").alias("path"), file_of("target").alias("imported")).where("path <> imported")


@query(_SQL + _CALLED + _REFS.format("'calls'") + _FILE_IMPORTS + _THROUGH + " SELECT source, name, target FROM th")
def named_import_targets(spark, d):
    n, e = graph(spark, d)
    return K.named_imports(_refs(e, "calls"), _imports(e), _symbols(n, "class", "function", "method"))


_FOLDER = "regexp_replace({0}, '/?[^/]*$', '')"


@query(
    _SQL + _CALLED + _REFS.format("'calls'") + _BOTH + _FILE_IMPORTS + _THROUGH
    + f""", pk AS (SELECT {_FOLDER.format('path')} AS folder, name, min(id) AS pi, count(*) AS pn FROM s GROUP BY ALL),
    x AS (SELECT r.source, r.name, CASE WHEN ln = 1 THEN 'same_file' WHEN th.target IS NOT NULL THEN 'named_import' WHEN pn = 1 THEN 'same_package' WHEN gn = 1 THEN 'unique' ELSE 'ambiguous' END AS rung, li, gi, pi, th.target AS ti
      FROM r JOIN g USING (name) LEFT JOIN l ON l.path = r.path AND l.name = r.name LEFT JOIN th ON th.source = r.source AND th.name = r.name LEFT JOIN pk ON pk.folder = {_FOLDER.format('r.path')} AND pk.name = r.name)
    SELECT source, name, CASE rung WHEN 'same_file' THEN li WHEN 'named_import' THEN ti WHEN 'same_package' THEN pi ELSE gi END AS target, rung,
      CASE WHEN rung IN ('same_file', 'named_import') THEN 'extracted' WHEN rung = 'ambiguous' THEN 'ambiguous' ELSE 'inferred' END AS confidence FROM x"""
)
def call_ladder(spark, d):
    n, e = graph(spark, d)
    return K.call_ladder(_refs(e, "calls"), _imports(e), _symbols(n, "class", "function", "method"))


@query(
    f"""WITH p AS (SELECT DISTINCT f.path FROM files f WHERE f.generation_id = (SELECT max(id) FROM generations WHERE state = 'committed') AND f.path LIKE '%.go' AND NOT {_TEST.format('f.path')}),
    k AS (SELECT path, {_FOLDER.format('path')} AS package FROM p) SELECT path, package, count(*) OVER (PARTITION BY package) - 1 AS peers FROM k"""
)
def go_packages(spark, d):
    newest = N.newest_generation(table(spark, d, "generations"))
    return K.package_members(table(spark, d, "files").where((F.col("generation_id") == newest) & F.col("path").endswith(".go")).select("path"))


_INDEX = "regexp_matches({0}, '(^|/)(__init__\\.py|index\\.[a-z]+)$')"


@query(_SQL + f"SELECT id FROM n WHERE NOT {_IS_FILE} AND exported AND {_FILE.format('id')} IN (SELECT {_FILE.format('target')} FROM ee WHERE kind = 'imports' AND {_INDEX.format(_FILE.format('source'))})")
def reexported_symbols(spark, d):
    return K.reexported(*graph(spark, d))


_STEM = "regexp_extract(lower(id), '([^/.]+)[^/]*$', 1)"
_DIR = "regexp_extract(lower(id), '([^/]+)/[^/]*$', 1)"
_ENTRY = f"SELECT id, CASE WHEN {_STEM} IN ({', '.join(repr(x) for x in K.ENTRY_NAMES)}) THEN 'name' WHEN {_DIR} IN ({', '.join(repr(x) for x in K.ENTRY_DIRS)}) THEN 'directory' END AS why FROM n WHERE {_IS_FILE} AND NOT {_TEST.format('id')}"


@query(_SQL + f"SELECT * FROM ({_ENTRY}) WHERE why IS NOT NULL")
def entry_root_files(spark, d):
    return K.entry_roots(graph(spark, d)[0])


@query(
    _SQL
    + f""", u AS (SELECT DISTINCT {_NAME.format('target')} AS name, {_FILE.format('source')} AS path FROM ee WHERE kind NOT IN ('calls', 'contains', 'documents'))
    SELECT name, count(*) AS files, array_to_string(list_sort(list(path))[1:8], ',') AS first FROM u WHERE name <> '' GROUP BY name"""
)
def reference_names(spark, d):
    return K.reference_index(graph(spark, d)[1]).select("name", "files", F.concat_ws(",", "first").alias("first"))


_NOW = """WITH cur AS (SELECT path, content FROM files WHERE generation_id = (SELECT max(id) FROM generations WHERE state = 'committed') AND path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC NULLS LAST) = 1)"""


@query(
    _NOW
    + f""", x AS (SELECT path, unnest(regexp_extract_all(content, '(?:import_module|__import__|require|import)\\(\\s*[''"]([^''"\\n]+)[''"]', 1)) AS raw FROM cur WHERE content IS NOT NULL AND NOT {_TEST.format('path')})
    SELECT DISTINCT module, path FROM (SELECT translate(regexp_replace(regexp_replace(raw, '^[./]+', ''), '\\.(js|ts|jsx|tsx|mjs|cjs|py)$', ''), '/', '.') AS module, path FROM x) WHERE module <> ''"""
)
def dynamic_import_index(spark, d):
    return K.dynamic_imports(contents(spark, d))


@query(
    f"SELECT id FROM ({Q.ORACLES['dead_symbols']}) WHERE tier = 'extracted' AND id NOT IN (SELECT {_ID.format('target')} FROM edges WHERE json_extract_string(extras, '$.provenance') = 'runtime' AND {_ID.format('target')} IS NOT NULL) AND id NOT IN (SELECT id FROM ({_SQL}SELECT id FROM n WHERE NOT {_IS_FILE} AND exported AND {_FILE.format('id')} IN (SELECT {_FILE.format('target')} FROM ee WHERE kind = 'imports' AND {_INDEX.format(_FILE.format('source'))})))"
)
def dead_unseen(spark, d):
    """Dead symbols that no run reached and no index file passes on."""
    n, e = graph(spark, d)
    dead = T.dead_symbols(n, e, roots(n)).where("tier = 'extracted'").select("id")
    protected = K.runtime_seen(table(spark, d, "edges")).unionByName(K.reexported(n, e))
    return dead.hint("merge").join(protected.hint("merge"), "id", "left_anti")


@query(f"SELECT id FROM ({Q.ORACLES['dead_symbols']}) WHERE tier = 'extracted' INTERSECT SELECT id FROM ({RQ.ORACLES['unmentioned_symbols']})")
def dead_and_unmentioned(spark, d):
    """Symbols that both the graph and the texts show to be unused."""
    n, e = graph(spark, d)
    dead = T.dead_symbols(n, e, roots(n)).where("tier = 'extracted'").select("id")
    return dead.hint("merge").join(RQ.unmentioned_symbols(spark, d).hint("merge"), "id", "left_semi")


@query(
    _SQL
    + f""", ch AS (SELECT DISTINCT path FROM n WHERE path LIKE '{CHANGED}'), lk AS (SELECT DISTINCT {_FILE.format('target')} AS src, {_FILE.format('source')} AS dst FROM ee WHERE kind = 'imports' AND rank >= 1 AND {_FILE.format('source')} <> {_FILE.format('target')}),
    w AS (SELECT path AS id FROM ch UNION SELECT lk.dst FROM w JOIN lk ON lk.src = w.id),
    al AS (SELECT path, 0 AS o FROM ch UNION ALL SELECT id, 1 FROM w UNION ALL SELECT {_FILE.format('source')}, 2 FROM ee WHERE rank = 0 AND {_FILE.format('source')} <> {_FILE.format('target')} AND {_FILE.format('target')} IN (SELECT path FROM ch))
    SELECT path, CASE min(o) WHEN 0 THEN 'changed' WHEN 1 THEN 'import' ELSE 'name' END AS why FROM al GROUP BY path"""
)
def affected_files(spark, d):
    n, e = graph(spark, d)
    return K.affected_closure(e, n.where(F.col("path").like(CHANGED)).select("path"))


_DECL = "list_transform(list_filter(string_split_regex(content, '\\r?\\n'), lambda x: regexp_matches(x, '^\\s*(export |public |async )*(def|class|function|func|type|interface|enum|const|var|let)\\b')), lambda x: regexp_replace(trim(x), '\\s+', ' ', 'g'))"


@query(
    f"""WITH g AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS k FROM generations WHERE state = 'committed'),
    f AS (SELECT g.k, path, content FROM files JOIN g ON g.id = generation_id WHERE k <= 2 AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY ingested_at DESC NULLS LAST) = 1),
    s AS (SELECT k, path, sha256(content) AS h, sha256(array_to_string({_DECL}, chr(10))) AS surface FROM f WHERE content IS NOT NULL)
    SELECT a.path, a.surface = b.surface AS stable FROM s a JOIN s b ON a.path = b.path AND a.k = 1 AND b.k = 2 WHERE a.h <> b.h"""
)
def surface_stability(spark, d):
    """Of the files whose content changed in the last generation, whether their declarations stayed the same."""
    ids = [r["generation_id"] for r in N.committed_generations(table(spark, d, "generations")).orderBy(F.desc("generation_id")).limit(2).collect()]
    sides = []
    for i in [*ids, None, None][:2]:
        c = N.current_files(table(spark, d, "files"), i, ["content"]).where("content is not null")
        sides.append(K.surfaces(c).join(c.select("path", F.sha2("content", 256).alias("h")), "path"))
    new, old = sides[0].alias("a"), sides[1].alias("b")
    return new.hint("merge").join(old.hint("merge"), F.col("a.path") == F.col("b.path")).where("a.h <> b.h").select("a.path", (F.col("a.surface") == F.col("b.surface")).alias("stable"))


@query()
def route_map(spark, d):
    """Routes of the sources with handlers, consumers and shape differences (tested by fixture)."""
    c = contents(spark, d).select("path", "content")
    found = framework_lines(c).where("kind = 'route'").dropDuplicates(["path", "line"])
    callables = E.extract(contents(spark, d)).where(F.col("what").isin("function", "method"))
    handlers = callables.select(F.concat_ws("::", "path", "name").alias("id"), "path", F.col("line").cast("int").alias("line"))
    out = RT.route_map(found, handlers, c)
    return out.select("route", "verb", "url", "handler", "consumers", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "unused").alias("unused"), "risk")


@query()
def fetch_sites(spark, d):
    return RT.fetch_sites(contents(spark, d)).select("site", "verb", "url", F.concat_ws(",", "keys").alias("keys"))


@query(
    _SQL
    + f"SELECT 'nodes' AS part, count(*) AS rows FROM n UNION ALL SELECT 'edges', count(*) FROM ee WHERE NOT ({_FILE.format('source')} LIKE '{CHANGED}') AND NOT ({_FILE.format('target')} LIKE '{CHANGED}') OR {_FILE.format('source')} LIKE '{CHANGED}'"
)
def synced_generation(spark, d):
    """A published graph after a sync of the changed files: their nodes and outgoing edges are new, edges into them gone."""
    n, e = graph(spark, d)
    root = f"{Scratch(spark, 'sync').root}/graph"
    edges = e.select("source", "target", "kind", file_of("source").alias("source_path"), file_of("target").alias("target_path"))
    nodes = n.select("id", "kind", F.coalesce("path", F.lit("")).alias("path"))
    changed = n.where(F.col("path").like(CHANGED)).select("path").distinct()
    ST.sync(root, changed, nodes, edges)
    ST.sync(root, changed, nodes.where(F.col("path").like(CHANGED)), edges.where(F.col("source_path").like(CHANGED)))
    parts = [ST.published(spark, root, t).select(F.lit(t).alias("part")) for t in ("nodes", "edges")]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
