"""Queries that explore the graph and describe files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import explore as X
from codeweft.operators import traversal as T
from codeweft.queries import graph as Q
from codeweft.queries.core_problems import table
from codeweft.queries.graph import _FILE, _IS_FILE, _SQL, NAME, graph, roots
from codeweft.queries.linking import _NOW
from codeweft.queries.sources import contents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GOAL = "cache the verdict of a scheduler"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MATCH = f""", mt AS (SELECT id, path, line, end_line, ordinal, CASE WHEN lower(id) = '{NAME}' OR lower(coalesce(path, '')) = '{NAME}' OR lower(coalesce(name, '')) = '{NAME}' OR lower(id) LIKE '%::{NAME}' THEN 0
    WHEN contains(lower(id), '{NAME}') OR contains(lower(coalesce(name, '')), '{NAME}') THEN 1 END AS tier FROM n),
  fo AS MATERIALIZED (SELECT * FROM mt WHERE tier IS NOT NULL ORDER BY tier, ordinal, id LIMIT 20)"""


@query(
    _SQL + _MATCH
    + f""", {_NOW.split('WITH', 1)[1]}, ib AS (SELECT target AS id, array_to_string(list_sort(list(DISTINCT source))[1:50], ',') AS l FROM ee WHERE target IN (SELECT id FROM fo) GROUP BY target),
    ob AS (SELECT source AS id, array_to_string(list_sort(list(DISTINCT target))[1:50], ',') AS l FROM ee WHERE source IN (SELECT id FROM fo) GROUP BY source),
    w AS (SELECT id, id AS pt, 0 AS d FROM fo UNION SELECT w.id, m.source, w.d + 1 FROM w JOIN m ON m.target = w.pt WHERE w.d < 3),
    im AS (SELECT id, count(DISTINCT pt) - 1 AS k FROM w GROUP BY id),
    sn AS (SELECT fo.id, array_to_string(string_split(content, chr(10))[line:least(greatest(end_line, line), line + 11)], chr(10)) AS t FROM fo JOIN cur ON cur.path = fo.path WHERE line > 0 AND content IS NOT NULL)
    SELECT fo.id, fo.tier, coalesce(sn.t, '') AS snippet, coalesce(ib.l, '') AS inbound, coalesce(ob.l, '') AS outbound, im.k AS impact
    FROM fo LEFT JOIN sn ON sn.id = fo.id LEFT JOIN ib ON ib.id = fo.id LEFT JOIN ob ON ob.id = fo.id LEFT JOIN im ON im.id = fo.id"""
)
def explore(spark, d):
    n, e = graph(spark, d)
    found = X.explore(n, e, contents(spark, d).select("path", "content"), NAME)
    return found.select("id", "tier", "snippet", F.concat_ws(",", "inbound").alias("inbound"), F.concat_ws(",", "outbound").alias("outbound"), "impact")


@query(_SQL + f"SELECT id FROM n WHERE id = '{NAME}' OR coalesce(path, '') = '{NAME}' OR coalesce(name, '') = '{NAME}' OR contains(id, '{NAME}') OR suffix(coalesce(path, ''), '{NAME}')")
def symbol_match_exact_case(spark, d):
    return X.match_exact_case(graph(spark, d)[0], NAME)


_KIND = """CASE WHEN regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(lower(path), '(^|/)(test_[^/]*|[^/]*(_test|\\.test|\\.spec)\\.[a-z]+|conftest\\.py)$') THEN 'test'
    WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') OR regexp_matches(lower(path), '(^|/)docs?/') THEN 'doc'
    WHEN regexp_matches(lower(path), '\\.(toml|ini|cfg|ya?ml)$') OR regexp_matches(lower(path), '(^|/)[^/]*(config|settings)[^/]*$') THEN 'config'
    WHEN regexp_matches(lower(path), '\\.(json|csv|parquet)$') THEN 'data' ELSE 'source' END"""
_FAMILY = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) = '{k}' THEN '{v}'" for k, v in X.FAMILIES.items()) + " ELSE 'other' END"


@query(f"SELECT DISTINCT path, {_KIND} AS kind, {_FAMILY} AS family, CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] ELSE '' END AS area FROM files WHERE path IS NOT NULL")
def file_facts(spark, d):
    return X.file_facts(table(spark, d, "files"))


@query(
    """WITH f AS (SELECT split_part(path, '/', 1) AS repository, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS f FROM files WHERE path IS NOT NULL),
    e AS (SELECT repository, min(f) AS a, max(f) AS b FROM f GROUP BY repository)
    SELECT repository, array_to_string(a[1:list_max(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], '/') AS root FROM e"""
)
def repository_roots(spark, d):
    return X.common_directories(table(spark, d, "files"))


@query(f"SELECT split_part(path, '/', 1) AS repository, {_FAMILY} AS family, count(DISTINCT path) AS files FROM files WHERE path IS NOT NULL GROUP BY ALL")
def detected_languages(spark, d):
    facts = X.file_facts(table(spark, d, "files"))
    return facts.groupBy(F.substring_index("path", "/", 1).alias("repository"), "family").agg(F.count(F.lit(1)).alias("files"))


@query(
    _SQL
    + f""", lk AS (SELECT DISTINCT {_FILE.format('source')} AS a, {_FILE.format('target')} AS path FROM ee WHERE kind = 'imports'), dg AS (SELECT path, count(*) AS importers FROM lk WHERE a <> path GROUP BY path),
    x AS (SELECT area, n.id AS path, coalesce(importers, 0) AS importers, CASE WHEN regexp_extract(lower(n.id), '([^/.]+)[^/]*$', 1) IN ('__main__', 'main', 'index', 'app', 'cli') THEN 0 ELSE 1 END AS o FROM n LEFT JOIN dg ON dg.path = n.id WHERE {_IS_FILE} AND area IS NOT NULL)
    SELECT area, path, row_number() OVER (PARTITION BY area ORDER BY importers DESC, o, path) AS rank, importers FROM x QUALIFY rank <= 5"""
)
def ranked_area_files(spark, d):
    return X.ranked_area_files(*graph(spark, d))


_WORDS = sorted({w for w in GOAL.lower().split() if len(w) > 2})


@query(f"SELECT path, score FROM (SELECT DISTINCT path, {' + '.join(f'contains(lower(path), {w!r})::INT' for w in _WORDS)} AS score FROM files WHERE path IS NOT NULL) WHERE score > 0 ORDER BY score DESC, path DESC LIMIT 10")
def path_candidates(spark, d):
    return X.path_candidates(table(spark, d, "files").where("path is not null"), GOAL)


@query(f"WITH u AS ({Q.ORACLES['unwired_files']}), t AS (SELECT count(*) AS total FROM u) SELECT id, total, least(total, 50) AS shown, total > 50 AS truncated FROM u, t ORDER BY id LIMIT 50")
def capped_unwired(spark, d):
    n, e = graph(spark, d)
    return X.capped(T.unwired_files(n, e, roots(n)), "id", 50)


@query(
    _SQL
    + """, j AS (SELECT area, '{"id":' || to_json(id) || ',"kind":' || coalesce(to_json(kind)::VARCHAR, 'null') || '}' AS t FROM n)
    SELECT area, count(*) AS rows, bit_xor(('0x' || substr(sha256(t), 1, 13))::BIGINT) AS digest FROM j GROUP BY area"""
)
def area_digests(spark, d):
    return X.digest(graph(spark, d)[0], ["id", "kind"], ["area"])


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\\t-\\r\\x{85}\\p{Z}]+', ' ', 'g'))) AS key FROM documents WHERE text IS NOT NULL")
def query_keys(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.query_key("text").alias("key"))


@query(
    """WITH e AS (SELECT user_id AS key, min(ts) AS created, max(ts) AS accessed FROM events GROUP BY user_id), t AS (SELECT max(ts) AS now FROM events)
    SELECT key, epoch_us(accessed) AS accessed_us FROM e, t WHERE epoch_us(now) - epoch_us(created) <= 2590000 * 1000000::BIGINT ORDER BY accessed DESC, key LIMIT 100"""
)
def live_cache_entries(spark, d):
    """Users' first and last events as cache entries: not older than the time to live, the 100 used last."""
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    entries = ev.groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("created"), F.max("ts").alias("accessed"))
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    return X.live_entries(entries, now, 2_590_000, 100).select("key", F.unix_micros("accessed").alias("accessed_us"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS hits, count(*) AS lookups, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS rate FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def cache_hit_rates(spark, d):
    """Share of hits (views) among lookups (views and clicks) a day."""
    hit = F.count_if(F.col("event_type") == "view")
    return table(spark, d, "events").where("event_type in ('view', 'click')").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(hit.alias("hits"), F.count(F.lit(1)).alias("lookups"), F.round(hit / F.count(F.lit(1)), 6).alias("rate"))


@query(
    _NOW
    + """, l AS (SELECT path, unnest(string_split_regex(content, '\\r?\\n')) AS text FROM cur WHERE content IS NOT NULL),
    x AS (SELECT path, coalesce(nullif(regexp_extract(text, '^\\s*from\\s+([A-Za-z_]\\w*)[\\w.]*\\s+import\\b', 1), ''), nullif(regexp_extract(text, '^\\s*import\\s+([A-Za-z_]\\w*)[\\w.]*(?:\\s+as\\s+\\w+)?\\s*(?:,.*)?$', 1), ''),
      nullif(regexp_extract(text, '^\\s*(?:import|export)\\b.*\\bfrom\\s+[''"]([^''"./][^''"/]*)', 1), '')) AS package FROM l)
    SELECT DISTINCT path, package FROM x WHERE package IS NOT NULL"""
)
def top_level_imports(spark, d):
    c = contents(spark, d).select("path", F.explode(F.split("content", r"\r?\n")).alias("text"))
    return X.top_level_imports(c)
