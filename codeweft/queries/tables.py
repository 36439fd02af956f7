"""Queries of joins, stores and ledgers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import joins as J
from codeweft.operators import ledger as L
from codeweft.operators import snapshots as N
from codeweft.operators import store as S
from codeweft.queries.core_problems import _FILES, _ID, table
from codeweft.queries.graph import _FILE, _SQL, graph
from codeweft.sources.graph import file_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spans(n):
    return n.where("line > 0 and path <> ''").select("path", "id", "line", "end_line")


_SPANS = ", sp AS (SELECT path, id, line, end_line FROM n WHERE line > 0 AND path <> '')"


@query(
    _SQL + _SPANS
    + """, c AS (SELECT a.path, a.line + 2 AS line, a.id, b.id AS span_id, row_number() OVER (PARTITION BY a.id ORDER BY b.line DESC, CASE WHEN b.end_line > 0 THEN b.end_line ELSE 2147483647 END, b.id) AS k
    FROM sp a LEFT JOIN sp b ON b.path = a.path AND a.line + 2 BETWEEN b.line AND CASE WHEN b.end_line > 0 THEN b.end_line ELSE 2147483647 END)
    SELECT path, line, id, span_id FROM c WHERE k = 1"""
)
def enclosing_symbol(spark, d):
    """For the second line within each symbol, the innermost symbol around it."""
    s = _spans(graph(spark, d)[0])
    return J.enclosing(s.select("path", (F.col("line") + 2).alias("line"), "id"), s)


@query(
    _SQL + _SPANS
    + """, c AS (SELECT a.path, a.line, a.id, b.id AS next_id, b.line AS bl, row_number() OVER (PARTITION BY a.id ORDER BY b.line, b.id) AS k FROM sp a LEFT JOIN sp b ON b.path = a.path AND b.line > a.line AND b.line <= a.line + 8)
    SELECT path, line, id, next_id FROM c WHERE k = 1"""
)
def next_callable(spark, d):
    s = _spans(graph(spark, d)[0])
    return J.next_within(s.select("path", "line", "id"), s.select("path", "line", "id"))


_AREAS = "SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS area FROM n WHERE path LIKE '%/%/%'"


@query(_SQL + f", a AS ({_AREAS}), p AS (SELECT DISTINCT path FROM n WHERE path <> '') SELECT p.path, max_by(a.area, length(a.area)) AS area FROM p LEFT JOIN a ON p.path = a.area OR starts_with(p.path, a.area || '/') GROUP BY p.path")
def longest_prefix_area(spark, d):
    n = graph(spark, d)[0]
    areas = n.where("path like '%/%/%'").select(F.concat_ws("/", F.slice(F.split("path", "/"), 1, 2)).alias("area")).distinct()
    return J.longest_prefix(n.where("path <> ''"), areas)


@query(
    "WITH r AS (SELECT DISTINCT 'GET' AS verb, l_partkey AS k FROM lineitem), c AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, o_custkey AS k, o_orderstatus AS s FROM orders) SELECT 'GET /orders/' || r.k || '/{status}/' AS route_id, c.verb || ' /orders/' || c.k || '/' || s AS call_id FROM r JOIN c ON r.verb = c.verb AND r.k = c.k"
)
def route_match(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    routes = li.select(F.concat(F.lit("/orders/"), F.col("l_partkey").cast("string"), F.lit("/{status}/")).alias("url")).distinct().select(F.concat_ws(" ", F.lit("GET"), "url").alias("id"), F.lit("GET").alias("verb"), "url")
    verb = F.when(F.col("o_orderkey") % 2 == 0, "GET").otherwise("POST")
    calls = o.select(verb.alias("verb"), F.concat(F.lit("/orders/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderstatus")).alias("url")).distinct().select(F.concat_ws(" ", "verb", "url").alias("id"), "verb", "url")
    return J.match_routes(routes, calls)


@query(
    _SQL
    + f""", s AS (SELECT path, name, id FROM n WHERE kind IN ('function', 'class', 'method') AND path <> ''), c AS (SELECT DISTINCT {_FILE.format('source')} AS path, regexp_extract(target, '([A-Za-z_0-9]+)$', 1) AS name FROM ee WHERE kind = 'calls'),
    l AS (SELECT path, name, min(id) AS li, count(*) AS ln FROM s GROUP BY ALL), g AS (SELECT name, min(id) AS gi, count(*) AS gn FROM s GROUP BY name)
    SELECT c.path, c.name, CASE WHEN ln = 1 THEN li ELSE gi END AS target, CASE WHEN ln = 1 THEN 'extracted' WHEN gn = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM c JOIN g USING (name) LEFT JOIN l ON l.path = c.path AND l.name = c.name"""
)
def call_resolution(spark, d):
    n, e = graph(spark, d)
    symbols = n.where(F.col("kind").isin("function", "class", "method") & (F.col("path") != "")).select("path", "name", "id")
    calls = e.where("kind = 'calls'").select(file_of("source").alias("path"), F.regexp_extract("target", r"([A-Za-z_0-9]+)$", 1).alias("name"))
    return J.unique_name_resolution(calls, symbols)


def _two(spark, d):
    rows = N.snapshot_rows(table(spark, d, "files"), table(spark, d, "generations")).withColumnRenamed("row_hash", "content_hash")
    last = N.committed_generations(table(spark, d, "generations")).count()
    side = lambda k: rows.where(F.col("snapshot") == k).select("path", "content_hash")
    return side(last - 1), side(last)


_TWO = _FILES + ", mx AS (SELECT max(k) AS m FROM gens), a AS (SELECT path, h FROM last, mx WHERE k = m - 1), b AS (SELECT path, h FROM last, mx WHERE k = m) "


@query(_TWO + ", g AS (SELECT h, min(path) AS old_path, count(*) AS n FROM a WHERE path NOT IN (SELECT path FROM b) GROUP BY h), c AS (SELECT h, min(path) AS new_path, count(*) AS n FROM b WHERE path NOT IN (SELECT path FROM a) GROUP BY h) SELECT old_path, new_path, g.h AS content_hash FROM g JOIN c ON g.h = c.h AND g.n = 1 AND c.n = 1")
def file_renames(spark, d):
    return S.renames(*_two(spark, d))


@query(_TWO + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.h IS DISTINCT FROM b.h")
def reconcile_files(spark, d):
    return S.reconcile(*_two(spark, d), ["content_hash"])


@query(_TWO + ", ch AS (SELECT b.path FROM b LEFT JOIN a ON a.path = b.path WHERE a.path IS NULL OR a.h IS DISTINCT FROM b.h UNION SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)) SELECT path, h AS content_hash FROM b")
def next_generation(spark, d):
    """Unaffected rows of the generation before and the changed ones make up the newest generation."""
    a, b = _two(spark, d)
    changed = S.reconcile(a, b, ["content_hash"]).select("path")
    return S.copy_unaffected(a, changed, b.join(changed, "path", "left_semi"))


@query("WITH g AS (SELECT id FROM generations WHERE state = 'committed' ORDER BY id DESC LIMIT 2) SELECT generation_id, count(*) AS files FROM files WHERE generation_id IN (SELECT id FROM g) GROUP BY generation_id")
def pruned_generations(spark, d):
    return S.prune(table(spark, d, "files"), table(spark, d, "generations"), 2).groupBy("generation_id").agg(F.count(F.lit(1)).alias("files"))


@query("WITH l AS (SELECT lower(language) AS language, size FROM files WHERE generation_id IS NOT NULL) SELECT count(*) AS payloads FROM (SELECT DISTINCT language, size FROM l)")
def payload_dedupe(spark, d):
    f = table(spark, d, "files").select("path", F.lower("language").alias("language"), "size")
    return S.payloads(f, "path", ["language", "size"])[1].agg(F.count(F.lit(1)).alias("payloads"))


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, max(ts) AS ts, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def latest_event(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return L.latest(e, ["user_id"], ["ts", "event_id"])


@query(
    f"WITH o AS (SELECT ordinal, {_ID.format('id')} AS id, line, kind FROM nodes QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY id) = 1), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS k FROM o), b AS (SELECT *, CASE WHEN k = 1 THEN id ELSE id || '#L' || line || ':' || kind END AS i FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY ordinal) AS z FROM b) SELECT ordinal, id, CASE WHEN z = 1 THEN i ELSE i || ':' || z END AS new_id FROM c"
)
def unique_node_ids(spark, d):
    from codeweft.functions.ids import plain_id

    n = table(spark, d, "nodes").select("ordinal", plain_id("id").alias("id"), "line", "kind").dropDuplicates(["ordinal"])
    return S.unique_ids(n).select("ordinal", "id", "new_id")


_EV = "WITH x AS (SELECT event_id, ts, coalesce(nullif(CASE WHEN json_extract(props, '$.k')::INT = 0 THEN '' ELSE user_id::VARCHAR END, ''), '(unattributed)') AS task, event_type AS run, round(value / 1000, 6) AS cost, json_extract(props, '$.k')::BIGINT AS tokens FROM events) "


def _ledger(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", "ts", F.when(k != 0, F.col("user_id").cast("string")).alias("task"), F.col("event_type").alias("run"), F.round(F.col("value") / 1000, 6).alias("cost"), k.alias("tokens"))


@query(_EV + "SELECT 'total' AS dimension, '' AS key, count(*) AS n, round(sum(cost), 4) AS amount, sum(tokens)::BIGINT AS units FROM x UNION ALL SELECT 'task', task, count(*), round(sum(cost), 4), sum(tokens)::BIGINT FROM x GROUP BY task UNION ALL SELECT 'run', run, count(*), round(sum(cost), 4), sum(tokens)::BIGINT FROM x GROUP BY run")
def ledger_rollup(spark, d):
    return L.rollup(_ledger(spark, d), ["task", "run"], "cost", "tokens")


@query(_EV + ", w AS (SELECT event_id, task, sum(tokens) OVER (PARTITION BY task ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS after, tokens FROM x) SELECT event_id, task, (after - tokens)::BIGINT AS before, after::BIGINT AS after FROM w WHERE after - tokens < 500 AND after >= 500")
def budget_crossing(spark, d):
    r = _ledger(spark, d).withColumn("task", L.attributed("task"))
    return L.crossings(r, "task", ["ts", "event_id"], "tokens", 500).select("event_id", "task", "before", "after")


@query(_EV + ", p AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS p), r AS (SELECT run, tokens, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY tokens) AS k FROM x) SELECT run, n, p, tokens AS quantile FROM r, p WHERE k = greatest(1, ceil(p * n))")
def token_percentiles(spark, d):
    return L.nearest_rank(_ledger(spark, d), ["run"], "tokens", [0.5, 0.95])


@query("WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT event_id, user_id FROM g WHERE gap IS NULL OR gap >= INTERVAL 1 HOUR")
def debounced_events(spark, d):
    return L.kept_by_debounce(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "user_id")


_TR = "SELECT source, target, count(*) AS n, max(ts) AS last_seen FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target, ts FROM events) WHERE source IS NOT NULL GROUP BY source, target"


@query(_TR)
def runtime_edges(spark, d):
    return L.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"WITH r AS ({_TR}), s AS (SELECT DISTINCT event_type AS source, 'view' AS target FROM events) SELECT source, target, 'calls' AS kind, 'static' AS origin FROM s UNION ALL SELECT source, target, 'calls', 'runtime' FROM r WHERE (source, target) NOT IN (SELECT source, target FROM s)")
def runtime_edge_merge(spark, d):
    e = table(spark, d, "events")
    static = e.select(F.col("event_type").alias("source"), F.lit("view").alias("target"), F.lit("calls").alias("kind"))
    runtime = L.transitions(e, "user_id", ["ts", "event_id"], "event_type").where("target is not null")
    return L.merge_runtime(static, runtime.withColumn("kind", F.lit("calls")))


@query("SELECT l_linestatus AS arm, count(*) AS n, count(*) FILTER (t AND v) AS tp, count(*) FILTER (NOT t AND v) AS fp, count(*) FILTER (t AND NOT v) AS fn, count(*) FILTER (NOT t AND NOT v) AS tn, round((count(*) FILTER (t = v)) / count(*), 6) AS accuracy FROM (SELECT l_linestatus, l_returnflag = 'R' AS t, l_discount > 0.05 AS v FROM lineitem) GROUP BY l_linestatus")
def verdict_confusion(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("arm"), (F.col("l_returnflag") == "R").alias("t"), (F.col("l_discount") > 0.05).alias("v"))
    return L.confusion(li, ["arm"], "t", "v")


@query("WITH n AS (SELECT l_orderkey, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN max(n) * 2 > sum(n) THEN max_by(c, n) END AS choice, sum(n)::BIGINT AS votes FROM n GROUP BY l_orderkey")
def majority_vote(spark, d):
    return L.majority(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS part FROM orders")
def hash_split(spark, d):
    return L.split_by_hash(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 0.2)


@query("SELECT c_custkey, t.k AS o_orderkey FROM customer LEFT JOIN (SELECT o_orderkey AS k, unnest(list_distinct([o_custkey, o_custkey + 1])) AS m FROM orders) t ON t.m = c_custkey")
def requirement_matrix(spark, d):
    """Left rows with all rows whose array names them; those that none names stay with a null."""
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("members"))
    return L.array_matrix(table(spark, d, "customer").select("c_custkey"), "c_custkey", o, "members").select("c_custkey", "o_orderkey")
