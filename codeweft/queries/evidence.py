"""Queries of evidence, gaps, runs and retention, and their SQL.

The test tables have no such records; orders stand for criteria, their lines for evidence and gaps,
and events for runs, messages and observations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import evidence as V
from codeweft.queries.core_problems import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CRITERIA = "cr AS (SELECT o_orderkey AS criterion_id FROM orders), ev AS (SELECT l_orderkey AS criterion_id, l_linenumber AS ordinal, CASE WHEN l_linestatus = 'F' THEN 'passed' ELSE 'failed' END AS status FROM lineitem)"
_MATRIX = f"WITH {_CRITERIA}, la AS (SELECT criterion_id, max_by(status, (ordinal, status)) AS status FROM ev GROUP BY 1), mx AS (SELECT criterion_id, coalesce(status, 'no_evidence') AS status FROM cr LEFT JOIN la USING (criterion_id)) "


def _criteria(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("criterion_id"))
    status = F.when(F.col("l_linestatus") == "F", "passed").otherwise("failed")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("criterion_id"), F.col("l_linenumber").alias("ordinal"), status.alias("status"))
    return c, e


@query(_MATRIX + "SELECT * FROM mx")
def evidence_matrix(spark, d):
    return V.evidence_matrix(*_criteria(spark, d))


@query(f"WITH {_CRITERIA} SELECT criterion_id FROM cr WHERE criterion_id NOT IN (SELECT criterion_id FROM ev WHERE status = 'passed')")
def unproven_criteria(spark, d):
    c, e = _criteria(spark, d)
    return V.unproven(c, e.where("status = 'passed'"))


@query(_MATRIX + "SELECT count(*) AS criteria, count(*) FILTER (status <> 'no_evidence') AS with_evidence, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'no_evidence') AS without_evidence, round(count(*) FILTER (status = 'passed') / count(*), 6) AS share FROM mx")
def evidence_coverage(spark, d):
    return V.coverage_summary(*_criteria(spark, d))


_SEV = "CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'other' END"
_GAPS = f"g AS (SELECT l_partkey AS part, l_suppkey AS supplier, l_returnflag = 'R' AS blocking, {_SEV} AS severity, l_orderkey * 10 + l_linenumber AS ordinal, l_returnflag AS kind, repeat(l_linestatus || ' ', l_quantity::INT * 5) AS text, CASE l_linenumber % 5 WHEN 4 THEN 9 ELSE l_linenumber % 5 END AS rank FROM lineitem)"


def _gaps(spark, d):
    k = F.col("l_linenumber") % 5
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "other"))), k + 1)
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), (F.col("l_returnflag") == "R").alias("blocking"), severity.alias("severity"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("kind"), F.expr("repeat(concat(l_linestatus, ' '), cast(l_quantity as int) * 5)").alias("text"),
    )


@query(f"WITH {_GAPS} SELECT part, supplier, blocking, severity, ordinal, kind FROM g QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY blocking DESC, rank, ordinal) = 1")
def preferred_gaps(spark, d):
    return V.preferred(_gaps(spark, d).drop("text"), ["part", "supplier"], ["ordinal"])


@query(f"WITH {_GAPS} SELECT supplier, count(*) FILTER (blocking) AS blocking, count(*) FILTER (NOT blocking) AS advisory, CASE min(rank) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END AS gravest FROM g GROUP BY supplier")
def gap_counts(spark, d):
    return V.gap_counts(_gaps(spark, d), ["supplier"])


@query(f"WITH {_GAPS} SELECT ordinal, severity, kind, CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS text FROM g WHERE blocking ORDER BY rank, kind, ordinal LIMIT 25")
def repair_order(spark, d):
    return V.repair_order(_gaps(spark, d), 25)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE user_id = 7 OR event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def run_timeline(spark, d):
    return V.timeline(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), (F.col("user_id") == 7) | (F.col("event_type") == "error"), 200)


_SESSIONS = "s AS (SELECT user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE 'now' END AS fingerprint FROM events GROUP BY user_id)"


@query(f"WITH {_SESSIONS} SELECT session_id, fingerprint, event_type, count(*) AS n FROM events JOIN s ON s.session_id = user_id WHERE fingerprint = 'now' GROUP BY ALL")
def session_observations(spark, d):
    ev = table(spark, d, "events")
    sessions = ev.select(F.col("user_id").alias("session_id")).distinct().withColumn("fingerprint", F.when(F.col("session_id") % 3 == 0, "old").otherwise("now"))
    seen = V.observed_sessions(ev.select(F.col("user_id").alias("session_id"), "event_type"), sessions, "now")
    return seen.groupBy("session_id", "fingerprint", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events WHERE ts < TIMESTAMP '2024-01-16'), l AS (SELECT user_id, max(ordinal) AS last FROM o GROUP BY user_id)
    SELECT user_id, event_id, coalesce(last, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events LEFT JOIN l USING (user_id) WHERE ts >= TIMESTAMP '2024-01-16'"""
)
def appended_ordinals(spark, d):
    """Observations of the second half of the month are appended to those of the first."""
    ev = table(spark, d, "events")
    half = F.lit("2024-01-16").cast("timestamp")
    none = ev.limit(0).select("user_id", F.lit(0).cast("long").alias("ordinal"))
    first = V.append_ordinals(none, ev.where(F.col("ts") < half).select("user_id", "event_id"), "user_id", ["event_id"])
    return V.append_ordinals(first, ev.where(F.col("ts") >= half).select("user_id", "event_id"), "user_id", ["event_id"])


@query(
    """WITH r AS (SELECT user_id AS run_id, max_by(event_type, (ts, event_id)) AS e, max(ts) AS touched FROM events GROUP BY user_id)
    SELECT run_id, CASE WHEN e IN ('click', 'view') THEN 'running' ELSE 'done' END AS status, e IN ('click', 'view') AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(touched) > 43200 * 1000000::BIGINT AS orphaned FROM r"""
)
def orphaned_runs(spark, d):
    """Runs (users) whose last event leaves them running, and half a day untouched."""
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = ev.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"), F.max("ts").alias("touched"))
    runs = last.withColumn("status", F.when(F.col("e").isin("click", "view"), "running").otherwise("done"))
    return V.orphaned(runs, F.lit(ev.agg(F.max("ts")).first()[0]), 43_200)


@query(
    """WITH m AS (SELECT user_id AS agent, event_id AS message_id, ts, event_type = 'error' AS unread FROM events)
    SELECT agent, message_id, unread FROM m WHERE unread UNION ALL SELECT agent, message_id, unread FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, message_id DESC) AS k FROM m WHERE NOT unread) WHERE k <= 10"""
)
def retained_messages(spark, d):
    ev = table(spark, d, "events")
    return V.retained(ev.select(F.col("user_id").alias("agent"), F.col("event_id").alias("message_id"), F.col("ts").alias("sent"), (F.col("event_type") == "error").alias("unread")), 10)



@query("WITH i AS (SELECT s_suppkey AS gate, sha256(s_name) AS input_hash FROM supplier), c AS (SELECT s_suppkey AS gate, CASE WHEN s_suppkey % 4 = 0 THEN sha256('changed') ELSE sha256(s_name) END AS input_hash, s_suppkey % 5 <> 0 AS passed FROM supplier) SELECT gate, input_hash FROM i WHERE (gate, input_hash) NOT IN (SELECT gate, input_hash FROM c WHERE passed)")
def gates_to_run(spark, d):
    """Suppliers as gates: a fourth has changed inputs, a fifth did not pass."""
    s = table(spark, d, "supplier")
    inputs = s.select(F.col("s_suppkey").alias("gate"), F.sha2("s_name", 256).alias("input_hash"))
    cache = s.select(F.col("s_suppkey").alias("gate"), F.when(F.col("s_suppkey") % 4 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.sha2("s_name", 256)).alias("input_hash"), (F.col("s_suppkey") % 5 != 0).alias("passed"))
    return V.stale_hashes(inputs, cache)


@query("SELECT c_custkey AS page, CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE 'outdated' END AS state FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 3 = 0")
def stale_pages(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.sha2("c_name", 256).alias("fingerprint"))
    pages = c.where("page % 7 <> 0").withColumn("fingerprint", F.when(F.col("page") % 3 == 0, "old").otherwise(F.col("fingerprint")))
    return V.stale_pages(pages, c)


@query("SELECT l_suppkey AS arm, count(*) AS n, round(avg(least(1.0, greatest(0.0, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity / 25 - 0.5 END))) FILTER (l_returnflag <> 'N') * count(*) FILTER (l_returnflag <> 'N') / count(*), 6) AS mean FROM lineitem GROUP BY 1")
def mean_scores(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("arm"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 25 - 0.5).alias("score"))
    return V.mean_score(li, ["arm"])


@query(
    """WITH p AS (SELECT l_suppkey AS path, l_partkey AS line, l_returnflag = 'R' AS executed, l_linestatus AS tool FROM lineitem), l AS (SELECT path, line, bool_or(executed) AS executed FROM p GROUP BY ALL), t AS (SELECT path, string_agg(DISTINCT tool, '+' ORDER BY tool) AS tools FROM p GROUP BY path)
    SELECT l.path, count(*) AS executable, count(*) FILTER (executed) AS executed, any_value(tools) AS tools FROM l JOIN t USING (path) GROUP BY l.path"""
)
def merged_coverage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("line"), (F.col("l_returnflag") == "R").alias("executed"), F.col("l_linestatus").alias("tool"))
    return V.merge_coverage(li)


@query(
    """WITH l AS (SELECT doc_id AS id, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL))
    SELECT id, line, text FROM l WHERE contains(lower(text), 'error') ORDER BY id DESC, line DESC LIMIT 50"""
)
def log_grep(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", r"\r?\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line"), "text")
    return V.grep(lines, "ERROR", 50)
