"""Queries of extraction, program dependence and streaming, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.operators import dependence as D
from codeweft.operators import export as X
from codeweft.operators.snapshots import current_files, newest_generation
from codeweft.operators.store import newest_generations
from codeweft.queries.core_problems import table
from codeweft.queries.graph import _SQL, graph
from codeweft.session import Scratch
from codeweft.sources import extract as E
from codeweft.sources import reports as R
from codeweft.streaming import traces as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def contents(spark, d):
    now = current_files(table(spark, d, "files"), newest_generation(table(spark, d, "generations")), ["content", "language"])
    return now.where("content is not null")


@query()
def extracted_records(spark, d):
    return E.extract(contents(spark, d))


@query()
def extracted_symbols(spark, d):
    e = E.extract(contents(spark, d))
    return e.where(F.col("what").isin("function", "class", "method", "struct", "interface")).groupBy("what", "exported").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("files"))


@query()
def dependence_edges(spark, d):
    return D.dependence(contents(spark, d))


@query()
def taint_findings(spark, d):
    return D.dependence(contents(spark, d)).where("what = 'taint'").select("path", "function", "source_line", "target_line", "label")


@query(
    """WITH l AS (SELECT doc_id AS id, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS l FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT id, line, length(regexp_extract(l, '^(#+)', 1))::INT AS level, trim(regexp_extract(l, '^#+\\s+(.*?)\\s*#*\\s*$', 1)) AS title FROM l WHERE regexp_matches(l, '^#{1,6}\\s+\\S'))
    SELECT a.id, a.line, a.level, a.title, (SELECT max(b.line) FROM h b WHERE b.id = a.id AND b.line < a.line AND b.level < a.level) AS parent_line FROM h a"""
)
def document_sections(spark, d):
    return E.sections(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null"))


def _stream(spark, d):
    return T.event_stream(spark, d, EVENTS, "events.parquet")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_totals(spark, d):
    s = T.windowed_totals(_stream(spark, d), "ts", "event_type", "value")
    return T.run_to_end(s, "complete", Scratch(spark, "stream"), "daily").withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_running_totals(spark, d):
    s = _stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return T.run_to_end(s, "complete", Scratch(spark, "stream"), "running").withColumn("total", F.round("total", 4))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark, d):
    """Incremental upserts give the same table as the batch."""
    s = _stream(spark, d).select("user_id", "ts", "event_id")
    return T.upsert_stream(s, ["user_id"], "ts", Scratch(spark, "stream"), "latest")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, session
    HAVING epoch_ms(max(ts) + INTERVAL 6 HOUR) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events)"""
)
def stream_sessions(spark, d):
    """Sessions that the watermark has closed; open ones are not given out yet."""
    s = T.sessions(_stream(spark, d), "ts", "user_id", "6 hours", "1 day")
    return T.run_to_end(s, "append", Scratch(spark, "stream"), "sessions")


@query(
    """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE ts >= TIMESTAMP '2024-01-16' AND epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) <= (SELECT epoch_ms(max(ts)) - 2 * 86400000 FROM events) GROUP BY ALL"""
)
def stream_late_rows(spark, d):
    """The later half of the events comes first; the stream is ended and resumed, and what follows is later than the watermark and dropped."""
    scratch = Scratch(spark, "stream")
    events, half = table(spark, d, "events"), F.lit("2024-01-16").cast("timestamp")
    for part in (F.col("ts") >= half, F.col("ts") < half):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{scratch.root}/arriving")
        s = T.windowed_totals(T.event_stream(spark, f"{scratch.root}/arriving", EVENTS), "ts", "event_type", "value")
        out = T.run_to_end(s, "append", scratch, "late")
    return out.withColumn("total", F.round("total", 4))


@query()
def framework_lines(spark, d):
    return R.framework_lines(contents(spark, d))


@query(_SQL + "SELECT t.tier, sum(CASE t.tier WHEN 'stub' THEN strlen(json_object('id', id)) ELSE strlen(json_object('id', id, 'kind', kind)) END)::BIGINT AS bytes, count(*) AS rows FROM n, (SELECT unnest(['stub', 'compact']) AS tier) t GROUP BY t.tier")
def export_tier_sizes(spark, d):
    return X.json_tiers(graph(spark, d)[0]).where(F.col("tier").isin("stub", "compact"))


@query(_SQL + "SELECT 'node' AS part, count(*) AS rows FROM n UNION ALL SELECT 'edge', count(*) FROM ee")
def graphml_elements(spark, d):
    return X.graphml_rows(*graph(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query(_SQL + "SELECT area, trim(regexp_replace(lower(area), '[^a-z0-9]+', '-', 'g'), '-') AS slug, '# ' || area || chr(10) || chr(10) || string_agg('- ' || path, chr(10) ORDER BY path) AS page FROM (SELECT DISTINCT area, path FROM n WHERE kind = 'file' AND area <> '') GROUP BY area")
def area_pages(spark, d):
    return X.markdown_pages(graph(spark, d)[0])


@query()
def semantic_changes(spark, d):
    """Symbols that differ between the two newest committed generations."""
    f, g = table(spark, d, "files"), table(spark, d, "generations")
    ids = [r["id"] for r in newest_generations(g, 2).collect()]
    kinds = ("function", "class", "method", "struct", "interface")
    side = lambda i: E.extract(current_files(f, i, ["content", "language"])).where(F.col("what").isin(*kinds))
    return X.semantic_changes(side(ids[-1]), side(ids[0]))
