"""Queries over texts and vectors (tables documents, nodes, embeddings) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft.functions import text as X
from codeweft.operators import search as S
from codeweft.queries.core_problems import table
from codeweft.queries.graph import _SQL, graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TERMS = "report cache"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")


def node_texts(spark, d):
    return graph(spark, d)[0].select("id", F.concat_ws(" ", F.coalesce("name", F.lit("")), "id", F.coalesce("path", F.lit(""))).alias("text"))


_BM25 = """, w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM dd), s AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM w),
  q AS (SELECT unnest(['cache', 'report']) AS term), f AS (SELECT term, count(*) AS df FROM q JOIN w ON list_contains(ws, term) GROUP BY term),
  h AS (SELECT * FROM w WHERE list_contains(ws, 'cache') AND list_contains(ws, 'report')),
  t AS (SELECT id, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM h, q)
  SELECT id, round(-sum((CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM t JOIN f USING (term), s GROUP BY id"""


@query("WITH dd AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)" + _BM25)
def bm25_documents(spark, d):
    return S.bm25(documents(spark, d), TERMS).select("id", F.round("score", 6).alias("score"))


@query(_SQL + ", dd AS (SELECT id, concat_ws(' ', coalesce(name, ''), id, coalesce(path, '')) AS text FROM n)" + _BM25)
def bm25_nodes(spark, d):
    return S.bm25(node_texts(spark, d), TERMS).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id FROM documents WHERE lower(text) LIKE '%blast radius%' ORDER BY id LIMIT 500")
def fallback_search(spark, d):
    return S.substring_search(documents(spark, d), "blast radius", 500)


@query("SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id AS id, len(ws) AS length, unnest(ws) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL)) GROUP BY ALL")
def inverted_index(spark, d):
    return S.postings(documents(spark, d))


def _embedding(rows: str) -> str:
    return f"""tk AS (SELECT id, sha256(t) AS h FROM (SELECT id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS t FROM {rows}) WHERE length(t) > 1),
    rw AS (SELECT id, i, sum((('0x' || substr(h, (i % 32) * 2 + 1, 2))::INTEGER - 128) / 128.0::DOUBLE) AS v FROM tk, range(64) r(i) GROUP BY id, i),
    em AS (SELECT id, i, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY id)) > 0 THEN v / sqrt(sum(v * v) OVER (PARTITION BY id)) ELSE v END AS v FROM rw)"""


@query(_SQL + ", dd AS (SELECT id, concat_ws(' ', coalesce(path, ''), coalesce(name, ''), kind) AS text FROM n), " + _embedding("dd") + " SELECT id, i AS dim, round(v, 5) AS v FROM em")
def hash_embeddings(spark, d):
    n = graph(spark, d)[0].select("id", F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("name", F.lit("")), "kind").alias("text"))
    return n.select("id", F.posexplode(S.hash_embedding("text")).alias("dim", "v")).select("id", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("v"))


def embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_TOPK = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS k FROM s QUALIFY k <= 5) """


@query(_TOPK + "SELECT query_id, id, round(c, 5) AS cosine FROM t")
def embedding_top5(spark, d):
    """Every fiftieth vector against all vectors."""
    e = embeddings(spark, d)
    return S.top_k(e, e.where("id % 50 = 0"), 5).select("query_id", "id", F.round("cosine", 5).alias("cosine"))


_GATES = _TOPK + """, f AS (SELECT *, lead(c) OVER (PARTITION BY query_id ORDER BY c DESC, id) AS second FROM t), g AS (
  SELECT query_id, CASE WHEN c < 0.3 THEN 'out_of_domain' WHEN c < 0.5 THEN 'below_threshold' WHEN c - second < 0.03 THEN 'ambiguous' WHEN q.label <> v.label THEN 'intent_mismatch' ELSE 'hit' END AS outcome, round(c, 5) AS cosine
  FROM f JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings v ON v.vec_id = f.id WHERE k = 1) """


@query(_GATES + "SELECT * FROM g")
def cache_gates(spark, d):
    """The gates with limits that suit these vectors, which lie far apart."""
    e = embeddings(spark, d)
    q = e.where("id % 50 = 0")
    near = S.top_k(e, q, 5)
    gates = S.cache_gates(near, e, 0.5, 0.3, 0.03)
    return gates.join(q.select(F.col("id").alias("query_id")), "query_id", "left_semi")


@query("WITH r AS (SELECT (event_id * 7919 % 1000) / 1000.0::DOUBLE AS c, event_type = 'error' AND event_id % 3 = 0 AND (event_id * 7919 % 1000) < 900 AS wrong FROM events ORDER BY event_id DESC LIMIT 1000), g AS (SELECT round(0.98 - i * 0.005, 3) AS t FROM range(27) x(i)), z AS (SELECT t, count(*) FILTER (c >= t) AS n, avg(wrong::INT) FILTER (c >= t) AS rate FROM r, g GROUP BY t) SELECT coalesce(max(t) FILTER (n >= 20 AND rate <= 0.001), 0.85)::DOUBLE AS threshold, (SELECT count(*) FROM r) AS labels FROM z")
def tuner_threshold(spark, d):
    e = table(spark, d, "events")
    c = (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)
    return S.tuned_threshold(e.select(F.col("event_id").alias("at"), c.alias("cosine"), ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0) & (F.col("event_id") * 7919 % 1000 < 900)).alias("wrong")))


@query("WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL), c AS (SELECT id, ws, unnest(range(greatest(0, ceil((len(ws) - 64) / 48.0))::BIGINT + 1)) AS chunk FROM w WHERE len(ws) > 0) SELECT id, chunk::INT AS chunk, (chunk * 48)::INT AS start, len(ws[chunk * 48 + 1:chunk * 48 + 64])::INT AS words, array_to_string(ws[chunk * 48 + 1:chunk * 48 + 64], ' ') AS text FROM c")
def document_chunks(spark, d):
    return S.chunks(documents(spark, d), 64, 16)


@query()
def mmr_selection(spark, d):
    e = embeddings(spark, d)
    near = S.top_k(e, e.where("id % 50 = 0"), 20)
    c = near.join(e.select("id", "vec"), "id").select("query_id", "id", F.col("cosine").alias("score"), "vec", F.lit(300).alias("tokens"))
    return S.mmr(c, least=0.0)


_ANCHOR = "an AS (SELECT unnest(range(5)) AS id, unnest(['hello', 'what time is it', 'define photosynthesis', 'translate hello to french', 'what is 2 plus 2']) AS text)"


@query(
    "WITH dd AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), " + _ANCHOR + ", " + _embedding("dd") + ", "
    + _embedding("an").replace("tk AS", "tka AS").replace("FROM tk,", "FROM tka,").replace("rw AS", "rwa AS").replace("FROM rw)", "FROM rwa)").replace("em AS", "ema AS")
    + """, sim AS (SELECT id, max(s) AS s FROM (SELECT em.id, ema.id AS a, sum(em.v * ema.v) AS s FROM em JOIN ema ON em.i = ema.i GROUP BY ALL) GROUP BY id),
    sc AS (SELECT dd.id, text, round(0.25 * least(1.0, len(list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')) / 512.0)
      + 0.30 * least(1.0, CASE WHEN regexp_matches(text, '(?i)\\b(implement|architect|refactor|debug|optimize|prove|derive|multi.?step|recursive|distributed|benchmark|sql|regex|algorithm)\\b') THEN 0.6 ELSE 0 END
      + CASE WHEN regexp_matches(text, '```|<code>|def |class |function\\s*\\(|import ') THEN 0.4 ELSE 0 END + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 OR contains(text, chr(10)) THEN 0.2 ELSE 0 END)
      + 0.25 * (1 - coalesce(s, 0)), 4)::DOUBLE AS complexity FROM dd LEFT JOIN sim USING (id))
    SELECT id, complexity, CASE WHEN complexity < 0.45 THEN 'small' ELSE 'large' END AS tier, CASE WHEN regexp_matches(text, '```|<code>|def |class |function\\s*\\(|import ') THEN 'code' WHEN complexity >= 0.6 THEN 'reasoning' WHEN contains(text, '?') THEN 'qa' ELSE 'general' END AS intent FROM sc"""
)
def router_scores(spark, d):
    return S.route(documents(spark, d))


def _words(ws: tuple[str, ...]) -> str:
    return X.any_word(ws).replace("'", "''")


@query(
    "SELECT level, count(*) AS documents FROM (SELECT CASE "
    + " ".join(f"WHEN regexp_matches(lower(text), '{_words(w)}') THEN " + (f"CASE WHEN regexp_matches(lower(text), '{_words(X.CARRY_OUT)}') THEN 'Apply' ELSE '{n}' END" if n in ("Create", "Evaluate") else f"'{n}'") for n, w in X.LEVELS)
    + " ELSE 'Apply' END AS level FROM documents WHERE text IS NOT NULL) GROUP BY level"
)
def bloom_counts(spark, d):
    return documents(spark, d).groupBy(X.bloom_level("text").alias("level")).agg(F.count(F.lit(1)).alias("documents"))


def _redacted(c: str) -> str:
    for _, p, r in X.REDACTIONS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace('$', chr(92))}', 'g')"
    return c


@query(f"SELECT doc_id AS id, {_redacted('text')} AS text FROM documents WHERE text IS NOT NULL AND {_redacted('text')} <> text")
def redacted_documents(spark, d):
    r = documents(spark, d).withColumn("r", X.redact("text"))
    return r.where("r <> text").select("id", F.col("r").alias("text"))


_PLANTED = ["AKIA" + "Z" * 16, "secret_key=" + "a1B2" * 10, "ghu_" + "x9" * 18, "sk-" + "y8" * 12, "AIza" + "q7" * 17 + "w", "sk_live_" + "p6" * 9, "token: " + "z" * 18, "Bearer " + "b" * 18, "mysql://u:pw@h/d", "nothing"]
_SAMPLE = "list_value(" + ", ".join(f"'{x}'" for x in _PLANTED) + ")[(doc_id % 10)::INT + 1]"


@query(f"SELECT doc_id AS id, {_redacted('t')} AS text FROM (SELECT doc_id, text || ' ' || {_SAMPLE} || ' end' AS t FROM documents WHERE text IS NOT NULL)")
def redacted_secrets(spark, d):
    """Every document with a secret planted at its end, redacted."""
    planted = F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, _PLANTED)), (F.col("id") % 10).cast("int") + 1), F.lit("end"))
    return documents(spark, d).select("id", X.redact(planted).alias("text"))


def file_lines(spark, d):
    """Lines of the newest generation's files: path, line, text."""
    from codeweft.operators.snapshots import current_files, newest_generation

    now = current_files(table(spark, d, "files"), newest_generation(table(spark, d, "generations")), ["content"]).where("content is not null")
    return now.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


_LINES = """WITH g AS (SELECT max(id) AS id FROM generations WHERE state = 'committed'), cf AS (SELECT path, content FROM files f JOIN g ON f.generation_id = g.id QUALIFY row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC, content DESC NULLS LAST) = 1),
  sp AS (SELECT path, string_split(content, chr(10)) AS ls FROM cf WHERE content IS NOT NULL), l AS (SELECT path, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS text FROM sp) """


@query(_LINES + "SELECT sign, count(*) AS lines FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in X.STUB_SIGNS) + " END AS sign FROM l) WHERE sign IS NOT NULL GROUP BY sign")
def stub_signs(spark, d):
    return file_lines(spark, d).select(X.stub_sign("text").alias("sign")).where("sign is not null").groupBy("sign").agg(F.count(F.lit(1)).alias("lines"))


@query(_LINES + "SELECT path, count(*) AS lines, count(*) FILTER (length(trim(text)) > 0 AND NOT regexp_matches(trim(text), '^(#|//|/\\*|\\*)')) AS code FROM l GROUP BY path")
def code_lines(spark, d):
    return file_lines(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(X.is_code_line("text").cast("long")).alias("code"))


@query("SELECT doc_id, ref, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z_]+/[a-z_]+\\.(?:py|js|ts|go)')) AS ref FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def document_code_refs(spark, d):
    """References of documents to code files."""
    refs = F.explode(F.regexp_extract_all("text", F.lit(r"([a-z_]+/[a-z_]+\.(?:py|js|ts|go))"), F.lit(1)))
    return documents(spark, d).select(F.col("id").alias("doc_id"), refs.alias("ref")).groupBy("doc_id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT kind, count(*) AS claims, count(DISTINCT id) AS documents FROM (SELECT id, CASE WHEN regexp_matches(s, '" + X.HEDGES + "') THEN NULL "
    + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in X.CLAIMS)
    + " END AS kind FROM (SELECT doc_id AS id, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')) AS s FROM documents WHERE text IS NOT NULL) WHERE trim(s) <> '') WHERE kind IS NOT NULL GROUP BY kind"
)
def claim_counts(spark, d):
    s = documents(spark, d).select("id", F.explode(X.sentences("text")).alias("s"))
    k = s.select("id", X.claim_kind("s").alias("kind")).where("kind is not null")
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("id").alias("documents"))


@query("SELECT doc_id AS id, round(((contains(lower(text), 'gate')::INT + contains(lower(text), 'cache')::INT) / 2.0 * 0.6 + contains(lower(text), 'ledger')::INT * 0.3 + (NOT contains(lower(text), 'todo'))::INT * 0.2) / 1.1, 6) AS score FROM documents WHERE text IS NOT NULL")
def term_coverage(spark, d):
    return documents(spark, d).select("id", F.round(X.term_coverage("text", ("gate", "cache"), ("ledger",), ("TODO",)), 6).alias("score"))
