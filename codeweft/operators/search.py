"""Text search and vectors: ranked search, hash embeddings, exact top-k, cache gates, chunks, selection."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import tokens
from codeweft.session import Scratch

K1, B = 1.2, 0.75
_EMBEDDED = re.compile(r"[^a-z0-9_]+")


def postings(docs: DataFrame) -> DataFrame:
    """Inverted index of (id, text): id, term, tf, length."""
    words = docs.select("id", tokens("text").alias("ws")).select("id", F.size("ws").alias("length"), F.explode("ws").alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Documents that hold every term: id, score (negative, best first), by Okapi weights.

    Only postings of the query's terms take part beyond the count of all documents and lengths.
    """
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    # texts are cut into words once; only counts of the query's words go on
    want = F.array(*map(F.lit, terms)).cast("array<string>")
    cut = docs.select("id", tokens("text").alias("ws")).select("id", F.size("ws").alias("length"), F.filter("ws", lambda w: F.array_contains(want, w)).alias("own"))
    cut = Scratch(docs.sparkSession, "bm25").save(cut)
    size = cut.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    found = cut.select(F.explode(F.array_distinct("own")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = cut.where(F.size(F.array_distinct("own")) == len(terms)).select("id", "length", F.explode("own").alias("term")).groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = tf.join(F.broadcast(found), "term").crossJoin(F.broadcast(size)).groupBy("id").agg((-F.sum(weight)).alias("score"))
    return scored.orderBy("score", "id").limit(limit) if limit else scored


def substring_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Fallback search: ids of texts that hold the query in any letter case, by id."""
    return docs.where(F.lower("text").contains(query.lower())).select("id").orderBy("id").limit(limit)


def _hash_embedding(texts: pd.Series) -> pd.Series:
    memo: dict[str, np.ndarray] = {}
    out = []
    for text in texts:
        v = np.zeros(32)
        for t in _EMBEDDED.split((text or "").lower()):
            if len(t) > 1:
                h = memo.get(t)
                if h is None:
                    h = memo[t] = (np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8).astype(np.float64) - 128) / 128
                v += h
        v = np.concatenate((v, v))
        n = float(np.sqrt(v @ v))
        out.append(v / n if n else v)
    return pd.Series(out)


def hash_embedding(text: Column | str) -> Column:
    """64 numbers of unit length from the SHA-256 of the tokens: entry i sums (byte i mod 32 - 128) / 128.

    An Arrow function: nested lambdas in the JVM would hash every token once a dimension.
    """
    return F.pandas_udf(_hash_embedding, "array<double>")(text)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k most similar vectors of each query by exact cosine: query_id, id, cosine.

    ``vectors`` and ``queries`` have id and vec; a vector is not its own neighbour. Blocks of
    queries meet blocks of vectors, so neither side is held whole anywhere.
    """
    nq, nv = max(1, math.ceil(queries.count() / block)), max(1, math.ceil(vectors.count() / block))
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"), F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"))
    v = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        x, y = (np.stack([np.asarray(z, np.float64) for z in col]) for col in (a["q"], b["vec"]))
        s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
        ids, asked = b["id"].to_numpy(), a["query_id"].to_numpy()
        s[asked[:, None] == ids[None, :]] = -2
        n = min(k, len(ids))
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        rows = np.repeat(np.arange(len(asked)), n)
        out = pd.DataFrame({"query_id": asked[rows], "id": ids[best.ravel()], "cosine": s[rows, best.ravel()]})
        return out[out["cosine"] > -2]

    met = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(compare, "query_id long, id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


#: Gates of the semantic cache.
OUT_OF_DOMAIN, SIMILAR, MARGIN = 0.75, 0.92, 0.03


def cache_gates(neighbours: DataFrame, labels: DataFrame, similar: float = SIMILAR, out_of_domain: float = OUT_OF_DOMAIN, margin: float = MARGIN) -> DataFrame:
    """What a cache would answer, from top-k lists: query_id, outcome, cosine.

    Gates in order: empty, out of domain, below the threshold, too near to the second, other intent.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    ranked = neighbours.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("cosine").over(w)).where("k = 1")
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("intent"))
    hit = labels.select("id", F.col("label").alias("found"))
    joined = own.join(ranked, "query_id", "left").join(hit, "id", "left")
    outcome = (
        F.when(F.col("cosine").isNull(), "empty").when(F.col("cosine") < out_of_domain, "out_of_domain").when(F.col("cosine") < similar, "below_threshold")
        .when(F.col("cosine") - F.col("second") < margin, "ambiguous").when(F.col("intent") != F.col("found"), "intent_mismatch").otherwise("hit")
    )
    return joined.select("query_id", outcome.alias("outcome"), F.round("cosine", 5).alias("cosine"))


def tuned_threshold(judged: DataFrame, last: int = 1000, least_labels: int = 20, worst: float = 0.001) -> DataFrame:
    """The cache threshold that recent judgements allow: threshold, labels.

    ``judged`` has at, cosine, wrong (boolean). Over the ``last`` rows by time, the highest value
    from 0.98 down to 0.85 by 0.005 with enough labels at or above it, of which no more than the
    share ``worst`` is wrong; 0.85 where none is; 0.98 with too few rows.
    """
    recent = judged.orderBy(F.desc("at")).limit(last)
    grid = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.round(F.lit(0.98) - i * F.lit(0.005), 3))
    tried = recent.select("cosine", "wrong", F.explode(grid).alias("t"))
    rated = tried.groupBy("t").agg(F.count(F.when(F.col("cosine") >= F.col("t"), 1)).alias("n"), F.avg(F.when(F.col("cosine") >= F.col("t"), F.col("wrong").cast("double"))).alias("rate"))
    best = rated.where((F.col("n") >= least_labels) & (F.col("rate") <= worst)).agg(F.max("t").alias("best"))
    total = recent.agg(F.count(F.lit(1)).alias("labels"))
    return total.crossJoin(F.broadcast(best)).select(F.when(F.col("labels") < least_labels, F.lit(0.98)).otherwise(F.coalesce("best", F.lit(0.85))).alias("threshold"), "labels")


def chunks(docs: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """Windows of ``size`` words that overlap: id, chunk, start (word), words, text."""
    ws = F.filter(F.split("text", r"[ \t\r\n\f\v]+"), lambda w: w != "")
    step = max(1, size - overlap)
    d = docs.select("id", ws.alias("ws")).where(F.size("ws") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("ws") - size) / F.lit(step))).cast("int")
    cut = d.select("id", "ws", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).withColumn("start", F.col("chunk") * step)
    part = F.slice("ws", F.col("start") + 1, F.lit(size))
    return cut.select("id", "chunk", "start", F.size(part).alias("words"), F.concat_ws(" ", part).alias("text"))


def mmr(candidates: DataFrame, k: int = 8, trade: float = 0.7, least: float = 0.35, budget: int = 2048) -> DataFrame:
    """Maximal marginal relevance per query under a token budget: query_id, id, rank.

    ``candidates`` has query_id, id, score, vec, tokens. Choices depend on earlier ones, so each
    query's candidates (a bounded top-k list) are one group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"] >= least].sort_values(["score", "id"], ascending=[False, True], kind="stable")
        x = [np.asarray(v, np.float64) for v in pdf["vec"]]
        x = [v / (np.linalg.norm(v) or 1) for v in x]
        chosen: list[int] = []
        left, used = list(range(len(pdf))), 0
        scores, sizes = pdf["score"].to_numpy(), pdf["tokens"].to_numpy()
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (trade * scores[i] - (1 - trade) * max((float(x[i] @ x[j]) for j in chosen), default=0.0), -i))
            left.remove(best)
            if used + sizes[best] <= budget:
                chosen.append(best)
                used += sizes[best]
        return pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[chosen], "id": pdf["id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, id long, rank int")


#: Simple queries, and patterns of hard ones and of code.
ANCHORS = ("hello", "what time is it", "define photosynthesis", "translate hello to french", "what is 2 plus 2")
HARD_WORDS = r"(?i)\b(implement|architect|refactor|debug|optimize|prove|derive|multi.?step|recursive|distributed|benchmark|sql|regex|algorithm)\b"
CODE_SIGNS = r"```|<code>|def |class |function\s*\(|import "
#: Weights of length, structure, dispersion and domain, and the score from which the large tier answers.
ROUTE_WEIGHTS, LARGE_FROM = (0.25, 0.30, 0.25, 0.20), 0.45


def route(queries: DataFrame) -> DataFrame:
    """Complexity and tier of (id, text): id, complexity (4 decimals), tier, intent; the embedder is the hash embedding."""
    t = F.col("text")
    length = F.least(F.lit(1.0), F.size(F.filter(F.split(t, r"[ \t\r\n\f\v]+"), lambda w: w != "")) / 512.0)
    marks = F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    structure = F.least(F.lit(1.0), F.when(t.rlike(HARD_WORDS), 0.6).otherwise(0.0) + F.when(t.rlike(CODE_SIGNS), 0.4).otherwise(0.0) + F.when((marks > 1) | t.contains("\n"), 0.2).otherwise(0.0))
    fixed = [F.array(*[F.lit(float(x)) for x in v]) for v in _hash_embedding(pd.Series(ANCHORS))]
    e = queries.select("id", "text", hash_embedding("text").alias("e"))
    apart = 1 - F.greatest(*[dot("e", a) for a in fixed])
    w = ROUTE_WEIGHTS
    score = F.lit(w[0]) * length + F.lit(w[1]) * structure + F.lit(w[2]) * apart
    scored = e.select("id", "text", F.round(score, 4).alias("complexity"))
    intent = F.when(t.rlike(CODE_SIGNS), "code").when(F.col("complexity") >= 0.6, "reasoning").when(t.contains("?"), "qa").otherwise("general")
    return scored.select("id", "complexity", F.when(F.col("complexity") < LARGE_FROM, "small").otherwise("large").alias("tier"), intent.alias("intent"))
