"""Queries of the text, source-file and vector problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import garbled as GA
from codeweft.llm import handwritten as HW
from codeweft.llm import leaks as LE
from codeweft.llm import neighbours as NE
from codeweft.llm import parsing as PA
from codeweft.llm import tokenize as TO

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return HW.newest_contents(table(spark, d, "files"), table(spark, d, "generations"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return HW.classify_files(_contents(spark, d)).where("reason is not null").select("path")


@query
def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    found = HW.classify_files(_contents(spark, d))
    return found.groupBy("repository", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return NE.similar_pairs(table(spark, d, "symbol_vectors")).select("node_id_a", "node_id_b")


@query
def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every vector, however far they are."""
    return NE.similar_pairs(table(spark, d, "symbol_vectors"), least=float("-inf")).select("node_id_a", "node_id_b", F.round("cosine", 4).alias("cosine"))


@query
def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p4_found's index against brute force and the share of vectors it compares, by model."""
    return NE.index_quality(table(spark, d, "symbol_vectors"))


@query
def p4_recall_far(spark: SparkSession, d: str) -> DataFrame:
    """The same for p4_pairs, whose neighbours may be however far."""
    return NE.index_quality(table(spark, d, "symbol_vectors"), least=float("-inf"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return PA.parse_files(_contents(spark, d)).where("valid = false").select("path")


@query
def p7_errors(spark: SparkSession, d: str) -> DataFrame:
    return PA.parse_files(_contents(spark, d)).where("valid = false").select("path", "language", "n_errors", "first_cause", "first_line")


@query
def p7_all_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every file, in the order of the text."""
    listed = PA.parse_files(_contents(spark, d)).where("valid = false").select("path", "language", F.posexplode("errors").alias("number", "e"))
    return listed.select("path", "language", "number", "e.line", "e.message")


@query
def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return PA.acceptance(PA.parse_files(_contents(spark, d)))


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return TO.encode_corpus(table(spark, d, "documents"))


@query
def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return TO.decode_corpus(TO.encode_corpus(table(spark, d, "documents")))


ORACLES["p8_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = LE.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.where(F.col("word_share") >= LE.LEAST).select("doc_id", "item_id")


@query
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    leaks = LE.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("word_share").alias("word_share"), F.max("template_share").alias("template_share"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return GA.find_garbled(table(spark, d, "documents")).select("doc_id")


@query
def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    found = GA.find_garbled(table(spark, d, "documents"))
    return found.select("doc_id", F.array_join("trips", ", ").alias("trips"), "lost", "reason", "repaired")


@query
def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Documents by what shows that they are garbled, and whether all of the original came back."""
    found = GA.find_garbled(table(spark, d, "documents"))
    return found.groupBy("reason", "lost").agg(F.count(F.lit(1)).alias("documents"))
