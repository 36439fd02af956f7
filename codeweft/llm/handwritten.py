"""Generated, minified and vendored source files, and data blobs saved as code.

Grammars at two levels. Within a file, Re-Pair over the token shapes gives the share of the file
that its grammar needs: generated accessors, minified bundles and tables reuse few rules, which
hand-written code never does to that degree; a literal whose own grammar does not compress is a
blob. Across the corpus, Re-Pair over lines replaces pairs that occur in more than one repository,
round by round; a file made of long rules shared across repositories is a vendored copy. Last,
marks (words of a line, of a comment, of the path) that several repositories share and that hardly
occur outside files found so far flag the files too short to be found by their own grammar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.ids import language_of, repository
from codeweft.llm.repair import grammars
from codeweft.operators.skew import HOT_SHARE, join_on_skewed, union_all
from codeweft.operators.snapshots import current_files, newest_generation
from codeweft.session import Scratch

#: Rounds of the corpus grammar; a rule of round r spans up to 2**r lines.
ROUNDS = 5
#: Lines of a rule that shows a copy, and the share of a file's lines that such rules must cover.
LONG_RULE, VENDORED = 7, 0.4
#: Letters of a mark, makes (copies of one file count once) that carry it, and the share of them that must have been found.
MARK_LETTERS, MARK_MAKES, MARK_SHARE, MAKE_LINES = 4, 8, 0.75, 4
#: A file whose grammar is smaller than this share of its tokens is machine-made: code, code almost
#: without white space (less than DENSE of its characters), and JSON.
REUSE, REUSE_DENSE, REUSE_JSON = 0.25, 0.42, 0.315
DENSE = 0.1
#: Tokens below which the share says nothing.
LEAST_TOKENS = 40
#: Literals of at least PIECE characters without white space are data; a file's data of at least BLOB_CHARS
#: characters, of which their grammar keeps BLOB_KEEPS, are a blob.
PIECE, BLOB_CHARS, BLOB_KEEPS = 40, 160, 0.6
#: Share of a file's text that its blobs must make up.
BLOB_SHARE = 0.4
TOKEN = re.compile(
    r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
    r"|//[^\n]*|#[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|[^\W\d][\w$]*|\d[\w.]*|[^\s\w]",
    re.S,
)
#: Words of the languages that keep their own shape.
KEYWORDS = frozenset(
    """and as async await break case class const continue def default defer del elif else except export extends false
    finally for from func function go if implements import in interface is lambda let map new nil none not null or
    package pass raise range return select self static struct super switch this throw true try type var while with
    yield None True False""".split()
)
FEATURES = "file long, path string, repository string, tokens long, grammar long, uses long, blob_chars long, chars long, spaces long, lines array<long>, make long, marks array<long>"


def _shape(lexeme: str) -> str:
    c = lexeme[0]
    if c in "\"'`":
        return "S"
    if c.isdigit():
        return "N"
    if (c == "#" and len(lexeme) > 1) or lexeme[:2] in ("//", "/*"):
        return "C"
    if c.isalpha() or c == "_":
        return lexeme if lexeme in KEYWORDS else "I"
    return lexeme


def token_shapes(text: str, codes: dict[str, int], memo: dict[str, int]) -> tuple[np.ndarray, list[str]]:
    """The shapes of a text's tokens as numbers, and its data literals."""
    lexemes = TOKEN.findall(text)
    out = np.empty(len(lexemes), np.int64)
    for i, x in enumerate(lexemes):
        v = memo.get(x)
        if v is None:
            v = codes.setdefault(_shape(x), len(codes) + 1)
            if len(x) < 40 and len(memo) < 200_000:
                memo[x] = v
        out[i] = v
    return out, [x for x in lexemes if len(x) >= PIECE and (x[0] in "\"'`" or len(x) >= 4 * BLOB_CHARS) and len(x.split()) == 1]


def line_symbols(text: str) -> list[int]:
    """The terminals of the corpus grammar: lines without white space, those of under 4 characters left out."""
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in ("".join(line.split()) for line in text.splitlines()) if len(x) > 3]


_LETTERS = re.compile(r"[^\W\d_]+")


def marks(text: str, path: str) -> list[int]:
    """Hashes of what a file shares with others of its make: the words of each line, three neighbouring words of its comments, its directories."""
    out = {f"/{x}" for x in path.lower().split("/")[1:-1]}
    for line in text.splitlines():
        w = _LETTERS.findall(line.lower())
        if sum(map(len, w)) >= MARK_LETTERS:
            out.add(" ".join(w))
            x = line.strip()
            if x[:1] in ("#", "*") or x[:2] in ("//", "/*"):
                out.update("#" + " ".join(w[i : i + 3]) for i in range(len(w) - 2))
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in out]


def file_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes: dict[str, int] = {}
    memo: dict[str, int] = {}
    for pdf in batches:
        for at in range(0, len(pdf), 400):
            part = pdf.iloc[at : at + 400]
            shapes, blob_seqs, blob_of = [], [], []
            for i, text in enumerate(part["content"]):
                s, long = token_shapes(text, codes, memo)
                shapes.append(s)
                data = "".join(x.strip("\"'`") for x in long)
                if len(data) >= BLOB_CHARS:
                    blob_seqs.append(np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
                    blob_of.append(i)
            final, rules, uses = grammars(shapes)
            blob = np.zeros(len(part), np.int64)
            if blob_seqs:
                f, r, _ = grammars(blob_seqs)
                for i, n, size in zip(blob_of, map(len, blob_seqs), f + 2 * r):
                    if size >= BLOB_KEEPS * n:
                        blob[i] += n
            yield pd.DataFrame({
                "file": part["file"].to_numpy(), "path": part["path"].to_numpy(), "repository": part["repository"].to_numpy(),
                "tokens": [len(s) for s in shapes], "grammar": final + 2 * rules, "uses": uses,
                "blob_chars": blob, "chars": [len(t) for t in part["content"]],
                "spaces": [len(t) - len("".join(t.split())) for t in part["content"]],
                "lines": (lines := [line_symbols(t) for t in part["content"]]),
                "make": [xxhash.xxh64_intdigest(repr(sorted(set(x))[:MAKE_LINES])) - (1 << 63) for x in lines],
                "marks": [marks(t, p) for t, p in zip(part["content"], part["path"])],
            })


def replace_pairs(seq: np.ndarray, spans: np.ndarray, pairs: np.ndarray, counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """One round of Re-Pair in one file: shared pairs give way to their rule, the more frequent ones first, none overlapping."""
    times = [counts.get(h, 0) for h in pairs.tolist()]
    free, taken = [True] * len(seq), set()
    for i in sorted((i for i, n in enumerate(times) if n), key=lambda i: (-times[i], pairs[i], i)):
        if free[i] and free[i + 1]:
            free[i] = free[i + 1] = False
            taken.add(i)
    out, size, i = [], [], 0
    while i < len(seq):
        if i in taken:
            out.append(int(pairs[i]))
            size.append(int(spans[i] + spans[i + 1]))
            i += 2
        else:
            out.append(int(seq[i]))
            size.append(int(spans[i]))
            i += 1
    return out, size


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [replace_pairs(s, n, h, dict(zip(k, c))) for s, n, h, k, c in zip(pdf["seq"], pdf["spans"], pdf["pairs"], pdf["known"], pdf["counts"])]
        yield pd.DataFrame({"file": pdf["file"].to_numpy(), "repository": pdf["repository"].to_numpy(), "seq": [g[0] for g in got], "spans": [g[1] for g in got]})


def shared_cover(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Lines of each file that long rules of the corpus grammar cover: file, covered; ``files`` has file, repository, lines.

    A rule is a pair of neighbouring symbols that occurs in more than one repository; its hash is
    the new symbol, so that equal stretches get equal rules wherever they stand. Files without a
    shared pair drop out. Frequent pairs are counted map-side and met by broadcast, at most 1,000.
    """
    current = files.where(F.size("lines") > 1).select("file", "repository", F.col("lines").alias("seq"), F.transform("lines", lambda x: F.lit(1)).alias("spans"))
    covered = []
    for _ in range(ROUNDS):
        n = F.size("seq")
        pairs = F.when(n > 1, F.zip_with(F.slice("seq", F.lit(1), n - 1), F.slice("seq", F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))
        current = current.withColumn("pairs", pairs)
        uses = current.select("file", "repository", F.explode(F.array_distinct("pairs")).alias("rule"))
        found = uses.groupBy("rule").agg(F.min("repository").alias("a"), F.max("repository").alias("b"), F.count(F.lit(1)).alias("n"))
        rules = scratch.save(found.where("a <> b").select("rule", "n"))
        total = current.agg(F.sum(F.size("pairs"))).first()[0] or 0
        hot = [r["rule"] for r in rules.where(F.col("n") >= F.lit(max(1, total * HOT_SHARE))).select("rule").collect()]
        known = join_on_skewed(uses.select("file", "rule"), rules, "rule", hot=hot).groupBy("file").agg(F.collect_list("rule").alias("known"), F.collect_list("n").alias("counts"))
        met = current.hint("merge").join(known.withColumnRenamed("file", "_f").hint("merge"), F.col("file") == F.col("_f"), "left")
        # a file without a shared pair has its last form
        last = met.where("_f is null").select("file", "spans")
        covered.append(last)
        current = scratch.save(met.where("_f is not null").select("file", "repository", "seq", "spans", "pairs", "known", "counts").mapInPandas(_replace, "file long, repository string, seq array<long>, spans array<int>"))
    covered.append(current.select("file", "spans"))
    long = F.aggregate(F.filter("spans", lambda x: x >= LONG_RULE), F.lit(0), lambda a, x: a + x)
    return union_all([c.select("file", long.alias("covered")) for c in covered])


def telling_files(files: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Files with a mark that tells: file. ``files`` has file, repository, make, marks; ``found`` has file, for those found so far.

    A mark tells when more than one repository and at least MARK_MAKES makes of files have it and at
    least MARK_SHARE of these makes have been found by their grammar. Files with the same MAKE_LINES
    least line symbols are one make, so that copies of one file are no evidence beyond the first.
    """
    known = files.hint("merge").join(found.select("file", F.lit(1).alias("_found")).hint("merge"), "file", "left")
    uses = scratch.save(known.select("file", "repository", F.coalesce("_found", F.lit(0)).alias("_found"), "make", F.explode("marks").alias("mark")))
    makes = uses.groupBy("mark", "make").agg(F.min("repository").alias("a"), F.max("repository").alias("b"), F.max("_found").alias("k"), F.min("_found").alias("all"), F.count(F.lit(1)).alias("rows"))
    per = makes.groupBy("mark").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.min("all").alias("all"), F.sum("rows").alias("rows"))
    telling = scratch.save(per.where((F.col("a") != F.col("b")) & (F.col("n") >= MARK_MAKES) & (F.col("k") >= F.col("n") * MARK_SHARE) & (F.col("all") == 0)).select("mark", "rows"))
    total = uses.count()
    hot = [r["mark"] for r in telling.where(F.col("rows") >= F.lit(max(1, total * HOT_SHARE))).select("mark").collect()]
    return join_on_skewed(uses.where("_found = 0").select("file", "mark"), telling.select("mark"), "mark", hot=hot).select("file").distinct()


def classify_files(files: DataFrame) -> DataFrame:
    """Why a file is not hand-written: path, repository, reason (null for hand-written source) and figures.

    ``files`` has path and content, one row per path; rows with a null in either are left out and
    other columns are ignored. Empty and very short files are hand-written unless a mark tells
    otherwise. Whole contents are read. Reasons, the first that holds: ``vendored`` (long rules
    shared across repositories), ``blob`` (incompressible literal), ``repetitive`` (rule reuse:
    generated, minified or bulk data), ``marked`` (shares a mark that hardly any other file has).
    """
    scratch = Scratch(files.sparkSession, "handwritten")
    rows = files.where("path is not null and content is not null").select(F.monotonically_increasing_id().alias("file"), "path", repository("path").alias("repository"), "content")
    features = scratch.save(rows.mapInPandas(file_features, FEATURES))
    cover = shared_cover(features.select("file", "repository", "lines"), scratch)
    reuse = F.when(F.lower("path").endswith(".json"), REUSE_JSON).when(F.col("spaces") < F.col("chars") * DENSE, REUSE_DENSE).otherwise(REUSE)
    covered = F.coalesce("covered", F.lit(0)) / F.greatest(F.size("lines"), F.lit(1))
    reason = (
        F.when(covered >= VENDORED, "vendored")
        .when(F.col("blob_chars") >= F.col("chars") * BLOB_SHARE, F.when(F.col("blob_chars") > 0, "blob"))
        .when((F.col("tokens") >= LEAST_TOKENS) & (F.col("grammar") < F.col("tokens") * reuse), "repetitive")
    )
    first = features.hint("merge").join(cover.withColumnRenamed("file", "_f").hint("merge"), F.col("file") == F.col("_f"), "left").select(
        "file", "path", "repository", reason.alias("_reason"), "tokens",
        F.round(F.col("grammar") / F.greatest(F.col("tokens"), F.lit(1)), 4).alias("grammar_share"),
        F.round(covered, 4).alias("shared_share"), "blob_chars", "chars",
    )
    first = scratch.save(first)
    told = telling_files(features.select("file", "repository", "make", "marks"), first.where("_reason is not null"), scratch).withColumn("_told", F.lit("marked"))
    joined = first.hint("merge").join(told.hint("merge"), "file", "left")
    return joined.select("path", "repository", F.coalesce("_reason", "_told").alias("reason"), "tokens", "grammar_share", "shared_share", "blob_chars", "chars")


def newest_contents(files: DataFrame, generations: DataFrame) -> DataFrame:
    """Current contents of the newest committed generation: path, language, content (not null)."""
    now = current_files(files, newest_generation(generations), ["content", "language"])
    return now.where("content is not null").select("path", language_of("language", "path").alias("language"), "content")
