"""One answer about a name: matches, their text, neighbours and what depends on them; and file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.symbols import match_symbols
from codeweft.session import Scratch
from codeweft.sources.graph import file_of, is_file_node, metric_edges

#: Neighbours listed, matches, steps of the impact, lines of a snippet.
NEIGHBOURS, MATCHES, STEPS, SNIPPET = 50, 20, 3, 12


def match_exact_case(nodes: DataFrame, query: str) -> DataFrame:
    """Case-sensitive match in one tier: ids equal to the query, with that path or name, holding it, or ending in it."""
    q = F.lit(query)
    hit = (F.col("id") == q) | (F.coalesce("path", F.lit("")) == q) | (F.coalesce("name", F.lit("")) == q) | F.col("id").contains(query) | F.coalesce("path", F.lit("")).endswith(query)
    return nodes.where(hit).select("id")


def first_neighbours(edges: DataFrame, found: DataFrame, own: str, other: str, cap: int = NEIGHBOURS) -> DataFrame:
    """The first ``cap`` neighbours by id of each found id: id, ends. Cut by a ranked window, which keeps ``cap`` rows a task."""
    ends = edges.select(F.col(own).alias("id"), F.col(other).alias("end")).join(F.broadcast(found.select("id")), "id").distinct()
    w = Window.partitionBy("id").orderBy("end")
    return ends.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).groupBy("id").agg(F.sort_array(F.collect_list("end")).alias("ends"))


def impact_sizes(edges: DataFrame, found: DataFrame, steps: int = STEPS) -> DataFrame:
    """How many ids depend on each found id within ``steps`` metric edges: id, impact.

    All found ids walk at once, keyed by where they began; ``found`` is a bounded list.
    """
    scratch = Scratch(edges.sparkSession, "explore")
    links = scratch.save(metric_edges(edges).select(F.col("target").alias("src"), F.col("source").alias("dst")).distinct())
    seen = scratch.save(found.select("id", F.col("id").alias("at")))
    frontier = seen
    for _ in range(steps):
        step = frontier.hint("merge").join(links.hint("merge"), F.col("at") == F.col("src")).select("id", F.col("dst").alias("at")).distinct()
        frontier = scratch.save(step.hint("merge").join(seen.hint("merge"), ["id", "at"], "left_anti"))
        seen = scratch.save(seen.unionByName(frontier))
    return seen.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("impact"))


def snippets(found: DataFrame, contents: DataFrame, lines: int = SNIPPET) -> DataFrame:
    """The first lines of each found symbol's text: id, snippet; ``found`` has id, path, line, end_line."""
    last = F.least(F.greatest("end_line", "line"), F.col("line") + (lines - 1))
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("line"), last - F.col("line") + 1), "\n")
    return contents.join(F.broadcast(found.where("line > 0").select("id", "path", "line", "end_line")), "path").select("id", text.alias("snippet"))


def explore(nodes: DataFrame, edges: DataFrame, contents: DataFrame, query: str, limit: int = MATCHES) -> DataFrame:
    """Matches with everything around them: id, tier, snippet, inbound, outbound, impact.

    At most ``limit`` matches (exact ones first, then graph order); neighbours are sorted and cut to
    NEIGHBOURS; impact counts the dependents within STEPS metric edges.
    """
    found = Scratch(nodes.sparkSession, "explore").save(match_symbols(nodes, query, limit).select("id", "tier").join(nodes.select("id", "path", "line", "end_line"), "id"))
    parts = [
        snippets(found, contents), first_neighbours(edges, found, "target", "source").withColumnRenamed("ends", "inbound"),
        first_neighbours(edges, found, "source", "target").withColumnRenamed("ends", "outbound"), impact_sizes(edges, found),
    ]
    out = found.select("id", "tier")
    for p in parts:
        out = out.join(p, "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", "tier", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("inbound", none).alias("inbound"), F.coalesce("outbound", none).alias("outbound"), "impact")


#: Families of languages by extension.
FAMILIES = {"py": "python", "pyi": "python", "js": "ecma", "jsx": "ecma", "mjs": "ecma", "cjs": "ecma", "ts": "ecma", "tsx": "ecma", "mts": "ecma", "cts": "ecma", "go": "go", "rs": "rust", "json": "data", "toml": "data", "yaml": "data", "yml": "data"}


def _in(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def file_kind(path: str) -> Column:
    """What a file is for, by its path: test, doc, config, data or source."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(^|/)(tests?|__tests__|spec)/") | p.rlike(r"(^|/)(test_[^/]*|[^/]*(_test|\.test|\.spec)\.[a-z]+|conftest\.py)$"), "test")
        .when(p.rlike(r"\.(md|rst|txt)$") | p.rlike(r"(^|/)docs?/"), "doc")
        .when(p.rlike(r"\.(toml|ini|cfg|ya?ml)$") | p.rlike(r"(^|/)[^/]*(config|settings)[^/]*$"), "config")
        .when(p.rlike(r"\.(json|csv|parquet)$"), "data").otherwise("source")
    )


def file_facts(files: DataFrame) -> DataFrame:
    """Kind, language family and area (the first one or two directories) of each path: path, kind, family, area."""
    parts = F.split("path", "/")
    area = F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2))).when(F.size(parts) == 2, parts[0]).otherwise(F.lit(""))
    family = F.coalesce(_in(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), FAMILIES), F.lit("other"))
    return files.select("path").where("path is not null").distinct().select("path", file_kind("path").alias("kind"), family.alias("family"), area.alias("area"))


def common_directories(files: DataFrame) -> DataFrame:
    """The longest directory that all files of a repository share: repository, root.

    It is the common prefix of the least and the greatest directory, which two aggregates give.
    """
    folder = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    ends = files.where("path is not null").groupBy(F.substring_index("path", "/", 1).alias("repository")).agg(F.min(folder).alias("a"), F.max(folder).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return ends.select("repository", F.concat_ws("/", F.slice("a", 1, F.array_max(same))).alias("root"))


def ranked_area_files(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """The files to read first in each area: area, path, rank, importers.

    By importing files, then names that programs start from, then path.
    """
    links = edges.where("kind = 'imports'").select(file_of("source").alias("a"), file_of("target").alias("path")).where("a <> path").distinct()
    degree = links.groupBy("path").agg(F.count(F.lit(1)).alias("importers"))
    files = nodes.where(is_file_node() & F.col("area").isNotNull()).select("area", F.col("id").alias("path"))
    entry = F.when(F.regexp_extract(F.lower("path"), r"([^/.]+)[^/]*$", 1).isin("__main__", "main", "index", "app", "cli"), 0).otherwise(1)
    w = Window.partitionBy("area").orderBy(F.desc("importers"), entry, "path")
    ranked = files.hint("merge").join(degree.hint("merge"), "path", "left").withColumn("importers", F.coalesce("importers", F.lit(0))).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top).select("area", "path", "rank", "importers")


def path_candidates(files: DataFrame, goal: str, top: int = 10) -> DataFrame:
    """Paths that hold words of a goal: path, score; score and path both descending, the first ``top``."""
    words = sorted({w for w in goal.lower().replace("_", " ").split() if len(w) > 2})
    score = sum((F.lower("path").contains(w).cast("int") for w in words), F.lit(0))
    return files.select("path").distinct().select("path", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("path")).limit(top)


def capped(rows: DataFrame, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows with how many there are in all: order column, total, shown, truncated."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    first = rows.select(order).orderBy(order).limit(cap)
    return first.crossJoin(F.broadcast(total)).select(order, "total", F.least("total", F.lit(cap)).alias("shown"), (F.col("total") > cap).alias("truncated"))


def digest(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """An order-free digest per group: by columns, rows, digest.

    The exclusive-or of the leading 52 bits of each row's SHA-256, with the number of rows: mergeable
    map-side, so that no group is gathered to be sorted.
    """
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")
    return rows.select(*by, bits.alias("_b")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("_b").alias("digest"))


def query_key(text: str) -> Column:
    """The cache key of a query: SHA-256 of its lower-case text with white space in one form."""
    return F.sha2(F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), 256)


def live_entries(entries: DataFrame, now: Column, ttl_seconds: int, keep: int) -> DataFrame:
    """Cache entries (key, created, accessed) that have not expired, the ``keep`` used last: key, accessed."""
    fresh = entries.where(F.unix_micros(now) - F.unix_micros("created") <= ttl_seconds * 1_000_000)
    return fresh.select("key", "accessed").orderBy(F.desc("accessed"), "key").limit(keep)


def top_level_imports(lines: DataFrame) -> DataFrame:
    """The package an import statement names first: path, package; ``lines`` has path and text. Relative imports have none."""
    name = F.coalesce(
        F.nullif(F.regexp_extract("text", r"^\s*from\s+([A-Za-z_]\w*)[\w.]*\s+import\b", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"^\s*import\s+([A-Za-z_]\w*)[\w.]*(?:\s+as\s+\w+)?\s*(?:,.*)?$", 1), F.lit("")),
        F.nullif(F.regexp_extract("text", r"""^\s*(?:import|export)\b.*\bfrom\s+['"]([^'"./][^'"/]*)""", 1), F.lit("")),
    )
    return lines.select("path", name.alias("package")).where("package is not null").distinct()
