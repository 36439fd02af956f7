"""Resolving names and paths to files and symbols, and what depends on a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import join_on_skewed
from codeweft.operators.traversal import inbound, layers
from codeweft.sources.graph import file_of, is_test_path, metric_edges


def module_suffixes(files: DataFrame) -> DataFrame:
    """Every dotted suffix of a file's module that names one file only: suffix, path."""
    module = F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), r"/(__init__|index)$", "")
    parts = F.split(module, "/")
    s = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    return s.groupBy("suffix").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n")).where("n = 1").drop("n")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (path, name) to files: path, name, target. The name is cut from the right until a suffix matches."""
    names = imports.select("path", "name").distinct()
    parts = F.split(F.regexp_replace(F.regexp_replace("name", r"^(\.+/)+", ""), "/", "."), r"\.")
    tries = names.select("path", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("k"), F.array_join(F.slice(parts, 1, i), ".").alias("suffix")))).alias("t"))
    hit = tries.select("path", "name", "t.k", "t.suffix").join(module_suffixes(files).withColumnRenamed("path", "target"), "suffix")
    return hit.where("target <> path").groupBy("path", "name").agg(F.max_by("target", "k").alias("target"))


def ancestor_packages(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Existing package files of all directories above a path: path, package."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i), F.lit("__init__.py")))).alias("package"))
    return up.where("package <> path").join(files.select(F.col("path").alias("package")).distinct(), "package", "left_semi").distinct()


def dependents(edges: DataFrame, cap: int = 8) -> DataFrame:
    """Importers of each file: path, importers (the first ``cap`` by name), total."""
    links = edges.where("kind = 'imports'").select(file_of("source").alias("a"), file_of("target").alias("path")).where("a <> path").distinct()
    w = Window.partitionBy("path").orderBy("a")
    first = links.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).groupBy("path").agg(F.sort_array(F.collect_list("a")).alias("importers"))
    return first.join(links.groupBy("path").agg(F.count(F.lit(1)).alias("total")), "path")


def changed_impact(nodes: DataFrame, edges: DataFrame, paths: DataFrame, max_depth: int = 3) -> DataFrame:
    """What changed files reach over metric edges, from the symbols in them: id, depth."""
    seeds = nodes.join(paths.select("path").distinct(), "path", "left_semi").select("id")
    return layers(inbound(metric_edges(edges)), seeds, max(1, min(3, max_depth))).where("depth > 0").select("id", "depth")


def repair_paths(planned: DataFrame, known: DataFrame) -> DataFrame:
    """Planned paths to known ones: path, repaired, how (known, basename or unknown).

    A path that is not known is repaired when its base name belongs to one known path only.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    k = known.select("path").distinct()
    only = k.groupBy(base("path").alias("b")).agg(F.min("path").alias("other"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    p = planned.select("path").distinct().withColumn("b", base("path")).join(k.withColumn("known", F.lit(True)), "path", "left").join(only, "b", "left")
    how = F.when(F.col("known"), "known").when(F.col("other").isNotNull(), "basename").otherwise("unknown")
    return p.select("path", F.when(F.col("known"), F.col("path")).otherwise(F.coalesce("other", "path")).alias("repaired"), how.alias("how"))


def unmentioned_symbols(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """Symbols whose name no other file's text and no line outside their own span mentions: id.

    ``symbols`` has id, path, name, line, end_line; ``contents`` has path, content. Tokens of all
    texts are an inverted index of (token, path, line); names meet it in one equality join.
    """
    lines = contents.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    words = lines.select(F.col("path").alias("in_path"), (F.col("at") + 1).alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("name"))
    per_file = words.groupBy("name", "in_path").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    wanted = per_file.hint("merge").join(symbols.select("name").distinct().hint("merge"), "name", "left_semi")
    # of a name only the least and the greatest file matter, so that a common name costs one row, not its occurrences
    spread = wanted.groupBy("name").agg(F.min("in_path").alias("_a"), F.max("in_path").alias("_b"))
    own = wanted.select("name", F.col("in_path").alias("path"), "first", "last")
    met = join_on_skewed(symbols.select("id", "path", "name", "line", "end_line"), spread, "name").join(own.hint("merge"), ["name", "path"], "left")
    elsewhere = (F.col("_a") != F.col("path")) | (F.col("_b") != F.col("path"))
    outside = elsewhere | (F.col("first") < F.col("line")) | (F.col("last") > F.greatest("line", "end_line"))
    return symbols.select("id").distinct().hint("merge").join(met.where(outside).select("id").hint("merge"), "id", "left_anti")


def disjoint_wave(tasks: DataFrame, size: int) -> list[str]:
    """Up to ``size`` tasks, in order, whose path sets are disjoint: first fit over (id, order, paths).

    Each choice depends on those before; tasks are read in order and reading stops when the wave is full.
    """
    chosen: list[str] = []
    taken: set[str] = set()
    for t in tasks.orderBy("order", "id").toLocalIterator():
        if len(chosen) == size:
            break
        if not taken & set(t["paths"] or ()):
            chosen.append(t["id"])
            taken |= set(t["paths"] or ())
    return chosen


def suggested_tests(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Test files whose base name fits a changed file's: path, test."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z.]+$", ""), r"^test_|_test$|\.test$|\.spec$", "")
    tests = files.where(is_test_path("path")).select(F.col("path").alias("test"), stem("path").alias("stem"))
    return paths.where(~is_test_path("path")).select("path", stem("path").alias("stem")).join(tests, "stem").select("path", "test").distinct()
