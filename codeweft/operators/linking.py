"""Typed edges: references by name resolved to symbols, and what protects symbols from being dead.

A reference is (source, name); the ladders differ in which rungs they have. Candidates are reduced
to counts, least ids and at most ``CANDIDATES`` ids per name before any join, so that a name that
thousands of symbols carry costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import join_on_skewed
from codeweft.operators.traversal import inbound, layers
from codeweft.sources.graph import file_of, is_file_node, is_test_path

#: Fixed value: candidates listed for an ambiguous name.
CANDIDATES = 8
#: Base names of files that programs start from, without extension.
ENTRY_NAMES = ("__main__", "app", "cli", "index", "main", "manage", "server", "setup", "wsgi", "asgi")
#: Directories whose files are started directly.
ENTRY_DIRS = ("bin", "cmd", "scripts")


def bare_name(c: Column | str) -> Column:
    """The last identifier of an id: the text after the last '::', '.' or '/'."""
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([A-Za-z_$0-9]+)$", 1)


def owner_of(c: Column | str) -> Column:
    """The id that a member's id starts with: the text before the last '.' after '::', null without one."""
    return F.nullif(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"^(.+::.+)\.[^.]+$", 1), F.lit(""))


def _by_name(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (id, path, name) by file and name, and by name with its first candidates."""
    local = symbols.groupBy("path", "name").agg(F.min("id").alias("local"), F.count(F.lit(1)).alias("n_local"))
    w = Window.partitionBy("name").orderBy("id")
    first = symbols.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= CANDIDATES)
    listed = first.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("candidates"))
    counted = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n_any"))
    return local, counted.hint("merge").join(listed.hint("merge"), "name")


def resolve_parents(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inheritance ladder: source, name, target, confidence, candidates.

    The only symbol of that name in the source's file (extracted), else the only one anywhere
    (inferred), else the least id (ambiguous) with the first CANDIDATES of all. Names that no symbol
    has give no row; repeated references one.
    """
    local, anywhere = _by_name(symbols)
    wanted = refs.select("source", "name").where("source is not null and name <> ''").distinct().withColumn("path", file_of("source"))
    j = join_on_skewed(wanted, anywhere, "name").join(local.hint("merge"), ["path", "name"], "left")
    target = F.when(F.col("n_local") == 1, F.col("local")).otherwise(F.col("candidates")[0])
    confidence = F.when(F.col("n_local") == 1, "extracted").when(F.col("n_any") == 1, "inferred").otherwise("ambiguous")
    return j.select("source", "name", target.alias("target"), confidence.alias("confidence"), F.when(confidence == "ambiguous", F.col("candidates")).alias("candidates"))


def resolve_decorators(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Decorators: source, name, target, confidence; the least symbol of the same file, else the only one anywhere."""
    local, anywhere = _by_name(symbols)
    wanted = refs.select("source", "name").where("source is not null and name <> ''").distinct().withColumn("path", file_of("source"))
    j = join_on_skewed(wanted, anywhere, "name").join(local.hint("merge"), ["path", "name"], "left")
    target = F.when(F.col("local").isNotNull(), F.col("local")).when(F.col("n_any") == 1, F.col("candidates")[0])
    return j.select("source", "name", target.alias("target"), F.when(F.col("local").isNotNull(), "extracted").otherwise("inferred").alias("confidence")).where("target is not null")


def override_edges(inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods that override a parent's method of the same name: source, target.

    ``inherits`` has source, target (class ids); ``methods`` has id and name. The join of the class
    links is on the child and then on (parent, name), of which each names few methods.
    """
    own = methods.select("id", "name", owner_of("id").alias("owner")).where("owner is not null")
    child = inherits.select("source", F.col("target").alias("parent")).distinct().hint("merge").join(own.select(F.col("owner").alias("source"), "name", F.col("id").alias("method")).hint("merge"), "source")
    above = own.select(F.col("owner").alias("parent"), "name", F.col("id").alias("target"))
    return child.hint("merge").join(above.hint("merge"), ["parent", "name"]).where("method <> target").select(F.col("method").alias("source"), "target").distinct()


def named_imports(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """References resolved through the imports of their file: source, name, target.

    ``imports`` has path and imported (files); ``symbols`` has id, path, name and are top-level. Of
    several imported files that define the name one whose base name is the name wins, then the least id.
    """
    wanted = refs.select("source", "name").where("source is not null and name <> ''").distinct().withColumn("path", file_of("source"))
    names = wanted.select("path", "name").distinct().hint("merge").join(imports.select("path", "imported").distinct().hint("merge"), "path")
    defined = symbols.select(F.col("path").alias("imported"), "name", "id")
    stem = F.regexp_extract("imported", r"([^/.]+)[^/]*$", 1)
    hit = names.hint("merge").join(defined.hint("merge"), ["imported", "name"]).groupBy("path", "name").agg(F.min(F.struct((stem != F.col("name")).alias("other"), "id")).alias("b"))
    return wanted.hint("merge").join(hit.hint("merge"), ["path", "name"]).select("source", "name", F.col("b.id").alias("target"))


def call_ladder(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """The whole ladder for calls: source, name, target, rung, confidence.

    same_file (the only one there), named_import, same_package (the only one in the file's
    directory), unique (the only one anywhere), ambiguous (the least id).
    """
    local, anywhere = _by_name(symbols)
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    package = symbols.groupBy(folder("path").alias("folder"), "name").agg(F.min("id").alias("near"), F.count(F.lit(1)).alias("n_near"))
    wanted = refs.select("source", "name").where("source is not null and name <> ''").distinct().withColumn("path", file_of("source")).withColumn("folder", folder(F.col("path")))
    through = named_imports(refs, imports, symbols).withColumnRenamed("target", "through")
    j = (
        join_on_skewed(wanted, anywhere, "name").join(local.hint("merge"), ["path", "name"], "left")
        .join(through.hint("merge"), ["source", "name"], "left").join(package.hint("merge"), ["folder", "name"], "left")
    )
    rung = (
        F.when(F.col("n_local") == 1, "same_file").when(F.col("through").isNotNull(), "named_import").when(F.col("n_near") == 1, "same_package")
        .when(F.col("n_any") == 1, "unique").otherwise("ambiguous")
    )
    target = F.when(rung == "same_file", F.col("local")).when(rung == "named_import", F.col("through")).when(rung == "same_package", F.col("near")).otherwise(F.col("candidates")[0])
    confidence = F.when(rung.isin("same_file", "named_import"), "extracted").when(rung == "ambiguous", "ambiguous").otherwise("inferred")
    return j.select("source", "name", target.alias("target"), rung.alias("rung"), confidence.alias("confidence"))


def package_members(files: DataFrame) -> DataFrame:
    """Files that see each other without an import, as members of a package: path, package, peers.

    The non-test files of one directory; ``peers`` counts the others. Pairs are not formed.
    """
    own = files.where(~is_test_path("path")).select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("package")).distinct()
    sizes = own.groupBy("package").agg((F.count(F.lit(1)) - 1).alias("peers"))
    return join_on_skewed(own, sizes, "package")


def reexported(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that a package's index file passes on: id. They are exported and defined in a file that the index imports."""
    index = file_of("source").rlike(r"(^|/)(__init__\.py|index\.[a-z]+)$")
    passed = edges.where((F.col("kind") == "imports") & index).select(file_of("target").alias("path")).distinct()
    own = nodes.where(~is_file_node() & F.coalesce("exported", F.lit(False))).select("id", file_of("id").alias("path"))
    return own.hint("merge").join(passed.hint("merge"), "path", "left_semi").select("id")


def entry_roots(nodes: DataFrame) -> DataFrame:
    """Files that programs start from, by their name or directory: id, why."""
    stem = F.regexp_extract(F.lower("id"), r"([^/.]+)[^/]*$", 1)
    folder = F.regexp_extract(F.lower("id"), r"([^/]+)/[^/]*$", 1)
    why = F.when(stem.isin(*ENTRY_NAMES), "name").when(folder.isin(*ENTRY_DIRS), "directory")
    return nodes.where(is_file_node() & ~is_test_path("id")).select("id", why.alias("why")).where("why is not null")


def reference_index(edges: DataFrame) -> DataFrame:
    """Names that are referred to other than by calls: name, files (how many), first (the first CANDIDATES of them)."""
    uses = edges.where(~F.col("kind").isin("calls", "contains", "documents")).select(bare_name("target").alias("name"), file_of("source").alias("path")).where("name <> ''").distinct()
    w = Window.partitionBy("name").orderBy("path")
    first = uses.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= CANDIDATES).groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("first"))
    return uses.groupBy("name").agg(F.count(F.lit(1)).alias("files")).hint("merge").join(first.hint("merge"), "name")


def dynamic_imports(contents: DataFrame) -> DataFrame:
    """Modules that are imported by a call: module, path; from import(), require(), import_module() and __import__() of a literal.

    Relative marks and file endings are cut, and slashes become dots; test files do not count.
    """
    pattern = r"""(?:import_module|__import__|require|import)\(\s*['"]([^'"\n]+)['"]"""
    found = contents.where(~is_test_path("path")).select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("raw"))
    module = F.translate(F.regexp_replace(F.regexp_replace("raw", r"^[./]+", ""), r"\.(js|ts|jsx|tsx|mjs|cjs|py)$", ""), "/", ".")
    return found.select(module.alias("module"), "path").where("module <> ''").distinct()


def runtime_seen(edges: DataFrame) -> DataFrame:
    """Targets that a running program was seen to reach: id. ``edges`` is the raw table with its extras."""
    from codeweft.functions.ids import plain_id

    seen = edges.where(F.get_json_object("extras", "$.provenance") == "runtime")
    return seen.select(plain_id("target").alias("id")).where("id is not null").distinct()


def affected_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files to look at anew when files change: path, why.

    The changed files, all that import them directly or not (import), and those that name something
    in them without being sure (name: ambiguous edges).
    """
    paths = changed.select("path").where("path is not null").distinct()
    links = edges.where((F.col("kind") == "imports") & (F.col("rank") >= 1)).select(file_of("source").alias("source"), file_of("target").alias("target"), "rank").where("source <> target").distinct()
    closure = layers(inbound(links), paths.select(F.col("path").alias("id"))).select(F.col("id").alias("path"), F.when(F.col("depth") == 0, 0).otherwise(1).alias("order"))
    unsure = edges.where("rank = 0").select(file_of("source").alias("a"), file_of("target").alias("path")).where("a <> path").distinct()
    named = unsure.hint("merge").join(paths.hint("merge"), "path", "left_semi").select(F.col("a").alias("path"), F.lit(2).alias("order"))
    first = closure.unionByName(named).groupBy("path").agg(F.min("order").alias("o"))
    return first.select("path", F.element_at(F.array(*map(F.lit, ("changed", "import", "name"))), F.col("o") + 1).alias("why"))


def surfaces(contents: DataFrame) -> DataFrame:
    """The declarations of each file without their places: path, surface (hash of its declaring lines in order)."""
    line = F.filter(F.split("content", r"\r?\n"), lambda x: x.rlike(r"^\s*(export |public |async )*(def|class|function|func|type|interface|enum|const|var|let)\b"))
    plain = F.transform(line, lambda x: F.regexp_replace(F.btrim(x), r"\s+", " "))
    return contents.select("path", F.sha2(F.array_join(plain, "\n"), 256).alias("surface"))
