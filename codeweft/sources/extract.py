"""Rows out of source text and tool reports: symbols, imports, calls, diffs, coverage, sections, JSON lines."""

from __future__ import annotations

import ast
import json
import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.ids import language_of

RECORDS = "path string, what string, name string, owner string, line int, end_line int, exported boolean"
_COLUMNS = ["path", "what", "name", "owner", "line", "end_line", "exported"]

_PATTERNS = {
    "javascript": (
        ("function", re.compile(r"^(?P<x>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<n>[A-Za-z_$][\w$]*)")),
        ("function", re.compile(r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>")),
        ("class", re.compile(r"^(?P<x>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<n>[A-Za-z_$][\w$]*)")),
        ("interface", re.compile(r"^(?P<x>export\s+)?interface\s+(?P<n>[A-Za-z_$][\w$]*)")),
        ("import", re.compile(r"^import\b.*?['\"](?P<n>[^'\"]+)['\"]")),
    ),
    "go": (
        ("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(?P<n>[A-Za-z_]\w*)\s*[(\[]")),
        ("struct", re.compile(r"^type\s+(?P<n>[A-Za-z_]\w*)\s+struct\b")),
        ("interface", re.compile(r"^type\s+(?P<n>[A-Za-z_]\w*)\s+interface\b")),
        ("import", re.compile(r"^(?:import\s+|\t)(?:[\w.]+\s+)?\"(?P<n>[^\"]+)\"\s*$")),
    ),
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]


def _python(path: str, text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    listed = next((
        {e.value for e in n.value.elts if isinstance(e, ast.Constant)} for n in tree.body
        if isinstance(n, ast.Assign) and isinstance(n.value, (ast.List, ast.Tuple)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)
    ), None)
    public = lambda n: n in listed if listed is not None else not n.startswith("_")
    out, spans = [], []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((path, "function", node.name, "", node.lineno, node.end_lineno, public(node.name)))
            spans.append((node.lineno, node.end_lineno, node.name))
        elif isinstance(node, ast.ClassDef):
            out.append((path, "class", node.name, "", node.lineno, node.end_lineno, public(node.name)))
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append((path, "method", m.name, node.name, m.lineno, m.end_lineno, public(node.name)))
                    spans.append((m.lineno, m.end_lineno, f"{node.name}.{m.name}"))
    package = path.split("/")[:-1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(path, "import", a.name, "", node.lineno, node.end_lineno, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = ".".join(package[: len(package) - node.level + 1]) if node.level else ""
            module = ".".join(x for x in (base, node.module or "") if x)
            out.append((path, "import", module, "", node.lineno, node.end_lineno, False))
            out += [(path, "import", f"{module}.{a.name}" if module else a.name, "", node.lineno, node.end_lineno, False) for a in node.names if a.name != "*"]
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                owner = next((n for a, b, n in reversed(spans) if a <= node.lineno <= b), "")
                out.append((path, "call", name, owner, node.lineno, node.end_lineno, False))
    return out


def _by_patterns(path: str, text: str, language: str) -> list[tuple]:
    out = []
    for at, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        for what, pattern in _PATTERNS[language]:
            m = pattern.match(line)
            if m:
                exported = m["n"][:1].isupper() if language == "go" else bool(m.groupdict().get("x"))
                out.append((path, what, m["n"], "", at, at, exported and what != "import"))
                break
    return out


def extract(files: DataFrame) -> DataFrame:
    """Symbols, imports and calls of source files: path, what, name, owner, line, end_line, exported.

    ``files`` has path, language, content. Python goes through its syntax tree (a file that does
    not parse gives nothing), other languages through patterns of their declarations.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["content"]):
                out += _python(path, text) if language == "python" else _by_patterns(path, text, language) if language in _PATTERNS else []
            yield pd.DataFrame(out, columns=_COLUMNS)

    rows = files.where("path is not null and content is not null").select("path", language_of("language", "path").alias("language"), "content")
    return rows.mapInPandas(run, RECORDS)


def fresh_only(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose content is not in a cache of (content_hash): only these need extraction."""
    return files.join(cached.select("content_hash").distinct(), "content_hash", "left_anti")


def added_lines(diffs: DataFrame) -> DataFrame:
    """Added lines of unified diffs (id, diff): id, path, line (in the new file), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, diff in zip(pdf["id"], pdf["diff"]):
                path, at = None, 0
                for line in (diff or "").split("\n"):
                    if line.startswith("+++ "):
                        target = line[4:].split("\t")[0].strip()
                        path = None if target == "/dev/null" else target[2:] if target[:2] in ("a/", "b/") else target
                    elif line.startswith("@@"):
                        m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line)
                        at = int(m[1]) if m else 0
                    elif path and line.startswith("+"):
                        out.append((key, path, at, line[1:]))
                        at += 1
                    elif path and not line.startswith(("-", "\\")):
                        at += 1
            yield pd.DataFrame(out, columns=["id", "path", "line", "text"])

    return diffs.select(F.col("id").cast("string").alias("id"), "diff").mapInPandas(run, "id string, path string, line int, text string")


def parse_coverage(text: str) -> list[tuple[str, int, bool]]:
    """(path, line, executed) of a coverage report: LCOV, coverage JSON or Cobertura XML."""
    out: list[tuple[str, int, bool]] = []
    head = text.lstrip()[:1]
    try:
        if head == "{":
            for path, f in json.loads(text).get("files", {}).items():
                out += [(path, n, True) for n in f.get("executed_lines", [])] + [(path, n, False) for n in f.get("missing_lines", [])]
        elif head == "<":
            for c in ET.fromstring(text).iter("class"):
                out += [(c.get("filename", ""), int(x.get("number", 0)), int(x.get("hits", 0)) > 0) for x in c.iter("line")]
        else:
            path = ""
            for line in text.splitlines():
                if line.startswith("SF:"):
                    path = line[3:].strip()
                elif line.startswith("DA:"):
                    n, hits = line[3:].split(",")[:2]
                    out.append((path, int(n), int(hits) > 0))
    except (ValueError, ET.ParseError, AttributeError):
        return []
    return out


def coverage(reports: DataFrame) -> DataFrame:
    """Coverage rows of reports (id, report): path, line, executed; malformed reports give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for t in pdf["report"] if t for r in parse_coverage(t)], columns=["path", "line", "executed"])

    return reports.select("report").mapInPandas(run, "path string, line int, executed boolean").groupBy("path", "line").agg(F.max("executed").alias("executed"))


def changed_coverage(added: DataFrame, covered: DataFrame) -> DataFrame:
    """Coverage of changed lines per file: path, changed, executable, executed."""
    j = added.select("path", "line").distinct().join(covered, ["path", "line"], "left")
    return j.groupBy("path").agg(F.count(F.lit(1)).alias("changed"), F.count("executed").alias("executable"), F.count(F.when(F.col("executed"), 1)).alias("executed"))


def sections(docs: DataFrame) -> DataFrame:
    """Headings of Markdown texts (id, text): id, line, level, title, parent_line (nearest lower level before)."""
    lines = docs.select("id", F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    h = lines.where(F.col("l").rlike(r"^#{1,6}\s+\S")).select("id", (F.col("at") + 1).alias("line"), F.length(F.regexp_extract("l", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("l", r"^#+\s+(.*?)\s*#*\s*$", 1)).alias("title"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("line"))).over(w) for k in range(1, 6)]
    cols = [F.col("id"), F.col("line"), F.col("level"), F.col("title")]
    marked = h.select(*cols, *[a.alias(f"_{k}") for k, a in enumerate(above, 1)])
    parent = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)])
    return marked.select(*cols, parent.alias("parent_line"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a line that does not fit is kept as it is in ``_rejected``."""
    return spark.read.schema(f"{schema}, _rejected string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_rejected").json(path)


def read_files(spark: SparkSession, root: str, ignored: str = r"/(\.git|node_modules|__pycache__|dist|build)/") -> DataFrame:
    """Files under a folder: path, size, modified, content; ignored directories are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.where(~F.col("path").rlike(ignored)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "utf-8").alias("content"))
