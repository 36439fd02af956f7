"""Rows out of tool reports: dependency audits, CPU profiles, routes and wiring of web frameworks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import normal_route


def parse_audit(text: str) -> list[tuple[str, str, str, str]]:
    """(package, version, id, severity) of an audit: a list of dependencies, a map of packages, or OSV results."""
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return []
    out: list[tuple[str, str, str, str]] = []
    if not isinstance(data, (dict, list)):
        return out
    listed = data.get("dependencies") if isinstance(data, dict) else data
    if isinstance(listed, list):
        for d in listed:
            for v in d.get("vulns", []) or []:
                out.append((d.get("name", ""), d.get("version", ""), v.get("id", ""), "unknown"))
    elif isinstance(data.get("vulnerabilities"), dict):
        for name, v in data["vulnerabilities"].items():
            via = next((x for x in v.get("via", []) if isinstance(x, dict)), {})
            out.append((name, v.get("range", ""), str(via.get("source", via.get("url", ""))), v.get("severity", "unknown")))
    for r in data.get("results", []) if isinstance(data, dict) else []:
        for p in r.get("packages", []):
            for v in p.get("vulnerabilities", []):
                severity = (v.get("database_specific") or {}).get("severity", "unknown")
                out.append((p.get("package", {}).get("name", ""), p.get("package", {}).get("version", ""), v.get("id", ""), str(severity).lower()))
    return out


def audits(reports: DataFrame) -> DataFrame:
    """Dependency risks of audit reports (id, report): id, package, version, vulnerability, severity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(str(i), *r) for i, t in zip(pdf["id"], pdf["report"]) for r in parse_audit(t)]
            yield pd.DataFrame(out, columns=["id", "package", "version", "vulnerability", "severity"])

    return reports.select(F.col("id").cast("string").alias("id"), "report").mapInPandas(run, "id string, package string, version string, vulnerability string, severity string")


_NODES = "array<struct<id:long,callFrame:struct<functionName:string,url:string,lineNumber:int>,children:array<long>>>"


def profile_edges(profiles: DataFrame) -> DataFrame:
    """Caller-callee edges of CPU profiles (id, profile JSON): id, source, target, count = max(1, samples)."""
    p = profiles.select("id", F.from_json("profile", f"nodes {_NODES}, samples array<long>").alias("p")).where("p is not null")
    nodes = p.select("id", F.explode("p.nodes").alias("n")).select("id", F.col("n.id").alias("node"), F.concat_ws("::", "n.callFrame.url", "n.callFrame.functionName").alias("name"), "n.children")
    hits = p.select("id", F.explode("p.samples").alias("node")).groupBy("id", "node").agg(F.count(F.lit(1)).alias("hits"))
    links = nodes.select("id", F.col("name").alias("source"), F.explode("children").alias("node"))
    to = nodes.select("id", "node", F.col("name").alias("target"))
    counted = links.join(to, ["id", "node"]).join(hits, ["id", "node"], "left")
    return counted.groupBy("id", "source", "target").agg(F.sum(F.greatest(F.lit(1), F.coalesce("hits", F.lit(0)))).alias("count"))


#: Line patterns of routes and wiring: family, kind, pattern (group 1 the verb or event, group 2 the name).
FRAMEWORKS = (
    ("decorator", "route", re.compile(r"^\s*@\w+\.(get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)")),
    ("router", "route", re.compile(r"\b(?:app|router|server)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)")),
    ("path", "route", re.compile(r"^\s*(re_path|path|url)\(\s*r?['\"]([^'\"]*)")),
    ("mux", "route", re.compile(r"\b(HandleFunc|Handle)\(\s*\"([^\"]+)")),
    ("emit", "event", re.compile(r"\.(emit|publish|dispatch)\(\s*['\"]([^'\"]+)")),
    ("listen", "event", re.compile(r"\.(on|once|subscribe|addEventListener)\(\s*['\"]([^'\"]+)")),
    ("send", "call", re.compile(r"\b(fetch|send|axios\.\w+)\(\s*['\"`](/[^'\"`]*)")),
)


def framework_lines(files: DataFrame) -> DataFrame:
    """Routes, events and calls in source files (path, content): path, line, family, kind, verb, name.

    Every pattern sees every line, so that a line may count for several families; a verb that is no
    HTTP method is ANY; route parameters are '*'.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"]):
                for at, line in enumerate(text.split("\n"), 1):
                    for family, kind, pattern in FRAMEWORKS:
                        for m in pattern.finditer(line):
                            verb = m[1].upper() if m[1].lower() in ("get", "post", "put", "patch", "delete") else "ANY"
                            out.append((path, at, family, kind, verb, m[2]))
            yield pd.DataFrame(out, columns=["path", "line", "family", "kind", "verb", "name"])

    found = files.where("content is not null").select("path", "content").mapInPandas(run, "path string, line int, family string, kind string, verb string, name string")
    return found.withColumn("name", F.when(F.col("kind") == "event", F.col("name")).otherwise(normal_route("name")))
