"""Program dependence of Python functions: control flow, control dependence, reaching definitions, taint.

A function is analysed whole by one Python worker; functions are independent, so nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.ids import language_of

#: Where untrusted data come from and where they must not go, by category.
SOURCES = {"input": re.compile(r"\b(input|sys\.argv|os\.environ|os\.getenv|request\.\w+)\b"), "file": re.compile(r"\b(open\w*|read_text|load_\w+)\s*\(")}
SINKS = {"code": re.compile(r"\b(eval|exec|compile)\s*\("), "command": re.compile(r"\b(os\.system|subprocess\.\w+|popen)\s*\("), "sql": re.compile(r"\.execute(many)?\s*\("), "write": re.compile(r"\.(write|writelines|send)\s*\(")}

RECORDS = "path string, function string, what string, source_line int, target_line int, label string"


@dataclass
class Flow:
    edges: set[tuple[int, int, str]] = field(default_factory=set)
    control: set[tuple[int, int, str]] = field(default_factory=set)
    defs: dict[int, set[str]] = field(default_factory=dict)
    uses: dict[int, set[str]] = field(default_factory=dict)
    text: dict[int, str] = field(default_factory=dict)


def _names(node: ast.AST, store: bool) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del) if store else ast.Load)}


class _Builder:
    """Control flow at the level of lines; loops, branches, try and jumps."""

    def __init__(self) -> None:
        self.f = Flow()
        self.loops: list[tuple[int, set]] = []

    def visit(self, node: ast.stmt, parts: list[ast.AST]) -> int:
        line = node.lineno
        self.f.defs.setdefault(line, set()).update(*[_names(p, True) for p in parts])
        self.f.uses.setdefault(line, set()).update(*[_names(p, False) for p in parts])
        self.f.text[line] = self.f.text.get(line, "") + " ".join(ast.unparse(p) for p in parts)
        return line

    def link(self, froms: set[tuple[int, str]], line: int) -> None:
        self.f.edges |= {(a, line, k) for a, k in froms}

    def block(self, body: list[ast.stmt], froms: set[tuple[int, str]], owners: list[tuple[int, str]]) -> set[tuple[int, str]]:
        for s in body:
            froms = self.statement(s, froms, owners)
        return froms

    def statement(self, s: ast.stmt, froms, owners):
        head = {ast.If: ["test"], ast.While: ["test"], ast.For: ["target", "iter"], ast.AsyncFor: ["target", "iter"], ast.With: ["items"], ast.AsyncWith: ["items"], ast.Match: ["subject"]}.get(type(s))
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            parts: list[ast.AST] = [ast.Name(id=s.name, ctx=ast.Store())]
        elif isinstance(s, ast.Try):
            parts = []
        elif head:
            parts = [x for h in head for x in (getattr(s, h) if isinstance(getattr(s, h), list) else [getattr(s, h)])]
        else:
            parts = [s]
        line = self.visit(s, parts)
        self.link(froms, line)
        self.f.control |= {(o, line, b) for o, b in owners[-1:]}
        if isinstance(s, ast.If):
            yes = self.block(s.body, {(line, "true")}, [*owners, (line, "T")])
            no = self.block(s.orelse, {(line, "false")}, [*owners, (line, "F")]) if s.orelse else {(line, "false")}
            return yes | no
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            self.loops.append((line, out := set()))
            self.link(self.block(s.body, {(line, "true")}, [*owners, (line, "T")]), line)
            self.loops.pop()
            rest = self.block(s.orelse, {(line, "false")}, [*owners, (line, "F")]) if s.orelse else {(line, "false")}
            return rest | out
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.block(s.body, {(line, "next")}, owners)
        if isinstance(s, ast.Try):
            done = self.block(s.body, {(line, "next")}, owners)
            done = self.block(s.orelse, done, owners)
            for h in s.handlers:
                self.visit(h, [h.type] if h.type else [])
                if h.name:
                    self.f.defs[h.lineno].add(h.name)
                self.link({(line, "raise")}, h.lineno)
                done |= self.block(h.body, {(h.lineno, "next")}, [*owners, (h.lineno, "T")])
            return self.block(s.finalbody, done, owners)
        if isinstance(s, ast.Match):
            done = {(line, "false")}
            for c in s.cases:
                done |= self.block(c.body, {(line, "case")}, [*owners, (line, "T")])
            return done
        if isinstance(s, (ast.Return, ast.Raise)):
            return set()
        if isinstance(s, ast.Break) and self.loops:
            self.loops[-1][1].add((line, "break"))
            return set()
        if isinstance(s, ast.Continue) and self.loops:
            self.link({(line, "continue")}, self.loops[-1][0])
            return set()
        return {(line, "next")}


def analyse(fn: ast.FunctionDef | ast.AsyncFunctionDef) -> Flow:
    b = _Builder()
    args = fn.args
    names = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
    b.f.defs[fn.lineno] = names
    b.f.uses[fn.lineno] = set()
    b.block(fn.body, {(fn.lineno, "entry")}, [])
    return b.f


def reaching(f: Flow) -> set[tuple[str, int, int]]:
    """(variable, definition line, use line) by the fixed point OUT = (IN - kill) + gen."""
    before: dict[int, set[int]] = {}
    after: dict[int, set[int]] = {}
    for a, b, _ in f.edges:
        before.setdefault(b, set()).add(a)
        after.setdefault(a, set()).add(b)
    into: dict[int, set[tuple[str, int]]] = {x: set() for x in f.defs}
    out: dict[int, set[tuple[str, int]]] = {x: set() for x in f.defs}
    todo = sorted(f.defs)
    while todo:
        x = todo.pop(0)
        into[x] = set().union(*[out[p] for p in before.get(x, ())]) if before.get(x) else set()
        new = {d for d in into[x] if d[0] not in f.defs[x]} | {(v, x) for v in f.defs[x]}
        if new != out[x]:
            out[x] = new
            todo += [n for n in sorted(after.get(x, ())) if n not in todo]
    return {(v, d, x) for x in f.uses for v, d in into[x] if v in f.uses[x]}


def taint(f: Flow, flows: set[tuple[str, int, int]]) -> set[tuple[int, int, str]]:
    """(source line, sink line, category): a sink whose values lead back to a source over definitions."""
    feeds: dict[int, set[int]] = {}
    for _, d, u in flows:
        feeds.setdefault(u, set()).add(d)
    out = set()
    for line, text in f.text.items():
        for category, sink in SINKS.items():
            if sink.search(text):
                seen, todo = set(), [line]
                while todo:
                    x = todo.pop()
                    if x in seen:
                        continue
                    seen.add(x)
                    if x <= line and any(s.search(f.text.get(x, "")) for s in SOURCES.values()):
                        out.add((x, line, category))
                    todo += feeds.get(x, ())
    return out


def dependence(files: DataFrame) -> DataFrame:
    """Dependence of all Python functions: path, function, what, source_line, target_line, label.

    ``what`` is flow (label next, true, false, ...), control (T or F), def_use (the variable) or
    taint (the category). Files that do not parse give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["content"]):
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    try:
                        tree = ast.parse(text)
                    except (SyntaxError, ValueError, RecursionError):
                        continue
                for fn in ast.walk(tree):
                    if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        f = analyse(fn)
                        flows = reaching(f)
                        name = f"{fn.name}:{fn.lineno}"
                        out += [(path, name, "flow", a, b, k) for a, b, k in sorted(f.edges)]
                        out += [(path, name, "control", a, b, k) for a, b, k in sorted(f.control)]
                        out += [(path, name, "def_use", d, u, v) for v, d, u in sorted(flows)]
                        out += [(path, name, "taint", a, b, k) for a, b, k in sorted(taint(f, flows))]
            yield pd.DataFrame(out, columns=["path", "function", "what", "source_line", "target_line", "label"])

    python = files.where((language_of("language", "path") == "python") & F.col("content").isNotNull())
    return python.select("path", "content").mapInPandas(run, RECORDS)
