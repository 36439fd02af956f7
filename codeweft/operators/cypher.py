"""A small MATCH ... RETURN language over the current graph, planned as DataFrame joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relationship types the language knows.
RELATIONS = frozenset(("calls", "imports", "contains", "references", "implements", "extends", "decorates"))
DEFAULT_LIMIT = 50

_MATCH = re.compile(
    r"^\s*MATCH\s*\(\s*a\s*(?::\s*\w+)?\s*\)\s*(?P<rel>-\s*\[\s*r\s*:\s*(?P<types>\w+(?:\s*\|\s*:?\w+)*)\s*\]\s*->\s*\(\s*b\s*(?::\s*\w+)?\s*\)\s*)?"
    r"(?:WHERE\s+(?P<where>.*?)\s+)?RETURN\s+(?P<ret>.+?)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)
_MUTATES = re.compile(r"\b(create|delete|merge|set|remove|detach)\b", re.I)
_CONTAINS = re.compile(r"contains\s*\(\s*(a|b)\.(\w+)\s*,\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)", re.I)
_STARTS = re.compile(r"starts\s*with\s*\(\s*(a|b)\.(\w+)\s*,\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)", re.I)


class CypherError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    types: tuple[str, ...] | None
    predicate: tuple[str, str, str, str] | None
    limit: int


def parse(text: str, strict: bool = False) -> Pattern:
    """The pattern of a query. Labels and the RETURN list do not matter.

    The first contains(...) counts, else the first starts with(...); other conditions are ignored,
    or refused when ``strict``.
    """
    if _MUTATES.search(text):
        raise CypherError("Mutating queries are not allowed")
    m = _MATCH.match(text)
    if not m:
        raise CypherError("Unsupported Cypher")
    types = None
    if m["rel"]:
        types = tuple(t.strip(" :").lower() for t in m["types"].split("|"))
        for t in types:
            if t not in RELATIONS:
                raise CypherError(f"Unsupported relationship: {t}")
    predicate, where = None, m["where"] or ""
    for name, pattern in (("contains", _CONTAINS), ("starts", _STARTS)):
        if not predicate and (p := pattern.search(where)):
            predicate = (name, p[1].lower(), p[2].lower(), p[3] if p[3] is not None else p[4])
            if strict and p.group().strip() != where.strip():
                raise CypherError("Only one condition is supported")
    if strict and where and not predicate:
        raise CypherError("Unsupported condition")
    return Pattern(types, predicate, int(m["limit"]) if m["limit"] else DEFAULT_LIMIT)


def run(text: str, nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of a query in edge (or node) order: a_id, a_name, a_path, a_kind and, with a relation, kind, b_*."""
    p = parse(text, strict)
    side = lambda x: nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "name", "path", "kind")], *([F.col("ordinal")] if not p.types and x == "a" else []))
    if p.types is None:
        rows, order = side("a"), ["ordinal", "a_id"]
        columns = ["a_id", "a_name", "a_path", "a_kind"]
    else:
        e = edges.where(F.col("kind").isin(*p.types)).select("source", "target", "kind", "ordinal")
        rows = e.join(side("a"), F.col("source") == F.col("a_id")).join(side("b"), F.col("target") == F.col("b_id"))
        order = ["ordinal", "a_id", "b_id", "kind"]
        columns = ["a_id", "a_name", "a_path", "a_kind", "kind", "b_id", "b_name", "b_path", "b_kind"]
    if p.predicate:
        name, var, field, value = p.predicate
        if f"{var}_{field}" not in columns:
            raise CypherError(f"Unsupported field: {var}.{field}")
        c = F.col(f"{var}_{field}")
        rows = rows.where(F.lower(c).contains(value.lower()) if name == "contains" else c.startswith(value))
    return rows.orderBy(*order).limit(p.limit).select(*columns)
