"""Source files that do not parse: all errors, first cause, and acceptance per language."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.ids import language_of, repository
from codeweft.llm.syntax import ecma, golang, jsontext, pylang
from codeweft.llm.syntax.base import DEEPEST, line_of

CHECKS: dict[str, Callable[[str], list[tuple[int, str]]]] = {
    "python": pylang.check,
    "javascript": ecma.check_javascript,
    "typescript": ecma.check_typescript,
    "go": golang.check,
    "json": jsontext.check,
}
RESULT = "path string, language string, valid boolean, n_errors int, first_cause string, first_line int, errors array<struct<line:int,message:string>>"
#: Frames the parsers may use: some 30 for each level of base.DEEPEST. They are on the heap, not on the C stack.
FRAMES = 30 * DEEPEST


def syntax_errors(text: str, language: str) -> list[tuple[int, str]] | None:
    """All errors of a text as (offset, message), first one first; None for a language without a parser."""
    check = CHECKS.get(language)
    if check is None:
        return None
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    if not text and language != "json":
        return []
    try:
        return check(text)
    except RecursionError:
        return [(0, "nested too deeply")]


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, language, text in zip(pdf["path"], pdf["language"], pdf["content"]):
            errors = syntax_errors(text, language)
            if errors is None:
                out.append((path, language, None, None, None, None, None))
            else:
                listed = [{"line": line_of(text, at), "message": m} for at, m in errors]
                first = listed[0] if listed else {"line": None, "message": None}
                out.append((path, language, not listed, len(listed), first["message"], first["line"], listed))
        df = pd.DataFrame(out, columns=["path", "language", "valid", "n_errors", "first_cause", "first_line", "errors"])
        yield df.astype({"n_errors": "Int32", "first_line": "Int32", "valid": "boolean"})


def parse_files(files: DataFrame) -> DataFrame:
    """Parse every file: path, language, valid, n_errors, first_cause, first_line, errors.

    ``files`` has path, language, content; other columns are ignored. The language is the stated
    one in any letter case, else that of the extension. Rows without content are left out; a
    language without a parser gives nulls. An empty file is valid unless it is JSON. The whole
    text is parsed; after an error the parser resumes at the next statement, so that all errors
    are kept, however many. No shuffle takes place.
    """
    rows = files.where("content is not null").select("path", language_of("language", "path").alias("language"), "content")
    return rows.mapInPandas(_check, RESULT)


def acceptance(parsed: DataFrame) -> DataFrame:
    """Rates per repository and language: repository, language, files, invalid, rate."""
    known = parsed.where("valid is not null")
    bad = F.sum((~F.col("valid")).cast("long"))
    return known.groupBy(repository("path").alias("repository"), "language").agg(
        F.count(F.lit(1)).alias("files"), bad.alias("invalid"), F.round(bad / F.count(F.lit(1)), 6).alias("rate")
    )
