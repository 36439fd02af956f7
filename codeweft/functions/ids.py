"""Spelling rules of identifiers, kinds and hashes (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around an identifier.
BLANKS = " \t\r\n\x0b\x0c\xa0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _edge_free(c: Column) -> Column:
    """Whether the first and the last character are no blanks; tells most strings without a scan."""
    ends = [F.ascii(c), F.ascii(F.substring(c, -1, 1))]
    return (ends[0] > 32) & (ends[0] != 160) & (ends[1] > 32) & (ends[1] != 160)


def plain_id(c: Column | str) -> Column:
    """The one spelling of an endpoint; null where there is no reference.

    White space around, the direction of slashes and a leading current-directory mark do not
    distinguish ids. Null, empty and blank endpoints become null. Strings that are plain already
    are told by their ends and one search, and pass as they are.
    """
    c = _col(c)
    t = F.btrim(F.translate(c, "\\", "/"), F.lit(BLANKS))
    t = F.when(t.startswith("./"), F.regexp_replace(t, r"^(\./+)+", "")).otherwise(t)
    return F.when(_edge_free(c) & ~F.contains(c, F.lit("\\")) & ~c.startswith("./"), c).otherwise(F.when(F.length(t) > 0, t))


def plain_word(c: Column | str) -> Column:
    """Lower case without white space around; null where empty (kinds, confidences, languages)."""
    c = _col(c)
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(_edge_free(c), F.lower(c)).otherwise(F.when(F.length(t) > 0, t))


def plain_hash(c: Column | str) -> Column:
    """A SHA-256 in one notation: 64 lower-case hex digits without prefix or blanks, else null."""
    t = F.regexp_replace(F.lower(F.btrim(_col(c), F.lit(BLANKS))), r"^sha-?256:\s*", "")
    return F.when(F.length(t) > 0, t)


def content_key(content_hash: Column | str, content: Column | str) -> Column:
    """The hash that identifies a content: the delivered one, else computed; null if neither is there."""
    return F.coalesce(plain_hash(content_hash), F.sha2(_col(content), 256))


def repository(path: Column | str) -> Column:
    """The first segment of a path."""
    return F.substring_index(_col(path), "/", 1)


#: Language by file extension.
EXTENSION_LANGUAGE = {
    "py": "python", "pyi": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "go": "go",
    "json": "json",
}


def language_of(language: Column | str, path: Column | str) -> Column:
    """The stated language in lower case, else the one of the path's extension, else null."""
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.coalesce(plain_word(language), table[ext])
