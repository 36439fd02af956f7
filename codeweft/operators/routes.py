"""Routes, their handlers and consumers: route map, shape differences and the risk of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import normal_route
from codeweft.operators.joins import match_routes, next_within

#: Lines after a request in which its answer's keys are looked for, and lines of a handler.
WINDOW, BODY = 40, 120
_CALL = r"""(?i)\b(?:fetch|(?:axios(?:\.default)?|requests|httpx)\.(?:get|post|put|patch|delete))\s*\(\s*['"`]([^'"`]+)['"`]"""
_VERB = r"(?i)\b(?:axios(?:\.default)?|requests|httpx)\.(get|post|put|patch|delete)\s*\("
_ANSWER = r"(?i)(\w+)\s*=\s*(?:await\s+)?(?:fetch|axios|requests|httpx)\b"
_BODY_OF = r"(\w+)\s*=\s*(?:await\s+)?(\w+)\.json\s*\("
_UNPACKED = r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*(?:await\s+)?\w"


def _windows(files: DataFrame, lines: int) -> DataFrame:
    """Every line with the text from it on: path, line, text, window."""
    split = files.where("path is not null and content is not null").select("path", F.split("content", r"\r?\n").alias("ls"))
    at = split.select("path", "ls", F.posexplode("ls").alias("p", "text"))
    return at.select("path", (F.col("p") + 1).alias("line"), "text", F.slice("ls", F.col("p") + 1, F.lit(lines)).alias("rest"))


def fetch_sites(files: DataFrame) -> DataFrame:
    """Requests in source files (path, content): site, path, line, verb, url, keys.

    The keys are those read from the answer in the lines that follow: attributes and items of the
    variable that holds it (or its decoded body), and names it is unpacked into. Lines without a
    request are dropped before any window is joined.
    """
    found = _windows(files, WINDOW).withColumn("urls", F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))).where(F.size("urls") > 0)
    w = found.withColumn("window", F.array_join("rest", "\n"))
    first = F.regexp_extract("window", _ANSWER, 1)
    body, source = F.regexp_extract("window", _BODY_OF, 1), F.regexp_extract("window", _BODY_OF, 2)
    w = w.withColumn("answer", F.when((body != "") & ((first == "") | (source == first)), body).otherwise(first))
    dotted = F.regexp_extract_all("window", F.lit(r"\b(\w+\.\w+)\b"), F.lit(1))
    items = F.transform(F.regexp_extract_all("window", F.lit(r"""\b(\w+\s*\[\s*['"]\w+['"]\s*\])"""), F.lit(1)), lambda x: F.regexp_replace(x, r"""[\s\['"\]]+""", "."))
    own = F.filter(F.concat(dotted, items), lambda x: (F.col("answer") != "") & (F.split(x, r"\.")[0] == F.col("answer")))
    read = F.filter(F.transform(own, lambda x: F.split(x, r"\.")[1]), lambda x: x != "json")
    unpacked = F.flatten(F.transform(F.regexp_extract_all("window", F.lit(_UNPACKED), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda y: F.btrim(F.split(y, ":")[0]))))
    keys = F.array_sort(F.array_distinct(F.filter(F.concat(read, unpacked), lambda x: x.rlike(r"^\w+$"))))
    verb = F.upper(F.coalesce(F.nullif(F.regexp_extract("text", _VERB, 1), F.lit("")), F.lit("GET")))
    each = w.select("path", "line", verb.alias("verb"), keys.alias("keys"), F.posexplode("urls").alias("n", "url"))
    return each.select(F.concat_ws(":", "path", "line", "n").alias("site"), "path", "line", "verb", F.btrim("url").alias("url"), "keys")


def handler_keys(handlers: DataFrame, files: DataFrame) -> DataFrame:
    """Keys of the objects a handler returns: id, keys. ``handlers`` has id, path, line; a body ends where the next one begins."""
    following = F.lead("line").over(Window.partitionBy("path").orderBy("line", "id"))
    ends = handlers.select("id", "path", "line", F.greatest(F.lit(1), F.least(F.lit(BODY), F.coalesce(following - F.col("line"), F.lit(BODY)))).alias("n"))
    at = ends.hint("merge").join(files.where("content is not null").select("path", F.split("content", r"\r?\n").alias("ls")).hint("merge"), "path")
    body = F.array_join(F.slice("ls", F.col("line"), F.col("n")), "\n")
    returned = F.regexp_extract_all(body, F.lit(r"\breturn\s*\(?\s*\{([^}]*)\}"), F.lit(1))
    python = F.col("path").endswith(".py")
    pattern = lambda quote: F.flatten(F.transform(returned, lambda x: F.regexp_extract_all(x, F.lit(rf"""{quote}(\w+){quote}\s*:"""), F.lit(1))))
    return at.select("id", F.array_sort(F.array_distinct(F.when(python, pattern("['\"]")).otherwise(pattern("['\"]?")))).alias("keys"))


def route_map(routes: DataFrame, handlers: DataFrame, files: DataFrame) -> DataFrame:
    """Every route with its handler and consumers: route, verb, url, handler, handler_keys, consumers, missing, unused, risk.

    ``routes`` has path, line, verb, name; ``handlers`` has id, path, line. A route's handler is the
    next callable within eight lines. ``missing`` are keys that consumers read and the handler does
    not return, ``unused`` the reverse; both are empty where the handler returns no object or there
    is no consumer. Risk: none without consumers, high for a difference with two or more, medium
    for a difference with one, else low.
    """
    r = routes.select(F.concat_ws(":", "path", "line").alias("route"), "path", "line", "verb", F.col("name").alias("url"))
    near = next_within(r.select("path", "line", "route"), handlers.select("path", "line", "id")).select("route", F.col("next_id").alias("handler"))
    sites = fetch_sites(files)
    served = match_routes(r.select(F.col("route").alias("id"), "verb", "url"), sites.select(F.col("site").alias("id"), "verb", "url")).withColumnsRenamed({"route_id": "route", "call_id": "site"})
    used = served.hint("merge").join(sites.select("site", "keys").hint("merge"), "site")
    per = used.groupBy("route").agg(F.count(F.lit(1)).alias("consumers")).hint("merge").join(
        used.select("route", F.explode_outer("keys").alias("key")).groupBy("route").agg(F.array_sort(F.collect_set("key")).alias("read")).hint("merge"), "route"
    )
    keyed = handler_keys(handlers, files).withColumnsRenamed({"id": "handler", "keys": "handler_keys"})
    j = r.hint("merge").join(near.hint("merge"), "route", "left").join(keyed.hint("merge"), "handler", "left").join(per.hint("merge"), "route", "left")
    none = F.array().cast("array<string>")
    n, have, read = F.coalesce("consumers", F.lit(0)), F.coalesce("handler_keys", none), F.coalesce("read", none)
    both = (n > 0) & (F.size(have) > 0) & (F.size(read) > 0)
    missing, unused = F.when(both, F.array_except(read, have)).otherwise(none), F.when(both, F.array_except(have, read)).otherwise(none)
    risk = F.when(n == 0, "none").when((F.size(missing) > 0) & (n >= 2), "high").when(F.size(missing) > 0, "medium").otherwise("low")
    return j.select("route", "verb", normal_route("url").alias("url"), "handler", have.alias("handler_keys"), n.alias("consumers"), missing.alias("missing"), unused.alias("unused"), risk.alias("risk"))
