"""Joins that are not equalities: ranges, nearest following rows, longest prefixes, route patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import normal_route


def enclosing(points: DataFrame, spans: DataFrame, by: str = "path") -> DataFrame:
    """The innermost span around each point: points' columns and span_id (null where none encloses it).

    ``points`` has ``by`` and line; ``spans`` has ``by``, id, line, end_line (0 or less is open).
    Of the spans that hold the line the one that starts last wins, then the shortest, then the
    least id. The join is on the file, where spans are few; only the range is a condition.
    """
    s = spans.select(F.col(by).alias("_by"), F.col("id").alias("span_id"), F.col("line").alias("_from"), F.when(F.col("end_line") > 0, F.col("end_line")).otherwise((1 << 31) - 1).alias("_to"))
    key = [c for c in points.columns]
    met = points.join(s, (points[by] == s["_by"]) & points["line"].between(s["_from"], s["_to"]), "left")
    return met.groupBy(*key).agg(F.min_by("span_id", F.struct(-F.col("_from"), F.col("_to"), F.col("span_id"))).alias("span_id"))


def next_within(points: DataFrame, rows: DataFrame, by: str = "path", reach: int = 8) -> DataFrame:
    """The nearest following row within ``reach`` lines of each point: points' columns and next_id.

    An as-of join forwards: both sides are sorted together once per key.
    """
    keep = [c for c in points.columns if c not in (by, "line")]
    p = points.select(by, "line", F.struct(*(keep or [by])).alias("_p"), F.lit(1).alias("_point"), F.lit(None).cast("struct<line:int,id:string>").alias("_n"))
    r = rows.select(by, "line", F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(0).alias("_point"), F.struct(F.col("line").cast("int").alias("line"), F.col("id").cast("string").alias("id")).alias("_n"))
    w = Window.partitionBy(by).orderBy(F.col("line"), F.col("_point"), F.col("_n.id")).rowsBetween(1, Window.unboundedFollowing)
    met = p.unionByName(r).withColumn("_next", F.first("_n", ignorenulls=True).over(w)).where("_point = 1")
    near = (F.col("_next.line") > F.col("line")) & (F.col("_next.line") <= F.col("line") + reach)
    return met.select(by, "line", *[F.col("_p")[c].alias(c) for c in keep], F.when(near, F.col("_next.id")).alias("next_id"))


def longest_prefix(paths: DataFrame, areas: DataFrame) -> DataFrame:
    """The longest area that is a path or one of its directories: path, area (null where none).

    Each path is taken apart into its own prefixes, so that the join is an equality.
    """
    segments = F.split("path", "/")
    own = paths.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.size(segments))).alias("k"), segments.alias("s"))
    prefixes = own.select("path", "k", F.concat_ws("/", F.slice("s", F.lit(1), F.col("k"))).alias("prefix"))
    known = areas.select(F.col("area").alias("prefix"), F.lit(1).alias("known")).distinct()
    hit = prefixes.join(known, "prefix", "left")
    return hit.groupBy("path").agg(F.max_by("prefix", F.when(F.col("known") == 1, F.col("k"))).alias("area"))


def match_routes(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that a route serves: route_id, call_id. Segments are equal or '*'; verbs are equal or ANY.

    ``routes`` and ``calls`` have id, verb, url. The verb counts as a first segment. A shape tells
    where a side is open; for each two shapes of one length that occur, what is open in neither is
    the key, so that the join is an equality and every pair that meets is a result.
    """

    def prepared(df: DataFrame, name: str) -> DataFrame:
        verb = F.when(F.upper("verb") == "ANY", "*").otherwise(F.concat(F.lit("="), F.upper("verb")))
        segments = F.filter(F.split(normal_route("url"), "/"), lambda x: x != "")
        parts = df.select(F.col("id").alias(f"{name}_id"), F.concat(F.array(F.coalesce(verb, F.lit(name))), segments).alias("parts")).where("parts is not null")
        return parts.withColumn(f"{name}_shape", F.array_join(F.transform("parts", lambda x: F.when(x == "*", "*").otherwise(".")), ""))

    r, c = prepared(routes, "route"), prepared(calls, "call")
    shapes = r.select("route_shape").distinct().join(c.select("call_shape").distinct(), F.length("route_shape") == F.length("call_shape"))

    def keyed(df: DataFrame, name: str, other: str) -> DataFrame:
        key = F.transform("parts", lambda x, i: F.when(F.substring(F.col(f"{other}_shape"), i + 1, F.lit(1)) == "*", "*").otherwise(x))
        return df.join(shapes, f"{name}_shape").select(f"{name}_id", "route_shape", "call_shape", key.alias("key"))

    return keyed(r, "route", "call").join(keyed(c, "call", "route"), ["route_shape", "call_shape", "key"]).select("route_id", "call_id")


def unique_name_resolution(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names resolved by a ladder: same file, then the only symbol of that name anywhere, else ambiguous.

    ``calls`` has path, name; ``symbols`` has path, name, id. Columns: path, name, target, confidence;
    an ambiguous name goes to its least id. Names nobody defines are left out.
    """
    wanted = calls.select("path", "name").distinct()
    local = symbols.groupBy("path", "name").agg(F.min("id").alias("local"), F.count(F.lit(1)).alias("n_local"))
    everywhere = symbols.groupBy("name").agg(F.min("id").alias("any"), F.count(F.lit(1)).alias("n_any"))
    j = wanted.join(local, ["path", "name"], "left").join(everywhere, "name")
    target = F.when(F.col("n_local") == 1, F.col("local")).otherwise(F.col("any"))
    confidence = F.when(F.col("n_local") == 1, "extracted").when(F.col("n_any") == 1, "inferred").otherwise("ambiguous")
    return j.select("path", "name", target.alias("target"), confidence.alias("confidence"))
