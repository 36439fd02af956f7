"""Per-key counts, heavy keys and exact quantiles when a few keys hold most of the records.

Exact selection by histograms: every (key, rank) wanted keeps a bin of values that must contain it.
Each round counts the key's values in finer bins of that bin, with counts that merge map-side, and
moves to the one that holds the rank, until a bin is one value. A hot key costs a task at most one
row per bin, and its values are never gathered.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.ids import plain_id, plain_word
from codeweft.session import Scratch

#: Bits of a value that a round resolves: a bin is cut into 2**DIGIT bins.
DIGIT = 10
#: A bin with this share of the records is hot; there are at most 1,000 at once, which are broadcast.
HOT_SHARE = 0.001
#: Hashed keys are non-negative and below 2**KEY_BITS.
KEY_BITS = 62


def edge_records(edges: DataFrame, value: str = "seen_at") -> DataFrame:
    """Each edge record once: ordinal, target, kind, value (microseconds), in plain spelling.

    Copies with one ordinal are one record; of differing copies the greatest counts. Rows without
    ordinal cannot be told apart and are one record each.
    """
    row = F.struct(plain_id("target").alias("target"), plain_word("kind").alias("kind"), F.unix_micros(value).alias("value"))
    known = edges.where("ordinal is not null").groupBy("ordinal").agg(F.max(row).alias("r"))
    other = edges.where("ordinal is null").select(F.col("ordinal"), row.alias("r"))
    return known.unionByName(other).select("ordinal", "r.target", "r.kind", "r.value")


def _same(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _within(values: DataFrame, states: DataFrame, key: list[str], total: int) -> DataFrame:
    """The values that lie in a bin of ``states``: hot bins meet a broadcast, the others are merged by shuffle."""
    hashed = [*key, "prefix"]
    v = values.withColumn("_kp", F.xxhash64(*hashed)).alias("v")
    s = states.select(*hashed, "c").withColumn("_kp", F.xxhash64(*hashed))
    hot = F.col("c") >= F.lit(max(1, total * HOT_SHARE))
    on = (F.col("v._kp") == F.col("s._kp")) & _same("v", "s", hashed)
    near, far = F.broadcast(s.where(hot)).alias("s"), s.where(~hot).alias("s")
    by_near = v.join(near, on, "left_semi")
    if not s.where(~hot).limit(1).count():
        return by_near.drop("_kp")
    cold = v.join(near, on, "left_anti").alias("v")
    return by_near.unionByName(cold.hint("merge").join(far.hint("merge"), on, "left_semi")).drop("_kp")


def select_ranks(records: DataFrame, key: list[str], wanted: DataFrame, value: str = "value", scratch: Scratch | None = None, every: bool = False) -> DataFrame:
    """The values of given ranks: key columns, rank, value, equal (rows of the key with that value).

    ``wanted`` has the key columns and ranks (array of long, from 1, over the key's non-null
    values), one row a key; ``every`` says that it holds all keys. Ranks beyond a key's values give
    no row. Values are integers; keys may be null, and ``key`` may be empty for one selection over
    all rows. ``records`` should be a written table: it is read in each of bits/DIGIT rounds at
    most, of which the later ones count only values in bins not yet resolved.
    """
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "ranks")
    span = records.agg(F.count(value), F.min(value), F.max(value)).first()
    total, lo, hi = span[0], span[1], span[2]
    shift = (hi - lo).bit_length() if total else 0
    offset = F.col(value) - F.lit(lo if total else 0)
    ranks = F.transform("ranks", lambda r: F.struct(r.cast("long").alias("rank"), r.cast("long").alias("left")))
    states = scratch.save(wanted.select(*key, F.lit(0).cast("long").alias("prefix"), ranks.alias("ranks")))
    few = every or states.limit(int(1 / HOT_SHARE) + 1).count() <= 1 / HOT_SHARE
    states = states.withColumn("c", F.lit(total if few else 0).cast("long"))
    done, first = [], True
    while True:
        values = records.where(F.col(value).isNotNull()).select(*key, F.shiftright(offset, shift).alias("prefix") if shift < 64 else F.lit(0).alias("prefix"), F.col(value).alias("_v"), offset.alias("_o"))
        inside = values if first and every else _within(values, states, key, total)
        first, shift = False, max(0, shift - DIGIT)
        bins = inside.groupBy(*key, "prefix", F.shiftright("_o", shift).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        w = Window.partitionBy(*key, "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = bins.withColumn("upto", F.sum("c").over(w))
        on = _same("b", "s", [*key, "prefix"])
        met = upto.alias("b").hint("merge").join(states.drop("c").alias("s").hint("merge"), on)
        held = F.filter("s.ranks", lambda r: (r["left"] <= F.col("b.upto")) & (r["left"] > F.col("b.upto") - F.col("b.c")))
        moved = F.transform(held, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("b.upto") + F.col("b.c")).alias("left")))
        step = scratch.save(met.select(*[F.col(f"b.{c}").alias(c) for c in key], F.col("b.bin").alias("prefix"), moved.alias("ranks"), "b.c", "b.least", "b.most").where(F.size("ranks") > 0))
        found = step.where("least = most").select(*key, F.explode("ranks").alias("r"), "least", "c")
        done.append(found.select(*key, "r.rank", F.col("least").alias(value), F.col("c").alias("equal")))
        states = step.where("least < most").select(*key, "prefix", "ranks", "c")
        if not shift or not states.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_quantiles(records: DataFrame, key: list[str], probabilities: list[float], value: str = "value", keys: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Exact per-key quantiles of an integer column: key columns, n, p, quantile.

    The quantile of p is the value of rank ceil(p * n_values), at least 1; n counts the key's rows,
    those without a value too. Keys may be null; keys with no value have a null quantile. ``keys``
    (key columns, n, n_values) restricts the result; without it all keys come out.
    """
    scratch = scratch or Scratch(records.sparkSession, "quantiles")
    counted = scratch.save(keys if keys is not None else records.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values")))
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    rank = lambda p: F.greatest(F.lit(1), F.ceil(p * F.col("n_values"))).cast("long")
    wanted = counted.where("n_values > 0").select(*key, F.array_distinct(F.transform(ps, rank)).alias("ranks"))
    found = select_ranks(records, key, wanted, value, scratch, every=keys is None)
    each = counted.select(*key, "n", "n_values", F.explode(ps).alias("p")).withColumn("rank", rank(F.col("p")))
    met = each.alias("e").hint("merge").join(found.alias("f").hint("merge"), _same("e", "f", [*key, "rank"]), "left")
    return met.select(*[F.col(f"e.{c}").alias(c) for c in key], "e.n", "e.p", F.col(f"f.{value}").alias("quantile"))


def heavy_keys(records: DataFrame, key: list[str], least_share: float, total: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Keys with at least ``least_share`` of ``total`` rows, by selection: key columns, n.

    In the order of the keys' hashes a key with L = ceil(least_share * total) rows covers a rank
    that is a multiple of L, so the at most 1/least_share values of these ranks hold all heavy keys.
    They are selected by histograms of the hashes; an exact count of the few keys that have such a
    hash follows. Keys are never all counted. ``total`` defaults to the number of rows.
    """
    scratch = scratch or Scratch(records.sparkSession, "heavy")
    hashed = records.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*key), 64 - KEY_BITS))
    n = records.count()
    total = n if total is None else total
    least = max(1, math.ceil(Fraction(str(least_share)) * total))
    wanted = records.sparkSession.createDataFrame([(list(range(least, n + 1, least)),)], "ranks array<long>")
    hits = select_ranks(hashed, [], wanted, "_h", scratch).where(F.col("equal") >= least).select("_h").distinct()
    few = hashed.join(F.broadcast(hits), "_h", "left_semi")
    return few.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _profile(edges: DataFrame, least_share: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    records = scratch.save(edge_records(edges))
    total = records.count()
    keyed = records.where("target is not null")
    return keyed, scratch.save(heavy_keys(keyed, ["target", "kind"], least_share, total, scratch)), total


def heavy_edge_keys(edges: DataFrame, least_share: float = 0.01) -> DataFrame:
    """(target, kind) keys with at least ``least_share`` of all edge records: target, kind, n.

    Records without a target are no key but count in the total; a null kind is a key of its own.
    An empty table gives no rows.
    """
    return _profile(edges, least_share, Scratch(edges.sparkSession, "keys"))[1]


def key_profile(edges: DataFrame, least_share: float = 0.01, probabilities: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Heavy (target, kind) keys of an edge table with exact quantiles of seen_at.

    Columns target, kind, n, share, p, seen_at; keys as in ``heavy_edge_keys``, at most 1/least_share.
    """
    scratch = Scratch(edges.sparkSession, "keys")
    keyed, heavy, total = _profile(edges, least_share, scratch)
    key = ["target", "kind"]
    own = keyed.alias("r").join(F.broadcast(heavy.select(*key)).alias("h"), _same("r", "h", key), "left_semi")
    values = own.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))
    q = exact_quantiles(keyed, key, list(probabilities), keys=values, scratch=scratch)
    return q.select(*key, "n", F.round(F.col("n") / F.lit(max(1, total)), 6).alias("share"), "p", F.timestamp_micros("quantile").alias("seen_at"))


def key_quantiles(edges: DataFrame, probabilities: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact quantiles of seen_at of every (target, kind) key, heavy or not: target, kind, n, p, seen_at."""
    scratch = Scratch(edges.sparkSession, "keys")
    keyed = scratch.save(edge_records(edges).where("target is not null"))
    q = exact_quantiles(keyed, ["target", "kind"], list(probabilities), scratch=scratch)
    return q.select("target", "kind", "n", "p", F.timestamp_micros("quantile").alias("seen_at"))


def key_counts(edges: DataFrame) -> DataFrame:
    """Records per key whatever the skew: target, kind, n; records without a target are left out."""
    return edge_records(edges).where("target is not null").groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n"))
