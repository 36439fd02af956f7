import math
import random
from datetime import UTC, datetime, timedelta

from codeweft.operators import selection as S
from codeweft.operators import skew

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def edges(spark, data):
    return spark.createDataFrame([(t, k, o, None if s is None else T0 + timedelta(microseconds=s), 1) for t, k, o, s in data], "target string, kind string, ordinal long, seen_at timestamp, n int")


def test_heavy_keys_and_quantiles(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.4 else f"t{r.randrange(300)}", "calls", i, r.randrange(10**12) if r.random() < 0.9 else 5) for i in range(1500)]
    data += [(None, "calls", 5000, 1), (" ", "calls", 5001, 1), ("hot", " CALLS", 5002, 7), ("./hot", "calls", 5003, None)] + data[:200]
    got = S.key_profile(edges(spark, data), 0.05, (0.0, 0.5, 0.9, 1.0)).collect()
    values = sorted({o: s for t, k, o, s in data if t in ("hot", "./hot") and s is not None}.values())
    n = len({o for t, k, o, s in data if t in ("hot", "./hot")})
    assert {(x["target"], x["kind"], x["n"]) for x in got} == {("hot", "calls", n)}
    for x in got:
        want = values[max(1, math.ceil(x["p"] * len(values))) - 1]
        assert x["seen_at"].replace(tzinfo=UTC) == T0 + timedelta(microseconds=want)


def test_counts_and_empty(spark, rows):
    e = edges(spark, [("a", None, 1, 1), ("a", None, 1, 1), ("a", "x", 2, 1), (None, "x", 3, 1), ("b", "X ", None, 1), ("b", "x", None, 1)])
    assert rows(S.key_counts(e)) == [("a", None, 1), ("a", "x", 1), ("b", "x", 2)]
    assert S.key_profile(e.limit(0)).count() == 0


def test_all_values_equal(spark, rows):
    e = edges(spark, [("a", "k", i, 9) for i in range(10)])
    assert {(x["p"], x["seen_at"].microsecond) for x in S.key_profile(e).collect()} == {(0.5, 9), (0.9, 9), (0.99, 9)}


def test_skewed_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 60}", i) for i in range(400)] + [(None, 1)], "key string, v int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3)], "key string, w int")
    assert skew.hot_keys(left, "key", 0.3) == ["hot"]
    for how in ("inner", "left"):
        assert rows(skew.join_on_skewed(left, right, "key", how, ["hot"])) == rows(left.join(right, "key", how))
        many = [f"k{i}" for i in range(60)]
        assert rows(skew.join_on_skewed(left, right, "key", how, many)) == rows(left.join(right, "key", how))


def test_quantiles_of_every_key_with_negative_and_wide_values(spark):
    r = random.Random(7)
    data = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([r.randrange(-(10**6), 10**15), 3, -4, None])) for _ in range(4000)] + [("none", None), ("one", -9)]
    df = spark.createDataFrame(data, "key string, value long")
    got = {(x["key"], x["p"]): (x["n"], x["quantile"]) for x in S.exact_quantiles(df, ["key"], [0.0, 0.25, 0.5, 1.0]).collect()}
    for k in {k for k, _ in data}:
        values = sorted(v for t, v in data if t == k and v is not None)
        for p in (0.0, 0.25, 0.5, 1.0):
            assert got[k, p] == (sum(t == k for t, _ in data), values[max(1, math.ceil(p * len(values))) - 1] if values else None)
    assert S.exact_quantiles(df.limit(0), ["key"], [0.5]).count() == 0


def test_heavy_keys_at_the_bound(spark, rows):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 6 + [(f"k{i}",) for i in range(687)], "key string")
    assert rows(S.heavy_keys(df, ["key"], 0.01)) == [("a", 7)]
    assert rows(S.heavy_keys(df, ["key"], 0.0085)) == [("a", 7), ("b", 6)]
    assert rows(S.heavy_keys(df, ["key"], 0.01, total=600)) == [("a", 7), ("b", 6)]


def test_selection_counts_bins_when_many_states_are_cold(spark):
    r = random.Random(3)
    data = [(f"k{r.randrange(1500)}", r.randrange(10**9)) for _ in range(12_000)]
    df = spark.createDataFrame(data, "key string, value long")
    got = {x["key"]: x["quantile"] for x in S.exact_quantiles(df, ["key"], [0.5]).collect()}
    for k in {k for k, _ in data}:
        values = sorted(v for t, v in data if t == k)
        assert got[k] == values[max(1, math.ceil(0.5 * len(values))) - 1]
