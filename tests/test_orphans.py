import random
from datetime import UTC, datetime, timedelta

from codeweft.operators import orphans as O

T0 = datetime(2025, 1, 1, tzinfo=UTC)
EDGES = "source string, target string, kind string, ordinal long, seen_at timestamp, pos string, _hot int"
NODES = "id string, added_at timestamp, deleted_at timestamp, first string"
ALIASES = "old_id string, new_id string, generation_id long, id string"


def at(day):
    return None if day is None else T0 + timedelta(days=day)


def frames(spark, edges, nodes, aliases):
    return (
        spark.createDataFrame([(s, t, "calls", o, at(d), "x", 1) for s, t, o, d in edges], EDGES),
        spark.createDataFrame([(i, at(a), at(b), "y") for i, a, b in nodes], NODES),
        spark.createDataFrame([(a, b, 1, "z") for a, b in aliases], ALIASES),
    )


def test_cases(spark, rows):
    edges = [
        ("a", "gone", 1, 5), ("a", "late", 2, 5), ("a", None, 3, 5), ("", " ", 4, 5), ("./a", "a\t", 5, 5), ("a", "old", 6, 5),
        ("a", "loop1", 7, 5), ("never", "a", 8, 5), ("never", "a", 8, 5), ("a", "back", 9, 5), ("a", "back", 10, 15), ("a", "a", 11, None), ("d\\e", "a", 12, 5),
    ]
    nodes = [("a", 0, None), ("a", 0, None), ("gone", 0, 5), ("late", 6, None), ("c", 0, None), ("back", 0, 3), ("back", 10, 20), ("d/e", 0, None), (None, 0, None), ("nul", None, None)]
    aliases = [("old", "mid"), ("mid", "c"), ("old", "mid"), ("loop1", "loop2"), ("loop2", "loop1"), (None, "a"), ("a", None)]
    got = rows(O.orphan_references(*frames(spark, edges, nodes, aliases)).select("ordinal", "side"))
    assert got == sorted([(1, "target"), (2, "target"), (7, "target"), (8, "source"), (9, "target"), (11, "source"), (11, "target")], key=lambda r: (True, str(r[0]), True, str(r[1])))


def test_empty_tables(spark, rows):
    e, n, a = frames(spark, [("a", "b", 1, 1)], [("a", 0, None)], [])
    assert O.orphan_references(e.limit(0), n, a).count() == 0
    assert rows(O.orphan_references(e, n.limit(0), a).select("ordinal", "side")) == [(1, "source"), (1, "target")]


def test_runs_compress(spark, rows):
    keys = spark.createDataFrame([("k", 1, 3), ("k", 4, 4), ("k", 2, 2), ("k", 9, 9), ("k", 9, 9), ("k", 8, 7), (None, 1, 1), ("m", None, 2)], "id string, first long, last long")
    assert rows(O.compress_runs(keys)) == [("k", 1, 4), ("k", 9, 9)]


def test_against_brute_force_with_hot_key(spark, rows):
    r = random.Random(3)
    nodes = [(f"n{r.randrange(30)}", a := r.randrange(40), None if r.random() < 0.3 else a + r.randrange(1, 15)) for _ in range(60)]
    aliases = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(15)]
    edges = [("n1" if r.random() < 0.5 else f"n{r.randrange(45)}", f"n{r.randrange(45)}", k, r.randrange(50)) for k in range(400)]
    step = {}
    for a, b in aliases:
        step.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in step.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    want = {(k, side) for s, t, k, d in edges for side, x in (("source", s), ("target", t)) if not any(i in reach(x) and a <= d and (b is None or b > d) for i, a, b in nodes)}
    assert {tuple(x) for x in O.orphan_references(*frames(spark, edges, nodes, aliases)).select("ordinal", "side").collect()} == want
    report = O.orphan_report(*frames(spark, edges, nodes, aliases)).collect()
    assert sum(x["orphans"] for x in report) == len(want) and sum(x["references"] for x in report) == 800


def test_long_alias_chain_and_many_stays(spark, rows):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(70)]
    nodes = [("c70", 3, 5), ("c35", 8, 9)] + [("m", 10 * k, 10 * k + 5) for k in range(40)]
    edges = [("c0", "c40", 1, 4), ("c0", "c36", 2, 8), ("c70", "c71", 3, 4)] + [("m", "m", 100 + d, d) for d in range(0, 420, 3)]
    got = rows(O.orphan_references(*frames(spark, edges, nodes, chain)).select("ordinal", "side"))
    want = [(2, "target"), (3, "target")] + [(100 + d, side) for d in range(0, 420, 3) if d >= 400 or d % 10 >= 5 for side in ("source", "target")]
    assert got == sorted(want, key=lambda r: (True, str(r[0]), True, str(r[1])))


def test_missing_keys_come_from_runs_of_numbered_ids(spark):
    from codeweft.session import Scratch

    ids = spark.createDataFrame([(f"id{i:04}", i % 7 != 0, i % 3 == 0) for i in range(500)], "id string, parent boolean, referenced boolean")
    keys = O.numbered(ids, Scratch(spark, "t"))
    order = [r["num"] for r in keys.orderBy("id").collect()]
    assert order == sorted(order) and len(set(order)) == 500
    missing = {r["id"] for r in keys.join(O.missing_keys(keys), "num").collect()}
    assert missing == {f"id{i:04}" for i in range(500) if i % 7 == 0 and i % 3 == 0}


def test_orphan_keys(spark, rows):
    children = spark.createDataFrame([(k, 1) for k in (1, 2, 2, 5, 70_000, 70_000, -4, None)], "k long, references int")
    parents = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 70_001, None)], "k long")
    assert rows(O.orphan_keys(children, "k", parents, "k")) == [(-4, 1), (5, 1), (70_000, 2)]
    assert O.orphan_keys(children, "k", parents.limit(0), "k").count() == 5
    assert O.orphan_keys(children.limit(0), "k", parents, "k").count() == 0
