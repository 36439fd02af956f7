import random

from codeweft.operators import hierarchy as H


def links(spark, pairs):
    return spark.createDataFrame([(p, n, "x", 1) for p, n in pairs], "parent string, node string, w string, op int")


def brute(pairs):
    up = {n: p for p, n in pairs}
    out = {}
    for x in {a for p in pairs for a in p}:
        path, at = [x], x
        while at in up and len(path) <= len(up) + 1:
            at = up[at]
            path.append(at)
        out[x] = ("", -1) if at in up else (at, len(path) - 1)
    return out


def test_forest_chain_cycle(spark):
    r = random.Random(7)
    pairs = [(f"t{r.randrange(max(1, i))}", f"t{i}") for i in range(1, 60)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(25)]  # a chain
    pairs += [("x", "y"), ("y", "z"), ("z", "x"), ("z", "below"), ("below", "lower"), ("self", "self"), ("self", "kid")]
    pairs += [("hub", f"h{i}") for i in range(80)]
    tree = H.hierarchy(links(spark, pairs + pairs[:5] + [(None, "q"), ("q", None)]), with_paths=True)
    got = {x["node_id"]: (x["root_id"], x["depth"], x["path"]) for x in tree.collect()}
    want = brute(pairs)
    assert {k: v[:2] for k, v in got.items()} == want
    up = {n: p for p, n in pairs}
    for node, (root, depth, path) in got.items():
        if depth < 0:
            assert path is None
        else:
            assert path[0] == root and path[-1] == node and all(up[b] == a for a, b in zip(path, path[1:]))
    pairs_down = H.descendants(tree)
    assert pairs_down.count() == sum(d for _, d in want.values() if d > 0)
    sizes = {x[0]: x[1] for x in H.subtree_sizes(links(spark, pairs)).collect()}
    below = {}
    for x in pairs_down.collect():
        below[x["ancestor_id"]] = below.get(x["ancestor_id"], 0) + 1
    assert sizes == {k: below.get(k, 0) if d >= 0 else None for k, (_, d) in want.items()}
    assert sizes["hub"] == 80 and sizes["c0"] == 25 and sizes["c25"] == 0 and sizes["x"] is None


def test_empty(spark):
    assert H.hierarchy(links(spark, [])).count() == 0


def test_contains_links_spelling(spark, rows):
    e = spark.createDataFrame([("./a", "b ", " CONTAINS"), ("a", "b", "contains"), ("a", "c", "calls"), ("", "c", "contains"), (None, "c", "contains"), ("a\\d", "e", "Contains")], "source string, target string, kind string")
    assert rows(H.contains_links(e)) == [("a", "b"), ("a/d", "e")]


def test_a_long_chain_is_contracted(spark):
    pairs = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    got = {x["node_id"]: (x["root_id"], x["depth"]) for x in H.hierarchy(links(spark, pairs)).collect()}
    assert got == {f"c{i:04}": ("c0000", i) for i in range(1001)}
