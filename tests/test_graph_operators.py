import random

import pytest

from codeweft.operators import cypher as C
from codeweft.operators import metrics as M
from codeweft.operators import ranking as R
from codeweft.operators import symbols as S
from codeweft.operators import traversal as T
from codeweft.sources import graph as G

NODES = "id string, kind string, path string, name string, line int, end_line int, area string, language string, exported boolean, community string, ordinal long, deleted_at timestamp"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, p, n, 1, 9, "x", "python", False, "", o, None) for o, (i, k, p, n) in enumerate(rows)], NODES).drop("deleted_at")


def edges(spark, *rows):
    return spark.createDataFrame([(s, t, k, r, o) for o, (s, t, k, r) in enumerate(rows)], "source string, target string, kind string, rank int, ordinal long")


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, ("a.py::foo", "function", "a.py", "foo"), ("b.py::bar", "function", "pkg/b.py", "bar"), ("c.py::baz", "function", "c.py", "baz"))
    e = edges(spark, ("a.py::foo", "b.py::bar", "calls", 2), ("a.py::foo", "c.py::baz", "imports", 2))
    return n, e


def test_cypher(small):
    got = C.run("MATCH (a)-[r:CALLS]->(b) WHERE contains(a.name,'foo') AND starts with(b.path,'pkg/') RETURN a,b LIMIT 10", *small).collect()
    assert [x["b_name"] for x in got] == ["bar"]
    assert [x["a_id"] for x in C.run("MATCH (a) RETURN a LIMIT 2", *small).collect()] == ["a.py::foo", "b.py::bar"]
    for text, error in (("CREATE (a) RETURN a", "Mutating"), ("MATCH (a)--(b) RETURN a", "Unsupported Cypher"), ("MATCH (a)-[r:OWNS]->(b) RETURN a", "Unsupported relationship")):
        with pytest.raises(C.CypherError, match=error):
            C.run(text, *small)
    with pytest.raises(C.CypherError):
        C.run("MATCH (a) WHERE a.name = 'x' RETURN a", *small, strict=True)


def test_symbol_lookup(small, rows):
    assert rows(S.match_symbols(small[0], "FOO").select("id", "tier")) == [("a.py::foo", 0)]
    assert [x["id"] for x in S.match_symbols(small[0], "ba").collect()] == ["b.py::bar", "c.py::baz"]
    v = S.symbol_view(*small, "bar").collect()[0]
    assert v["callers"] == ["a.py::foo"] and v["imports"] == []
    assert rows(S.non_test_inbound(*small)) == [("b.py::bar",), ("c.py::baz",)]


def test_current_views(spark, rows):
    raw = spark.createDataFrame([("./a", "b", "Calls ", "INFERRED", 3), ("a", "b", "calls", "extracted", 1), ("a", None, "calls", None, 2), ("a", "c", None, None, 4)], "source string, target string, kind string, confidence string, ordinal long")
    assert rows(G.current_edges(raw)) == [("a", "b", "calls", 2, 1)]


def test_degrees_leave_out_tests(spark, rows):
    e = edges(spark, ("tests/t.py::t", "a::f", "calls", 2), ("b::g", "a::f", "calls", 1), ("b::g", "a::f", "contains", 2), ("b::g", "a::x", "calls", 0))
    assert rows(M.degrees(e)) == [("a::f", 2, 2, 0), ("b::g", 1, 0, 1)]


def random_links(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


def reach(links, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in links:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_traversals_against_brute_force(spark):
    links = random_links(1, 30, 45)
    e = edges(spark, *[(a, b, "calls", 2) for a, b in links])
    seeds = spark.createDataFrame([("n1",)], "id string")
    got = {x["id"]: x["depth"] for x in T.layers(T.outbound(e), seeds).collect()}
    assert set(got) == reach(links, "n1")
    for a, b in links:
        if a in got:
            assert got[b] <= got[a] + 1
    end = max(got, key=lambda x: (got[x], x))
    path = T.shortest_path(e, "n1", end).collect()
    assert [x["step"] for x in path] == list(range(got[end] + 1)) and path[0]["id"] == "n1" and path[-1]["id"] == end
    assert T.shortest_path(e, "n1", "nowhere").count() == 0
    assert {x["id"] for x in T.impact(e, seeds, 99).collect()} <= reach([(b, a) for a, b in links], "n1")


@pytest.mark.parametrize("seed", [2, 3])
def test_components_against_brute_force(spark, seed):
    links = random_links(seed, 25, 40)
    df = spark.createDataFrame(links, "src string, dst string")
    ids = {x for p in links for x in p}
    closure = {x: reach(links, x) for x in ids}
    want = {x: min(y for y in ids if y in closure[x] and x in closure[y]) for x in ids}
    assert {x["id"]: x["component"] for x in R.strong_components(df).collect()} == want
    both = links + [(b, a) for a, b in links]
    assert {x["id"]: x["component"] for x in R.connected_components(df).collect()} == {x: min(reach(both, x)) for x in ids}


def test_pagerank_sums_to_one_and_matches(spark):
    links = random_links(4, 12, 30)
    got = {x["id"]: x["rank"] for x in R.pagerank(spark.createDataFrame(links, "src string, dst string"), 20).collect()}
    ids = sorted({x for p in links for x in p})
    out = {x: [b for a, b in links if a == x] for x in ids}
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(20):
        lost = sum(r[x] for x in ids if not out[x])
        r = {x: 0.15 / len(ids) + 0.85 * (sum(r[a] / len(out[a]) for a, b in links if b == x) + lost / len(ids)) for x in ids}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[x] - r[x]) < 1e-9 for x in ids)


def test_topological_levels_with_cycle(spark, rows):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert rows(R.topological_levels(df)) == [("a", 0), ("b", 1), ("c", 2), ("x", -1), ("y", -1), ("z", -1)]


def test_louvain_finds_planted_communities(spark):
    import random

    r = random.Random(5)
    pairs = [(f"c{c}n{i:02}", f"c{c}n{j:02}") for c in range(6) for i in range(20) for j in range(i + 1, 20) if r.random() < 0.5]
    pairs += [(f"c{r.randrange(6)}n{r.randrange(20):02}", f"c{r.randrange(6)}n{r.randrange(20):02}") for _ in range(40)] + [("c0n01", "c0n01"), (None, "x"), pairs[0], pairs[0][::-1]]
    links = spark.createDataFrame(pairs, "src string, dst string")
    found = R.louvain(links)
    groups = {}
    for x in found.collect():
        groups.setdefault(x["community"], []).append(x["id"][:2])
    assert sum(max(map(g.count, set(g))) for g in groups.values()) >= 114 and 4 <= len(groups) <= 9
    assert R.modularity(links, found).first()[0] > 0.6
    assert R.louvain(links.limit(0)).count() == 0
