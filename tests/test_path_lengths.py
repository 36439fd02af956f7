from codeweft.queries import graph as G
from test_call_processes import graph_tables


def test_path_lengths_go_beyond_six_steps(spark, tmp_path):
    ids = [G.SEED, *[f"a.go::f{i}" for i in range(34)]]
    graph_tables(spark, tmp_path, [(i, "function") for i in ids], [(a, b, "calls") for a, b in zip(ids, ids[1:])])
    got = {x["id"]: x["depth"] for x in G.path_lengths(spark, str(tmp_path)).collect()}
    assert got == {i: k for k, i in enumerate(ids) if k <= 32}
