import random

from codeweft.operators import joins as J
from codeweft.queries import tables as Q


def test_route_match_keeps_whole_keys(spark, tmp_path, rows):
    spark.createDataFrame([(7,), (57,)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 57, "F"), (4, 107, "O"), (1, 57, "F")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(Q.route_match(spark, str(tmp_path))) == [("GET /orders/57/{status}/", "GET /orders/57/F")]


def test_match_routes_against_all_pairs(spark, rows):
    r = random.Random(4)
    urls = lambda: "/" + "/".join(r.choice(["a", "b", "c", "*", ":id", "x*"]) for _ in range(r.randrange(4)))
    make = lambda n, k: [(f"{k}{i}", r.choice(["get", "GET", "POST", "any", "*", None]), r.choice([urls(), urls(), urls(), None])) for i in range(n)]
    a, b = make(60, "r"), make(80, "c")

    def fits(x, y):
        verb = [z and z.upper() for z in (x[1], y[1])]
        if None in (x[2], y[2]) or not ("ANY" in verb or (verb[0] == verb[1] and verb[0])):
            return False
        s, t = ([("*" if p == ":id" else p) for p in u[2].split("/") if p] for u in (x, y))
        return len(s) == len(t) and all(p == q or "*" in (p, q) for p, q in zip(s, t))

    schema = "id string, verb string, url string"
    got = J.match_routes(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert rows(got) == sorted((x[0], y[0]) for x in a for y in b if fits(x, y))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x][0].count("=") >= 3, plan
