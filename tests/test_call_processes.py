from codeweft.queries import graph as G

NODE = "id string, kind string, path string, name string, line int, end_line int, area string, language string, exported boolean, community string, ordinal long, deleted_at timestamp"
EDGE = "source string, target string, kind string, confidence string, ordinal long"


def graph_tables(spark, d, nodes, edges):
    spark.createDataFrame([(i, k, "p", i.split("::")[-1], 1, 9, "x", "go", False, "", o, None) for o, (i, k) in enumerate(nodes)], NODE).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(s, t, k, "extracted", o) for o, (s, t, k) in enumerate(edges)], EDGE).write.parquet(f"{d}/edges.parquet")


def test_call_processes_start_from_every_symbol(spark, tmp_path, rows):
    nodes = [("a.go", "file"), ("a.go::main", "function"), ("a.go::export_all", "function"), ("a.go::S.m", "method"), ("a.go::idle", "function")]
    edges = [("a.go::main", "a.go::export_all", "calls"), ("a.go::export_all", "a.go::S.m", "calls"), ("a.go::S.m", "a.go::export_all", "calls")]
    graph_tables(spark, tmp_path, nodes, edges)
    assert rows(G.call_processes(spark, str(tmp_path))) == [("a.go::S.m", 1, 1), ("a.go::export_all", 1, 1), ("a.go::idle", 0, 0), ("a.go::main", 2, 2)]
