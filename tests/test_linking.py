from codeweft.operators import linking as K

EDGES = "source string, target string, kind string, rank int, name string"


def edges(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], EDGES)


def test_overrides_and_owners(spark, rows):
    methods = spark.createDataFrame([("a.py::A.f", "f"), ("a.py::A.g", "g"), ("b.py::B.f", "f"), ("b.py::B.h", "h"), ("c.py::run", "run"), (None, "f")], "id string, name string")
    links = spark.createDataFrame([("b.py::B", "a.py::A"), ("b.py::B", "a.py::A"), ("a.py::A", "a.py::A"), (None, "a.py::A")], "source string, target string")
    assert rows(K.override_edges(links, methods)) == [("b.py::B.f", "a.py::A.f")]
    assert K.override_edges(links.limit(0), methods).count() == 0


def test_ladders(spark, rows):
    s = spark.createDataFrame([("p/a.py::X", "p/a.py", "X"), ("p/b.py::X", "p/b.py", "X"), ("q/c.py::Y", "q/c.py", "Y"), ("q/x.py::Z", "q/x.py", "Z"), ("q/z.py::Z", "q/z.py", "Z"), ("p/d.py::W", "p/d.py", "W"), ("r/d.py::W", "r/d.py", "W")], "id string, path string, name string")
    refs = spark.createDataFrame([("p/a.py::m", "X"), ("q/c.py::m", "X"), ("p/a.py::m", "Y"), ("p/a.py::m", "none"), ("p/a.py::m", "Z"), ("p/a.py::m", "W"), (None, "X"), ("p/a.py::m", None)], "source string, name string")
    got = {(r["source"], r["name"]): (r["target"], r["confidence"], r["candidates"]) for r in K.resolve_parents(refs, s).collect()}
    assert got[("p/a.py::m", "X")] == ("p/a.py::X", "extracted", None) and got[("p/a.py::m", "Y")] == ("q/c.py::Y", "inferred", None)
    assert got[("q/c.py::m", "X")] == ("p/a.py::X", "ambiguous", ["p/a.py::X", "p/b.py::X"]) and len(got) == 5
    assert {(r["source"], r["name"], r["target"]) for r in K.resolve_decorators(refs, s).collect()} == {("p/a.py::m", "X", "p/a.py::X"), ("p/a.py::m", "Y", "q/c.py::Y")}
    imports = spark.createDataFrame([("p/a.py", "q/x.py"), ("p/a.py", "q/z.py"), ("p/a.py", None)], "path string, imported string")
    rung = {(r["source"], r["name"]): (r["target"], r["rung"]) for r in K.call_ladder(refs, imports, s).collect()}
    assert rung == {("p/a.py::m", "X"): ("p/a.py::X", "same_file"), ("q/c.py::m", "X"): ("p/a.py::X", "ambiguous"), ("p/a.py::m", "Y"): ("q/c.py::Y", "unique"), ("p/a.py::m", "Z"): ("q/x.py::Z", "named_import"), ("p/a.py::m", "W"): ("p/d.py::W", "same_package")}


def test_dynamic_imports(spark, rows):
    c = spark.createDataFrame([("a.py", "m = importlib.import_module('pkg.mod')\nx = __import__(\"os\")"), ("b.js", "const y = await import('./lib/z.js'); require( '../q' )"), ("tests/t.py", "import_module('no')"), ("n.py", None)], "path string, content string")
    assert rows(K.dynamic_imports(c)) == [("lib.z", "b.js"), ("os", "a.py"), ("pkg.mod", "a.py"), ("q", "b.js")]


def test_affected_files(spark, rows):
    e = edges(spark, [("b.py", "a.py::f", "imports", 2), ("c.py::g", "b.py", "imports", 1), ("d.py", "c.py", "imports", 0), ("e.py::x", "a.py::f", "calls", 0), ("f.py", "f.py::y", "imports", 2)])
    changed = spark.createDataFrame([("a.py",), ("a.py",), (None,)], "path string")
    assert rows(K.affected_closure(e, changed)) == [("a.py", "changed"), ("b.py", "import"), ("c.py", "import"), ("e.py", "name")]


def test_surfaces_ignore_bodies_and_places(spark):
    c = spark.createDataFrame([("a", "def f(x):\n    return 1\n"), ("b", "\n\ndef  f(x):\n    return 2\n"), ("c", "def f(y):\n    return 1\n")], "path string, content string")
    s = {r["path"]: r["surface"] for r in K.surfaces(c).collect()}
    assert s["a"] == s["b"] != s["c"]


def test_publish_and_sync(spark, tmp_path, rows):
    from codeweft.operators import store as S

    root = str(tmp_path / "g")
    assert S.published_generation(spark, root) is None
    node = lambda *r: spark.createDataFrame(list(r), "id string, path string")
    edge = lambda *r: spark.createDataFrame(list(r), "source string, target string, source_path string, target_path string")
    changed = spark.createDataFrame([("b",)], "path string")
    assert S.sync(root, changed, node(("a1", "a"), ("b1", "b"), ("c1", "c")), edge(("a1", "b1", "a", "b"), ("a1", "c1", "a", "c"), ("b1", "c1", "b", "c"))) == 1
    assert S.sync(root, changed, node(("b2", "b")), edge(("b2", "c1", "b", "c"))) == 2
    assert rows(S.published(spark, root, "nodes")) == [("a1", "a"), ("b2", "b"), ("c1", "c")]
    assert rows(S.published(spark, root, "edges").select("source", "target")) == [("a1", "c1"), ("b2", "c1")]
    # a generation that was written but not published is not seen
    node(("x", "x")).write.parquet(f"{root}/generation=3/nodes")
    assert S.published(spark, root, "nodes").count() == 3


def test_graph_document(spark, tmp_path, rows):
    from codeweft.operators import store as S

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "kind": "file", "line": 3}, {"id": "b"}],\n "edges": [{"source": "a", "target": "b", "kind": "calls"}]}')
    n, e = S.read_graph_json(spark, str(tmp_path / "g.json"))
    assert rows(n.select("id", "kind", "line")) == [("a", "file", 3), ("b", None, None)] and rows(e) == [("a", "b", "calls", None)]
