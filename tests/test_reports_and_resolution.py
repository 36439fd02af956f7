import json

from codeweft.operators import export as X
from codeweft.operators import resolution as R
from codeweft.sources import reports as P


def test_audits(spark):
    reports = [
        json.dumps([{"name": "a", "version": "1", "vulns": [{"id": "V1"}, {"id": "V2"}]}, {"name": "ok", "version": "1", "vulns": []}]),
        json.dumps({"vulnerabilities": {"b": {"severity": "high", "range": "<2", "via": ["x", {"source": 7}]}}}),
        json.dumps({"results": [{"packages": [{"package": {"name": "c", "version": "3"}, "vulnerabilities": [{"id": "O1", "database_specific": {"severity": "LOW"}}]}]}]}),
        "{broken", None, "3",
    ]
    got = {tuple(x)[1:] for x in P.audits(spark.createDataFrame(list(enumerate(reports)), "id int, report string")).collect()}
    assert got == {("a", "1", "V1", "unknown"), ("a", "1", "V2", "unknown"), ("b", "<2", "7", "high"), ("c", "3", "O1", "low")}


def test_profile_edges(spark, rows):
    frame = lambda n: {"functionName": n, "url": "u", "lineNumber": 1}
    profile = json.dumps({"nodes": [{"id": 1, "callFrame": frame("f"), "children": [2, 3]}, {"id": 2, "callFrame": frame("g")}, {"id": 3, "callFrame": frame("h")}], "samples": [2, 2, 1]})
    got = P.profile_edges(spark.createDataFrame([("p", profile), ("q", "no json"), ("r", None)], "id string, profile string"))
    assert rows(got.select("source", "target", "count")) == [("u::f", "u::g", 2), ("u::f", "u::h", 1)]


def test_framework_lines(spark, rows):
    code = "@app.get('/a/{id}')\nrouter.post('/b/:x', f)\nbus.emit('done')\nawait send(\"/c/d\", x)\n"
    got = P.framework_lines(spark.createDataFrame([("p", code), ("q", None)], "path string, content string"))
    assert rows(got.select("line", "kind", "verb", "name").distinct()) == [(1, "route", "GET", "/a/*"), (2, "route", "POST", "/b/*"), (3, "event", "ANY", "done"), (4, "call", "ANY", "/c/d")]


def test_exports(spark, rows):
    n = spark.createDataFrame([("a<b", "file", "p", "n", 1, 2, "x", "python", True, "c")], "id string, kind string, path string, name string, line int, end_line int, area string, language string, exported boolean, community string")
    e = spark.createDataFrame([("a<b", "c", "calls")], "source string, target string, kind string")
    xml = {x["part"]: x["xml"] for x in X.graphml_rows(n, e).collect()}
    assert xml["node"].startswith('<node id="a&lt;b">') and 'target="c"' in xml["edge"]
    assert X.bounded_json(n, 10**6)[0] == "full" and X.bounded_json(n, 30)[0] == "compact" and X.bounded_json(n, 1)[0] == "stub"
    assert rows(X.markdown_pages(n)) == [("x", "x", "# x\n\n- p")]
    s = "path string, what string, name string, owner string, exported boolean"
    before = spark.createDataFrame([("p", "function", "f", "", True), ("p", "function", "g", "", True), ("p", "class", "k", "", False)], s)
    after = spark.createDataFrame([("p", "function", "f", "", False), ("p", "class", "k", "", False), ("p", "class", "n", "", False)], s)
    assert rows(X.semantic_changes(before, after)) == [("p", "f", "", "changed"), ("p", "g", "", "removed"), ("p", "n", "", "added")]


def test_resolution(spark, rows):
    files = spark.createDataFrame([("src/pkg/__init__.py",), ("src/pkg/mod.py",), ("a/util.py",), ("b/util.py",), ("tests/test_mod.py",)], "path string")
    imports = spark.createDataFrame([("a/x.py", "pkg.mod.name"), ("a/x.py", "util"), ("a/x.py", "os.path"), ("a/x.py", "b.util")], "path string, name string")
    assert rows(R.resolve_imports(imports, files)) == [("a/x.py", "b.util", "b/util.py"), ("a/x.py", "pkg.mod.name", "src/pkg/mod.py")]
    assert rows(R.ancestor_packages(spark.createDataFrame([("src/pkg/mod.py",)], "path string"), files)) == [("src/pkg/__init__.py", "src/pkg/mod.py")]
    planned = spark.createDataFrame([("src/pkg/mod.py",), ("lost/mod.py",), ("lost/util.py",)], "path string")
    assert rows(R.repair_paths(planned, files)) == [("lost/mod.py", "src/pkg/mod.py", "basename"), ("lost/util.py", "lost/util.py", "unknown"), ("src/pkg/mod.py", "src/pkg/mod.py", "known")]
    assert rows(R.suggested_tests(files, files)) == [("src/pkg/mod.py", "tests/test_mod.py")]
    symbols = spark.createDataFrame([("x", "a.py", "used", 1, 2), ("y", "a.py", "self", 3, 4)], "id string, path string, name string, line int, end_line int")
    texts = spark.createDataFrame([("a.py", "def used():\n  pass\ndef self():\n  self()"), ("b.py", "used()")], "path string, content string")
    assert rows(R.unmentioned_symbols(symbols, texts)) == [("y",)]
    tasks = spark.createDataFrame([("t1", 1, ["a"]), ("t2", 2, ["a", "b"]), ("t3", 3, ["c"]), ("t4", 4, None)], "id string, order int, paths array<string>")
    assert R.disjoint_wave(tasks, 2) == ["t1", "t3"]
