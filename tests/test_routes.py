from codeweft.operators import routes as R
from codeweft.sources.reports import framework_lines

API = """from x import app

@app.get("/users/{id}")
def user(id):
    return {"name": 1, "mail": 2}

@app.post("/users")
def add(body):
    if not body:
        return None
    return {'id': 3}

@app.get("/unused")
def unused():
    return {"a": 1}
"""
WEB = """async function load(id) {
  const answer = await fetch(`/users/${id}`);
  const data = await answer.json();
  show(data.name, data["age"]);
}
"""
MORE = """const { mail, role: r } = await axios.get('/users/7');
"""
PY = """def send():
    got = requests.post("/users", json={})
    return got["id"]
"""


def files(spark):
    return spark.createDataFrame([("api.py", API, 1), ("web.js", WEB, 1), ("more.ts", MORE, 1), ("send.py", PY, 1), ("null.py", None, 1), (None, PY, 1), ("empty.js", "", 1)], "path string, content string, line int")


def test_fetch_sites(spark):
    got = {(s["path"], s["line"]): (s["verb"], s["url"], s["keys"]) for s in R.fetch_sites(files(spark)).collect()}
    assert got == {("web.js", 2): ("GET", "/users/${id}", ["age", "name"]), ("more.ts", 1): ("GET", "/users/7", ["mail", "role"]), ("send.py", 2): ("POST", "/users", ["id"])}


def test_route_map_with_shapes_and_risk(spark):
    f = files(spark)
    routes = framework_lines(f.select("path", "content")).where("kind = 'route' and path = 'api.py'").dropDuplicates(["path", "line"])
    handlers = spark.createDataFrame([("api.py::user", "api.py", 4), ("api.py::add", "api.py", 8), ("api.py::unused", "api.py", 14)], "id string, path string, line int")
    got = {r["url"]: r for r in R.route_map(routes, handlers, f).collect()}
    assert set(got) == {"/users/*", "/users", "/unused"}
    u = got["/users/*"]
    assert (u["handler"], u["consumers"], u["missing"], u["unused"], u["risk"]) == ("api.py::user", 2, ["age", "role"], [], "high")
    assert (got["/users"]["consumers"], got["/users"]["missing"], got["/users"]["risk"]) == (1, [], "low") and got["/unused"]["risk"] == "none"
    assert R.route_map(routes.limit(0), handlers, f).count() == 0
