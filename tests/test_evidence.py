from datetime import datetime

from pyspark.sql import functions as F

from codeweft.operators import evidence as V


def test_last_evidence_and_what_is_unproven(spark, rows):
    c = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "x"), (None, "x")], "criterion_id long, status string")
    e = spark.createDataFrame([(1, 1, "failed"), (1, 2, "passed"), (2, 5, "passed"), (2, 5, "failed"), (None, 1, "passed"), (9, 1, "passed")], "criterion_id long, ordinal int, status string")
    assert rows(V.evidence_matrix(c, e)) == [(1, "passed"), (2, "passed"), (3, "no_evidence")]
    assert rows(V.unproven(c, e.where("status = 'passed'"), e.limit(0))) == [(3,)]
    assert rows(V.coverage_summary(c, e)) == [(3, 2, 2, 0, 1, 0.666667)]
    assert rows(V.evidence_matrix(c, e.limit(0))) == [(1, "no_evidence"), (2, "no_evidence"), (3, "no_evidence")] and V.evidence_matrix(c.limit(0), e).count() == 0


def test_preferred_gaps_and_counts(spark, rows):
    g = spark.createDataFrame(
        [("a", False, "critical", 1), ("a", True, "low", 3), ("a", True, "HIGH", 5), ("a", True, "high", 4), ("b", None, None, 2), ("b", False, "odd", 1), (None, True, "low", 7)],
        "k string, blocking boolean, severity string, ordinal int",
    )
    assert rows(V.preferred(g, ["k"], ["ordinal"]).select("k", "ordinal")) == [(None, 7), ("a", 4), ("b", 1)]
    assert rows(V.gap_counts(g, ["k"])) == [(None, 1, 0, "low"), ("a", 3, 1, "critical"), ("b", 0, 2, None)]


def test_ordinals_go_on(spark, rows):
    old = spark.createDataFrame([("s", 3), ("s", 7)], "session string, ordinal long")
    new = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "c")], "session string, event string")
    assert rows(V.append_ordinals(old, new, "session", ["event"])) == [("s", "a", 8), ("s", "b", 9), ("t", "c", 1)]


def test_orphans_retention_and_staleness(spark, rows):
    at = lambda h: datetime(2025, 1, 1, h)
    runs = spark.createDataFrame([(1, "running", at(1)), (2, "running", at(9)), (3, "done", at(1)), (4, "running", None)], "run_id long, status string, touched timestamp")
    assert rows(V.orphaned(runs, F.lit(at(10)), 3600 * 5)) == [(1, "running", True), (2, "running", False), (3, "done", False), (4, "running", None)]
    m = spark.createDataFrame([("a", k, at(k), k == 1) for k in range(1, 6)], "agent string, message_id long, sent timestamp, unread boolean")
    assert rows(V.retained(m, 2).select("message_id")) == [(1,), (4,), (5,)]
    inputs = spark.createDataFrame([("g", "1"), ("h", "2")], "gate string, input_hash string")
    cache = spark.createDataFrame([("g", "1", True), ("h", "2", False), ("h", "3", True)], "gate string, input_hash string, passed boolean")
    assert rows(V.stale_hashes(inputs, cache)) == [("h", "2")]
    pages = spark.createDataFrame([("p", "x"), ("q", "old")], "page string, fingerprint string")
    sources = spark.createDataFrame([("p", "x"), ("q", "new"), ("r", "y")], "page string, fingerprint string")
    assert rows(V.stale_pages(pages, sources)) == [("q", "outdated"), ("r", "missing")]


def test_links_scores_coverage_and_grep(spark, rows):
    d = spark.createDataFrame([("a", "see [b](b) and [c](c#x) or [w](https://x.y)"), ("b", None), ("d", "[a](a)")], "id string, text string")
    assert rows(V.broken_links(d)) == [("a", "c")]
    s = spark.createDataFrame([("x", 2.0), ("x", -1.0), ("x", None), ("y", 0.5)], "arm string, score double")
    assert rows(V.mean_score(s, ["arm"])) == [("x", 3, 0.333333), ("y", 1, 0.5)]
    c = spark.createDataFrame([("f", 1, True, "u"), ("f", 1, False, "v"), ("f", 2, False, "u")], "path string, line int, executed boolean, tool string")
    assert rows(V.merge_coverage(c)) == [("f", 2, 1, "u+v")]
    lines = spark.createDataFrame([(1, 1, "An Error"), (1, 2, "ok"), (2, 1, "error 2"), (2, 2, None)], "id long, line int, text string")
    assert rows(V.grep(lines, "eRRor", 1)) == [(2, 1, "error 2")]
