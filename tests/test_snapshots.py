import hashlib
from datetime import UTC, datetime, timedelta

from codeweft.operators import snapshots as N

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def files(spark, data):
    out = [(g, p, h, c, None if t is None else T0 + timedelta(minutes=t), "clash", 1) for g, p, h, c, t in data]
    return spark.createDataFrame(out, "generation_id long, path string, content_hash string, content string, ingested_at timestamp, row_hash string, snapshot int")


def generations(spark, *ids, failed=()):
    return spark.createDataFrame([(i, "committed") for i in ids] + [(i, "failed") for i in failed] + [(None, "committed")], "id long, state string")


def test_changes(spark, rows):
    sha = hashlib.sha256(b"text").hexdigest()
    f = files(spark, [
        (1, "same", "AA", None, 0), (2, "same", " aa", None, 0), (4, "same", "sha256:aa", None, 0),
        (1, "hash", sha.upper(), None, 0), (2, "hash", "", "text", 0), (4, "hash", None, "other", 0),
        (1, "gone", "a", None, 0), (4, "gone", "a", None, 0),
        (2, "late", "a", None, 1), (2, "late", "b", None, 5), (4, "late", "b", None, None), (4, "late", "c", None, 0), (4, "late", "c", None, 0),
        (3, "failed", "a", None, 0), (4, "new", "a", None, 0), (4, None, "a", None, 0),
        (1, "none", None, None, 0), (2, "none", None, None, 0), (4, "none", None, None, 0),
    ])
    g = generations(spark, 1, 2, 4, failed=(3,))
    want = [(2, "gone", "removed"), (4, "gone", "added"), (4, "hash", "changed"), (2, "late", "added"), (4, "late", "changed"), (4, "new", "added")]
    assert set(rows(N.file_changes(f, g))) == set(want)
    spans = {(p, a, b) for p, _, a, b in rows(N.file_intervals(f, g))}
    assert {("same", 1, 4), ("hash", 1, 2), ("hash", 4, 4), ("gone", 1, 1), ("gone", 4, 4)} <= spans


def test_empty_and_single(spark):
    f = files(spark, [(1, "a", "x", None, 0)])
    assert N.file_changes(f, generations(spark, 1)).count() == 0
    assert N.file_changes(f.limit(0), generations(spark, 1, 2)).count() == 0
    assert N.file_changes(f, generations(spark, failed=(1,))).count() == 0
    assert N.newest_generation(generations(spark, failed=(1,))) is None


def test_current_files(spark, rows):
    f = files(spark, [(1, "a", "x", "old", 0), (1, "a", "x", "new", 2), (1, "a", "x", "never", None), (2, "a", "x", "other", 9)])
    assert rows(N.current_files(f, 1, ["content"])) == [("a", "new")]
