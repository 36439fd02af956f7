import json

import numpy as np

from codeweft.llm import queries as Q


def test_pairs_have_five_neighbours_however_far(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(900, 64))
    rows = [(f"v{i:03}", "p", json.dumps(v.tolist()), "m", 1) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "node_id string, path string, vector_json string, model string, generation_id long").write.parquet(f"{tmp_path}/symbol_vectors.parquet")
    got = {(a, b) for a, b, _ in Q.p4_pairs(spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {(f"v{min(i, j):03}", f"v{max(i, j):03}") for i in range(len(x)) for j in top[i]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    assert Q.p4_found(spark, str(tmp_path)).count() == 0


def test_recall_of_few_or_no_vectors(spark):
    from codeweft.llm import neighbours as NE

    x = np.random.default_rng(4).normal(size=(400, 64))
    v = spark.createDataFrame([(f"v{i:03}", "p", json.dumps(a.tolist()), "m", 1) for i, a in enumerate(x)], "node_id string, path string, vector_json string, model string, generation_id long")
    got = NE.index_quality(v).collect()
    assert len(got) == 1 and got[0]["entries"] == 400 and got[0]["neighbours"] == 0 and got[0]["recall"] is None
    far = NE.index_quality(v, least=float("-inf")).collect()[0]
    assert far["neighbours"] == 5 * far["queries"] and far["recall"] > 0.6
    assert NE.index_quality(v.limit(0)).count() == 0 and NE.similar_pairs(v.limit(1)).count() == 0
