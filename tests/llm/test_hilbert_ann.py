import os

import numpy as np
import pytest

from fragspark.llm.hilbert_ann import hilbert_keys, nearest


def test_keys_walk_the_curve():
    for dims, levels in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << levels)] * dims), -1).reshape(-1, dims)
        order = grid[np.argsort(hilbert_keys(grid, levels))]
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def brute(ids, x, k, every):
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = sorted((-(x[j] * q).sum(), ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out += [(i, r, j, -v) for r, (v, j) in enumerate(s, 1)]
    return out


def test_small_tables_are_exact(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    x[50:120] = x[3]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    bad = [(1000, None, ""), (1020, [0.0] * 8, ""), (1040, [float("nan")] * 8, ""), (1060, [1.0, None] * 4, ""), (1080, [float("inf")] * 8, ""), (None, [1.0] * 8, ""), (1100, [1.0], ""), (1120, [], "")]
    got = nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cell string")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [w[:3] for w in brute(range(300), x, 20, 20)]
    few = nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>, cell string")).collect()
    assert len(few) == 4
    assert nearest(spark.createDataFrame(bad[:3], "vec_id long, embedding array<double>, cell string")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="no test data")
def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want = {(w[0], w[2]) for w in brute(ids, x, 20, 20)}
    got = {(r.query_id, r.vec_id) for r in nearest(df).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
