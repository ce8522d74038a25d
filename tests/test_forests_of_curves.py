"""What of a network's edges reaches the task that draws its curve."""

import random

from fragspark.operators import kernels as K
from fragspark.operators import replay as R


def test_less_than_an_edge_per_vertex_reaches_the_networks_task(spark):
    rnd = random.Random(5)
    rows = sorted({("g", *sorted(rnd.sample(range(60), 2))) for _ in range(900)})
    e = spark.createDataFrame(rows, "network string, src long, dst long").repartition(7)
    ranks = spark.createDataFrame([("g", "h", v, float(-v), v + 1) for v in range(60)], "network string, heuristic string, v long, score double, removal_num int")
    left = R.rank_forest(e, ranks).collect()
    assert len(left) < 60
    for ties in ("distinct", "multiset"):
        want = K.reverse_curve(60, [a + 1 for _, a, b in rows], [b + 1 for _, a, b in rows], ties)
        got = K.reverse_curve(60, [r.ra for r in left], [r.rb for r in left], ties)
        assert all((x == y).all() for x, y in zip(want, got, strict=True))
    curve = R.static_curve(e, ranks, 0.1).orderBy("removal_num").collect()
    assert [round(r.lcc * 60) for r in curve] == want[0][: len(curve)].tolist()


def test_tasks_thin_what_they_hold(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(R, "HELD_EDGES", 20)
    rnd = random.Random(6)
    rows = pd.DataFrame([("g" if i % 3 else "h", "x", *rnd.sample(range(1, 15), 2)) for i in range(400)], columns=["network", "heuristic", "ra", "rb"])
    out = pd.concat(R._forest(iter([rows[i : i + 30] for i in range(0, 400, 30)])))
    assert out.groupby("network").size().to_dict() == {"g": 13, "h": 13}
