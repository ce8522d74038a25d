"""Replay memory against plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from fragspark.operators import memory as Y


def some_steps(spark):
    draw = random.Random(4)
    rows = [("hot" if i % 3 else draw.choice(["a", "b", "c", None]), i, draw.randrange(100) if i % 7 else None) for i in range(400)] + [("one", 1000, 5)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "episode string, at long, reward long").repartition(5)


@pytest.mark.parametrize(("n", "gamma", "block"), [(5, 1.0, 7), (3, 0.5, 65536), (1, 1.0, 2)])
def test_returns_equal_loops(spark, monkeypatch, n, gamma, block):
    monkeypatch.setattr(Y, "BLOCK", block)
    rows, steps = some_steps(spark)
    got = {r.at: (r.n_return, r.next_state, r.terminal) for r in Y.n_step(steps, "episode", ["at"], "reward", "at", n, gamma).collect()}
    want = {}
    for name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        for i, r in enumerate(own):
            want[r[1]] = (sum((x[2] or 0) * gamma**j for j, x in enumerate(own[i : i + n])), own[i + n][1] if i + n < len(own) else None, i + n >= len(own))
    assert got == want


def test_draws_equal_loops(spark):
    draw = random.Random(6)
    errors = [0.0, 5.0, None, *(draw.random() for _ in range(60))]
    memory = Y.with_priorities(spark.createDataFrame(list(enumerate(errors)), "id long, error double").repartition(6), "error")
    got = Y.drawn(memory, ["id"], 40, seed=9).collect()
    most = (1.0) ** 0.6
    units = [max(1, round((most if e is None else min(abs(e) + 1e-7, 1.0) ** 0.6) * 1_000_000)) for e in errors]
    total, want = sum(units), []
    for j in range(40):
        u = int(hashlib.md5(f"9:{j}".encode()).hexdigest()[:8], 16)
        at, i = (j * 2**32 + u) * total // (40 * 2**32), 0
        while at >= units[i]:
            at, i = at - units[i], i + 1
        want.append((j, i, round((units[i] / min(units)) ** -0.4, 9)))
    assert sorted((r.draw, r.id, round(r.weight, 9)) for r in got) == want


def test_frequencies_follow_priorities(spark):
    memory = spark.createDataFrame([(i, float(1 + i % 4) if i else 200.0) for i in range(50)], "id long, priority double")
    total = 200 + sum(1 + i % 4 for i in range(1, 50))
    got = Counter(r.id for r in Y.drawn(memory, ["id"], 1000, seed=1).collect())
    assert sum(got.values()) == 1000
    assert all(abs(got[i] - 1000 * (200 if not i else 1 + i % 4) / total) <= 2 for i in range(50))
    once = [r.id for seed in range(40) for r in Y.drawn_once(memory, ["id"], 5, seed).collect()]
    seen = Counter(once)
    assert seen[0] >= 38 and sum(n for i, n in seen.items() if i % 4 == 3) > sum(n for i, n in seen.items() if i and i % 4 == 0)
    assert len({r.id for r in Y.drawn_once(memory, ["id"], 60).collect()}) == 50


def test_memory_keeps_the_newest_and_takes_new_errors(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 0.5) for i in range(9)], "id long, error double").repartition(4)
    assert sorted(r.id for r in Y.newest(rows, ["id"], 4).collect()) == [5, 6, 7, 8]
    new = spark.createDataFrame([(3, 0.1), (3, 0.1), (4, 0.9)], "id long, error double")
    got = {r.id: r.error for r in Y.re_priced(rows, new, ["id"], "error").collect()}
    assert len(got) == 9 and got[3] == 0.1 and got[4] == 0.9 and got[0] == 0.5 and got[5] is None


def test_empty_memory(spark):
    none = spark.createDataFrame([], "episode string, at long, reward long")
    assert Y.n_step(none, "episode", ["at"], "reward", "at").collect() == []
    empty = Y.with_priorities(spark.createDataFrame([], "id long, error double"), "error")
    assert Y.drawn(empty, ["id"], 3).collect() == [] and Y.drawn_once(empty, ["id"], 3).collect() == []
