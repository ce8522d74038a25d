"""Decycling by messages: what stays is a forest, and the sets are close to those of the rounds on one network in memory."""

import random

import numpy as np

from fragspark.operators import decycling as D
from fragspark.operators import kernels as K


def random_edges(seed, n, m, network="g"):
    rnd = random.Random(seed)
    return sorted({(network, *sorted(rnd.sample(range(n), 2))) for _ in range(m)})


def acyclic(rows, gone):
    union = {}

    def find(x):
        while union.setdefault(x, x) != x:
            x = union[x]
        return x

    for net, a, b in rows:
        if (net, a) in gone or (net, b) in gone:
            continue
        x, y = find((net, a)), find((net, b))
        if x == y:
            return False
        union[x] = y
    return True


def test_totals_leave_out_one_message_exactly():
    """Totals of all messages less one are the totals of the others."""
    rnd = np.random.default_rng(1)
    t, n = 5, 40
    key = rnd.integers(0, 6, n)
    zero, earlier, gain = D.parts(rnd.random((n, 2 * t)) * 3, t)
    rows = np.concatenate([zero[:, None], earlier, gain, np.ones(gain.shape), np.zeros(gain.shape)], 1)
    keys, total = D.merged(key, rows, t)
    for half in (D.merged(np.r_[keys], total, t)[1],):
        assert np.allclose(half, total)
    a, b = D.merged(key[:17], rows[:17], t), D.merged(key[17:], rows[17:], t)
    assert np.allclose(D.merged(np.r_[a[0], b[0]], np.concatenate([a[1], b[1]]), t)[1], total)
    for k in range(n):
        others = (key == key[k]) & (np.arange(n) != k)
        own = total[np.searchsorted(keys, key[k])]
        first, times, second = (own[1 + t * i : 1 + t * (i + 1)] for i in (1, 2, 3))
        assert np.allclose(own[1 : 1 + t] - earlier[k], earlier[others].sum(0), atol=1e-3)
        want = gain[others].min(0) if others.any() else np.zeros(t)
        assert np.allclose(np.where((gain[k] <= first) & (times == 1), second, first), np.minimum(want, 0))


def test_removals_leave_forests(spark):
    rows = random_edges(1, 40, 75) + random_edges(2, 25, 30, "h") + [("tree", 0, 1), ("tree", 1, 2)]
    gone = {tuple(r) for r in D.message_decycling(spark.createDataFrame(rows, "network string, src long, dst long"), depth=8, rounds=25).collect()}
    assert acyclic(rows, gone) and not any(n == "tree" for n, _ in gone)
    for net in ("g", "h"):
        own = [(a, b) for n, a, b in rows if n == net]
        alone = K.min_sum_decycling(K.Graph([a for a, _ in own], [b for _, b in own]))
        assert len([1 for n, _ in gone if n == net]) <= 1.25 * len(alone) + 1


def test_few_rounds_still_leave_forests_and_empty_tables_nothing(spark):
    rows = random_edges(3, 30, 60)
    e = spark.createDataFrame(rows, "network string, src long, dst long")
    gone = D.message_decycling(e, depth=4, rounds=1)
    assert acyclic(rows, {tuple(r) for r in gone.collect()})
    assert D.cycles_left(e, gone).first().cycles == 0
    assert D.message_decycling(e.limit(0), rounds=2).count() == 0


def test_a_hub_of_more_rows_than_a_task_holds(spark, monkeypatch):
    """A hub's messages that wait in a file give the same round as those held at once."""
    wheel = [("g", 0, i) for i in range(1, 30)] + [("g", i, i + 1) for i in range(1, 29)]
    near = sorted([(a, b) for _, a, b in wheel] + [(b, a) for _, a, b in wheel])
    rnd, t = np.random.default_rng(3), 5
    rows = [("g", v, None, rnd.random(t).tobytes(), None, None, 1, 2) for v in range(30)]
    rows += [("g", v, u, rnd.random(2 * t).tobytes(), rnd.random(2 * t).tobytes(), 1.0, None, None) for v, u in near]
    table = spark.createDataFrame(rows, D.ROUND)

    def after():
        got = D._round(table, t, 0.1, 0.1).collect()
        assert len(got) == len(rows)
        return {(r.v, r.other): (np.frombuffer(r.message), r.moved, r.time, r.still) for r in got}

    held = after()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    monkeypatch.setattr(D, "HELD_ROWS", 6)
    try:
        filed = after()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert held.keys() == filed.keys()
    for key, (message, moved, time, still) in held.items():
        assert np.allclose(message, filed[key][0]) and (time, still) == filed[key][2:]
        assert moved is None and filed[key][1] is None or abs(moved - filed[key][1]) < 1e-9
    # What goes back is what the totals of the other messages say: left out one by one.
    hub = {r[2]: r for r in rows if r[1] == 0 and r[2] is not None}
    bias = np.frombuffer(rows[0][3])[None]
    for u in (1, 15):
        others = np.stack([np.frombuffer(r[3]) for k, r in hub.items() if k != u])
        total = D.totals(D.parts(others, t), np.zeros(len(others), int), t)[1]
        after_ = bias + total[:, 1 : 1 + t]
        before = after_ + total[:, 1 + t : 1 + 2 * t]
        after_[:, 0] = before[:, 0] = bias[:, 0] + total[:, 0]
        new = np.concatenate([before, after_], 1)
        new -= new.min()
        assert np.allclose(held[u, 0][0], 0.1 * np.frombuffer(hub[u][4]) + 0.9 * new[0])
