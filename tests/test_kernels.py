import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fragspark.operators import kernels as K

PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
STAR = [(0, i) for i in range(1, 6)]
CLIQUE = [(i, j) for i in range(5) for j in range(i)]
BRIDGED = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


def graph(edges, isolated=()):
    return K.Graph([a for a, _ in edges], [b for _, b in edges], isolated)


def sizes_after(g, out):
    union = K.Union(g.n)
    for v in range(g.n):
        for y in g.near[v]:
            if v not in out and y not in out:
                union.join(v, y)
    roots = [union.find(v) for v in range(g.n)]
    return sorted((roots.count(r) for r in set(roots)), reverse=True)


def random_graph(seed, n=30, m=45):
    rnd = random.Random(seed)
    return graph([(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)], range(n))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["distinct", "multiset"]))
def test_reverse_union_find_equals_forward_recomputation(seed, ties):
    g = random_graph(seed)
    order = random.Random(seed).sample(range(g.n), g.n)
    rank = np.empty(g.n, np.int64)
    rank[order] = np.arange(1, g.n + 1)
    keep = g.a != g.b
    a, b = rank[g.a[keep]], rank[g.b[keep]]
    forest = K.spanning_edges(None, a, b)
    lcc, slcc = K.reverse_curve(g.n, a[forest], b[forest], ties)
    forward = K.forward_curve(g, order, "all", 0, ties)
    for k in range(g.n):
        s = sizes_after(g, set(order[: k + 1]))
        second = s[1] if ties == "multiset" and len(s) > 1 else next((x for x in s if x < s[0]), 0)
        assert (lcc[k], slcc[k]) == (s[0], second)
        if k < len(forward):
            assert forward[k] == (order[k], s[0], second)
    assert (np.diff(lcc) <= 0).all()


def test_micro_graphs():
    assert K.forward_curve(graph(PATH), [1, 0, 2, 3, 4], "all", 1)[0] == (1, 3, 1)
    assert K.forward_curve(graph(STAR), list(range(6)), "all", 1) == [(0, 1, 0)]
    assert [x[1] for x in K.forward_curve(graph(CLIQUE), list(range(5)), "all", 1)] == [4, 3, 2, 1]
    assert K.forward_curve(graph(BRIDGED), [2, 3, 0, 1, 4, 5], "all", 6)[0][1] == 3  # recorded, then tested
    assert K.Live(graph(BRIDGED)).core() == set(range(6)) and K.Live(graph(PATH)).core() == set()
    assert K.Live(graph([(0, 1), (2, 3)])).sizes.top() == (2, 0) and K.Live(graph([(0, 1), (2, 3)])).sizes.top("multiset") == (2, 2)


def test_modes_of_forward_replay():
    g = random_graph(3)
    order = sorted(range(g.n), key=lambda v: (-len(g.near[v]), v))
    for v, *_ in K.forward_curve(g, order, "lcc", 3):
        assert v in order
    peak = K.forward_curve(g, order, "peak", 3)
    assert sorted(v for v, *_ in peak) == sorted(order)
    core = K.forward_curve(g, order, "core", 1)
    live = K.Live(g)
    for v, *_ in core:
        assert v in live.core() and v in live.members[live.largest()]
        live.remove(v)
    assert K.forward_curve(g, order, "degree", 3)[0][0] == order[0]


def test_tree_breaker():
    g = graph(PATH)
    out = K.tree_break(g.near, set(range(5)), 2)
    assert out == [2]
    with pytest.raises(ValueError):
        K.tree_break(graph(CLIQUE).near, set(range(5)), 1)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_methods_reach_the_threshold(seed):
    g = random_graph(seed, 24, 34)
    stop = 4
    for name, out in {
        "ci1": K.collective_influence(g, stop, 1), "ci2": K.collective_influence(g, stop, 2), "core": K.core_hd(g, stop), "ms": K.min_sum(g, stop), "msr": K.min_sum(g, stop, True),
        "gnd": K.generalized_dismantling(g, stop), "ei1": K.explosive_immunization(g, stop, 1), "ei2": K.explosive_immunization(g, stop, 2),
    }.items():
        assert len(set(out)) == len(out), name
        assert sizes_after(g, set(out))[0] <= max(stop, 1) or not out and sizes_after(g, set())[0] <= stop, name
    cut = set(K.min_sum_decycling(g))
    assert K._acyclic(g, cut)
    all_out = K.generalized_dismantling(g, stop)
    back = K.reinserted(g, all_out, stop)
    assert set(back) <= set(all_out) and sizes_after(g, set(back))[0] <= max(stop, sizes_after(g, set(all_out))[0])


def test_min_sum_is_small_on_cycles():
    ring = [(i, (i + 1) % 8) for i in range(8)]
    assert len(K.min_sum_decycling(graph(ring))) == 1
    assert len(K.min_sum_decycling(graph(BRIDGED))) == 2


def test_min_sum_goes_on_until_it_settles():
    rnd = random.Random(3)
    n = rnd.randrange(20, 60)
    g = graph(sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(int(n * 1.8))}))
    settled = K.min_sum_decycling(g)
    assert len(settled) == 6 and K._acyclic(g, set(settled))  # 7 after 300 rounds
    assert settled == K.min_sum_decycling(g, rounds=20_000)


def test_entropies():
    g = graph(BRIDGED)
    got = K.network_entanglement(g, 0.9, [2])
    lap = K.laplacian(g)
    lam = np.linalg.eigvalsh(lap)
    tau = -np.log(0.9) / lam[lam > 1e-12].min()

    def s(m):
        p = np.exp(-tau * np.linalg.eigvalsh(m))
        p /= p.sum()
        return -(p * np.log2(p)).sum()

    without = K.laplacian(graph([(0, 1), (3, 4), (3, 5), (4, 5)]))
    star = K.laplacian(graph([(0, i) for i in range(1, 5)]))
    assert abs(got[0] - (s(without) + s(star) - s(lap))) < 1e-9
    values = K.vertex_entanglement(graph(PATH), list(range(5)))  # no eigenvalue comes twice here
    assert abs(values[0] - values[4]) < 1e-9 and abs(values[1] - values[3]) < 1e-9


def test_attention_forward_by_hand():
    x = np.array([[1.0], [2.0]])
    weights = {"conv": [{"w": np.ones((1, 1, 1)), "left": np.zeros((1, 1)), "right": np.zeros((1, 1)), "linear": np.zeros((1, 1))}], "full": [{"w": np.ones((1, 1)), "b": np.zeros(1)}]}
    got = K.gat_forward(x, np.array([0, 1]), np.array([1, 0]), weights)
    assert np.allclose(got, 1 / (1 + np.exp(-1.5)))


def test_removals_cost_what_they_cut_off():
    """A long ring with hubs: relabelling the whole component at each removal would take far longer."""
    import time

    n, rnd = 20_000, np.random.default_rng(1)
    ring = np.arange(n)
    g = K.Graph(np.r_[ring, ring[: n // 2]], np.r_[(ring + 1) % n, rnd.integers(0, n, n // 2)])
    began = time.process_time()
    rows = K.forward_curve(g, np.argsort([-len(x) for x in g.near], kind="stable").tolist(), "lcc", n // 10)
    assert rows[-1][1] <= n // 10 and time.process_time() - began < 15


def test_live_components_equal_searched_ones():
    for seed in range(20):
        rnd = np.random.default_rng(seed)
        g = K.Graph(*rnd.integers(0, 25, (2, 35)), range(25))
        live, left = K.Live(g), set(range(25))
        for v in rnd.permutation(25).tolist():
            live.remove(v)
            left.discard(v)
            union = K.Union(25)
            for x in left:
                for y in g.near[x] & left:
                    union.join(x, y)
            want = {frozenset(y for y in range(25) if union.find(y) == union.find(x)) for x in range(25)}
            assert {frozenset(m) for m in live.members.values()} == want and all(x in live.members[live.label[x]] for x in range(25))
            top = max(map(len, want))
            assert live.sizes.top("multiset")[0] == top and min(live.members[live.largest()]) == min(min(m) for m in want if len(m) == top)


def plain_immunization(g, stop, sigma, candidates):
    """Every candidate scored in every step."""
    union, out, degree = K.Union(g.n), set(range(g.n)), g.degree()
    mix = [((v + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for v in range(g.n)]
    effective = [d if d <= 6 else max(1, sum(1 for y in g.near[v] if degree[y] <= 6)) for v, d in enumerate(degree)]
    clusters = lambda v: sorted(union.size[r] for r in {union.find(y) for y in g.near[v] - out})

    def score(v):
        c = clusters(v)
        return effective[v] + sum(np.sqrt(s) - 1 for s in c) if sigma == 1 else len(c) + (c[-2] / g.n if len(c) > 1 else 0)

    left = sorted(out, key=lambda v: (mix[v] ^ (mix[v] >> 29), v))
    while left:
        v = min(left[:candidates], key=lambda v: (score(v), v))
        if 1 + sum(clusters(v)) > stop:
            fits = [y for y in left if 1 + sum(clusters(y)) <= stop]
            if not fits:
                break
            v = min(fits, key=lambda y: (score(y), y))
        left.remove(v)
        out.discard(v)
        for y in g.near[v] - out:
            union.join(v, y)
    return sorted(out, key=lambda v: (-degree[v], v))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 20), st.sampled_from([1, 2]), st.sampled_from([1, 5, 1000]), st.integers(10, 120))
def test_immunization_equals_scoring_every_candidate(seed, stop, sigma, candidates, m):
    g = random_graph(seed, 30, m)
    assert K.explosive_immunization(g, stop, sigma, candidates) == plain_immunization(g, stop, sigma, candidates)


def test_immunization_of_a_large_network_ends():
    n = 20_000
    g = graph([(i, (i + 1) % n) for i in range(n)] + [(i, (i * 7919 + 13) % n) for i in range(0, n, 3)])
    began = time.time()
    for sigma in (1, 2):
        assert sizes_after_fast(g, K.explosive_immunization(g, n // 10, sigma)) <= n // 10
    assert time.time() - began < 30


def sizes_after_fast(g, out):
    union, out = K.Union(g.n), set(out)
    for v in range(g.n):
        for y in g.near[v]:
            if v not in out and y not in out:
                union.join(v, y)
    return max(union.size)
