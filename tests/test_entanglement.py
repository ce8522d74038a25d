import numpy as np
import pytest

from fragspark.operators import kernels as K
from fragspark.operators import methods as M

from .test_kernels import random_graph


def by_dense_spectra(g, beta):
    """The definition, one dense spectrum a vertex."""
    full = K.laplacian(g)
    values = np.linalg.eigvalsh(full)
    tau = -np.log(beta) / values[values > 1e-12].min()
    out = []
    for v in range(g.n):
        part = np.delete(np.delete(full, v, 0), v, 1)
        np.fill_diagonal(part, 0)
        np.fill_diagonal(part, -part.sum(1))
        k = len(g.near[v]) + 1
        out.append(K.entropy(np.linalg.eigvalsh(part), tau) + K.entropy(np.array([0.0, *[1.0] * (k - 1), k + 1.0]), tau) - K.entropy(values, tau))
    return np.array(out)


@pytest.mark.parametrize("beta", [0.9, 0.33, 0.01])
@pytest.mark.parametrize("n, m", [(12, 8), (30, 45), (40, 300)])
def test_traces_give_the_scores_of_dense_spectra(beta, n, m):
    g = random_graph(n + m, n, m)
    assert np.allclose(K.network_entanglement(g, beta, list(range(g.n))), by_dense_spectra(g, beta), atol=1e-9)


def test_hubs_beside_chains():
    edges = [(h, 10 + i) for h in range(3) for i in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(49, 100)]
    g = K.Graph([a for a, _ in edges], [b for _, b in edges], [500])
    assert np.allclose(K.network_entanglement(g, 0.1, list(range(g.n))), by_dense_spectra(g, 0.1), atol=1e-9)
    assert K.Multiplier(g).hubs


def test_networks_above_the_old_bound(spark):
    rows = [("star", 0, i) for i in range(1, 2100)] + [("star", i, i + 1) for i in range(1, 300)] + [("small", 0, 1), ("small", 1, 2), ("alone", 5, 5)]
    edges = spark.createDataFrame([(x, min(a, b), max(a, b)) for x, a, b in rows], "network string, src long, dst long")
    got = {(r.network, r.v): r.score for r in M.scores_of("network_entanglement_small", edges).collect()}
    assert len(got) == 2100 + 3 + 1
    small = by_dense_spectra(K.Graph([0, 1], [1, 2]), 0.9)
    assert np.allclose([got["small", v] for v in range(3)], small, atol=1e-9)


def by_cliques(g, v):
    """Vertex entanglement as defined: entropies over 199 times of the eigenvalues changed to first order by v's clique."""
    full = K.laplacian(g)
    values, vectors = np.linalg.eigh(full)
    second = values[values > 1e-9].min()
    members = [v, *sorted(g.near[v])]
    adjacent = np.array([[float(y in g.near[x]) for y in members] for x in members])
    k = len(members) - 1
    change = adjacent.sum() / (k * (k + 1)) * (1 - np.eye(k + 1)) - adjacent
    local = np.diag(change.sum(1)) - change
    moved = values + np.einsum("ik,ij,jk->k", vectors[members], local, vectors[members])
    return -min(K.entropy(moved, t) - K.entropy(values, t) for t in np.linspace(0, 10 / second, 199))


def test_vertex_entanglement_as_defined():
    g = random_graph(5, 40, 110)
    got = K.vertex_entanglement(g, list(range(g.n)))
    assert np.allclose(got, [by_cliques(g, v) if g.near[v] else 0 for v in range(g.n)], atol=1e-9)


def test_vertex_entanglement_above_the_old_bound(spark):
    rnd = np.random.default_rng(3)
    ends = {(min(a, b), max(a, b)) for a, b in [*rnd.integers(0, 2050, (4000, 2)).tolist(), *((i, i + 1) for i in range(2049))] if a != b}
    got = {r.v: r.score for r in M.scores_of("vertex_entanglement", spark.createDataFrame([("g", a, b) for a, b in sorted(ends)], "network string, src long, dst long")).collect()}
    g = K.Graph(*zip(*sorted(ends), strict=True))
    assert len(got) == 2050 and abs(got[7] - by_cliques(g, 7)) < 1e-9
