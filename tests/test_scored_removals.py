import time

import numpy as np
import pytest

from fragspark.operators import kernels as K
from fragspark.operators import methods as M
from fragspark.queries import made_up_weights

from .test_kernels import random_graph


def plain(g, scorer, stop, batch, core):
    """Every round from scratch, from sets."""
    live, out = K.Live(g), []
    while live.sizes.top()[0] > stop:
        inside = set(live.members[live.largest()])
        if core:
            inside &= live.core()
            if not inside:
                break
        score = scorer(g.ids, live.near)
        for v in sorted(inside, key=lambda v: (-score[v], v))[:batch]:
            live.remove(v)
            out.append(v)
    if core:
        out += K.tree_break(live.near, {v for v in range(g.n) if not live.gone[v]} - live.core(), stop)
    return out


@pytest.mark.parametrize("batch, core", [(1, True), (1, False), (4, False)])
def test_removals_by_arrays_equal_those_from_scratch(batch, core):
    for seed in range(12):
        g = random_graph(seed, 40, 30 + 10 * seed)
        for scorer in (M.attention_scorer(made_up_weights(2)), lambda ids, near: [len(x) for x in near]):
            assert K.scored_removals(g, scorer, 4, batch, core) == plain(g, scorer, 4, batch, core)


def test_a_round_on_a_large_network_is_short():
    g = random_graph(1, 9000, 40_000)
    began = time.time()
    assert len(K.scored_removals(g, M.attention_scorer(made_up_weights(2)), 8960, 1, True)) > 10
    rounds = time.time() - began
    src = np.repeat(np.arange(g.n), g.degree())
    assert rounds < 12 and len(src) == sum(g.degree())
