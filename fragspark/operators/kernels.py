"""What runs on one network inside a task: union-find, live components, greedy attacks. Vertices are 0 to n - 1 here; ties go to the lowest."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, insort

import numpy as np


class Sizes:
    """A multiset of component sizes; distinct sizes are few (their sum is n), so a sorted list of them is short."""

    def __init__(self, singles: int = 0):
        self.times: dict[int, int] = {}
        self.order: list[int] = []
        if singles:
            self.times, self.order = {1: singles}, [1]

    def add(self, size: int, by: int = 1) -> None:
        n = self.times.get(size, 0) + by
        if n:
            if size not in self.times:
                insort(self.order, size)
            self.times[size] = n
        else:
            del self.times[size]
            self.order.pop(bisect_left(self.order, size))

    def top(self, ties: str = "distinct") -> tuple[int, int]:
        if not self.order:
            return 0, 0
        first = self.order[-1]
        if ties == "multiset" and self.times[first] > 1:
            return first, first
        return first, self.order[-2] if len(self.order) > 1 else 0


class Union:
    def __init__(self, n: int):
        self.up, self.size = array("q", range(n)), array("q", [1]) * n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True


class Graph:
    """One network: sorted ids, neighbour sets."""

    def __init__(self, src, dst, isolated=()):
        self.ids = np.unique(np.concatenate([np.asarray(src, np.int64), np.asarray(dst, np.int64), np.asarray(list(isolated), np.int64)]))
        self.n = len(self.ids)
        self.a, self.b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        self.near: list[set[int]] = [set() for _ in range(self.n)]
        for x, y in zip(self.a.tolist(), self.b.tolist(), strict=True):
            if x != y:
                self.near[x].add(y)
                self.near[y].add(x)

    def degree(self) -> list[int]:
        return [len(x) for x in self.near]


class Live:
    """A network that loses vertices. A removed vertex counts as a component of its own.

    From the neighbours of a removed vertex searches go on in turn, join where they meet, and end when only one is still
    under way: what it would reach keeps its label, so a removal costs about what it cuts off, not the whole component.
    """

    def __init__(self, graph: Graph):
        self.near, self.n = [set(x) for x in graph.near], graph.n
        self.label, self.members, self.sizes, self.gone = [-1] * self.n, {}, Sizes(), [False] * self.n
        self.of_size: dict[int, set[int]] = {}
        self.fresh = 0
        for v in range(self.n):
            if self.label[v] < 0:
                self._grow(v)

    def _grow(self, v: int) -> None:
        found, seen = [v], {v}
        for x in found:
            for y in self.near[x]:
                if y not in seen:
                    seen.add(y)
                    found.append(y)
        self._named(found)

    def _named(self, found: list[int]) -> None:
        k, self.fresh = self.fresh, self.fresh + 1
        for x in found:
            self.label[x] = k
        self.members[k] = set(found)
        self._counted(k)

    def _counted(self, k: int) -> None:
        self.sizes.add(len(self.members[k]))
        self.of_size.setdefault(len(self.members[k]), set()).add(k)

    def remove(self, v: int) -> None:
        old, around = self.label[v], self.near[v]
        rest = self.members[old]
        self.sizes.add(len(rest), -1)
        self.of_size[len(rest)].discard(old)
        if not self.of_size[len(rest)]:
            del self.of_size[len(rest)]
        for y in around:
            self.near[y].discard(v)
        self.near[v], self.gone[v] = set(), True
        for found in [[v], *self._cut_off(sorted(around))]:
            rest.difference_update(found)
            self._named(found)
        if rest:
            self._counted(old)
        else:
            del self.members[old]

    def _cut_off(self, starts: list[int]) -> list[list[int]]:
        """The components of the starts but one."""
        done = [[y] for y in starts if not self.near[y]]
        open_ = [y for y in starts if self.near[y]]
        if len(open_) < 2:
            return done if open_ else done[1:]
        owner = {y: i for i, y in enumerate(open_)}
        up, found, at = list(range(len(open_))), [[y] for y in open_], [0] * len(open_)
        under_way = list(range(len(open_)))
        while True:
            for i in under_way:
                if up[i] != i:
                    continue
                if at[i] == len(found[i]):
                    done.append(found[i])
                    up[i] = -1
                    continue
                x = found[i][at[i]]
                at[i] += 1
                for y in self.near[x]:
                    j = owner.get(y)
                    if j is None:
                        owner[y] = i
                        found[i].append(y)
                        continue
                    while up[j] != j:
                        j = up[j]
                    if j != i:  # what j has still to look at goes behind what i has
                        found[i] += found[j][at[j]:]
                        found[i][:0] = found[j][: at[j]]
                        at[i] += at[j]
                        found[j], up[j] = [], i
            under_way = [i for i in under_way if up[i] == i]
            if len(under_way) < 2:
                return done if under_way else done[1:]

    def largest(self) -> int:
        """Label of the largest component; of equal ones that with the lowest vertex."""
        tied = self.of_size[self.sizes.top()[0]]
        return next(iter(tied)) if len(tied) == 1 else min((min(self.members[k]), k) for k in tied)[1]

    def core(self, k: int = 2) -> set[int]:
        d = [len(x) for x in self.near]
        stack = [v for v in range(self.n) if d[v] < k]
        out = set(stack)
        while stack:
            for y in self.near[stack.pop()]:
                d[y] -= 1
                if d[y] < k and y not in out:
                    out.add(y)
                    stack.append(y)
        return set(range(self.n)) - out


def reverse_curve(n: int, ranks_a, ranks_b, ties: str = "distinct") -> tuple[np.ndarray, np.ndarray]:
    """LCC and SLCC after removals 1 to n, from edges given by their ends' removal numbers: vertices come back last first, so each edge is joined once."""
    lcc, slcc = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high = np.minimum(ranks_a, ranks_b), np.maximum(ranks_a, ranks_b)
    order = np.argsort(-low, kind="stable")
    low, high = array("q", np.asarray(low)[order].astype(np.int64).tobytes()), array("q", np.asarray(high)[order].astype(np.int64).tobytes())
    union, sizes, i = Union(n + 1), Sizes(n), 0
    for k in range(n, 0, -1):  # state: vertices with a removal number above k are in
        while i < len(low) and low[i] > k:
            a, b = union.find(low[i]), union.find(high[i])
            if a != b:
                sizes.add(union.size[a], -1)
                sizes.add(union.size[b], -1)
                union.join(a, b)
                sizes.add(union.size[union.find(a)])
            i += 1
        lcc[k - 1], slcc[k - 1] = sizes.top(ties)
    return lcc, slcc


def reverse_squares(n: int, ranks_a, ranks_b) -> tuple[np.ndarray, np.ndarray]:
    """LCC and sum of squared component sizes after removals 1 to n, as vertices come back last first; removed ones count as components of one."""
    lcc, squares = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high = np.minimum(ranks_a, ranks_b), np.maximum(ranks_a, ranks_b)
    order = np.argsort(-low, kind="stable")
    low, high = array("q", np.asarray(low)[order].astype(np.int64).tobytes()), array("q", np.asarray(high)[order].astype(np.int64).tobytes())
    union, i, top, total = Union(n + 1), 0, 1, n
    for k in range(n, 0, -1):
        while i < len(low) and low[i] > k:
            a, b = union.find(low[i]), union.find(high[i])
            if a != b:
                total += 2 * union.size[a] * union.size[b]
                union.join(a, b)
                top = max(top, union.size[union.find(a)])
            i += 1
        lcc[k - 1], squares[k - 1] = top, total
    return lcc, squares


def spread(start: np.ndarray, near: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of the vertices `at`, one vertex after the other, and how many each has."""
    counts = start[at + 1] - start[at]
    return near[np.repeat(start[at] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())], counts


def adjacency(near: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and neighbours, sorted, of the sets of neighbours."""
    return np.concatenate([[0], np.cumsum([len(x) for x in near])]), np.array([y for x in near for y in sorted(x)], np.int64)


def distances(s: int, start: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The distances of all vertices from s; -1: not reached."""
    dist, at, far = np.full(len(start) - 1, -1), np.array([s]), 0
    dist[s] = 0
    while len(at):
        ends, _ = spread(start, near, at)
        far += 1
        ends = ends[dist[ends] < 0]
        dist[ends] = far
        at = np.flatnonzero(dist == far) if 8 * len(ends) > len(dist) else np.unique(ends)
    return dist


#: Numbers (vertex, source) of a block of sources that betweenness holds at once, in each of its arrays.
BLOCK_CELLS = 1 << 22
#: How much dearer an edge of one source is than one of a whole row of sources.
SPARSE_COST = 8


def _block_betweenness(sources: np.ndarray, start: np.ndarray, near: np.ndarray, total: np.ndarray) -> None:
    """Adds to total what the shortest paths from the sources give each vertex between their ends.

    Cells (vertex, source) go by distance. From one layer to the next either the giving cells push along their edges, or
    the taking ones look at theirs, or, where both are many, rows of all sources are added up along the vertices' edges:
    whichever is cheapest, so that long graphs cost no more than their edges.
    """
    n, k = len(start) - 1, len(sources)
    dist, paths = np.full((n, k), -1, np.int32), np.zeros((n, k))
    flat, reach = dist.reshape(-1), paths.reshape(-1)
    degree, at = np.diff(start), sources * k + np.arange(k)
    around = [(v, near[start[v] : start[v + 1]]) for v in np.flatnonzero(degree).tolist()]
    flat[at], reach[at] = 0, 1.0
    layers, edges = [at], [int(degree[sources].sum())]

    def edges_of(cells: np.ndarray) -> int:
        return int(degree[cells // k].sum())

    def pushed(give: np.ndarray, value: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells at distance `to` next to the cells give, and their sums."""
        ends, counts = spread(start, near, give // k)
        cells, value = ends * k + np.repeat(give % k, counts), np.repeat(value, counts)
        on = flat[cells] == to
        cells, value = cells[on], value[on]
        if 8 * len(cells) > n * k:
            sums = np.bincount(cells, value, n * k)
            take = np.flatnonzero(sums)
            return take, sums[take]
        take, place = np.unique(cells, return_inverse=True)
        return take, np.bincount(place, value, len(take))

    def pulled(take: np.ndarray, give: np.ndarray, value: np.ndarray) -> np.ndarray:
        held = np.zeros(n * k)
        held[give] = value
        ends, counts = spread(start, near, take // k)
        return np.add.reduceat(held[ends * k + np.repeat(take % k, counts)], np.cumsum(counts) - counts) if len(take) else np.zeros(0)

    def summed(give: np.ndarray, value: np.ndarray) -> np.ndarray:
        held, out = np.zeros((n, k)), np.zeros((n, k))
        held.reshape(-1)[give] = value
        for v, ends in around:
            np.add.reduce(held[ends], 0, out=out[v])
        return out.reshape(-1)

    row_cost = len(near) * k / SPARSE_COST
    while len(at):
        far = len(layers)
        if edges[-1] <= row_cost:
            at, got = pushed(at, reach[at], -1)
        else:
            take = np.flatnonzero(flat < 0)
            got = pulled(take, at, reach[at]) if edges_of(take) <= row_cost else summed(at, reach[at])[take]
            at, got = take[got > 0], got[got > 0]
        flat[at], reach[at] = far, got
        if len(at):
            layers.append(at)
            edges.append(edges_of(at))
    part = np.zeros(n * k)
    for far in range(len(layers) - 1, 1, -1):  # what the first layer would give the sources does not count
        give, take = layers[far], layers[far - 1]
        value = (1 + part[give]) / reach[give]
        if min(edges[far], edges[far - 1]) > row_cost:
            got = summed(give, value)[take]
        elif edges[far] < edges[far - 1]:
            take, got = pushed(give, value, far - 1)
        else:
            got = pulled(take, give, value)
        part[take] = got * reach[take]
    total += part.reshape(n, k).sum(1)


def live_betweenness(near: list[set[int]]) -> np.ndarray:
    """Betweenness of each vertex, by sums over the shortest paths from blocks of sources."""
    alive = np.flatnonzero([len(x) > 0 for x in near])
    out = np.zeros(len(near))
    if not len(alive):
        return out
    start, ends = adjacency(near)
    start, ends = start[np.r_[alive, len(near)]], np.searchsorted(alive, ends)  # rows of the others are empty
    total, block = np.zeros(len(alive)), max(1, BLOCK_CELLS // len(alive))
    for first in range(0, len(alive), block):
        _block_betweenness(np.arange(first, min(first + block, len(alive))), start, ends, total)
    out[alive] = total
    return out


def _nearness(dist: np.ndarray) -> tuple[int, int]:
    reached = dist > 0
    return int(reached.sum()), int(dist[reached].sum())


def live_closeness(near: list[set[int]]) -> np.ndarray:
    """Reached vertices by the sum of their distances."""
    start, ends = adjacency(near)
    found = [_nearness(distances(s, start, ends)) for s in range(len(near))]
    return np.array([reached / far if reached else 0.0 for reached, far in found])


def live_pagerank(near: list[set[int]], rounds: int = 50, damping: float = 0.85) -> np.ndarray:
    n = len(near)
    degree = np.array([len(x) for x in near])
    src = np.repeat(np.arange(n), degree)
    dst = np.array([y for x in near for y in sorted(x)], np.int64)
    now = np.full(n, 1 / n)
    for _ in range(rounds):
        now = (1 - damping) / n + damping * np.bincount(dst, (now / np.maximum(1, degree))[src], minlength=n)
    return now


LIVE_SCORES = {"degree": lambda near: np.array([float(len(x)) for x in near]), "betweenness": live_betweenness, "closeness": live_closeness, "pagerank": live_pagerank}


def adaptive(graph: Graph, kind: str, stop: int, ties: str = "distinct"):
    """(vertex, score, lcc, slcc) per removal: the live vertex of the best score now, ties to the lowest, until the LCC is within stop or no edge is left."""
    if kind == "closeness":
        return adaptive_closeness(graph, stop, ties)
    live, out = Live(graph), []
    while any(live.near):
        score = np.round(LIVE_SCORES[kind](live.near), 9)
        v = max((v for v in range(graph.n) if not live.gone[v]), key=lambda v: (score[v], -v))
        live.remove(v)
        lcc, slcc = live.sizes.top(ties)
        out.append((v, float(score[v]), lcc, slcc))
        if lcc <= stop:
            break
    return out


def adaptive_closeness(graph: Graph, stop: int, ties: str = "distinct"):
    """adaptive() by closeness, which is found again only of vertices that could come first.

    Distances only grow, so what a vertex's known sum keeps after a removal, less the distances to what it no longer
    reaches, is at most its sum now, and gives its score an upper bound. One search from the removed vertex tells these
    distances: to vertices cut off, the way went through it. The best bound is checked until the best is a true score.
    """
    live, out, n = Live(graph), [], graph.n
    start, near = adjacency(live.near)
    edges = int(start[-1])
    label, far, size = np.array(live.label), np.zeros(n, np.int64), np.zeros(n, np.int64)
    score, true, gone = np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
    for s in range(n):
        size[s], far[s] = _nearness(distances(s, start, near))
    score = np.round(size / np.maximum(far, 1), 9)
    while edges:
        v = int(np.argmax(np.where(gone, -1.0, score)))  # the first of equal ones
        while not true[v]:
            size[v], far[v] = _nearness(distances(v, start, near))
            score[v], true[v] = np.round(size[v] / far[v] if far[v] else 0.0, 9), True
            v = int(np.argmax(np.where(gone, -1.0, score)))
        dist, named = distances(v, start, near), live.fresh
        edges -= 2 * len(live.near[v])
        live.remove(v)
        for k in range(named, live.fresh):
            label[list(live.members[k])] = k
        left = np.flatnonzero(dist > 0)
        names, part = np.unique(label[left], return_inverse=True)
        sizes, sums = np.bincount(part, minlength=len(names)), np.bincount(part, dist[left], len(names)).astype(np.int64)
        size[left] = sizes[part] - 1
        far[left] -= dist[left] * (1 + len(left) - sizes[part]) + dist[left].sum() - sums[part]
        score[left] = np.round(size[left] / np.maximum(far[left], 1), 9)
        true[left], gone[v] = size[left] == 0, True
        start, near = without_vertex(v, start, near)
        lcc, slcc = live.sizes.top(ties)
        out.append((v, float(score[v]), lcc, slcc))
        if lcc <= stop:
            break
    return out


def without_vertex(v: int, start: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The adjacency after all edges of v went."""
    keep = near != v
    keep[start[v] : start[v + 1]] = False
    count = np.concatenate([[0], np.cumsum(keep)])
    return count[start], near[keep]


def spanning_edges(n_ids, low, high) -> np.ndarray:
    """Which edges a maximum spanning forest by the lower removal number keeps: all that any prefix of removals needs."""
    ids, flat = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = flat[: len(low)], flat[len(low) :]
    union, keep = Union(len(ids)), np.zeros(len(low), bool)
    for i in np.argsort(-np.minimum(low, high), kind="stable").tolist():
        keep[i] = union.join(int(a[i]), int(b[i]))
    return keep


def forward_curve(graph: Graph, order: list[int], mode: str, stop: int, ties: str = "distinct", block: int = 1):
    """(vertex, lcc, slcc) per removal. Modes: all, lcc (only vertices of the largest component, from the head of the list each time),
    core (lcc and 2-core), peak (lcc until the best SLCC so far reaches the LCC, the rest with constant sizes), degree (highest degree now, `block` at a time)."""
    live, out, best = Live(graph), [], 0
    place, lists, at = {v: i for i, v in enumerate(order)}, {}, {}
    core = live.core() if mode == "core" else None
    inside = {v: len(live.near[v] & core) for v in core} if core is not None else {}
    heap = [(-len(x), v) for v, x in enumerate(live.near)] if mode == "degree" else []
    heapq.heapify(heap)

    def highest() -> list[int]:
        picks = []
        while heap and len(picks) < block:
            d, v = heapq.heappop(heap)
            if d == -len(live.near[v]):
                picks.append(v)
            else:  # degrees only fall: a stale entry goes back
                heapq.heappush(heap, (-len(live.near[v]), v))
        return picks

    def first() -> list[int]:
        """The first of the list in the largest component (and the 2-core): what a list has passed has left it for good."""
        k = -1 if mode == "all" else live.largest()
        if k not in lists:
            lists[k], at[k] = order if k < 0 else sorted((v for v in live.members[k] if v in place), key=place.__getitem__), 0
        while at[k] < len(lists[k]):
            v = lists[k][at[k]]
            if not live.gone[v] and (k < 0 or live.label[v] == k) and (core is None or v in core):
                return [v]
            at[k] += 1
        return []

    def peel(v: int) -> None:
        stack = [v]
        core.discard(v)
        while stack:
            for y in live.near[stack.pop()]:
                if y in core:
                    inside[y] -= 1
                    if inside[y] < 2:
                        core.discard(y)
                        stack.append(y)

    while picks := highest() if mode == "degree" else first():
        for v in picks:
            if core is not None:
                peel(v)
            live.remove(v)
            lcc, slcc = live.sizes.top(ties)
            out.append((v, lcc, slcc))
            best = max(best, slcc)
            if (mode != "peak" and lcc <= stop) or lcc <= 1:
                return out
        if mode == "peak" and best >= out[-1][1]:
            done = {v for v, *_ in out}
            return out + [(v, *out[-1][1:]) for v in order if v not in done]
    return out


def tree_break(near: list[set[int]], alive: set[int], stop: int) -> list[int]:
    """Vertices whose removal leaves trees of at most `stop` vertices: of the largest tree always the centroid. Raises on cycles."""
    near = {v: near[v] & alive for v in alive}

    def tree(root: int):
        order, up = [root], {root: -1}
        for x in order:
            for y in near[x]:
                if y != up[x]:
                    if y in up:
                        raise ValueError("the graph has a cycle: trees only")
                    up[y] = x
                    order.append(y)
        return order, up

    heap, seen, out = [], set(), []
    for v in sorted(alive):
        if v not in seen:
            order, _ = tree(v)
            seen.update(order)
            heap.append((-len(order), min(order)))
    heapq.heapify(heap)
    while heap and -heap[0][0] > stop:
        total, root = heapq.heappop(heap)
        order, up = tree(root)
        size = dict.fromkeys(order, 1)
        for x in reversed(order[1:]):
            size[up[x]] += size[x]
        worst = {x: max([len(order) - size[x], *(size[y] for y in near[x] if y != up[x])]) for x in order}
        centre = min(order, key=lambda x: (worst[x], x))
        out.append(centre)
        for y in near.pop(centre):
            near[y] = near[y] - {centre}
            part, _ = tree(y)
            heapq.heappush(heap, (-len(part), min(part)))
    return out


def scored_removals(graph: Graph, scorer, stop: int, batch: int = 1, core: bool = False) -> list[int]:
    """The `batch` best of the largest component (with core: of its 2-core) by scorer, again and again until the LCC is within stop; with core trees are broken at the end."""
    live, out = Live(graph), []
    inner = live.core() if core else set()
    inside = {v: len(live.near[v] & inner) for v in inner}
    src = np.repeat(np.arange(graph.n), graph.degree())
    dst = np.array([y for near in graph.near for y in sorted(near)], np.int64)
    there = np.ones(graph.n, bool)
    while live.sizes.top()[0] > stop:
        part = live.members[live.largest()]
        found = np.fromiter(part & inner if core else part, np.int64)
        if not len(found):
            break
        if hasattr(scorer, "of_edges"):
            keep = there[src] & there[dst]
            src, dst = src[keep], dst[keep]
            score = scorer.of_edges(graph.n, src, dst)
        else:
            score = scorer(graph.ids, live.near)
        own = np.asarray(score)[found]
        if batch < len(found):
            best = own >= np.partition(own, len(own) - batch)[len(own) - batch]  # all that tie with the last
            found, own = found[best], own[best]
        for v in found[np.lexsort((found, -own))][:batch].tolist():
            stack = [v] if v in inner else []
            inner.discard(v)
            while stack:
                for y in live.near[stack.pop()]:
                    if y in inner:
                        inside[y] -= 1
                        if inside[y] < 2:
                            inner.discard(y)
                            stack.append(y)
            live.remove(v)
            there[v] = False
            out.append(v)
    if core:
        out += tree_break(live.near, {v for v in range(graph.n) if not live.gone[v]} - inner, stop)
    return out


def reinserted(graph: Graph, removed: list[int], target: int, by: str = "degree") -> list[int]:
    """Removed vertices come back while the component that each makes stays below target, smallest first; what stays out, by degree downwards or in the given order."""
    out, union = set(removed), Union(graph.n)
    for v in range(graph.n):
        if v not in out:
            for y in graph.near[v]:
                if y not in out:
                    union.join(v, y)

    def size(v: int) -> int:
        return 1 + sum(union.size[r] for r in {union.find(y) for y in graph.near[v] if y not in out})

    heap = [(size(v), v) for v in removed]
    heapq.heapify(heap)
    while len(out) > 1 and heap:
        s, v = heapq.heappop(heap)
        now = size(v)
        if now > s:  # sizes only grow: a stale entry goes back
            heapq.heappush(heap, (now, v))
            continue
        if now >= target:
            break
        out.discard(v)
        for y in graph.near[v]:
            if y not in out:
                union.join(v, y)
    left = [v for v in removed if v in out]
    return sorted(left, key=lambda v: -len(graph.near[v])) if by == "degree" else left


def reranked(graph: Graph, removed: list[int], step: int = 1) -> list[int]:
    """All removed vertices, put back in order of how many clusters they would join, listed from the last one put back to the first."""
    out, union, back = set(removed), Union(graph.n), []
    for v in range(graph.n):
        if v not in out:
            for y in graph.near[v] - out:
                union.join(v, y)
    while out:
        cost = sorted((len({union.find(y) for y in graph.near[v] - out}), v) for v in out)
        for _, v in cost[:step]:
            out.discard(v)
            back.append(v)
            for y in graph.near[v] - out:
                union.join(v, y)
    return back[::-1]


def collective_influence(graph: Graph, stop: int, hops: int) -> list[int]:
    """Removes the vertex of largest (k - 1) * sum of (k' - 1) over its ball's border until LCC <= stop, then ranks anew by reinsertion."""
    live, out = Live(graph), []

    def border(v: int, r: int) -> tuple[set[int], set[int]]:
        seen, edge = {v}, {v}
        for _ in range(r):
            edge = {y for x in edge for y in live.near[x]} - seen
            seen |= edge
        return edge, seen

    def value(v: int) -> int:
        return (len(live.near[v]) - 1) * sum(len(live.near[y]) - 1 for y in border(v, hops)[0]) if len(live.near[v]) > 1 else 0

    now = {v: value(v) for v in range(graph.n)}
    heap = [(-x, v) for v, x in now.items()]
    heapq.heapify(heap)
    while live.sizes.top()[0] > stop and heap:
        x, v = heapq.heappop(heap)
        if live.gone[v] or now[v] != -x:
            continue
        if not x:  # only trees' ends left: highest degree then
            v = max((y for y in range(graph.n) if not live.gone[y]), key=lambda y: (len(live.near[y]), -y))
        around = border(v, hops + 1)[1] - {v}
        live.remove(v)
        out.append(v)
        for y in around:
            now[y] = value(y)
            heapq.heappush(heap, (-now[y], y))
        heapq.heappush(heap, (0, -1)) if not heap else None
        if heap and heap[0][1] < 0:
            heapq.heappop(heap)
    return reranked(graph, out, 1 if graph.n <= 1000 else max(1, graph.n // 1000))


def two_core(near: list[set[int]], alive: set[int]) -> set[int]:
    """The 2-core of the vertices alive."""
    core = set(alive)
    d = {v: len(near[v] & core) for v in core}
    stack = [v for v in core if d[v] < 2]
    core.difference_update(stack)
    while stack:
        for y in near[stack.pop()] & core:
            d[y] -= 1
            if d[y] < 2:
                core.discard(y)
                stack.append(y)
    return core


def highest_in_core(near: list[set[int]], core: set[int]) -> list[int]:
    """Vertices of highest degree within the 2-core that is left, one after the other until there is none; core ends empty."""
    out, d = [], {v: len(near[v] & core) for v in core}
    heap = [(-d[v], v) for v in core]
    heapq.heapify(heap)
    while core:
        x, v = heapq.heappop(heap)
        if v not in core or d[v] != -x:
            continue
        out.append(v)
        core.discard(v)
        stack = [v]
        while stack:
            for y in near[stack.pop()] & core:
                d[y] -= 1
                if d[y] < 2:
                    core.discard(y)
                    stack.append(y)
                else:
                    heapq.heappush(heap, (-d[y], y))
    return out


def core_hd(graph: Graph, stop: int) -> list[int]:
    """Highest degree within the 2-core until there is none, trees broken, vertices put back while components stay within stop."""
    alive = set(range(graph.n))
    out = highest_in_core(graph.near, two_core(graph.near, alive))
    out += tree_break(graph.near, alive - set(out), stop)
    return reinserted(graph, out, stop + 1, "order")


def fiedler(near: dict[int, set[int]], rounds: int, seed: int) -> tuple[list[int], np.ndarray]:
    """An approximate second eigenvector of the Laplacian by power iteration of d_max - L against the constant vector."""
    ids = sorted(near)
    place = {v: i for i, v in enumerate(ids)}
    src = np.array([place[v] for v in ids for _ in near[v]], np.int64)
    dst = np.array([place[y] for v in ids for y in near[v]], np.int64)
    d = np.bincount(src, minlength=len(ids)).astype(float)
    x = np.random.default_rng(seed).normal(size=len(ids))
    for _ in range(rounds):
        x -= x.mean()
        x = (2 * d.max() - d) * x + np.bincount(src, x[dst], minlength=len(ids))
        x /= np.sqrt(x @ x) or 1
    return ids, x - x.mean()


def generalized_dismantling(graph: Graph, stop: int, seed: int = 1, cost: str = "unit") -> list[int]:
    """Splits the largest component along the Fiedler vector: a greedy vertex cover of the edges across goes, until LCC <= stop."""
    live, out = Live(graph), []
    while live.sizes.top()[0] > max(1, stop):
        part = sorted(live.members[live.largest()])
        near = {v: live.near[v] for v in part}
        ids, x = fiedler(near, int(30 * np.log(len(part) + 1) * np.sqrt(np.log(len(part) + 1))) + 10, seed)
        side = dict(zip(ids, x.tolist(), strict=True))
        cut = {v: {y for y in near[v] if side[v] * side[y] < 0} for v in part}

        def price(v: int) -> float:
            return (1 if cost == "unit" else len(near[v])) / len(cut[v])

        cover, heap = [], [(price(v), v) for v in part if cut[v]]
        heapq.heapify(heap)
        while heap:
            now, v = heapq.heappop(heap)
            if not cut[v]:
                continue
            if price(v) != now:  # prices only rise: a stale entry goes back
                heapq.heappush(heap, (price(v), v))
                continue
            cover.append(v)
            for y in cut[v]:
                cut[y].discard(v)
            cut[v] = set()
        if not cover:
            break
        heap, last, born = [(-len(live.near[v]), v) for v in cover], None, 0
        heapq.heapify(heap)
        while True:
            k = live.largest()
            if last not in (None, k) and k < born:  # a component from before: none of the cover was in the largest all the time
                break
            while heap and (live.gone[heap[0][1]] or live.label[heap[0][1]] != k or heap[0][0] != -len(live.near[heap[0][1]])):
                v = heapq.heappop(heap)[1]
                if not live.gone[v] and live.label[v] == k:
                    heapq.heappush(heap, (-len(live.near[v]), v))
            if not heap or live.sizes.top()[0] <= stop:
                break
            last, born = k, live.fresh
            v = heapq.heappop(heap)[1]
            live.remove(v)
            out.append(v)
    return out


def explosive_immunization(graph: Graph, stop: int, sigma: int, candidates: int = 1000, seed: int = 0) -> list[int]:
    """All vertices start vaccinated; of the candidates in hash order the one of least score is released while the LCC stays within stop.

    Scores rise as clusters grow, so what a heap holds is a lower bound, looked at again when it comes first; they fall only
    where clusters that a vertex touches become one, and then the vertex goes into the heaps anew. What does not fit once never does.
    """
    union, out = Union(graph.n), set(range(graph.n))
    mix = [((v + 1) * 0x9E3779B97F4A7C15 + seed) & (2**64 - 1) for v in range(graph.n)]
    hub = 6
    degree = graph.degree()
    effective = [d if d <= hub else max(1, sum(1 for y in graph.near[v] if degree[y] <= hub)) for v, d in enumerate(degree)]

    def clusters(v: int) -> list[int]:
        return sorted(union.size[r] for r in {union.find(y) for y in graph.near[v] - out})

    def score(v: int) -> float:
        c = clusters(v)
        if sigma == 1:
            return effective[v] + sum(np.sqrt(s) - 1 for s in c)
        return len(c) + (c[-2] / graph.n if len(c) > 1 else 0)

    order = sorted(out, key=lambda v: (mix[v] ^ (mix[v] >> 29), v))
    pool, ahead = set(order[:candidates]), candidates
    near_pool, near_all = [(score(v), v) for v in pool], None
    heapq.heapify(near_pool)
    around: dict[int, set[int]] = {}  # of a cluster the vertices that touch it and are not released

    def first(heap: list, live: set[int], fitting: bool) -> int | None:
        while heap:
            s, v = heap[0]
            if v not in live or (fitting and 1 + sum(clusters(v)) > stop):
                heapq.heappop(heap)
                continue
            now = score(v)
            if now == s:
                return v
            heapq.heapreplace(heap, (now, v))
        return None

    while out:
        v = first(near_pool, pool, False)
        if 1 + sum(clusters(v)) > stop:
            if near_all is None:
                near_all = [(score(y), y) for y in out]
                heapq.heapify(near_all)
            v = first(near_all, out, True)
            if v is None:
                break
        out.discard(v)
        inside = graph.near[v] - out
        borders = sorted((around.pop(r) for r in {union.find(y) for y in inside}), key=len)
        for y in inside:
            union.join(v, y)
        border, twice = borders.pop() if borders else set(), set()
        for less in borders:
            twice |= less & border
            border |= less
        border |= graph.near[v] & out
        border.discard(v)
        around[union.find(v)] = border
        for y in twice & out:
            if y in pool:
                heapq.heappush(near_pool, (score(y), y))
            if near_all is not None:
                heapq.heappush(near_all, (score(y), y))
        if v in pool:
            pool.discard(v)
            while ahead < len(order) and order[ahead] not in out:
                ahead += 1
            if ahead < len(order):
                pool.add(order[ahead])
                heapq.heappush(near_pool, (score(order[ahead]), order[ahead]))
                ahead += 1
    return sorted(out, key=lambda v: (-degree[v], v))


#: Rounds in which the pull of min-sum's reinforcement grows to its full force.
RAMP = 300


def min_sum_decycling(graph: Graph, depth: int = 20, rounds: int = 10_000, force: float = 1e-3, damp: float = 0.1, noise: float = 1e-4, seed: int = 0, settled: int = 30, tolerance: float = 1e-5) -> list[int]:
    """A small set whose removal leaves no cycle, by reinforced min-sum.

    Each vertex has a time: 0 for removed (cost 1), else the round in which it falls as a leaf, when at most one
    neighbour has its time or a later one. before[e, t]: least cost behind edge e = (i, j) when i has time t and j an
    earlier one; after[e, t]: when j is the one neighbour with the same or a later time. All edges are updated at once,
    until no message moves by more than tolerance or no vertex changed its time in `settled` rounds and the removed
    ones leave no cycle, for `rounds` rounds at most.
    """
    core = Live(graph).core()
    ids = sorted(core)
    if not ids:
        return []
    place = {v: i for i, v in enumerate(ids)}
    src = np.array([place[v] for v in ids for _ in graph.near[v] & core], np.int64)
    dst = np.array([place[y] for v in ids for y in sorted(graph.near[v] & core)], np.int64)
    number = {e: k for k, e in enumerate(zip(src.tolist(), dst.tolist(), strict=True))}
    back = np.array([number[b, a] for a, b in zip(src.tolist(), dst.tolist(), strict=True)])
    n, m, t = len(ids), len(src), depth + 1
    begin = np.searchsorted(src, np.arange(n))
    field = np.random.default_rng(seed).random((n, t)) * noise
    field[:, 0] += 1
    bias = np.zeros((n, t))
    before, after = np.zeros((m, t)), np.zeros((m, t))
    total, times_now, still = field, np.full(n, -1), 0
    for r in range(rounds):
        into_b, into_a = before[back], after[back]  # messages k -> i on the slot of edge (i, k)
        zero = np.minimum(into_b[:, 0], into_b[:, 1:].min(1))
        removed_or = np.minimum.accumulate(np.concatenate([into_b[:, :1], into_a[:, 1:]], 1), 1)
        earlier = np.full((m, t), 1e9)
        earlier[:, 1:] = removed_or[:, :-1]
        later = np.full((m, t), 1e9)
        later[:, 1:] = into_a[:, 1:]
        tail = np.minimum.accumulate(into_b[:, :0:-1], 1)[:, ::-1]
        later[:, 1:-1] = np.minimum(later[:, 1:-1], tail[:, 1:])
        gain = np.minimum(0, later - earlier)
        sums = np.stack([np.bincount(src, column, n) for column in earlier.T], 1)
        zeros = np.bincount(src, zero, n)
        first = np.minimum(0.0, np.minimum.reduceat(gain, begin))  # src goes up, and every vertex of a 2-core has edges
        least = gain <= first[src]
        times = np.add.reduceat(least, begin, dtype=np.int64)
        second = np.minimum(0.0, np.minimum.reduceat(np.where(least, 0.0, gain), begin))
        other = np.where(least & (times[src] == 1), second[src], first[src])
        rest = sums[src] - earlier
        fresh_after = field[src] + bias[src] + rest
        fresh_before = fresh_after + other
        fresh_after[:, 0] = fresh_before[:, 0] = field[src, 0] + bias[src, 0] + zeros[src] - zero
        low = np.minimum(fresh_before.min(1), fresh_after.min(1))[:, None]
        fresh_before = damp * before + (1 - damp) * (fresh_before - low)
        fresh_after = damp * after + (1 - damp) * (fresh_after - low)
        moved = max(np.abs(fresh_before - before).max(), np.abs(fresh_after - after).max())
        before, after = fresh_before, fresh_after
        total = field + bias + sums + first
        total[:, 0] = field[:, 0] + bias[:, 0] + zeros
        bias += force * r * (total - total.min(1, keepdims=True)) / RAMP
        bias = np.minimum(bias, 50)
        was, times_now = times_now, total.argmin(1)
        still = still + 1 if np.array_equal(was, times_now) else 0
        if moved <= tolerance:
            break
        if still >= settled:
            if _acyclic(graph, {ids[i] for i in np.flatnonzero(times_now == 0)}):
                break
            still = 0
    chosen = {ids[i] for i in np.flatnonzero(total.argmin(1) == 0)}
    near = [x - chosen for x in graph.near]
    chosen.update(highest_in_core(near, two_core(near, set(range(graph.n)) - chosen)))  # what did not settle: highest degree in the 2-core
    union = Union(graph.n)
    for v in range(graph.n):
        if v not in chosen:
            for y in graph.near[v]:
                if y > v and y not in chosen:
                    union.join(v, y)
    for v in sorted(chosen):  # no member that is not needed: it may return where it has one edge at most into each tree
        ends = [union.find(y) for y in graph.near[v] if y not in chosen]
        if len(ends) == len(set(ends)):
            chosen.discard(v)
            for y in ends:
                union.join(v, y)
    return sorted(chosen)


def _acyclic(graph: Graph, out: set[int]) -> bool:
    union = Union(graph.n)
    return all(union.join(v, y) for v in range(graph.n) if v not in out for y in graph.near[v] if y > v and y not in out)


def min_sum(graph: Graph, stop: int, back: bool = False) -> list[int]:
    """Decycling, trees broken to stop; with back, what can return does."""
    cut = min_sum_decycling(graph)
    out = cut + tree_break(graph.near, set(range(graph.n)) - set(cut), stop)
    return reinserted(graph, out, stop + 1) if back else out


def entropy(values: np.ndarray, tau: float) -> float:
    """Spectral entropy in bits of exp(-tau * Laplacian)."""
    p = np.exp(-tau * values)
    p = p / p.sum()
    p = p[p > 1e-20]
    return float(-(p * np.log2(p)).sum())


def laplacian(graph: Graph) -> np.ndarray:
    out = np.zeros((graph.n, graph.n))
    for v, near in enumerate(graph.near):
        out[v, v] = len(near)
        out[v, list(near)] = -1
    return out


#: Entries of an array of vectors: more vertices, fewer vectors at once.
HELD = 2_000_000


class Multiplier:
    """The Laplacian of a network times the columns of an array whose rows are the vertices by degree downwards, as `place` has them.

    The first neighbours of all vertices are one gather, the second ones of those that have two the next, and so on; what
    is left of a few hubs is summed hub by hub.
    """

    def __init__(self, graph: Graph):
        degree = np.array(graph.degree(), np.int64)
        order = np.argsort(-degree, kind="stable")
        self.place = np.empty(graph.n, np.int64)
        self.place[order] = np.arange(graph.n)
        self.degree = degree[order].astype(float)
        self.near = [self.place[sorted(graph.near[v])] for v in order]
        self.slots, self.hubs = [], []
        of = graph.n
        for s in range(int(degree.max(initial=0))):
            while len(self.near[of - 1]) <= s:
                of -= 1
            if of < 16:
                self.hubs = [(i, self.near[i][s:]) for i in range(of)]
                break
            self.slots.append(np.array([self.near[i][s] for i in range(of)]))
        #: No eigenvalue is above it.
        self.top = max((self.degree[i] + self.degree[near].max() for i, near in enumerate(self.near) if len(near)), default=0.0)
        self.width = int(max(1, min(32, HELD // max(1, graph.n))))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, got = self.degree[:, None] * x, np.empty_like(x)
        for at in self.slots:
            np.take(x, at, axis=0, out=got[: len(at)], mode="clip")
            out[: len(at)] -= got[: len(at)]
        for i, rest in self.hubs:
            out[i] -= x[rest].sum(0)
        return out


def lanczos(times, x: np.ndarray, steps: int, project=lambda y: y) -> tuple[np.ndarray, np.ndarray]:
    """Of each column of x the tridiagonal matrix of `steps` Lanczos steps: its diagonal, and what stands beside it, 0 where nothing is left."""
    q, before = x / np.sqrt((x * x).sum(0)), np.zeros_like(x)
    beside = np.zeros(x.shape[1])
    a, b = np.zeros((steps, x.shape[1])), np.zeros((steps, x.shape[1]))
    for k in range(steps):
        y = times(q) - beside * before
        a[k] = (q * y).sum(0)
        y = project(y - a[k] * q)
        b[k] = beside = np.sqrt((y * y).sum(0))
        b[k][beside < 1e-13 * max(1.0, np.abs(a[: k + 1]).max())] = 0
        beside = b[k]
        if not beside.any():
            break
        before, q = q, np.divide(y, beside, out=np.zeros_like(y), where=beside > 0)
    return a, b[:-1]


def _least(a: list[float], b: list[float], top: float) -> float:
    """The least eigenvalue, from 0 to top, of a tridiagonal matrix, by halving: below it no pivot is negative."""
    low, high, squares = 0.0, top, [0.0, *(x * x for x in b)]
    while high - low > 1e-15 * high + 1e-300:
        middle = (low + high) / 2
        if not low < middle < high:
            break
        pivot = 1.0
        for x, s in zip(a, squares, strict=True):
            pivot = x - middle - s / pivot
            if pivot <= 0:
                high = middle
                break
        else:
            low = middle
    return high


def least_positive(graph: Graph, times: Multiplier, seed: int = 1) -> float:
    """The least positive eigenvalue of the Laplacian, by Lanczos steps without the constants of the components, twice as many until it stands."""
    label = np.empty(graph.n, np.int64)
    label[times.place] = Live(graph).label
    size = np.bincount(label)

    def project(y: np.ndarray) -> np.ndarray:
        return y - (np.bincount(label, y[:, 0]) / size)[label][:, None]

    start = project(np.random.default_rng(seed).normal(size=(graph.n, 1)))
    start[times.degree == 0] = 0
    steps, was = 64, np.inf
    while True:
        a, b = lanczos(times, start, steps, project)
        end = int(np.argmax(b[:, 0] == 0)) + 1 if (b[:, 0] == 0).any() else steps
        now = _least(a[:end, 0].tolist(), b[: end - 1, 0].tolist(), times.top)
        if end < steps or abs(was - now) <= 1e-12 * now + 1e-15 * times.top:
            return now
        steps, was = 2 * steps, now


def heat_steps(tau: float, top: float) -> int:
    """Lanczos steps after which traces of exp(-tau x) and tau x exp(-tau x) are exact to 14 digits for eigenvalues from 0 to top: half the degree of their Chebyshev series."""
    n = 64
    while True:
        x = tau * top / 2 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
        large = np.maximum(np.abs(np.fft.rfft(np.exp(-x))), np.abs(np.fft.rfft(x * np.exp(-x)))) / n > 1e-14
        degree = int(np.flatnonzero(large).max(initial=0))
        if degree < n // 4:
            return degree // 2 + 2
        n *= 2


def _heat(a: np.ndarray, b: np.ndarray, tau: float, vectors: bool) -> np.ndarray:
    """Per column the sums of exp(-tau x) and tau x exp(-tau x) over the matrix's eigenvalues, each by its first entry's square with `vectors`."""
    steps, many = a.shape
    m = np.zeros((many, steps, steps))
    i = np.arange(steps)
    m[:, i, i] = a.T
    m[:, i[1:], i[:-1]] = m[:, i[:-1], i[1:]] = b.T
    if vectors:
        x, v = np.linalg.eigh(m)
        weight = v[:, 0, :] ** 2
    else:
        x, weight = np.linalg.eigvalsh(m), 1.0
    e = weight * np.exp(-tau * np.maximum(x, 0))
    return np.stack([e.sum(1), (e * tau * x).sum(1)], 1)


def heat_traces(graph: Graph, beta: float, own: list[int]) -> tuple[float, np.ndarray]:
    """tau, and per vertex of own four numbers: its entries on the diagonals of exp(-tau L) and tau L exp(-tau L), and by how much both traces change when its edges go.

    No matrix is dense. An edge that goes takes a matrix of rank one off L, so the change of a trace is that of the
    tridiagonal matrix from the edge's vector, whose first entry falls by 2; a vertex's edges go one after the other.
    """
    times = Multiplier(graph)
    tau = -np.log(beta) / least_positive(graph, times) if times.top else 0.0
    steps = heat_steps(tau, times.top)
    found = np.zeros((len(own), 4))
    for i in range(0, len(own), times.width):
        v = times.place[own[i : i + times.width]]
        start = np.zeros((graph.n, len(v)))
        start[v, np.arange(len(v))] = 1
        found[i : i + len(v), :2] = _heat(*lanczos(times, start, steps), tau, True)
    runs = [(k, v, times.near[v], j) for k, v in enumerate(times.place[own].tolist()) for j in range(len(times.near[v]))]
    for i in range(0, len(runs), times.width):
        part = runs[i : i + times.width]
        column, at = np.arange(len(part)), np.array([v for _, v, _, _ in part])
        ends = np.array([near[j] for _, _, near, j in part])
        gone = np.array([y for _, _, near, j in part for y in near[:j]], np.int64)
        of = np.repeat(column, [j for *_, j in part])

        def without(x: np.ndarray, at=at, column=column, gone=gone, of=of) -> np.ndarray:
            y = times(x)
            if len(of):
                apart = x[at[of], of] - x[gone, of]
                y[gone, of] += apart
                y[at, column] -= np.bincount(of, apart, len(column))
            return y

        start = np.zeros((graph.n, len(part)))
        start[at, column], start[ends, column] = 1, -1
        a, b = lanczos(without, start, steps)
        whole = _heat(a, b, tau, False)
        a[0] -= 2
        np.add.at(found[:, 2:], [k for k, *_ in part], _heat(a, b, tau, False) - whole)
    return float(tau), found


def heat_entropy(z, e):
    """In bits, from the traces of exp(-tau L) and tau L exp(-tau L)."""
    return np.log2(z) + e / z / np.log(2)


def entanglement_of(tau: float, degree: np.ndarray, z: float, e: float, dz: np.ndarray, de: np.ndarray) -> np.ndarray:
    """S(G without v) + S(star of v's degree + 1 leaves) - S(G) from the traces z and e of G and what v's edges change of them, to ten digits: equal vertices tie."""
    one, last = np.exp(-tau), np.exp(-tau * (degree + 2))
    star = heat_entropy(1 + degree * one + last, tau * (degree * one + (degree + 2) * last))
    return np.round(heat_entropy(np.maximum(z + dz - 1, 1), e + de) + star - heat_entropy(z, e), 10)


def network_entanglement(graph: Graph, beta: float, own: list[int]) -> list[float]:
    """S(G without v) + S(star of v's degree + 1 leaves) - S(G) at tau = -ln(beta) / first positive eigenvalue, for the vertices own."""
    tau, found = heat_traces(graph, beta, list(range(graph.n)))
    z, e = found[:, :2].sum(0)
    return entanglement_of(tau, np.array(graph.degree(), float), z, e, found[:, 2], found[:, 3])[own].tolist()


#: Steps of tau that vertex entanglement looks at, up to ten times the slowest diffusion's time.
TAU_STEPS = 198
#: Entries of an array that stays in a core's cache.
CACHED = 250_000
#: exp(-tau x) below it adds nothing to sums that are 1 at least.
NOTHING = 1e-30


def _entropy_curves(x: np.ndarray, step: float) -> np.ndarray:
    """Spectral entropies in bits of the eigenvalues in each row of x, ascending but for small changes, at tau = 0, step, 2 * step and so on."""
    z, e = np.empty((len(x), TAU_STEPS + 1)), np.empty((len(x), TAU_STEPS + 1))
    factor, p = np.exp(-step * x), np.ones_like(x)
    for j in range(TAU_STEPS + 1):
        z[:, j], e[:, j] = p.sum(1), np.einsum("ij,ij->i", p, x)
        p *= factor
        if j % 4 == 3:  # what has died out leaves: the largest eigenvalues go first
            last = int(np.flatnonzero(p.max(0) > NOTHING).max(initial=0)) + 1
            x, factor, p = x[:, :last], factor[:, :last], p[:, :last]
    return heat_entropy(z, step * np.arange(TAU_STEPS + 1) * e)


def _clique_change(graph: Graph, vectors: np.ndarray, v: int) -> np.ndarray:
    """By how much the eigenvalues change, to first order, when v's closed neighbourhood becomes a uniform clique of the same total weight."""
    hood = sorted(graph.near[v])
    members, place = [v, *hood], {x: i for i, x in enumerate(hood, 1)}
    edges = [(0, i) for i in place.values()] + [(i, place[y]) for x, i in place.items() for y in graph.near[x] & graph.near[v] if x < y]
    if not edges:
        return np.zeros(len(vectors))
    a, b = np.array(edges).T
    psi = vectors[members]
    out = 2 * len(edges) / len(hood) * ((psi - psi.mean(0)) ** 2).sum(0)
    block = max(1, HELD // len(vectors))
    for i in range(0, len(a), block):
        apart = psi[a[i : i + block]] - psi[b[i : i + block]]
        out -= np.einsum("ij,ij->j", apart, apart)
    return out


def vertex_entanglement(graph: Graph, own: list[int]) -> list[float]:
    """Minus the least change of entropy over tau when v's closed neighbourhood becomes a uniform clique, eigenvalues to first order; ten digits.

    It takes every eigenvector: one dense spectrum a network, memory by the square and time by the cube of its vertices.
    """
    degree = graph.degree()
    if not any(degree):
        return [0.0] * len(own)
    values, vectors = np.linalg.eigh(laplacian(graph))
    step = 10 / values[values > 1e-9].min() / TAU_STEPS
    base, out = _entropy_curves(values[None], step), np.zeros(len(own))
    linked = [i for i, v in enumerate(own) if degree[v]]
    width = max(1, CACHED // graph.n)
    for i in range(0, len(linked), width):
        part = linked[i : i + width]
        changed = np.stack([values + _clique_change(graph, vectors, own[k]) for k in part])
        out[part] = -np.round((_entropy_curves(changed, step) - base).min(1), 10)
    return out.tolist()


def gat_forward(x: np.ndarray, src: np.ndarray, dst: np.ndarray, weights: dict) -> np.ndarray:
    """Scores of a graph attention network with user-given weights: per layer elu(attention + linear), then elu layers and a sigmoid.

    weights: {"conv": [{"w": (in, heads, out), "left": (heads, out), "right": (heads, out), "bias": (heads*out)?, "concat": bool,
    "linear": (in, heads*out or out), "linear_bias"}], "full": [{"w", "b"}]}. Self loops are added; attention is a softmax over a vertex's in-edges.
    """
    n = len(x)
    s, d = np.r_[src, np.arange(n)], np.r_[dst, np.arange(n)]
    elu = lambda a: np.where(a > 0, a, np.exp(np.minimum(a, 0)) - 1)
    for layer in weights["conv"]:
        h = np.einsum("ni,iho->nho", x, layer["w"])
        left, right = (h * layer["left"]).sum(-1), (h * layer["right"]).sum(-1)
        got = np.empty_like(h)
        for i in range(h.shape[1]):  # column by column: one-dimensional gathers and sums are many times faster
            e = np.ascontiguousarray(left[:, i])[s] + np.ascontiguousarray(right[:, i])[d]
            e = np.where(e > 0, e, layer.get("slope", 0.2) * e)
            top = np.full(n, -np.inf)
            np.maximum.at(top, d, e)
            e = np.exp(e - top[d])
            share = e / np.bincount(d, e, n)[d]
            for j in range(h.shape[2]):
                got[:, i, j] = np.bincount(d, np.ascontiguousarray(h[:, i, j])[s] * share, n)
        got = got.reshape(n, -1) if layer.get("concat", True) else got.mean(1)
        x = elu(got + layer.get("bias", 0) + x @ layer["linear"] + layer.get("linear_bias", 0))
    for i, layer in enumerate(weights["full"]):
        x = x @ layer["w"] + layer["b"]
        if i < len(weights["full"]) - 1:
            x = elu(x)
    return 1 / (1 + np.exp(-x[:, 0]))


def legacy_attention(weights: dict) -> dict:
    """Weights whose layers have one attention vector `att` (heads, 2 * out) and a transposed `w` (heads * out, in) -> the form of gat_forward."""
    conv = []
    for layer in weights["conv"]:
        if "att" not in layer:
            conv.append(layer)
            continue
        att = np.asarray(layer["att"])
        heads, out = att.shape[0], att.shape[1] // 2
        w = np.asarray(layer["w"]).T
        conv.append({**{k: v for k, v in layer.items() if k != "att"}, "w": w.reshape(w.shape[0], heads, out), "left": att[:, :out], "right": att[:, out:]})
    return {**weights, "conv": conv}
