"""Networks that lose vertices: components and degrees kept as tables, of which a batch of removals changes only what it touches.

Degrees: the order of many removals follows from the vertices of highest degree and the edges among them alone, so a round
settles all blocks that these decide, and then rewrites the degrees and edges that are left.

Components: each edge is stored under its component. Removals split at most the components that hold them, so a batch
reads the edges of those components, labels them anew, and leaves the others' rows as they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, written
from . import components as P
from .components import components
from .graph import both_ways, degrees, fresh, vertices_of
from .replay import static_curve


@dataclass
class Labels:
    """The components of a network that shrinks: edges(network, component, src, dst), labels(network, v, component), and what the last batch read."""

    edges: DataFrame
    labels: DataFrame
    edges_read: int = 0
    edges_all: int = 0


def labelled(edges: DataFrame) -> Labels:
    labels = written(components(edges), "labels")
    under = labels.select("network", F.col("v").alias("src"), "component")
    return Labels(written(edges.where("src != dst").join(under, ["network", "src"]).select("network", "component", "src", "dst").repartitionByRange("network", "component"), "live"), labels)


def removed_from(state: Labels, gone: DataFrame) -> Labels:
    """The components after gone (network, v) went. Vertices that are not there change nothing."""
    gone = written(gone.select("network", "v").distinct(), "gone")
    touched = written(state.labels.join(gone, ["network", "v"], "left_semi").select("network", "component").distinct(), "touched")
    inside = written(state.edges.join(touched, ["network", "component"], "left_semi"), "inside")
    left = inside
    for end in ("src", "dst"):
        left = left.join(gone.select("network", F.col("v").alias(end)), ["network", end], "left_anti")
    vertices = state.labels.join(touched, ["network", "component"], "left_semi").join(gone, ["network", "v"], "left_anti").select("network", "v")
    left = left.select("network", "src", "dst")
    new = written(components(left, vertices), "labels")
    under = new.select("network", F.col("v").alias("src"), "component")
    edges = state.edges.join(touched, ["network", "component"], "left_anti").unionByName(left.join(under, ["network", "src"]).select("network", "component", "src", "dst"))
    labels = state.labels.join(touched, ["network", "component"], "left_anti").unionByName(new)
    read, every = inside.count(), state.edges.count()
    out = Labels(written(edges.select("network", "component", "src", "dst").repartitionByRange("network", "component"), "live", state.edges), written(labels.select("network", "v", "component"), "labels", state.labels), read, every)
    discard(gone, touched, inside, new)
    return out


def largest(state: Labels) -> DataFrame:
    """network, size of the largest component that is left."""
    return state.labels.groupBy("network", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("network").agg(F.max("size").alias("size"))


#: Vertices whose next removals one task works out at once, and the most edges among them that it holds.
CANDIDATES = 50_000
INNER_EDGES = 5_000_000


def _next_blocks(best: np.ndarray, degree: np.ndarray, src: np.ndarray, dst: np.ndarray, block: int, bound: tuple[int, int] | None) -> list[tuple[int, int]]:
    """(place in best, degree) of removals in order, `block` at a time by degree now, ties to the lowest vertex.

    best and degree are the vertices of highest degree, with the edges src, dst among them; bound is the (-degree, v) of
    the best other vertex. The others' degrees only fall, so blocks whose picks are all better than it are right.
    """
    n, degree = len(best), degree.astype(np.int64).tolist()
    ends, others = np.r_[src, dst], np.r_[dst, src]
    order = np.argsort(ends, kind="stable")
    start, near = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]), others[order]
    heap, gone, out = [(-d, int(v), i) for i, (v, d) in enumerate(zip(best.tolist(), degree, strict=True))], [False] * n, []
    heapq.heapify(heap)
    while heap:
        picks = []
        while heap and len(picks) < block:
            d, v, i = heapq.heappop(heap)
            if d != -degree[i]:  # degrees only fall: a stale entry goes back
                heapq.heappush(heap, (-degree[i], v, i))
            elif bound is not None and (d, v) > bound:
                break
            else:
                picks.append(i)
        if bound is not None and len(picks) < block:
            break
        out += [(i, degree[i]) for i in picks]
        for i in picks:
            gone[i] = True
        for i in picks:
            for j in near[start[i] : start[i + 1]].tolist():
                if not gone[j]:
                    degree[j] -= 1
    return out


def _leap(base: DataFrame, edges: DataFrame, block: int, candidates: int) -> DataFrame:
    """network, v, degree, place (from 1): as many of the next removals as the `candidates` vertices of highest degree settle, one block at least where there is one."""
    first = F.row_number().over(Window.partitionBy("network").orderBy(F.desc("degree"), "v"))
    most = max(candidates, block)
    while True:
        top = written(base.select("network", "v", "degree", first.alias("k")).where(F.col("k") <= most + 1), "top")
        inner = edges
        for end in ("src", "dst"):
            inner = inner.join(F.broadcast(top.where(F.col("k") <= most).select("network", F.col("v").alias(end), F.col("k").alias(f"{end}_k"))), ["network", end])
        inner = written(inner.where("src != dst").select("network", "src_k", "dst_k"), "inner")
        held = inner.groupBy("network").count().agg(F.max("count")).first()[0] or 0
        if held <= INNER_EDGES or most <= max(block, 1000):
            break
        discard(top, inner)
        most = max(most // 2, block)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("k")
        beyond = left[left["k"] > most]
        bound = (-int(beyond["degree"].iloc[0]), int(beyond["v"].iloc[0])) if len(beyond) else None
        left = left[left["k"] <= most]
        found = _next_blocks(left["v"].to_numpy(), left["degree"].to_numpy(), right["src_k"].to_numpy() - 1, right["dst_k"].to_numpy() - 1, block, bound)
        i = np.array([i for i, _ in found], np.int64)
        return pd.DataFrame({"network": key[0], "v": left["v"].to_numpy()[i], "degree": np.array([d for _, d in found], np.int64), "place": np.arange(1, len(i) + 1)}, columns=["network", "v", "degree", "place"])

    return written(fresh(top).groupBy("network").cogroup(fresh(inner).groupBy("network")).applyInPandas(run, "network string, v long, degree long, place long"), "new", top, inner)


def adaptive_removals(edges: DataFrame, threshold: float = 0.1, block: int = 1, candidates: int | None = None, most_rounds: int = 1_000_000) -> DataFrame:
    """network, v, degree, removal_num: the vertices of highest degree go, `block` at a time, with degrees as they are after each block, at least until no component is larger than ceil(N * threshold).

    A round takes the vertices of highest degree and the edges among them to one task, which settles all the blocks in
    which no other vertex could come before them; then the degrees of the removed ones' neighbours fall. Rounds are as
    many as such leaps, not as blocks.
    """
    candidates = CANDIDATES if candidates is None else candidates
    n = vertices_of(edges).groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    most = written(n.select("network", F.ceil(F.col("n") * F.lit(float(threshold))).alias("most")), "most")
    base, left, order = written(degrees(edges), "base"), written(edges.select("network", "src", "dst"), "left"), None
    before = written(most.select("network", F.lit(0).cast("long").alias("before")), "before")
    for _ in range(most_rounds):
        largest_now = P.component_sizes(components(left.where("src != dst"), base)).groupBy("network").agg(F.max("size").alias("size"))
        open_ = written(largest_now.join(most, "network").where("size > most").select("network"), "open")
        new = _leap(base.join(open_, "network", "left_semi"), left, block, candidates)
        if new.isEmpty():
            discard(new, open_)
            break
        part = written(new.join(before, "network").select("network", "v", "degree", (F.col("before") + F.col("place")).alias("removal_num")), "order")
        order = part if order is None else order.unionByName(part)
        counted = part.groupBy("network").agg(F.max("removal_num").alias("now"))
        before = written(before.join(counted, "network", "left").select("network", F.coalesce("now", "before").alias("before")), "before", before)
        less = both_ways(left).join(new.select("network", F.col("v").alias("src")), ["network", "src"], "left_semi").groupBy("network", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("less"))
        base = written(base.join(new.select("network", "v"), ["network", "v"], "left_anti").join(less, ["network", "v"], "left").select("network", "v", (F.col("degree") - F.coalesce("less", F.lit(0))).alias("degree")), "base", base)
        thin = left
        for end in ("src", "dst"):
            thin = thin.join(new.select("network", F.col("v").alias(end)), ["network", end], "left_anti")
        left = written(thin.select("network", "src", "dst"), "left", left)
        discard(new, open_)
    discard(base, left, before, most)
    return order if order is not None else edges.sparkSession.createDataFrame([], "network string, v long, degree long, removal_num long")


def _with_rest(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Ranks: the removals of order, then the other vertices by vertex."""
    rest = vertices_of(edges).join(order.select("network", "v"), ["network", "v"], "left_anti")
    behind = order.groupBy("network").agg(F.max("removal_num").alias("before"))
    rest = rest.join(behind, "network", "left").select("network", "v", (F.row_number().over(Window.partitionBy("network").orderBy("v")) + F.coalesce("before", F.lit(0))).alias("removal_num"))
    found = order.select("network", "v", F.col("degree").cast("double").alias("score"), "removal_num").unionByName(rest.withColumn("score", F.lit(None).cast("double")).select("network", "v", "score", "removal_num"))
    return found.select("network", F.lit("adaptive_degree").alias("heuristic"), "v", "score", F.col("removal_num").cast("int").alias("removal_num"))


def adaptive_degree_order(edges: DataFrame, threshold: float = 0.1, block: int = 1, compact_every: int | None = None, candidates: int | None = None) -> DataFrame:
    """network, heuristic, v, score, removal_num: adaptive_removals() up to the block after which no component is larger than ceil(N * threshold); the others follow by vertex. (compact_every: of an earlier form, without effect.)"""
    order = adaptive_removals(edges, threshold, block, candidates)
    last = static_curve(edges, _with_rest(edges, order), threshold).groupBy("network").agg(F.max("removal_num").alias("last"))
    kept = order.join(fresh(last), "network").where(F.col("removal_num") <= F.ceil(F.col("last") / block) * block).drop("last")
    return _with_rest(edges, written(kept, "order"))


def adaptive_degree(edges: DataFrame, threshold: float = 0.1, block: int = 1, candidates: int | None = None) -> DataFrame:
    """The curve of adaptive_degree_order: it ends before the order's removals do, so these need no cut."""
    return static_curve(edges, _with_rest(edges, adaptive_removals(edges, threshold, block, candidates)), threshold)


def batched_sizes(edges: DataFrame, ranks: DataFrame, batch: int) -> DataFrame:
    """network, removal_num, lcc, edges_read, edges_all: the largest component after each `batch` removals of a fixed order, with the edges that the batch read and those that were left before it. All networks go on together."""
    state, out = labelled(edges), None
    last = ranks.agg(F.max("removal_num")).first()[0] or 0
    for begin in range(0, last, batch):
        state = removed_from(state, ranks.where((F.col("removal_num") > begin) & (F.col("removal_num") <= begin + batch)))
        part = written(largest(state).select("network", F.lit(begin + batch).alias("removal_num"), F.col("size").alias("lcc"), F.lit(state.edges_read).alias("edges_read"), F.lit(state.edges_all).alias("edges_all")), "sizes")
        out = part if out is None else out.unionByName(part)
        if state.edges_all == 0:
            break
    return out if out is not None else edges.sparkSession.createDataFrame([], "network string, removal_num int, lcc long, edges_read int, edges_all int")
