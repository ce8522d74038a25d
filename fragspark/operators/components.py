"""Connected components, their sizes, and k-cores, over distributed tables of edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_SQL
from ..tables import discard, written
from .graph import both_ways, degrees, vertices_of


def settled(df: DataFrame, *done: DataFrame) -> DataFrame:
    """A round's rows, written and reread; tables of rounds before, in `done`, are deleted."""
    return written(df, "round", *done)


#: Edges that a task ties into stars at once: what it holds of its partition.
BATCH_EDGES = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of the vertices 0 to n - 1 is connected with: roots hang on smaller ones, and paths halve, until no edge has two labels."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nearer := label[label], label):
            label = nearer


def star_edges(network, src, dst) -> pd.DataFrame:
    """The components' least vertices tied to the others: as connected as the edges given, and at most one edge per vertex."""
    parts = []
    frame = pd.DataFrame({"network": network, "src": src, "dst": dst})
    for name, g in frame.groupby("network"):
        ids, flat = np.unique(g[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        a, b = flat.reshape(-1, 2).T
        root = least_labels(a, b, len(ids))
        tied = root != np.arange(len(ids))
        parts.append(pd.DataFrame({"network": name, "src": ids[root[tied]], "dst": ids[tied]}))
    return pd.concat(parts) if parts else frame


def _stars(batches):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= BATCH_EDGES:
            held = [star_edges(*(pd.concat([x[c] for x in held]) for c in ("network", "src", "dst")))]
            if len(held[0]) > BATCH_EDGES // 2:  # little to gain from holding them on
                yield held.pop()
            n = sum(map(len, held))
    if held:
        yield star_edges(*(pd.concat([x[c] for x in held]) for c in ("network", "src", "dst")))


def _star_round(edges: DataFrame, large: bool) -> DataFrame:
    """edges(network, src, dst), src < dst. Large: every larger neighbour of a vertex is tied to its least neighbour; small: every smaller one."""
    both = both_ways(edges) if large else edges.select("network", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = both.toDF("network", "a", "b")
    least = both.groupBy("network", "a").agg(F.min("b").alias("m")).select("network", "a", F.least("a", "m").alias("m"))
    tied = both.join(least, ["network", "a"])
    if large:
        out = tied.where("b > a").select("network", F.col("m").alias("src"), F.col("b").alias("dst"))
    else:
        out = tied.where("b != m").select("network", F.col("m").alias("src"), F.col("b").alias("dst")).union(least.where("m < a").select("network", F.col("m").alias("src"), F.col("a").alias("dst")))
    return out.where("src < dst").distinct()


def _starry(edges: DataFrame) -> bool:
    """Is each vertex either tied to one other, or tied to by others, and not both?"""
    ends = edges.select("network", F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(0).alias("tied")), F.struct(F.col("dst").alias("v"), F.lit(1).alias("tied")))).alias("e"))
    seen = ends.groupBy("network", "e.v").agg(F.sum("e.tied").alias("ties"), F.min("e.tied").alias("least"))
    return seen.where((F.col("ties") > 1) | ((F.col("ties") == 1) & (F.col("least") == 0))).isEmpty()


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(network, src, dst) with src < dst -> network, v, component for all vertices of edges but the least ones of components.

    The edges that a task holds shrink to stars, at most one edge per vertex. Then large and small stars in turn tie all
    vertices to their least one, with a combining aggregation and one join a round (no vertex's neighbours are gathered),
    and tasks shrink what they hold again, until all edges form stars.
    """
    # A vertex hangs on one other at most in each batch, so all its ties meet without a hub's doing so.
    thin = edges.select("network", "src", "dst").where("src < dst").mapInPandas(_stars, EDGE_SQL)
    now = settled(thin.repartition("network", "dst").mapInPandas(_stars, EDGE_SQL))
    for _ in range(most_rounds):
        if _starry(now):
            return now.select("network", F.col("dst").alias("v"), F.col("src").alias("component"))
        now = settled(_star_round(_star_round(now, True), False).mapInPandas(_stars, EDGE_SQL), now)
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """network, v, component (its least vertex); vertices without edges are components of their own."""
    found = star_components(edges)
    all_of = (vertices if vertices is not None else vertices_of(edges)).select("network", "v")
    return all_of.join(found, ["network", "v"], "left").select("network", "v", F.coalesce("component", "v").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("network", "component").agg(F.count(F.lit(1)).alias("size"))


def lcc_slcc(labels: DataFrame, slcc_ties: str = "distinct") -> DataFrame:
    """network, lcc, slcc. Ties 'distinct': the largest size strictly below the LCC's; 'multiset': the second of all sizes. 0 if none."""
    sizes = component_sizes(labels)
    if slcc_ties == "distinct":
        top = sizes.groupBy("network").agg(F.max("size").alias("lcc"))
        return sizes.join(top, "network").groupBy("network").agg(F.max("lcc").alias("lcc"), F.coalesce(F.max(F.when(F.col("size") < F.col("lcc"), F.col("size"))), F.lit(0)).alias("slcc"))
    if slcc_ties != "multiset":
        raise ValueError("slcc_ties is 'distinct' or 'multiset'")
    place = F.row_number().over(Window.partitionBy("network").orderBy(F.desc("size"), "component"))
    ranked = sizes.withColumn("k", place).where("k <= 2")
    return ranked.groupBy("network").agg(F.max("size").alias("lcc"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("size"))), F.lit(0)).alias("slcc"))


def k_core(edges: DataFrame, k: int = 2, most_rounds: int = 10_000) -> DataFrame:
    """The edges of the k-core: vertices of lower degree are peeled until none is left. k = 2 takes trees off."""
    now = settled(edges.where("src != dst").select("network", "src", "dst"))
    for _ in range(most_rounds):
        weak = degrees(now).where(F.col("degree") < k).select("network", "v")
        if weak.isEmpty():
            return now
        now = settled(now.join(weak.withColumnRenamed("v", "src"), ["network", "src"], "left_anti").join(weak.withColumnRenamed("v", "dst"), ["network", "dst"], "left_anti").select("network", "src", "dst"), now)
    raise RuntimeError("no fixpoint")


def coreness(edges: DataFrame, normalise: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """network, v, core: each vertex's value falls to the h-index of its neighbours' values until none moves, all k at once.

    Neighbours travel as counts by value, combined before the shuffle, so a hub's are as many rows as there are values.
    """
    ways = settled(both_ways(edges))
    now = settled(degrees(edges).select("network", "v", F.col("degree").alias("core"), F.col("degree").alias("was")))
    for _ in range(most_rounds):
        seen = ways.join(now.select("network", F.col("v").alias("dst"), "core"), ["network", "dst"]).groupBy("network", F.col("src").alias("v"), "core").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("network", "v").orderBy(F.desc("core")))
        h = seen.withColumn("m", F.least("core", above)).groupBy("network", "v").agg(F.max("m").alias("h"))
        now = settled(now.join(h, ["network", "v"], "left").select("network", "v", F.least("core", "h").alias("core"), F.col("core").alias("was")), now)
        if now.where("was != core").isEmpty():
            discard(ways)
            now = now.select("network", "v", "core")
            if normalise:
                now = now.join(now.groupBy("network").agg(F.max("core").alias("top")), "network").select("network", "v", F.try_divide("core", "top").alias("core"))
            return now
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
