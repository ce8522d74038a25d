"""From scores to removal orders, curves and run rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CURVE_SQL
from . import kernels as K
from .graph import degrees, fresh, vertices_of

KEYS = ["network", "heuristic"]


def ranked(scores: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """network, heuristic, v, score, removal_num: score down, then vertex up; vertices of the table without a score come last."""
    if vertices is not None:
        scores = scores.select(*KEYS).distinct().join(vertices.select("network", "v"), "network").join(scores, [*KEYS, "v"], "left")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("score").desc_nulls_last(), F.col("v").asc()))
    return scores.select(*KEYS, "v", "score", place.alias("removal_num"))


def stop_size(n: Column, threshold: float) -> Column:
    """ceil(N * threshold), in double precision."""
    return F.ceil(n.cast("double") * F.lit(float(threshold)))


#: Edges that a task holds before it thins them to a forest: twice what the last forest kept, and at least so many.
HELD_EDGES = 1_000_000
#: Forests of so many edges are passed on instead of being held for more.
MOST_HELD = 16_000_000
#: Tasks of one network's second thinning, before the network's own task.
MIDDLE = 4


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Maximum spanning forests of all that a task gets, by network and heuristic: names are kept once, edges as arrays of numbers."""
    held: dict[tuple, list[np.ndarray]] = {}
    n, most = 0, HELD_EDGES

    def thinned(pairs: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(pairs, axis=1)
        return both[:, K.spanning_edges(None, both[0], both[1])]

    def frames():
        for (network, heuristic), pairs in held.items():
            for both in pairs:
                yield pd.DataFrame({"network": network, "heuristic": heuristic, "ra": both[0], "rb": both[1]})

    for b in batches:
        for key, g in b.groupby(KEYS, sort=False):
            held.setdefault(key, []).append(g[["ra", "rb"]].to_numpy(np.int32).T)
        n += len(b)
        if n >= most:
            held = {key: [thinned(pairs)] for key, pairs in held.items()}
            n = sum(pairs[0].shape[1] for pairs in held.values())
            most = max(HELD_EDGES, 2 * n)
            if n > MOST_HELD:
                yield from frames()
                held, n, most = {}, 0, HELD_EDGES
    held = {key: [thinned(pairs)] for key, pairs in held.items()}
    yield from frames()


RANK_PAIRS = "network string, heuristic string, ra int, rb int"


def rank_forest(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """network, heuristic, ra, rb: the edges as pairs of removal numbers, thinned to a spanning forest that has all that any prefix of removals needs.

    Tasks thin what they hold, a few tasks for each network thin what those leave, and the network's own task the rest,
    as it comes in: what a task holds grows with the vertices, not with the edges.
    """
    at = ranks.select(*KEYS, "v", "removal_num")
    joined = edges.join(at.withColumnsRenamed({"v": "src", "removal_num": "ra"}), ["network", "src"]).join(at.withColumnsRenamed({"v": "dst", "removal_num": "rb"}), [*KEYS, "dst"])
    thin = joined.select(*KEYS, "ra", "rb").mapInPandas(_forest, RANK_PAIRS)
    thin = thin.repartition(*KEYS, F.col("ra") % MIDDLE).mapInPandas(_forest, RANK_PAIRS)
    return thin.repartition(*KEYS).mapInPandas(_forest, RANK_PAIRS)


def static_curve(edges: DataFrame, ranks: DataFrame, threshold: float = 0.1, slcc_ties: str = "distinct") -> DataFrame:
    """The curve of a fixed order: each removal's LCC and SLCC as shares of N, up to the first LCC <= ceil(N * threshold), one removal at least.

    Edges travel as the forest of rank_forest(): less than one edge per vertex reaches the network's task. There the
    vertices come back in reverse order through a union-find: no component is ever searched again.
    """
    thin = rank_forest(edges, ranks)
    sizes = ranks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))

    def curve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table({"network": pa.array([], pa.string()), "heuristic": pa.array([], pa.string()), "removal_num": pa.array([], pa.int32()), "lcc": pa.array([], pa.float64()), "slcc": pa.array([], pa.float64())})
        n = right["n"][0].as_py()
        lcc, slcc = K.reverse_curve(n, left["ra"].to_numpy(), left["rb"].to_numpy(), slcc_ties)
        end = np.flatnonzero(lcc <= np.ceil(n * threshold))
        last = int(end[0]) + 1 if len(end) else n
        return pa.table({"network": pa.repeat(key[0], last), "heuristic": pa.repeat(key[1], last), "removal_num": np.arange(1, last + 1, dtype=np.int32), "lcc": lcc[:last] / n, "slcc": slcc[:last] / n})

    found = thin.groupBy(*KEYS).cogroup(fresh(sizes).groupBy(*KEYS)).applyInArrow(curve, "network string, heuristic string, removal_num int, lcc double, slcc double")
    return found.join(ranks, [*KEYS, "removal_num"]).select(*KEYS, "removal_num", F.col("v").alias("id"), F.col("score").alias("prediction"), "lcc", "slcc")


def sequential_curve(edges: DataFrame, ranks: DataFrame, mode: str = "lcc", threshold: float = 0.1, slcc_ties: str = "distinct", block: int = 1) -> DataFrame:
    """Replays that depend on what was removed before (kernels.forward_curve): one task per network and heuristic."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(left["src"], left["dst"], right["v"])
        right = right.sort_values("removal_num")
        order = np.searchsorted(g.ids, right["v"]).tolist()
        score = dict(zip(order, right["score"], strict=True))
        rows = K.forward_curve(g, order, mode, int(np.ceil(g.n * threshold)), slcc_ties, block)
        return pd.DataFrame([(key[0], key[1], i, int(g.ids[v]), score.get(v), lcc / g.n, slcc / g.n) for i, (v, lcc, slcc) in enumerate(rows, 1)], columns=["network", "heuristic", "removal_num", "id", "prediction", "lcc", "slcc"])

    wide = ranks.select(*KEYS).distinct().join(edges, "network")
    return fresh(wide).groupBy(*KEYS).cogroup(fresh(ranks).groupBy(*KEYS)).applyInPandas(run, CURVE_SQL)


def adaptive_degree_curve(edges: DataFrame, threshold: float = 0.1, block: int = 1) -> DataFrame:
    """Degree recomputed after every `block` removals."""
    ranks = ranked(degrees(edges).select("network", F.lit("adaptive_degree").alias("heuristic"), "v", F.col("degree").cast("double").alias("score")))
    return sequential_curve(edges, ranks, "degree", threshold, block=block)


def scored_adaptively(edges: DataFrame, scorer, heuristic: str, threshold: float = 0.1, share: float = 0.0, core: bool = False) -> DataFrame:
    """Rounds of a user scorer, scorer(ids, neighbours) -> scores of the vertices left: the best max(1, share * N) of the largest
    component go (with core: of its 2-core, and once that is empty the trees are broken). A scorer with of_edges(n, src, dst)
    gets arrays instead of sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(pdf["src"], pdf["dst"])
        out = K.scored_removals(g, scorer, int(np.ceil(g.n * threshold)), max(1, int(share * g.n)), core)
        return pd.DataFrame({"network": pdf["network"].iloc[0], "heuristic": heuristic, "v": g.ids[out], "score": [float(len(out) - i) for i in range(len(out))]})

    return edges.groupBy("network").applyInPandas(run, "network string, heuristic string, v long, score double")


def simpson(value: Column, i: Column, n: Column) -> Column:
    """Each point's share of Simpson's rule with unit steps; point i of n from 1. Even n: the last interval by the three last points."""
    m = F.when(n % 2 == 1, n).otherwise(n - 1)
    inner = F.when((i == 1) | (i == m), F.lit(1 / 3)).when(i % 2 == 0, F.lit(4 / 3)).otherwise(F.lit(2 / 3))
    weight = F.when(i <= m, inner).otherwise(0.0) + F.when(n % 2 == 1, 0.0).when(i == n, 5 / 12).when(i == n - 1, 2 / 3).when(i == n - 2, -1 / 12).otherwise(0.0)
    return value * F.when(n == 1, F.lit(0.0)).when(n == 2, F.lit(0.5)).otherwise(weight)


def run_metrics(curve: DataFrame) -> DataFrame:
    """network, heuristic, slcc_peak_at (first peak), lcc_size_at_peak, slcc_size_at_peak, r_auc, rem_num."""
    n = curve.groupBy(*KEYS).agg(F.max("removal_num").alias("n"))
    best = F.max(F.struct(F.col("slcc"), (-F.col("removal_num")).alias("turned"), F.col("lcc"))).alias("best")
    found = curve.join(n, KEYS).groupBy(*KEYS).agg(F.sum(simpson(F.col("lcc"), F.col("removal_num"), F.col("n"))).alias("r_auc"), F.max("n").cast("int").alias("rem_num"), best)
    return found.select(*KEYS, (-F.col("best.turned")).cast("int").alias("slcc_peak_at"), F.col("best.lcc").alias("lcc_size_at_peak"), F.col("best.slcc").alias("slcc_size_at_peak"), "r_auc", "rem_num")


def run_rows(curve: DataFrame, threshold: float, static: bool = True, prediction_time: float | None = None, dismantle_time: float | None = None) -> DataFrame:
    """Run rows with their removals nested."""
    nested = curve.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("removal_num", "id", "prediction", "lcc", "slcc"))).alias("removals"))
    extra = {"static": F.lit(static), "prediction_time": F.lit(prediction_time).cast("double"), "dismantle_time": F.lit(dismantle_time).cast("double"), "threshold": F.lit(float(threshold))}
    return run_metrics(curve).join(nested, KEYS).withColumns(extra)


def early_stopped(runs: DataFrame, most_auc: float | None = None, most_removals: int | None = None) -> DataFrame:
    """Runs over a bound lose their metrics and have status 'stopped'; others 'done'."""
    over = F.lit(False)
    if most_auc is not None:
        over = over | (F.col("r_auc") > most_auc)
    if most_removals is not None:
        over = over | (F.col("rem_num") > most_removals)
    return runs.withColumn("status", F.when(over, "stopped").otherwise("done")).withColumns({c: F.when(over, None).otherwise(F.col(c)) for c in ("r_auc", "rem_num")})


def stopped_curves(curve: DataFrame, most_auc: float | None = None, most_removals: int | None = None) -> DataFrame:
    """Curves up to where a bound is passed: the area so far (trapezoids) beyond most_auc, or more than most_removals removals; the last row kept is the one that passes."""
    before = Window.partitionBy(*KEYS).orderBy("removal_num")
    area = F.sum((F.col("lcc") + F.coalesce(F.lag("lcc").over(before), F.col("lcc"))) / 2 * F.when(F.col("removal_num") > 1, 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0))
    over = F.lit(False)
    if most_auc is not None:
        over = over | (F.col("area") > most_auc)
    if most_removals is not None:
        over = over | (F.col("removal_num") > most_removals)
    marked = curve.withColumn("area", area).withColumn("over", over)
    passed = F.sum(F.col("over").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("passed", F.coalesce(passed, F.lit(0))).where("passed = 0").drop("passed", "area").withColumnRenamed("over", "stopped")


def percolation(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """network, heuristic, removal_num, lcc, susceptibility after each removal: the largest component's share of N, and the squares of the other components' sizes by N."""
    thin = rank_forest(edges, ranks)
    sizes = ranks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))

    def curve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"network": [], "heuristic": [], "removal_num": [], "lcc": [], "susceptibility": []})
        n = int(right["n"].iloc[0])
        lcc, squares = K.reverse_squares(n, left["ra"].to_numpy(), left["rb"].to_numpy())
        return pd.DataFrame({"network": key[0], "heuristic": key[1], "removal_num": np.arange(1, n + 1), "lcc": lcc / n, "susceptibility": (squares - lcc.astype(float) ** 2) / n})

    return thin.groupBy(*KEYS).cogroup(fresh(sizes).groupBy(*KEYS)).applyInPandas(curve, "network string, heuristic string, removal_num int, lcc double, susceptibility double")


def adaptive_curve(edges: DataFrame, kind: str, threshold: float = 0.1, slcc_ties: str = "distinct") -> DataFrame:
    """The attack that recomputes a score after each removal and takes its best vertex: degree, betweenness, closeness or pagerank. One task per network."""
    if kind not in K.LIVE_SCORES:
        raise ValueError(f"kind is one of {sorted(K.LIVE_SCORES)}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(pdf["src"], pdf["dst"])
        rows = K.adaptive(g, kind, int(np.ceil(g.n * threshold)), slcc_ties)
        return pd.DataFrame([(pdf["network"].iloc[0], f"adaptive_{kind}", i, int(g.ids[v]), score, lcc / g.n, slcc / g.n) for i, (v, score, lcc, slcc) in enumerate(rows, 1)], columns=["network", "heuristic", "removal_num", "id", "prediction", "lcc", "slcc"])

    return edges.groupBy("network").applyInPandas(run, CURVE_SQL)


def robustness(curve: DataFrame, vertices: DataFrame) -> DataFrame:
    """Sum of the LCC's shares over all removals, by N."""
    n = vertices.groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    return curve.groupBy(*KEYS).agg(F.sum("lcc").alias("s")).join(n, "network").select(*KEYS, (F.col("s") / F.col("n")).alias("robustness"))


def attack_cost(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Share of all links gone after each removal: a link goes with the first of its ends."""
    at = ranks.select(*KEYS, "v", "removal_num")
    edges = edges.where("src != dst")
    first = edges.join(at.withColumnsRenamed({"v": "src", "removal_num": "ra"}), ["network", "src"]).join(at.withColumnsRenamed({"v": "dst", "removal_num": "rb"}), [*KEYS, "dst"])
    gone = first.groupBy(*KEYS, F.least("ra", "rb").alias("removal_num")).agg(F.count(F.lit(1)).alias("links"))
    total = edges.groupBy("network").agg(F.count(F.lit(1)).alias("total"))
    run = F.sum(F.coalesce("links", F.lit(0))).over(Window.partitionBy(*KEYS).orderBy("removal_num"))
    return at.join(gone, [*KEYS, "removal_num"], "left").join(total, "network").select(*KEYS, "removal_num", F.col("v").alias("id"), (run / F.col("total")).alias("cost"))
