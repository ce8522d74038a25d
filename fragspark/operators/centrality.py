"""Vertex scores that spread over edges: PageRank, eigenvector, betweenness, closeness, Collective Influence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard
from . import kernels as K
from .components import coreness, settled
from .graph import both_ways, chi_of, clustering, degree_normalised, degrees, fresh, vertices_of

FEATURES = ("degree", "clustering_coefficient", "eigenvectors", "chi_degree", "chi_lcc", "pagerank_out", "betweenness_centrality", "kcore")


def _moved(now: DataFrame, tolerance: float | None) -> bool:
    """Do the values of any network differ from those of the round before (score, was) by more than tolerance in all?"""
    if tolerance is None:
        return True
    return not now.groupBy("network").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("moved")).where(F.col("moved") >= tolerance).isEmpty()


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(1 - d) / N + d * (sum over neighbours of score / degree + the scores of vertices without edges / N), from 1 / N on.

    With a tolerance until the scores move by less in all, `rounds` rounds at most; else `rounds` rounds. A round is one
    join and one combining aggregation over all tasks.
    """
    d = degrees(edges)
    n = d.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("degree") == 0).cast("long")).alias("alone"))
    fixed = settled(d.join(n, "network").select("network", "v", "degree", "n", "alone"))
    ways = settled(both_ways(edges))
    now = fixed.select("network", "v", "degree", "n", (1 / F.col("n")).alias("score"))
    before = []
    some_alone = not fixed.where("alone > 0").isEmpty()
    for _ in range(rounds):
        share = now.select("network", F.col("v").alias("src"), F.try_divide("score", "degree").alias("share"))
        got = ways.join(share, ["network", "src"]).groupBy("network", F.col("dst").alias("v")).agg(F.sum("share").alias("got"))
        joined = now.join(got, ["network", "v"], "left")
        if some_alone:
            joined = joined.join(now.where("degree = 0").groupBy("network").agg((F.sum("score") / F.max("n")).alias("spread")), "network", "left")
        else:
            joined = joined.withColumn("spread", F.lit(0.0))
        value = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("spread", F.lit(0.0)))
        now = settled(joined.select("network", "v", "degree", "n", value.alias("score"), F.col("score").alias("was")), *before)
        before = [now]
        if not _moved(now, tolerance):
            break
    discard(*([ways, fixed] if before else []))
    return now.select("network", "v", "score")


def eigenvector(edges: DataFrame, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """Power iteration from all ones, scaled to length 1 per network after each round; with a tolerance until the values move by less in all, `rounds` rounds at most."""
    ways = settled(both_ways(edges))
    now, before = vertices_of(edges).select("network", "v", F.lit(1.0).alias("score")), []
    for _ in range(rounds):
        got = ways.join(now.select("network", F.col("v").alias("src"), "score"), ["network", "src"]).groupBy("network", F.col("dst").alias("v")).agg(F.sum("score").alias("got"))
        long = settled(now.join(got, ["network", "v"], "left").select("network", "v", F.coalesce("got", F.lit(0.0)).alias("got"), F.col("score").alias("was")), *before)
        length = long.groupBy("network").agg(F.sqrt(F.sum(F.col("got") * F.col("got"))).alias("length"))
        now, before = long.join(length, "network").select("network", "v", F.coalesce(F.try_divide("got", "length"), F.lit(0.0)).alias("score"), "was"), [long]
        if not _moved(now, tolerance):
            break
    discard(*([ways] if before else []))
    return now.select("network", "v", "score")


def ball(edges: DataFrame, hops: int) -> DataFrame:
    """network, v, u: u at distance exactly `hops` from v; frontier joins, visited vertices taken out."""
    ways = both_ways(edges)
    frontier = ways.select("network", F.col("src").alias("v"), F.col("dst").alias("u"))
    seen = frontier.union(frontier.select("network", "v", "v").distinct())
    for _ in range(hops - 1):
        step = frontier.join(ways.withColumnRenamed("src", "u").withColumnRenamed("dst", "w"), ["network", "u"]).select("network", "v", F.col("w").alias("u")).distinct()
        frontier = step.join(seen, ["network", "v", "u"], "left_anti")
        seen = seen.union(frontier)
    return frontier


#: Directed edges that a task of second_border() holds of either side.
SIDE_EDGES = 8_000_000
#: Two-step paths that it follows at once, and places that it remembers them by.
PATHS_AT_ONCE = 1_000_000
PLACES = 4_000_000


def _second_border(start: np.ndarray, near: np.ndarray, first: np.ndarray, middle: np.ndarray, itself: np.ndarray, direct: np.ndarray, linked: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Per source the sum of value over the ends of two-step paths, each end once, without the source (its place `itself`, -1: not among the ends) and the ends `linked` to it.

    Paths lead from source i to the places middle[first[i]:first[i + 1]] and on to the ends near[start[m]:start[m + 1]];
    linked[direct[i]:direct[i + 1]] are source i's own neighbours among the ends.
    """
    n, out = len(itself), np.zeros(len(itself))
    lengths = np.r_[0, np.cumsum(start[middle + 1] - start[middle])][first]  # paths before each source
    most, begin = max(1, PLACES // max(1, len(value))), 0
    place = np.empty(min(n, most) * len(value), np.int32)
    while begin < n:
        end = min(n, begin + most, max(begin + 1, int(np.searchsorted(lengths, lengths[begin] + PATHS_AT_ONCE, "right")) - 1))
        many = end - begin
        ends, _ = K.spread(start, near, middle[first[begin] : first[end]])
        of = np.repeat(np.arange(many), np.diff(lengths[begin : end + 1]))
        key, number = of * len(value) + ends, np.arange(len(ends), dtype=np.int32)
        place[key] = number  # of the paths to one end the last stays
        own = np.flatnonzero(itself[begin:end] >= 0)
        place[own * len(value) + itself[begin:end][own]] = -1
        place[np.repeat(np.arange(many), np.diff(direct[begin : end + 1])) * len(value) + linked[direct[begin] : direct[end]]] = -1
        kept = place[key] == number
        out[begin:end] = np.bincount(of[kept], value[ends[kept]], many)
        begin = end
    return out


def second_border(edges: DataFrame) -> DataFrame:
    """network, v, border: the sum of (k_u - 1) over the vertices u at distance 2.

    Vertices are dealt into blocks by a hash, and a task takes the sources of one block and the ends of another, with the
    lists of neighbours that lead from the ones and to the others: paths of two steps are followed in arrays and never
    become rows. What a task holds is bounded by the number of blocks, which grows with the edges.
    """
    edges = settled(edges.select("network", "src", "dst").where("src != dst"))
    ways = both_ways(edges)
    blocks = max(-(-2 * edges.count() // SIDE_EDGES), int(np.ceil(np.sqrt(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))

    def dealt(own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int")
        by = ["network", "src", *([] if own == "src" else [block.alias("end")])]
        lists = ways.groupBy(*by).agg(F.collect_list("dst").alias("near"))
        lists = lists.withColumn("begin", block) if own == "src" else lists
        return lists.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("network", "begin", "end", "src", "near")

    def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = table["near"].combine_chunks()
        near = near if isinstance(near, pa.Array) else pa.concat_arrays(near.chunks)
        return table["src"].to_numpy(), near.flatten().to_numpy(), np.r_[0, np.cumsum(near.value_lengths().to_numpy())].astype(np.int64)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sources, border = np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            sources, to, first = flat(left)
            middles, near, start = flat(right)
            order = np.argsort(middles)
            middles = middles[order]
            near, counts = K.spread(start, near, order)
            start = np.r_[0, np.cumsum(counts)]
            ends, near, degree = np.unique(near, return_inverse=True, return_counts=True)

            def found(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
                return np.where(ids[at] == x, at, -1)

            def among(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = found(ids, to)
                return np.r_[0, np.cumsum(at >= 0)][first], at[at >= 0]

            (by, middle), (direct, linked) = among(middles), among(ends)
            border = _second_border(start, near, by, middle, found(ends, sources), direct, linked, degree - 1.0)
        return pa.table({"network": pa.array([key[0].as_py()] * len(sources), pa.string()), "v": pa.array(sources, pa.int64()), "border": pa.array(border.astype(np.int64))})

    keys = ["network", "begin", "end"]
    parts = dealt("src", "end").groupBy(*keys).cogroup(fresh(dealt("dst", "begin")).groupBy(*keys)).applyInArrow(run, "network string, v long, border long")
    return parts.groupBy("network", "v").agg(F.sum("border").alias("border"))


def collective_influence(edges: DataFrame, hops: int = 1) -> DataFrame:
    """(k_v - 1) * sum of (k_u - 1) over u at distance `hops`; 0 for leaves."""
    d = degrees(edges)
    border = second_border(edges) if hops == 2 else ball(edges, hops).join(d.select("network", F.col("v").alias("u"), (F.col("degree") - 1).alias("k")), ["network", "u"]).groupBy("network", "v").agg(F.sum("k").alias("border"))
    return d.join(border, ["network", "v"], "left").select("network", "v", ((F.col("degree") - 1) * F.coalesce("border", F.lit(0))).cast("double").alias("score"))


def _adjacency(group: pd.DataFrame):
    """(ids, row starts, neighbours) of one network's edges."""
    ids, flat = np.unique(group[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    src, dst = np.r_[a, b], np.r_[b, a]
    order = np.argsort(src, kind="stable")
    return ids, np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]), dst[order]


def _added(to: np.ndarray, index: np.ndarray, values: np.ndarray) -> None:
    """Adds values at index: many at once over all places, few one by one, so that long thin graphs stay cheap."""
    if len(index) * 8 > len(to):
        to += np.bincount(index, values, len(to))
    else:
        np.add.at(to, index, values)


def _shortest(s: int, start: np.ndarray, near: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Distances (-1: not reached) and numbers of shortest paths from s, and by distance the edges (nearer ends, further ends) that such paths take."""
    n = len(start) - 1
    dist, paths, layers = np.full(n, -1, np.int32), np.zeros(n), []
    dist[s], paths[s], f = 0, 1.0, np.array([s])
    while len(f):
        counts = start[f + 1] - start[f]
        if 4 * counts.sum() > len(near):  # most edges: looked through as they lie
            on = np.flatnonzero((dist == len(layers))[begins] & (dist < 0)[near])
            begin, ends = begins[on], near[on]
        else:
            begin, ends = np.repeat(f, counts), near[np.repeat(start[f] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
            on = dist[ends] < 0
            begin, ends = begin[on], ends[on]
        if not len(ends):
            break
        _added(paths, ends, paths[begin])
        layers.append((begin, ends))
        dist[ends] = len(layers)
        f = np.flatnonzero(dist == len(layers)) if 8 * len(ends) > n else np.unique(ends)
    return dist, paths, layers


def shortest_path_scores(edges: DataFrame, kind: str = "betweenness", chunks: int = 32) -> DataFrame:
    """Betweenness (Brandes, normalised) or closeness (within the reachable part). Sources are split into chunks that run apart; each holds the network's adjacency."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, start, near = _adjacency(group)
        n, chunk = len(ids), int(group["chunk"].iloc[0])
        near, begins = near.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        total = np.zeros(n)
        for s in range(chunk, n, chunks):
            dist, paths, layers = _shortest(s, start, near, begins)
            if kind == "closeness":
                reached = dist > 0
                total[s] = reached.sum() / dist[reached].sum() if reached.any() else 0.0
                continue
            part = np.zeros(n)
            for begin, ends in reversed(layers):
                _added(part, begin, (paths[begin] * ((1 + part) / np.maximum(paths, 1))[ends]) if 8 * len(ends) > n else paths[begin] / paths[ends] * (1 + part[ends]))
            part[s] = 0
            total += part
        if kind == "betweenness" and n > 2:
            total /= (n - 1) * (n - 2)
        return pd.DataFrame({"network": group["network"].iloc[0], "v": ids, "score": total})

    dealt = edges.select("network", "src", "dst", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return dealt.groupBy("network", "chunk").applyInPandas(run, "network string, v long, score double").groupBy("network", "v").agg(F.sum("score").alias("score"))


def features(edges: DataFrame, names: tuple[str, ...] = ("degree", "clustering_coefficient", "kcore", "chi_degree")) -> DataFrame:
    """One DOUBLE column per feature name of FEATURES; 'None' is a column of ones."""
    edges = settled(edges)
    out = vertices_of(edges)
    for name in names:
        if name == "None":
            out = out.withColumn("None", F.lit(1.0))
            continue
        one = {
            "degree": lambda: degree_normalised(edges),
            "clustering_coefficient": lambda: clustering(edges),
            "eigenvectors": lambda: eigenvector(edges, 50),
            "chi_degree": lambda: chi_of(degrees(edges), "degree", "x"),
            "chi_lcc": lambda: chi_of(clustering(edges), "clustering_coefficient", "x"),
            "pagerank_out": lambda: pagerank(edges, 50),
            "betweenness_centrality": lambda: shortest_path_scores(edges),
            "kcore": lambda: coreness(edges, True),
        }[name]()
        out = out.join(one.toDF("network", "v", name), ["network", "v"], "left")
    return out


def feature_matrix(edges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """network, v, x: the features as one array, in the order of names."""
    return features(edges, names).select("network", "v", F.array(*(F.col(n) for n in names)).alias("x"))
