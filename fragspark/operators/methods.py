"""The registry of attack methods and the methods themselves.

A method takes edges(network, src, dst) and gives scores(network, heuristic, v, score): the higher the earlier. Methods
that choose step by step run per network in one task (applyInPandas), networks, seeds and parameters in parallel.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .centrality import eigenvector, pagerank, shortest_path_scores
from .components import settled
from .graph import degrees, fresh, random_scores, vertices_of
from .replay import adaptive_curve, ranked, run_rows, scored_adaptively, sequential_curve, static_curve

#: Scores by rounds end when all of a network together move by less.
TOLERANCE = 1e-6
SCORES = "network string, heuristic string, v long, score double"


@dataclass(frozen=True)
class Method:
    key: str
    name: str
    short_name: str
    run: Callable[..., DataFrame]
    depends_on: str | None = None
    includes_reinsertion: bool = False
    plot_color: str | None = None
    description: str = ""
    dynamic: bool = False
    options: dict = field(default_factory=dict)


REGISTRY: dict[str, Method] = {}


def method(name: str, short_name: str, depends_on: str | None = None, includes_reinsertion: bool = False, plot_color: str | None = None, description: str = "", key: str | None = None, dynamic: bool = False, **options):
    """Registers fn(edges, threshold, **options) -> scores without a heuristic column under key, or the function's name less 'get_'."""
    if not isinstance(short_name, str):
        raise TypeError("short_name is a string")

    def add(fn):
        own = key or fn.__name__.removeprefix("get_")
        if own in REGISTRY:
            raise ValueError(f"{own} is registered already")
        REGISTRY[own] = Method(own, name, short_name, fn, depends_on, includes_reinsertion, plot_color, description, dynamic, options)
        return fn

    return add


def methods_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.key, m.short_name, m.depends_on, m.includes_reinsertion, m.plot_color) for m in REGISTRY.values()], "heuristic string, short_name string, depends_on string, includes_reinsertion boolean, plot_color string")


def scheduled(keys: list[str]) -> list[str]:
    """The methods and what they depend on, each after its dependency; raises on cycles."""
    out: list[str] = []

    def visit(k: str, path: tuple):
        if k in path:
            raise ValueError("methods depend on each other: " + " > ".join([*path, k]))
        if k not in REGISTRY:
            raise KeyError(k)
        if REGISTRY[k].depends_on:
            visit(REGISTRY[k].depends_on, (*path, k))
        if k not in out:
            out.append(k)

    for k in keys:
        visit(k, ())
    return out


def by_kernel(edges: DataFrame, order: Callable[..., list[int]], threshold: float, columns: list[str] | None = None) -> DataFrame:
    """One task per network (and further columns): order(graph, stop, row) lists vertices, first to go first; score is the length less the place."""
    keys = ["network", *(columns or [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(pdf["src"], pdf["dst"])
        out = order(g, int(np.ceil(g.n * threshold)), pdf.iloc[0])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "v": g.ids[out].astype(np.int64), "score": [float(len(out) - i) for i in range(len(out))]}, columns=[*keys, "v", "score"])

    types = dict(edges.dtypes)
    return edges.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", v long, score double")


def by_order(edges: DataFrame, earlier: DataFrame, order: Callable[..., list[int]], threshold: float) -> DataFrame:
    """Like by_kernel, with the network's removals of another method: order(graph, stop, removed)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(left["src"], left["dst"])
        right = right.sort_values(["score", "v"], ascending=[False, True])
        out = order(g, int(np.ceil(g.n * threshold)), np.searchsorted(g.ids, right["v"]).tolist())
        return pd.DataFrame({"network": key[0], "v": g.ids[out].astype(np.int64), "score": [float(len(out) - i) for i in range(len(out))]}, columns=["network", "v", "score"])

    return fresh(edges).groupBy("network").cogroup(fresh(earlier).groupBy("network")).applyInPandas(run, "network string, v long, score double")


def by_vertex(edges: DataFrame, value: Callable[[K.Graph, list[int]], list], chunks: int = 32, columns: tuple[str, ...] = ("score",)) -> DataFrame:
    """Numbers that each vertex has on its own, its score or those of `columns`: vertices are split into chunks that run apart, each holding the network."""
    types = "network string, v long, " + ", ".join(f"{c} double" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = K.Graph(pdf["src"], pdf["dst"])
        own = list(range(int(pdf["chunk"].iloc[0]), g.n, chunks))
        found = np.array(value(g, own) if own else [], float).reshape(len(own), len(columns))
        return pd.DataFrame({"network": pdf["network"].iloc[0], "v": g.ids[own].astype(np.int64), **dict(zip(columns, found.T, strict=True))})

    dealt = edges.select("network", "src", "dst", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return dealt.repartition(chunks, "network", "chunk").groupBy("network", "chunk").applyInPandas(run, types)  # a fixed number: small inputs are long work here


def entanglement_scores(edges: DataFrame, beta: float) -> DataFrame:
    """Network entanglement at the diffusion time of beta: tasks find traces over sparse Laplacians for their vertices, and what these sum up to in a network gives each vertex its score."""

    def traces(g: K.Graph, own: list[int]) -> np.ndarray:
        tau, found = K.heat_traces(g, beta, own)
        return np.c_[np.full(len(own), tau), np.array(g.degree(), float)[own], found]

    parts = settled(by_vertex(edges, traces, columns=("tau", "degree", "z", "e", "dz", "de")))
    sums = parts.groupBy("network").agg(F.sum("z").alias("all_z"), F.sum("e").alias("all_e"))

    def run(batches):
        for b in batches:
            score = K.entanglement_of(*(b[c].to_numpy() for c in ("tau", "degree", "all_z", "all_e", "dz", "de")))
            yield b[["network", "v"]].assign(score=score)

    return parts.join(fresh(sums), "network").mapInPandas(run, "network string, v long, score double")


@method("Degree", "DEG")
def get_degree(edges, threshold=0.1):
    return degrees(edges).select("network", "v", F.col("degree").cast("double").alias("score"))


@method("Eigenvector centrality", "EIG")
def get_eigenvector_centrality(edges, threshold=0.1):
    return eigenvector(edges, 1000, TOLERANCE)


@method("PageRank", "PR")
def get_pagerank(edges, threshold=0.1):
    return pagerank(edges, 1000, tolerance=TOLERANCE)


@method("Betweenness", "BET")
def get_betweenness_centrality(edges, threshold=0.1):
    return shortest_path_scores(edges, "betweenness")


for _kind, _short in (("degree", "HDA"), ("betweenness", "HBA"), ("closeness", "HCA"), ("pagerank", "HPRA")):
    method(f"Adaptive {_kind}", _short, key=f"adaptive_{_kind}", dynamic=True)(
        lambda edges, threshold=0.1, kind=_kind: adaptive_curve(edges, kind, threshold).select("network", F.col("id").alias("v"), (-F.col("removal_num")).cast("double").alias("score"))
    )


@method("Random", "RND")
def get_random(edges, threshold=0.1, seed=0):
    return random_scores(vertices_of(edges), seed)


for _hops in (1, 2, 3):
    method(f"Collective Influence l={_hops}", f"CI l-{_hops}", includes_reinsertion=True, key=f"CollectiveInfluenceL{_hops}")(
        lambda edges, threshold=0.1, hops=_hops: by_kernel(edges, lambda g, stop, row: K.collective_influence(g, stop, hops), threshold)
    )


@method("CoreHD", "CoreHD", includes_reinsertion=True)
def get_CoreHD(edges, threshold=0.1):
    return by_kernel(edges, lambda g, stop, row: K.core_hd(g, stop), threshold)


@method("Generalized Network Dismantling", "GND")
def get_GND(edges, threshold=0.1, cost="unit"):
    return by_kernel(edges, lambda g, stop, row: K.generalized_dismantling(g, stop, 1, cost), threshold)


@method("Generalized Network Dismantling with reinsertion", "GNDR", depends_on="GND", includes_reinsertion=True)
def get_GNDR(edges, threshold=0.1, earlier=None):
    return by_order(edges, earlier, lambda g, stop, removed: K.reinserted(g, removed, stop), threshold)


@method("Ensemble Generalized Network Dismantling", "EGND")
def get_EGND(edges, threshold=0.1, runs=1000):
    """The smallest removal set over seeds, each a task of its own (the published aim; ties to the least seed). Each seed's set is found once."""
    seeded = edges.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    found = by_kernel(seeded, lambda g, stop, row: K.generalized_dismantling(g, stop, int(row["seed"])), threshold, ["seed"])
    sets = found.groupBy("network", "seed").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("v", "score")).alias("removed"))
    best = sets.groupBy("network").agg(F.min_by("removed", F.struct("size", "seed")).alias("removed"))
    return best.select("network", F.inline("removed"))


for _sigma in (1, 2):
    method(f"Explosive Immunization sigma={_sigma}", f"EI s{_sigma}", key=f"EI_s{_sigma}")(
        lambda edges, threshold=0.1, sigma=_sigma: by_kernel(edges, lambda g, stop, row: K.explosive_immunization(g, stop, sigma), threshold)
    )


@method("Min-Sum", "MS")
def get_MS(edges, threshold=0.1):
    return by_kernel(edges, lambda g, stop, row: K.min_sum(g, stop), threshold)


@method("Min-Sum with reinsertion", "MS +R", includes_reinsertion=True)
def get_MSR(edges, threshold=0.1):
    return by_kernel(edges, lambda g, stop, row: K.min_sum(g, stop, True), threshold)


for _size, _beta in (("small", 0.9), ("mid", 0.33), ("large", 0.01)):
    method(f"Network entanglement, {_size} scale", f"NE {_size}", key=f"network_entanglement_{_size}")(lambda edges, threshold=0.1, beta=_beta: entanglement_scores(edges, beta))
    method(f"Network entanglement, {_size} scale, with reinsertion", f"NE {_size} +R", depends_on=f"network_entanglement_{_size}", includes_reinsertion=True, key=f"network_entanglement_{_size}_reinsertion")(
        lambda edges, threshold=0.1, earlier=None: by_order(edges, truncated(edges, earlier, threshold), lambda g, stop, removed: K.reinserted(g, removed, stop), threshold)
    )


@method("Vertex entanglement", "VE")
def get_vertex_entanglement(edges, threshold=0.1):
    return by_vertex(edges, K.vertex_entanglement, chunks=1)  # the spectrum is nearly all of the work: found once a network


@method("Vertex entanglement with reinsertion", "VE +R", depends_on="vertex_entanglement", includes_reinsertion=True)
def get_vertex_entanglement_reinsertion(edges, threshold=0.1, earlier=None):
    return by_order(edges, truncated(edges, earlier, threshold), lambda g, stop, removed: K.reinserted(g, removed, stop), threshold)


def truncated(edges: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """The vertices of an order up to where its curve ends, with their scores."""
    r = ranked(scores.withColumn("heuristic", F.lit("")), vertices_of(edges))
    last = static_curve(edges, r, threshold).groupBy("network").agg(F.max("removal_num").alias("last"))
    return r.join(last, "network").where(F.col("removal_num") <= F.col("last")).select("network", "v", (-F.col("removal_num")).cast("double").alias("score"))


class AttentionScorer:
    """A scorer for scored_adaptively from user-given attention weights, over the vertex's degree share and a constant."""

    def __init__(self, weights: dict):
        self.weights = weights

    def __call__(self, ids, near):
        src = np.array([v for v, n in enumerate(near) for _ in n], np.int64)
        return self.of_edges(len(near), src, np.array([y for n in near for y in sorted(n)], np.int64))

    def of_edges(self, n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """The same from both directions of all edges, by their ends."""
        d = np.bincount(src, minlength=n).astype(float)
        return K.gat_forward(np.stack([d / max(1, d.max()), np.ones(n)], 1), src, dst, self.weights)


def attention_scorer(weights: dict, names: tuple[str, ...] = ("degree",)):
    return AttentionScorer(weights)


def model_scores(edges: DataFrame, models: dict[str, dict], names: tuple[str, ...] = ("degree", "clustering_coefficient", "kcore", "chi_degree")) -> DataFrame:
    """network, heuristic (the model's name), v, score: graph attention networks with user-given weights over the vertex features `names`, found once for all models."""
    from .centrality import feature_matrix

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("v")
        ids = right["v"].to_numpy()
        left = left[left["src"] != left["dst"]]
        a, b = np.searchsorted(ids, left["src"]), np.searchsorted(ids, left["dst"])
        x = np.stack(right["x"].to_numpy())
        return pd.concat([pd.DataFrame({"network": key[0], "heuristic": name, "v": ids, "score": K.gat_forward(x, np.r_[a, b], np.r_[b, a], K.legacy_attention(weights))}) for name, weights in models.items()])

    return fresh(edges).groupBy("network").cogroup(fresh(feature_matrix(edges, names)).groupBy("network")).applyInPandas(run, "network string, heuristic string, v long, score double")


def gdm_scores(edges: DataFrame, weights: dict, names: tuple[str, ...] = ("degree", "clustering_coefficient", "kcore", "chi_degree")) -> DataFrame:
    """Scores of one model; trained weights are not part of this package."""
    return model_scores(edges, {"": weights}, names).drop("heuristic")


@method("GDM", "GDM")
def get_GDM(edges, threshold=0.1, weights=None):
    return gdm_scores(edges, needed(weights))


@method("GDM with reinsertion", "GDM +R", depends_on="GDM", includes_reinsertion=True)
def get_GDMR(edges, threshold=0.1, earlier=None):
    return by_order(edges, truncated(edges, earlier, threshold), lambda g, stop, removed: K.reinserted(g, removed, stop), threshold)


@method("CoreGDM", "CoreGDM", includes_reinsertion=True, dynamic=True)
def get_CoreGDM(edges, threshold=0.1, weights=None):
    found = scored_adaptively(edges, attention_scorer(needed(weights)), "CoreGDM", threshold, core=True)
    return by_order(edges, found, lambda g, stop, removed: K.reinserted(g, removed, stop + 1, "order"), threshold)


@method("FINDER", "FINDER ND", dynamic=True)
def get_FINDER_ND(edges, threshold=0.1, weights=None, scorer=None):
    """The best 1 % of the largest component by a user-given value function, again and again."""
    return scored_adaptively(edges, scorer or attention_scorer(needed(weights)), "FINDER_ND", threshold, 0.01).select("network", "v", "score")


WEIGHTS = "model string, stack string, layer int, part string, shape array<int>, numbers array<double>"


def weights_table(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """Weights of models by name as rows, one for each array of a layer: what a Parquet table keeps."""
    rows = []
    for name, weights in models.items():
        for stack in ("conv", "full"):
            for i, layer in enumerate(weights[stack]):
                for part, x in layer.items():
                    a = np.asarray(x, float)
                    rows.append((name, stack, i, part, list(a.shape), a.ravel().tolist()))
    return spark.createDataFrame(rows, WEIGHTS)


def weights_of(table: DataFrame, model: str) -> dict:
    """The weights of one model from weights_table(): as many rows as it has arrays."""
    out: dict = {"conv": [], "full": []}
    for r in sorted(table.where(F.col("model") == model).collect(), key=lambda r: (r.stack, r.layer)):
        own = out[r.stack]
        while len(own) <= r.layer:
            own.append({})
        a = np.array(r.numbers).reshape(r.shape)
        own[r.layer][r.part] = bool(a) if r.part == "concat" else a
    return out


def parameter_name(**parameters) -> str:
    """A model's name from its parameters in the order given: the key under which trained weights are kept and found."""
    return "_".join(f"{k}{'x'.join(map(str, v)) if isinstance(v, (list, tuple)) else v}" for k, v in parameters.items())


def missing_models(grid: list[str], table: DataFrame) -> DataFrame:
    """The names of the grid without weights in the table yet."""
    return table.sparkSession.createDataFrame([(x,) for x in grid], "model string").join(table.select("model").distinct(), "model", "left_anti")


def gdm_grid(edges: DataFrame, models: dict[str, dict], threshold: float = 0.1) -> DataFrame:
    """Run rows of GDM with each of the models, heuristic being the model's name; the best of each network is report.first_of's or best_runs'."""
    found = settled(model_scores(edges, models))
    return run_rows(static_curve(edges, ranked(found, vertices_of(edges)), threshold), threshold)


def needed(weights):
    if weights is None:
        raise ValueError("this method needs user-given weights")
    return weights


def scores_of(key: str, edges: DataFrame, threshold: float = 0.1, found: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """The scores of a registered method, with its heuristic column; found holds those of its dependency."""
    m = REGISTRY[key]
    if m.depends_on:
        earlier = (found or {}).get(m.depends_on)
        options["earlier"] = earlier if earlier is not None else scores_of(m.depends_on, edges, threshold)
    return m.run(edges, threshold=threshold, **options).select("network", F.lit(key).alias("heuristic"), "v", F.col("score").cast("double").alias("score"))


REPLAYS = ("static", "lcc", "core", "peak")


def stored_scores(key: str, done: DataFrame) -> DataFrame:
    """The order of a stored run as scores; raises where its removals were not kept."""
    kept = F.when(F.size("removals") > 0, F.col("removals")).otherwise(F.raise_error(F.concat(F.lit("no removals are stored of "), "network", F.lit(f", {key}"))))
    return done.select("network", F.inline(kept)).select("network", F.lit(key).alias("heuristic"), F.col("id").alias("v"), (-F.col("removal_num")).cast("double").alias("score"))


def run_methods(edges: DataFrame, keys: list[str], threshold: float = 0.1, replay: str = "static", done: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """Run rows of the methods over all networks of edges.

    (network, heuristic, threshold) in done are skipped. Dependencies run once and first; those that are done give the
    removals of their stored runs, or are found again where done has no column of removals.
    """
    if replay not in REPLAYS:
        raise ValueError(f"replay is one of {REPLAYS}")
    found, out, n, order = {}, None, vertices_of(edges), scheduled(keys)
    for key in order:
        own, earlier = edges, (options or {}).get(key, {})
        needed_later = any(REGISTRY[k].depends_on == key for k in order)
        ended = None
        if done is not None:
            ended = done.where((F.col("heuristic") == key) & (F.round("threshold", 4) == round(threshold, 4)))
            own = edges.join(ended.select("network"), "network", "left_anti")
        began = time.time()
        scores = settled(scores_of(key, own, threshold, found, **earlier))
        took = time.time() - began
        found[key] = scores
        if ended is not None and needed_later:
            here = ended.join(edges.select("network").distinct(), "network", "left_semi")
            stored = stored_scores(key, here) if "removals" in done.columns else scores_of(key, edges.join(ended.select("network"), "network", "left_semi"), threshold, found, **earlier)
            found[key] = settled(scores.unionByName(stored))
        if key not in keys:
            continue
        ranks = ranked(scores, n)
        curve = static_curve(own, ranks, threshold) if replay == "static" else sequential_curve(own, ranks, replay, threshold)
        rows = run_rows(curve, threshold, not REGISTRY[key].dynamic, took)
        out = rows if out is None else out.unionByName(rows)
    return out
