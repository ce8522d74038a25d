"""Graphs as tables: edges(network, src, dst) with src < dst, distinct; vertices(network, v).

A vertex without edges may stand among the edges as a row (v, v): it counts as a vertex of degree 0 everywhere, so sizes
and thresholds see it, and never as an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_edges(pairs: DataFrame, a: str = "a", b: str = "b", network: str | Column = "network", tasks: int | None = None) -> DataFrame:
    """Undirected simple edges of any pairs: loops, parallel edges and pairs with nulls go. tasks: over how many tasks, where the session's number of shuffle partitions would give each too much to hold."""
    name = F.lit(network) if isinstance(network, str) and network not in pairs.columns else (F.col(network) if isinstance(network, str) else network)
    found = pairs.where(F.col(a) != F.col(b)).select(name.alias("network"), F.least(a, b).cast("long").alias("src"), F.greatest(a, b).cast("long").alias("dst"))
    return (found if tasks is None else found.repartition(tasks, "src", "dst")).distinct()


def with_isolated(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges, and a row (v, v) for each of the vertices (network, v) that has none."""
    ends = edges.select("network", F.explode(F.array("src", "dst")).alias("v"))
    alone = vertices.select("network", "v").where("v is not null").distinct().join(ends, ["network", "v"], "left_anti")
    return edges.select("network", "src", "dst").unionByName(alone.select("network", F.col("v").alias("src"), F.col("v").alias("dst")))


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can meet what was derived from it."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once from either end: the edge index of a graph network."""
    edges = edges.where("src != dst")
    return edges.select("network", "src", "dst").union(edges.select("network", F.col("dst"), F.col("src")))


def vertices_of(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """Distinct end points, and the vertices of `isolated` (network, v) too."""
    ends = edges.select("network", F.explode(F.array("src", "dst")).alias("v"))
    return (ends.unionByName(isolated.select("network", "v")) if isolated is not None else ends).distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """network, v, degree; vertices without edges have 0 where a vertex table is given."""
    ends = edges.select("network", F.explode(F.array_distinct(F.array("src", "dst"))).alias("v"), (F.col("src") != F.col("dst")).cast("long").alias("one"))
    found = ends.groupBy("network", "v").agg(F.sum("one").alias("degree"))
    return found if vertices is None else vertices.join(found, ["network", "v"], "left").fillna(0, ["degree"])


def degree_normalised(edges: DataFrame) -> DataFrame:
    """Degrees by the largest one of the network; 0 in a network without edges."""
    d = degrees(edges)
    return d.join(d.groupBy("network").agg(F.max("degree").alias("top")), "network").select("network", "v", (F.col("degree") / F.greatest("top", F.lit(1))).alias("score"))


def chi(observed: Column, expected: Column) -> Column:
    """(o - e)^2 / e, 0 where e is 0."""
    return F.when(expected == 0, F.lit(0.0)).otherwise(F.pow(observed - expected, F.lit(2.0)) / expected)


def chi_of(scores: DataFrame, column: str, out: str) -> DataFrame:
    """Deviation of each vertex's value from its network's mean."""
    means = scores.groupBy("network").agg(F.avg(column).alias("expected"))
    return scores.join(means, "network").select("network", "v", chi(F.col(column).cast("double"), F.col("expected")).alias(out))


def triangles(edges: DataFrame) -> DataFrame:
    """network, v, triangles. Edges point from the end of lower degree to the other, so a hub's wedges are few."""
    d = degrees(edges)
    edges = edges.where("src != dst")
    lo = d.select("network", F.col("v").alias("src"), F.col("degree").alias("d1"))
    hi = d.select("network", F.col("v").alias("dst"), F.col("degree").alias("d2"))
    turned = edges.join(lo, ["network", "src"]).join(hi, ["network", "dst"])
    up = F.struct("d1", "src") < F.struct("d2", "dst")
    directed = turned.select("network", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedges = directed.alias("p").join(directed.alias("q"), (F.col("p.network") == F.col("q.network")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y")))
    closed = wedges.select(F.col("p.network").alias("network"), F.col("p.x").alias("x"), F.col("p.y").alias("src"), F.col("q.y").alias("dst")).join(edges, ["network", "src", "dst"])
    found = closed.select("network", F.explode(F.array("x", "src", "dst")).alias("v")).groupBy("network", "v").agg(F.count(F.lit(1)).alias("triangles"))
    return d.join(found, ["network", "v"], "left").select("network", "v", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient; 0 below degree 2."""
    t = triangles(edges)
    pairs = F.col("degree") * (F.col("degree") - 1)
    return t.select("network", "v", F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(F.lit(0.0)).alias("clustering_coefficient"))


def dense_ids(vertices: DataFrame) -> DataFrame:
    """network, v, static_id: contiguous from 0 in the order of v."""
    return vertices.withColumn("static_id", (F.row_number().over(Window.partitionBy("network").orderBy("v")) - 1).cast("long"))


def zero_based(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Ids that start above 0 go down by one, per network."""
    least = pairs.groupBy("network").agg(F.min(F.least(a, b)).alias("least"))
    shift = F.when(F.col("least") > 0, 1).otherwise(0)
    return pairs.join(least, "network").withColumns({a: F.col(a) - shift, b: F.col(b) - shift}).drop("least")


def random_share(seed: int, *columns) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns: the same on every run and in SQL."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def erdos_renyi(spark, network: str, n: int, p: float, seed: int = 0) -> DataFrame:
    """A deterministic random graph: a pair is an edge where its hash is below p. Pairs come from rows of first ends, in ranges: n * (n - 1) / 2 hashes, no join."""
    ids = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("dst")) if n > 1 else spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return ids.where(random_share(seed, "src", "dst") < p).select(F.lit(network).alias("network"), "src", "dst")


def small_world(spark, network: str, n: int, k: int = 4, p: float = 0.1, seed: int = 0) -> DataFrame:
    """A ring in which each vertex meets its k / 2 next ones; with probability p an edge's far end goes to any vertex."""
    ring = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("step"))
    far = F.when(random_share(seed, "id", "step") < p, F.floor(random_share(seed + 1, "id", "step") * n)).otherwise((F.col("id") + F.col("step")) % n)
    return clean_edges(ring.select(F.col("id").alias("a"), far.cast("long").alias("b")), network=F.lit(network))


def _attached(network: str, n: int, m: int, triangle: float, seed: int):
    """Edges of preferential attachment, each new vertex with m ends among the old ones, picked by degree; with probability `triangle` a neighbour of the last pick is taken next."""
    import random

    import pandas as pd

    rnd, near, ends, edges = random.Random(seed), {v: set() for v in range(n)}, list(range(m)), []
    for v in range(m, n):
        picks: set[int] = set()
        last = None
        while len(picks) < m:
            close = sorted(near[last] - picks - {v}) if last is not None and rnd.random() < triangle else []
            last = rnd.choice(close) if close else rnd.choice(ends)
            picks.add(last)
        for u in sorted(picks):
            edges.append((network, u, v))
            near[u].add(v)
            near[v].add(u)
            ends += [u, v]
    return pd.DataFrame(edges, columns=["network", "src", "dst"])


def preferential(spark, networks: list[str], n: int, m: int = 4, triangle: float = 0.0, seed: int = 0) -> DataFrame:
    """Barabasi-Albert graphs, with triangle > 0 those of the power-law cluster model: one task per network, as each vertex needs all before it."""

    def run(pdf):
        return _attached(pdf["network"].iloc[0], n, m, triangle, seed + int(pdf["i"].iloc[0]))

    return spark.createDataFrame([(x, i) for i, x in enumerate(networks)], "network string, i int").groupBy("network").applyInPandas(run, "network string, src long, dst long")


def random_scores(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """A score in [0, 1) by a hash of seed and vertex: the same on every run."""
    return vertices.select("network", "v", random_share(seed, "v").alias("score"))
