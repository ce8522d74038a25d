"""Forests of any depth in rounds that grow with the logarithm of their size: Euler tours, subtree sizes, centroids.

A tour walks each tree over both directions of its edges: after (u, v) comes (v, w), w being v's neighbour after u. The
place of each step is found by list ranking: every round each step's pointer jumps over as many steps as it has seen, so
rounds are log2 of the longest tour, with one join each. The steps between (u, v) and (v, u) walk the subtree of v.
Centroids need no particular root, so leaves come off first, round by round: of shallow trees nothing is left to tour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, written
from .components import components
from .graph import both_ways, vertices_of
from .ranges import numbered, with_next


#: Rounds of leaves go on while each takes at least this share of the edges that are left.
LEAVES = 0.125


def tours(edges: DataFrame, labels: DataFrame, most_rounds: int = 64, weights: DataFrame | None = None) -> DataFrame:
    """network, component, src, dst, place, weight: the steps of each tree's tour, counted down to 0 at its last one, and the weights of the vertices (network, v, weight; else 0) that one of the steps from it on enters. The tour of a tree begins at its least vertex."""
    steps = numbered(both_ways(edges), ["network", "src", "dst"], "step")
    chained = written(with_next(steps, ["step"], ["network", "src", "step"]), "chained")
    first = chained.groupBy("network", "src").agg(F.min("step").alias("first"))
    # After (v, u) in the order of v's neighbours: the next one, or v's first again.
    same = (F.col("next.network") == F.col("network")) & (F.col("next.src") == F.col("src"))
    turns = chained.join(first, ["network", "src"]).select("network", F.col("src").alias("dst"), F.col("dst").alias("src"), F.when(same, F.col("next.step")).otherwise(F.col("first")).alias("follows"), (F.col("step") == F.col("first")).alias("counts"))
    if weights is None:
        turns = turns.withColumn("weight", F.lit(0).cast("long"))
    else:  # of the steps that enter a vertex one carries its weight
        turns = turns.join(weights.select("network", F.col("v").alias("dst"), "weight"), ["network", "dst"]).withColumn("weight", F.when(F.col("counts"), F.col("weight")).otherwise(0).cast("long"))
    begins = first.join(labels.where("v = component").select("network", F.col("v").alias("src"), F.lit(True).alias("root")), ["network", "src"]).select(F.col("first").alias("follows"), "root")
    now = chained.select("network", "src", "dst", "step").join(turns, ["network", "src", "dst"]).join(begins, "follows", "left")
    now = written(now.select("step", F.when(F.col("root"), F.lit(None)).otherwise(F.col("follows")).cast("long").alias("to"), F.when(F.col("root"), 0).otherwise(1).cast("long").alias("place"), "weight"), "ranks")
    for _ in range(most_rounds):
        if now.where("to is not null").isEmpty():
            break
        ahead = now.select(F.col("step").alias("to"), F.col("to").alias("then"), F.col("place").alias("more"), F.col("weight").alias("heavier"))
        now = written(now.join(ahead, "to", "left").select("step", F.col("then").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), (F.col("weight") + F.coalesce("heavier", F.lit(0))).alias("weight")), "ranks", now)
    else:
        raise RuntimeError(f"tours are not ranked after {most_rounds} rounds")
    where = labels.select("network", F.col("v").alias("src"), "component")
    return chained.select("network", "src", "dst", "step").join(now.select("step", "place", "weight"), "step").join(where, ["network", "src"]).select("network", "component", "src", "dst", "place", "weight")


def checked(edges: DataFrame, labels: DataFrame) -> None:
    """Raises on cycles."""
    vertices = labels.groupBy("network", "component").agg(F.count(F.lit(1)).alias("n"))
    m = edges.where("src != dst").join(labels.select("network", F.col("v").alias("src"), "component"), ["network", "src"]).groupBy("network", "component").agg(F.count(F.lit(1)).alias("m"))
    if not m.join(vertices, ["network", "component"]).where("m > n - 1").isEmpty():
        raise ValueError("the graph has a cycle: trees only")


def subtree_sizes(edges: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """network, component, v, parent, size of every vertex but the trees' least ones, each tree hanging from its least vertex; with weights (network, v, weight) size is their sum. Raises on cycles."""
    checked(edges, labels)
    found = written(tours(edges, labels, weights=weights), "tours")
    back = found.select("network", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("place").alias("back"), F.col("weight").alias("behind"))
    down = found.join(back, ["network", "src", "dst"]).where("place > back")
    size = ((F.col("place") - F.col("back") + 1) / 2).cast("long") if weights is None else F.col("weight") - F.col("behind")
    sizes = written(down.select("network", "component", F.col("dst").alias("v"), F.col("src").alias("parent"), size.alias("size")), "sizes")
    discard(found)
    return sizes


def hung_sizes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """network, v, parent, size: the subtree sizes of all vertices but one of each tree, which hangs from that one. Raises on cycles.

    A round takes off the leaves and hands their sizes on: one aggregation over the ends and two joins, over what is left.
    Where rounds take few, as along a path, what is left is toured with the sizes it holds as weights.
    """
    left = written(edges.where("src != dst").select("network", "src", "dst"), "left")
    n, held, out = left.count(), None, None
    while n:
        ends = both_ways(left).groupBy("network", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("parent")).where("degree = 1")
        # Two leaves at one edge: the larger hangs from the other.
        pairs = ends.groupBy("network", F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst")).agg(F.max("v").alias("v"))
        pairs = pairs.select("network", "v", (F.col("src") + F.col("dst") - F.col("v")).alias("parent"))
        sized = pairs.withColumn("size", F.lit(1).cast("long")) if held is None else pairs.join(held, ["network", "v"], "left").select("network", "v", "parent", (1 + F.coalesce("below", F.lit(0))).alias("size"))
        gone = written(sized, "leaves")
        taken = gone.count()
        if taken < max(1, n * LEAVES):
            discard(gone)
            break
        out = gone if out is None else out.unionByName(gone)
        more = gone.groupBy("network", F.col("parent").alias("v")).agg(F.sum("size").alias("below"))
        if held is not None:
            kept = held.join(gone.select("network", "v"), ["network", "v"], "left_anti")
            more = kept.unionByName(more).groupBy("network", "v").agg(F.sum("below").alias("below"))
        held = written(more, "below", *([] if held is None else [held]))
        cut = gone.select("network", F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst"))
        left, n = written(left.join(cut, ["network", "src", "dst"], "left_anti"), "left", left), n - taken
    if n:
        own = written(vertices_of(left).join(labels.select("network", "v", "component"), ["network", "v"]), "labels")
        roots = own.groupBy("network", "component").agg(F.min("v").alias("root"))
        rest = own.join(roots, ["network", "component"]).select("network", "v", F.col("root").alias("component"))
        weights = own.select("network", "v").withColumn("below", F.lit(0).cast("long")) if held is None else own.select("network", "v").join(held, ["network", "v"], "left")
        toured = subtree_sizes(left, written(rest, "labels"), written(weights.select("network", "v", (1 + F.coalesce("below", F.lit(0))).cast("long").alias("weight")), "weights")).select("network", "v", "parent", "size")
        out = toured if out is None else out.unionByName(toured)
    discard(left)
    return out if out is not None else edges.limit(0).select("network", F.col("src").alias("v"), F.col("dst").alias("parent"), F.lit(0).cast("long").alias("size"))


def centroids(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """network, component, v, worst, size: of each tree with an edge the vertex whose removal leaves the smallest largest part (worst), the lowest of equal ones; size is the tree's."""
    own = labels.join(edges.select("network", F.explode(F.array("src", "dst")).alias("v")).distinct(), ["network", "v"], "left_semi")
    sizes = hung_sizes(edges, own)
    n = own.groupBy("network", "component").agg(F.count(F.lit(1)).alias("n"))
    below = sizes.groupBy("network", F.col("parent").alias("v")).agg(F.max("size").alias("child"))
    parts = own.join(sizes.select("network", "v", "size"), ["network", "v"], "left").join(below, ["network", "v"], "left").join(n, ["network", "component"])
    worst = F.greatest(F.col("n") - F.coalesce("size", "n"), F.coalesce("child", F.lit(0)))
    best = parts.groupBy("network", "component").agg(F.min(F.struct(worst.alias("worst"), F.col("v").alias("v"))).alias("best"), F.max("n").alias("size"))
    return best.select("network", "component", "best.v", "best.worst", "size")


def broken_trees(edges: DataFrame, most: DataFrame, most_levels: int = 64) -> DataFrame:
    """network, v, size: removals that leave trees of at most `most` vertices each (most: network, most); size is the tree's that each one splits.

    Every tree that is too large loses its centroid, all trees of a level at once, so levels are as many as a tree's size
    can be halved. Trees are split apart from each other: taken by falling size (ties by the tree's least vertex) this is
    the order of one who always splits the largest tree. Raises on cycles.
    """
    left, out = written(edges.where("src != dst").select("network", "src", "dst"), "left"), None
    for _ in range(most_levels):
        labels = written(components(left), "labels")
        large = labels.groupBy("network", "component").agg(F.count(F.lit(1)).alias("n")).join(most, "network").where("n > most").select("network", "component")
        labels = written(labels.join(large, ["network", "component"], "left_semi"), "labels", labels)
        if labels.isEmpty():
            return out if out is not None else edges.limit(0).select("network", F.col("src").alias("v"), F.lit(0).cast("long").alias("size"))
        left = written(left.join(labels.select("network", F.col("v").alias("src")), ["network", "src"], "left_semi"), "left", left)
        gone = written(centroids(left, labels).select("network", "v", "size", "component"), "gone")
        part = gone.select("network", "v", "size")
        out = part if out is None else out.unionByName(part)
        for end in ("src", "dst"):
            left = left.join(gone.select("network", F.col("v").alias(end)), ["network", end], "left_anti")
        left = written(left.select("network", "src", "dst"), "left")
        discard(labels)
    raise RuntimeError(f"trees are too large after {most_levels} levels")
