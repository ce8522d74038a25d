"""Removed vertices that come back by rounds, many at once, while no component grows to a size.

A removed vertex would join the components around it; it may while their sizes and its own stay below the target. Of
those that may, a round takes back many that don't meddle with each other. The largest component around a vertex is its
home. A component whose least claimant (by the size it would make, then by number) is at home there takes in claimants
of which it is the home, as many as have room; any other component goes to its least claimant alone. A vertex with a
removed neighbour that comes before it waits. So what a round joins are stars of components about one home each.

The tables hold only what lies around removed vertices: which components touch them, with their sizes, and the edges
between removed ones. The edges of the rest are read once, for the components to start with. Once these tables have few
rows left for each network, its task brings back the other vertices one after the other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, written
from . import kernels as K
from .components import component_sizes, components
from .graph import both_ways, vertices_of

#: Parts of a home's claimants of like growth that enter whole or not at all.
PARTS = 64
#: Rows around a network's removed vertices that one task takes.
TASK_ROWS = 5_000_000
#: A vertex waits when it would make a component larger by this than it was taken for.
WAITS = 1.25


def _stay(n: int, target: int, size: np.ndarray, touch: tuple[np.ndarray, np.ndarray], near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the removed vertices 0 to n - 1 stay out: the one that makes about the least component comes back first, ties to the lowest.

    touch: pairs of a removed vertex and a component, of sizes size; near: pairs of removed vertices, both ways. A vertex
    is looked at again only when its component has grown by a quarter since, so that each is seen a few times.
    """
    union = K.Union(len(size) + n)
    for i, x in enumerate(size.tolist()):
        union.size[n + i] = x
    of, to = np.r_[touch[0], near[0]], np.r_[touch[1] + n, near[1]]
    order = np.argsort(of, kind="stable")
    begin, ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))], to[order]
    total = 1 + np.bincount(touch[0], size[touch[1]], n).astype(np.int64)
    heap = [(t, v) for v, t in enumerate(total.tolist()) if t < target]
    heapq.heapify(heap)
    out = bytearray([1]) * n
    while heap:
        was, v = heapq.heappop(heap)
        around = {union.find(x) for x in ends[begin[v] : begin[v + 1]].tolist() if x >= n or not out[x]}
        now = 1 + sum(union.size[x] for x in around)
        if now >= target:  # components only grow
            continue
        if now > WAITS * was and heap and heap[0] < (now, v):
            heapq.heappush(heap, (now, v))
            continue
        out[v] = 0
        for x in around:
            union.join(v, x)
    return np.flatnonzero(np.frombuffer(out, np.uint8))


def _at_once(gone: DataFrame, touch: DataFrame, near: DataFrame) -> DataFrame:
    """network, v: which of gone (network, v, target) stay out, one task a network."""
    none = F.lit(None).cast("long")
    rows = gone.select("network", F.lit(0).alias("kind"), "v", none.alias("to"), F.col("target").cast("long").alias("number"))
    rows = rows.unionByName(touch.select("network", F.lit(1).alias("kind"), "v", F.col("component").alias("to"), F.col("size").cast("long").alias("number")))
    rows = rows.unionByName(near.select("network", F.lit(2).alias("kind"), "v", F.col("w").alias("to"), none.alias("number")))

    def run(table: pa.Table) -> pa.Table:
        kind, v = table["kind"].to_numpy(), table["v"].to_numpy()
        to, number = (table[c].fill_null(0).to_numpy() for c in ("to", "number"))
        ids = np.unique(v[kind == 0])
        part, link = kind == 1, kind == 2
        _, first, component = np.unique(to[part], return_index=True, return_inverse=True)
        stays = _stay(len(ids), int(number[kind == 0][0]) if len(ids) else 0, number[part][first], (np.searchsorted(ids, v[part]), component), (np.searchsorted(ids, v[link]), np.searchsorted(ids, to[link])))
        return pa.table({"network": pa.array([table["network"][0].as_py()] * len(stays), pa.string()), "v": pa.array(ids[stays], pa.int64())})

    return rows.groupBy("network").applyInArrow(run, "network string, v long")


def reinserted(edges: DataFrame, removed: DataFrame, target: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """network, v: which of removed (network, v) stay out. target: network, target; every component that a vertex made by coming back is smaller than target.

    None of those that stay could come back alone. Removed vertices that the edges don't hold, and networks without a
    target, are left out; a network none of whose removals is needed gets no rows.
    """
    key = ["network", "v"]
    gone = written(vertices_of(edges).join(removed.select(*key).distinct(), key, "left_semi").join(target, "network").select(*key, "target"), "gone")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.select("network", F.col("v").alias(end)), ["network", end], "left_anti")
    labels = written(components(left, vertices_of(edges).join(gone, key, "left_anti")), "labels")
    labels = labels.join(component_sizes(labels), ["network", "component"])
    ways = both_ways(edges).join(gone.select("network", F.col("v").alias("src")), ["network", "src"], "left_semi")
    ways = written(ways.select("network", F.col("src").alias("v"), F.col("dst").alias("w")), "ways")
    touch = written(ways.join(labels.withColumnRenamed("v", "w"), ["network", "w"]).select(*key, "component", "size").distinct(), "touch")
    near = written(ways.join(gone.select("network", F.col("v").alias("w")), ["network", "w"], "left_semi").select(*key, "w"), "near", ways)
    stays = None
    for _ in range(most_rounds):
        held = touch.select("network").unionAll(near.select("network")).groupBy("network").count().agg(F.max("count")).first()[0] or 0
        if held <= TASK_ROWS:
            rest = written(_at_once(gone, touch, near), "rest")
            return rest if stays is None else stays.unionByName(rest)
        home = F.max(F.struct("size", "component")).alias("home")
        around = touch.groupBy(*key).agg((F.sum("size") + 1).alias("total"), home)
        now = gone.join(around, key, "left").withColumn("total", F.coalesce("total", F.lit(1)))
        now = written(now.select(*key, "target", "total", F.col("home.component").alias("home"), F.coalesce("home.size", F.lit(0)).alias("room")), "now")
        may = now.where("total < target")
        # Components only grow: what can't come back now never can.
        never = written(now.where("total >= target").select(*key), "never")
        stays = never if stays is None else stays.unionByName(never)
        if may.isEmpty():
            return stays
        claims = touch.join(may, key).withColumn("rank", F.struct("total", "v"))
        least = claims.groupBy("network", "component").agg(F.min(F.struct("rank", (F.col("home") == F.col("component")).alias("homed"))).alias("least"))
        fine = F.when(F.col("home") == F.col("component"), F.col("least.homed")).otherwise(F.col("least.rank.v") == F.col("v"))
        barred = claims.join(least, ["network", "component"]).groupBy(*key).agg(F.min(fine).alias("fine")).where("not fine").select(*key)
        other = may.select("network", F.col("v").alias("w"), F.struct("total", F.col("v").alias("v")).alias("other"))
        waits = near.join(other, ["network", "w"]).join(may.select(*key, F.struct("total", "v").alias("rank")), key).where("other < rank").select(*key).distinct()
        free = may.join(barred, key, "left_anti").join(waits, key, "left_anti")
        free = written(free.withColumns({"grows": F.col("total") - F.col("room"), "class": F.ceil(F.log2(F.col("total") - F.col("room"))), "part": F.pmod(F.xxhash64("v"), F.lit(PARTS))}), "free")
        # Growths are summed by class and part, so a home's claimants don't meet; the least one has room in any case.
        sums = free.where("home is not null").groupBy("network", "home", "class", "part").agg(F.sum("grows").alias("grows"), F.min(F.struct("total", "v")).alias("first"))
        at_home = Window.partitionBy("network", "home")
        sums = sums.withColumn("used", F.sum("grows").over(at_home.orderBy("class", "part")))
        sums = sums.select("network", "home", "class", "part", "used", F.min("used").over(at_home).alias("least_used"), F.min("first").over(at_home).alias("first"))
        entry = free.join(sums, ["network", "home", "class", "part"], "left")
        fits = F.col("room") + F.col("used") < F.col("target")
        only = (F.col("room") + F.col("least_used") >= F.col("target")) & (F.col("first.v") == F.col("v"))
        back = written(entry.where(F.col("home").isNull() | fits | only).select(*key, F.coalesce("home", "v").alias("into"), "room", "grows"), "back")
        sizes = written(back.groupBy("network", F.col("into").alias("component")).agg((F.max("room") + F.sum("grows")).alias("grown")), "sizes")
        moved = written(touch.join(back.select(*key, "into"), key).select("network", "component", "into").distinct(), "moved")
        old = touch.join(back, key, "left_anti").join(moved, ["network", "component"], "left").select(*key, F.coalesce("into", "component").alias("component"), "size")
        new = near.join(back.select("network", F.col("v").alias("w"), "into"), ["network", "w"]).select(*key, F.col("into").alias("component"), F.lit(None).cast("long").alias("size"))
        rows = old.unionByName(new).join(may.select(*key), key, "left_semi").join(sizes, ["network", "component"], "left")
        touch = written(rows.select(*key, "component", F.coalesce("grown", "size").alias("size")).distinct(), "touch", touch)
        gone = written(may.select(*key, "target").join(back, key, "left_anti"), "gone", gone)
        near = written(near.join(gone, key, "left_semi").join(gone.select("network", F.col("v").alias("w")), ["network", "w"], "left_semi").select(*key, "w"), "near", near)
        discard(now, free, back, sizes, moved)
    raise RuntimeError(f"vertices still come back after {most_rounds} rounds")
