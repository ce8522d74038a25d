"""An extension: curves over streams of events. Edges arrive, and per window each network's LCC is told; no counterpart in batch-only engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.kernels import Union


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, batch or stream; a stream drops what comes later than `late`."""
    kind = dict(events.dtypes)["ts"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def growing_components(edges: DataFrame) -> DataFrame:
    """network, edges, lcc after each micro-batch of a stream of edges (network, src, dst), from a union-find kept as state per network."""
    import pandas as pd

    def grow(key, batches, state):
        ids, up, n = state.get if state.exists else ([], [], 0)
        union, ids = Union(len(ids)), list(ids)
        union.up = list(up)
        place = {v: i for i, v in enumerate(ids)}
        for b in batches:
            for a, c in zip(b["src"].tolist(), b["dst"].tolist(), strict=True):
                for v in (a, c):
                    if v not in place:
                        place[v] = len(ids)
                        ids.append(v)
                        union.up.append(len(union.up))
                        union.size.append(1)
                x, y = union.find(place[a]), union.find(place[c])
                union.up[max(x, y)] = min(x, y)
                n += 1
        roots: dict[int, int] = {}
        for i in range(len(ids)):
            r = union.find(i)
            roots[r] = roots.get(r, 0) + 1
        state.update((ids, union.up, n))
        yield pd.DataFrame({"network": [key[0]], "edges": [n], "lcc": [max(roots.values(), default=0)]})

    return edges.groupBy("network").applyInPandasWithState(grow, "network string, edges long, lcc long", "ids array<long>, up array<long>, n long", "update", GroupStateTimeout.NoTimeout)
