"""Connected components of a table of edges, by the engine's contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """v, root for every vertex of an edge: root is the least vertex of its component. Loops and nulls give no edge."""
    clean = edges.select(F.lit("").alias("network"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("src") < F.col("dst")))
    found = star_components(clean).select("v", F.col("component").alias("root"))
    return found.union(found.select("root", "root").distinct())
