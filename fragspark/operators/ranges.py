"""Places, next rows and running sums over sorted ranges: no key's rows, and not all rows, pass through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows, written in ranges of the order, with the number of each one's range."""
    return written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their places, from 0, in the order over all of them."""
    cut = ranged(rows, *order)
    sizes = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "base")  # one row per range
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return cut.withColumn("own", place).join(F.broadcast(before), "range").withColumn(name, F.col("own") + F.col("base")).drop("own", "base", "range")


def with_next(rows: DataFrame, order: list[str], columns: list[str], name: str = "next") -> DataFrame:
    """rows with the columns of the one after each in the order, as a struct; null for the last. Ranges hand their first row to the range before."""
    cut = ranged(rows, *order)
    key = F.struct(*order)
    one = F.struct(*columns)
    firsts = cut.groupBy("range").agg(F.min(F.struct(key.alias("key"), one.alias("row"))).alias("first"))
    border = firsts.select("range", F.lead("first.row").over(Window.orderBy("range")).alias("border"))  # one row per range
    own = F.lead(one).over(Window.partitionBy("range").orderBy(*order))
    return cut.withColumn(name, own).join(F.broadcast(border), "range").withColumn(name, F.coalesce(name, "border")).drop("border", "range")
