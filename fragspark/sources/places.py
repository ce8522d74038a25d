"""Row numbers within files: of a file's rows in its own order, and of a folder's over its files by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

SPLIT = ["file", "_block", "_task"]


def _needed(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{what} changed while it was numbered: "), F.col("file"))).cast("long"))


def with_places(rows: DataFrame, name: str = "idx") -> DataFrame:
    """A frame as spark.read made it, with file, idx (the row's number in its file, from 0) and place (that over all files, by path).

    Two readings: the first counts the rows of every split, a small table; sums of these are what the second adds to a row's
    number within its split. No rows are moved. Both readings must cut files alike: where the number of cores comes and
    goes, pin spark.sql.files.minPartitionNum; a split that the first reading did not see fails. Columns file, place and `name` of the files themselves are replaced;
    an empty file has no rows and takes no place.
    """
    own = [c for c in rows.columns if c not in ("file", "place", name)]
    seen = rows.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_id"))
    splits = written(seen.groupBy(*SPLIT).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "splits")
    files = splits.groupBy("file").agg(F.sum("_n").alias("_rows"))
    upto = files.withColumn("_files", F.coalesce(F.sum("_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")  # one row per file
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = written(splits.withColumn("_base", before).join(upto, "file"), "bases")
    out = seen.join(base, SPLIT, "left").withColumn(name, _needed(F.col("_base") + F.col("_id") - F.col("_first"), "a split"))
    return out.select(*own, "file", name, (F.col("_files") + F.col(name)).alias("place"))


def row_at(rows: DataFrame, number: int, name: str = "idx") -> DataFrame:
    """The row of that number of the one file that was read; nothing beyond its end."""
    return with_places(rows, name).where(F.col(name) == number)


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """value, file, idx, place of the lines of text files, blank ones included."""
    return with_places(spark.read.text(paths))
