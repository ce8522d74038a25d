"""Run rows: Parquet partitioned by network, and the CSV form with literal removals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import read_removals, write_removals
from ..schema import RUN
from .places import with_places


def read_runs(spark: SparkSession, files: list[str], include_removals: bool = True, exclude: tuple[str, ...] = (), expected: tuple[str, ...] = (), raise_on_missing: bool = True, at_least_one: bool = False, callback: Callable[[DataFrame], DataFrame] | None = None, bookkeeping: bool = False) -> DataFrame:
    """The rows of run files (.csv or Parquet), only the columns asked for; with bookkeeping also file, idx (the row's number in its file, from 0) and place (over the files of a folder, by path).

    A file's missing columns are null. Missing files raise, or are passed over; without any file an empty table, or an error.
    """
    parts = []
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            if raise_on_missing:
                raise FileNotFoundError(f)
            continue
        if f.endswith(".csv"):
            text = T.StructType([T.StructField(x.name, T.StringType() if x.name == "removals" else x.dataType) for x in RUN])
            df = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').schema(T.StructType([next((x for x in text if x.name == c), T.StructField(c, T.StringType())) for c in columns_of(spark, f)])).csv(f)
        else:
            df = spark.read.schema(_names_as_text(spark.read.parquet(f).schema)).parquet(f)
        if bookkeeping:
            df = with_places(df)
        if f.endswith(".csv") and "removals" in df.columns:
            df = df.withColumn("removals", read_removals(F.col("removals")))
        for name in expected:
            if name not in df.columns:
                raise ValueError(f"{f} has no column {name}")
        df = df.select(*(F.col(x.name).cast(x.dataType).alias(x.name) if x.name in df.columns else F.lit(None).cast(x.dataType).alias(x.name) for x in RUN), *(c for c in df.columns if c not in RUN.names))
        parts.append(callback(df) if callback else df)
    if not parts and at_least_one:
        raise FileNotFoundError("no run file")
    out = parts[0] if parts else spark.createDataFrame([], RUN)
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.drop(*exclude, *([] if include_removals else ["removals"]))


def _names_as_text(schema: T.StructType) -> T.StructType:
    """The schema with the partition column of networks as text: a folder network=007 is the network "007", not 7."""
    return T.StructType([T.StructField(x.name, T.StringType()) if x.name == "network" else x for x in schema])


def columns_of(spark: SparkSession, file: str) -> list[str]:
    """The heading of a CSV file."""
    return spark.read.option("header", True).csv(file).columns if file.endswith(".csv") else spark.read.parquet(file).columns


def one_run(runs: DataFrame, network: str, heuristic: str, threshold: float) -> DataFrame:
    return runs.where((F.col("network") == network) & (F.col("heuristic") == heuristic) & (F.col("threshold").cast("decimal(6,4)") == F.lit(threshold).cast("decimal(6,4)")))


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds run rows as Parquet, a folder per network, for later pruning."""
    runs.write.mode("append").partitionBy("network").parquet(path)


def export_csv(runs: DataFrame, path: str) -> None:
    """Run rows as CSV files with headings and literal removals."""
    out = runs.withColumn("removals", write_removals(F.col("removals"))) if "removals" in runs.columns else runs
    out.write.mode("append").option("header", True).option("escape", '"').csv(path)


def export_table(table: DataFrame, path: str) -> None:
    """A small report table as one CSV file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
