"""Schemas of the engine's tables."""

from pyspark.sql import types as T

REMOVAL = T.StructType([T.StructField("removal_num", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("prediction", T.DoubleType()), T.StructField("lcc", T.DoubleType()), T.StructField("slcc", T.DoubleType())])
RUN = T.StructType(
    [
        T.StructField("network", T.StringType()), T.StructField("heuristic", T.StringType()), T.StructField("slcc_peak_at", T.IntegerType()),
        T.StructField("lcc_size_at_peak", T.DoubleType()), T.StructField("slcc_size_at_peak", T.DoubleType()), T.StructField("removals", T.ArrayType(REMOVAL)),
        T.StructField("static", T.BooleanType()), T.StructField("r_auc", T.DoubleType()), T.StructField("rem_num", T.IntegerType()),
        T.StructField("prediction_time", T.DoubleType()), T.StructField("dismantle_time", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    ]
)
EDGE_SQL = "network string, src long, dst long"
CURVE_SQL = "network string, heuristic string, removal_num int, id long, prediction double, lcc double, slcc double"
