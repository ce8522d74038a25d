"""Names of graph files as whole numbers: whole numbers as they stand, without a shuffle; other names in their order."""

from pyspark.sql import functions as F

from fragspark.sources import graphs as IO

PAIR = "network string, a string, b string, weight double"


def test_whole_numbers_are_not_shuffled(spark, tmp_path):
    (tmp_path / "g.adj").write_text("3 7 9\n7 9\n40\n")
    got = IO.adjacency_list(spark, f"{tmp_path}/g.adj")
    assert sorted((r.network, r.a, r.b) for r in got.collect()) == [("g", 3, 7), ("g", 3, 9), ("g", 7, 9), ("g", 40, 40)]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_kinds_of_names_side_by_side(spark):
    pairs = [("plain", "5", "-2", 1.0), ("plain", "5", None, None), ("dotted", "n7", "n1", None), ("mixed", "n7", "3", 2.0), ("mixed", "b", "n7", None), ("mixed", None, "b", None)]
    vertices = [("plain", "8"), ("dotted", "n3"), ("mixed", "a"), ("mixed", None), ("alone", "x"), ("alone", "w")]
    out, alone = IO.numbered(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(vertices, "network string, v string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("plain", 5, -2, 1.0), ("plain", 5, None, None), ("dotted", 7, 1, None), ("mixed", 3, 0, 2.0), ("mixed", 2, 3, None), ("mixed", None, 2, None)], key=str)
    assert sorted(map(tuple, alone.collect())) == [("alone", 0), ("alone", 1), ("dotted", 3), ("mixed", 1), ("plain", 8)]


def test_networks_of_paths(spark):
    want = {"file:/x/net.csv/part-0.txt": "net", "hdfs://h:1/a.b.el/part-0.c000.txt.gz": "a.b", "/a/b/net.v1.csv.gz": "net.v1", "/a/.csv/net.el": "net", "/a.zip/net": "net", "/a/csv/x.csv": "x"}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", IO.network_of_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in rows.collect()} == want
