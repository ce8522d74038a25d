"""Vertices without edges in sizes, methods and files; the older attention form; weights as a table."""

import numpy as np

from fragspark.operators import graph as G
from fragspark.operators import kernels as K
from fragspark.operators import methods as M
from fragspark.operators import replay as R
from fragspark.sources.graphs import edge_list, load_networks


def test_methods_count_vertices_without_edges(spark):
    path = [("p", i, i + 1) for i in range(9)]
    bare = spark.createDataFrame(path, "network string, src long, dst long")
    alone = spark.createDataFrame([("p", 100 + i) for i in range(10)] + [("p", 3)], "network string, v long")
    wide = G.with_isolated(bare, alone)
    assert wide.count() == 19 and G.vertices_of(wide).count() == 20
    for key in ("degree", "CoreHD", "CollectiveInfluenceL1"):
        few, many = M.run_methods(bare, [key], 0.2).first(), M.run_methods(wide, [key], 0.2).first()
        # The stop is 2 of 10 vertices, and 4 of 20: fewer removals reach it.
        assert many.rem_num < few.rem_num and min(r.lcc for r in many.removals) <= 0.2
    curve = R.static_curve(wide, R.ranked(G.degrees(wide).select("network", G.F.lit("d").alias("heuristic"), "v", G.F.col("degree").cast("double").alias("score"))), 0.0)
    assert curve.count() == 20 and curve.agg({"lcc": "max"}).first()[0] < 0.5


def test_names_headings_and_lone_vertices(spark, tmp_path):
    (tmp_path / "named.el").write_text("a1 b1\nb1 a1\nc a1\nlone\n")
    (tmp_path / "headed.csv").write_text("source,target,weight\n1,2,0.5\n2,3,\n7\n")
    got = {r.network: set() for r in load_networks(spark, str(tmp_path), extensions=("el", "csv")).collect()}
    for r in load_networks(spark, str(tmp_path), extensions=("el", "csv")).collect():
        got[r.network].add((r.src, r.dst))
    assert got == {"named": {(0, 1), (0, 2), (3, 3)}, "headed": {(1, 2), (2, 3), (7, 7)}}
    assert sorted((r.a, r.b, r.weight) for r in edge_list(spark, str(tmp_path / "headed.csv")).collect() if r.a != r.b) == [(1, 2, 0.5), (2, 3, None)]


def test_older_attention_form_scores_alike():
    g = np.random.default_rng(1)
    new = {"conv": [{"w": g.normal(size=(4, 2, 3)), "left": g.normal(size=(2, 3)), "right": g.normal(size=(2, 3)), "linear": g.normal(size=(4, 6))}], "full": [{"w": g.normal(size=(6, 1)), "b": np.zeros(1)}]}
    layer = new["conv"][0]
    old = {"conv": [{"w": layer["w"].reshape(4, 6).T, "att": np.concatenate([layer["left"], layer["right"]], 1), "linear": layer["linear"]}], "full": new["full"]}
    x, src, dst = g.normal(size=(5, 4)), np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    assert np.allclose(K.gat_forward(x, src, dst, K.legacy_attention(old)), K.gat_forward(x, src, dst, new))


def test_adaptive_attacks_and_percolation(spark):
    star = spark.createDataFrame([("s", 0, i) for i in range(1, 8)] + [("s", 1, 2)], "network string, src long, dst long")
    for kind in ("degree", "betweenness", "closeness", "pagerank"):
        first = R.adaptive_curve(star, kind, 0.3).orderBy("removal_num").first()
        assert first.id == 0 and first.lcc == 2 / 8
    ranks = R.ranked(G.degrees(star).select("network", G.F.lit("d").alias("heuristic"), "v", G.F.col("degree").cast("double").alias("score")))
    rows = R.percolation(star, ranks).orderBy("removal_num").collect()
    assert [(r.lcc, r.susceptibility) for r in rows[:2]] == [(2 / 8, 6 / 8), (1 / 8, 7 / 8)]


def test_preferential_graphs(spark):
    e = G.preferential(spark, ["a", "b"], 60, 3, 0.5, 1)
    assert e.count() == 2 * 57 * 3 and e.where("src >= dst").count() == 0 and e.distinct().count() == e.count()
