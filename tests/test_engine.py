import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fragspark.functions import scalar as S
from fragspark.operators import centrality as C
from fragspark.operators import components as P
from fragspark.operators import graph as G
from fragspark.operators import kernels as K
from fragspark.operators import methods as M
from fragspark.operators import replay as R
from fragspark.operators.optimum import best_sets
from fragspark.plans import report as Q
from fragspark.schema import RUN as RUN_SCHEMA
from fragspark.sources import graphs as IO
from fragspark.sources import runs as RUNS

BRIDGED = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


def edges(spark, rows, network="g"):
    return spark.createDataFrame([(network, a, b) for a, b in rows], "network string, src long, dst long")


def test_cleaning(spark):
    raw = spark.createDataFrame([("g", 2, 1), ("g", 1, 2), ("g", 3, 3), ("g", None, 1), ("h", 1, 2)], "network string, a long, b long")
    assert sorted(map(tuple, G.clean_edges(raw).collect())) == [("g", 1, 2), ("h", 1, 2)]
    one = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("h", 0, 1)], "network string, a long, b long")
    assert sorted(map(tuple, G.zero_based(one).select("network", "a", "b").collect())) == [("g", 0, 1), ("g", 1, 2), ("h", 0, 1)]


def test_components_of_a_long_path(spark):
    path = edges(spark, [(i, i + 1) for i in range(200)] + [(500, 501)])
    lone = spark.createDataFrame([("g", 900)], "network string, v long")
    got = {r.v: r.component for r in P.components(path, G.vertices_of(path, lone)).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[900] == 900


def test_coreness_and_core(spark):
    e = edges(spark, [*BRIDGED, (5, 6)])
    assert {r.v: r.core for r in P.coreness(e).collect()} == {**dict.fromkeys(range(6), 2), 6: 1}
    assert P.k_core(e, 2).count() == 7


def test_paths(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    assert {r.v: round(r.score, 6) for r in C.shortest_path_scores(e).collect()} == {0: 0, 1: round(4 / 6, 6), 2: round(4 / 6, 6), 3: 0}
    assert {r.v: round(r.score, 6) for r in C.shortest_path_scores(e, "closeness").collect()}[1] == 0.75


def test_metrics_edge_cases(spark):
    rows = [("g", "one", 1, 0, 1.0, 0.5, 0.1)] + [("g", "two", i, i, 1.0, y, 0.2) for i, y in ((1, 0.8), (2, 0.4))] + [("g", "sq", i, i, 1.0, float((i - 1) ** 2), 0.0) for i in range(1, 9)]
    got = {r.heuristic: r for r in R.run_metrics(spark.createDataFrame(rows, "network string, heuristic string, removal_num int, id long, prediction double, lcc double, slcc double")).collect()}
    assert got["one"].r_auc == 0 and abs(got["two"].r_auc - 0.6) < 1e-9 and abs(got["sq"].r_auc - 343 / 3) < 1e-9 and got["two"].slcc_peak_at == 1


def test_same_curve_for_any_partitioning(spark):
    e = G.erdos_renyi(spark, "er", 60, 0.06, 5)
    results = set()
    for n in (1, 5, 16):
        own = e.repartition(n)
        curve = R.static_curve(own, R.ranked(M.scores_of("degree", own)), 0.1)
        results.add(tuple(sorted(map(tuple, curve.collect()))))
    assert len(results) == 1


def test_methods_run_with_dependencies_and_skip_what_is_done(spark):
    e = edges(spark, BRIDGED).unionByName(edges(spark, BRIDGED[:3], "h"))
    runs = M.run_methods(e, ["GNDR", "degree"], 0.4)
    rows = runs.collect()
    assert {(r.network, r.heuristic) for r in rows} == {(n, h) for n in "gh" for h in ("GNDR", "degree")}
    done = spark.createDataFrame([("g", "degree", 0.4)], "network string, heuristic string, threshold double")
    again = M.run_methods(e, ["degree"], 0.4, done=done)
    assert {r.network for r in again.collect()} == {"h"}
    assert M.scheduled(["GNDR", "degree"]) == ["GND", "GNDR", "degree"]
    with pytest.raises(ValueError):
        M.scores_of("GDM", e)
    with pytest.raises(TypeError):
        M.method("x", None)
    stopped = R.early_stopped(runs, most_removals=0)
    assert {r.status for r in stopped.collect()} == {"stopped"}


def test_brute_force_beats_heuristics(spark):
    e = edges(spark, BRIDGED)
    got = {r.v: (r.k, r.target) for r in best_sets(e, stop=3).collect()}
    assert got[2][0] == 1 and got[2][1] == 0.5 and got[0][1] == 0


def test_adaptive_scorer(spark):
    out = R.scored_adaptively(edges(spark, BRIDGED), lambda ids, near: [len(x) for x in near], "own", 0.5, core=True)
    assert [r.v for r in out.orderBy(F.desc("score")).collect()][0] == 2


def test_scalars(spark):
    rows = spark.createDataFrame([(999,), (1000,), (1500,), (999_960,), (1_000_000,), (2_340_000_000,)], "x long")
    assert [r[0] for r in rows.select(S.intword(F.col("x"))).collect()] == ["999", "1K", "1.5K", "1M", "1M", "2.3B"]
    back = spark.createDataFrame([("1.5K",), ("2 m",), ("17",), ("x",)], "t string")
    assert [r[0] for r in back.select(S.from_human(F.col("t"))).collect()] == [1500, 2_000_000, 17, None]
    one = spark.createDataFrame([("[(1, 17, np.float64(0.5), 0.25, 0.0), (2, 3, 1e-3, 0.2, 0.1)]", "ER_n1000_k4_3", "odd")], "t string, n string, o string")
    r = one.select(S.read_removals(F.col("t")).alias("r"), S.pretty_network(F.col("n")).alias("p"), S.removed_ids(S.read_removals(F.col("t"))).alias("ids"), S.title_label(F.lit("_power-law x2y ")).alias("l")).first()
    assert [tuple(x) for x in r.r] == [(1, 17, 0.5, 0.25, 0.0), (2, 3, 0.001, 0.2, 0.1)] and r.p == "ER (1K)" and r.ids == [17, 3] and r.l == "Power-Law X2Y"
    with pytest.raises(PySparkException):
        one.select(S.pretty_network(F.col("o"))).collect()


def test_suffixes_up_to_the_largest(spark):
    rows = spark.createDataFrame([(999_960,), (999_960_000,), (1_000_000_000,), (2_340_000_000,)], "x long")
    assert [r[0] for r in rows.select(S.intword(F.col("x"), "M")).collect()] == ["1M", "1000M", "1000M", "2340M"]


def test_intword_equals_its_sql_beyond_a_thousand_million(spark, tmp_path):
    import duckdb

    from fragspark.queries import ORACLES, QUERIES

    spark.range(15_000, 90_000, 7).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(tuple(r) for r in QUERIES["intword"](spark, str(tmp_path)).collect()) == sorted(db.sql(ORACLES["intword"]).fetchall())


def test_run_files(spark, tmp_path):
    e = edges(spark, BRIDGED)
    runs = M.run_methods(e, ["degree"], 0.4)
    RUNS.append_runs(runs, f"{tmp_path}/runs")
    RUNS.append_runs(runs.withColumn("heuristic", F.lit("other")), f"{tmp_path}/runs")
    back = RUNS.read_runs(spark, [f"{tmp_path}/runs"])
    assert back.count() == 2 and RUNS.one_run(back, "g", "degree", 0.4).first().removals == runs.first().removals
    RUNS.export_csv(runs, f"{tmp_path}/runs.csv")
    csv = RUNS.read_runs(spark, [f"{tmp_path}/runs.csv"], bookkeeping=True)
    assert csv.first().removals == runs.first().removals and "file" in csv.columns
    assert RUNS.read_runs(spark, [f"{tmp_path}/none.csv"], raise_on_missing=False).count() == 0
    with pytest.raises(FileNotFoundError):
        RUNS.read_runs(spark, [f"{tmp_path}/none.csv"])
    with pytest.raises(ValueError):
        RUNS.read_runs(spark, [f"{tmp_path}/runs"], expected=("absent",))
    assert "removals" not in RUNS.read_runs(spark, [f"{tmp_path}/runs"], include_removals=False).columns


def test_graph_files(spark, tmp_path):
    want = sorted(BRIDGED)
    (tmp_path / "a.edgelist").write_text("# x\n" + "\n".join(f"{b} {a}" for a, b in BRIDGED))
    (tmp_path / "b.csv").write_text("src,dst\n" + "\n".join(f"{a},{b}" for a, b in BRIDGED))
    (tmp_path / "c.adj").write_text("0 1 2\n1 2\n2 3\n3 4 5\n4 5\n")
    (tmp_path / "d.net").write_text('*Vertices 2\n0 "x"\n*Edges\n' + "\n".join(f"{a} {b} 1.0" for a, b in BRIDGED))
    (tmp_path / "e.graphml").write_text("<graphml><graph>" + "".join(f'<node id="n{v}"></node>' for v in range(6)) + "".join(f'<edge source="n{a}" target="n{b}"></edge>' for a, b in BRIDGED) + "</graph></graphml>")
    got: dict = {}
    for r in IO.load_networks(spark, str(tmp_path)).collect():
        got.setdefault(r.network, []).append((r.src, r.dst))
    assert {k: sorted(v) for k, v in got.items()} == dict.fromkeys("abcde", want)
    assert IO.load_locations(spark, [str(tmp_path), f"{tmp_path}/none"], most_vertices=3).count() == 0
    with pytest.raises(FileNotFoundError):
        IO.list_networks(spark, str(tmp_path), "zz*")
    IO.write_graphml(edges(spark, BRIDGED), f"{tmp_path}/out")
    text = "".join(open(os.path.join(p, f)).read() for p, _, fs in os.walk(f"{tmp_path}/out") for f in fs if f.startswith("part"))
    assert text.count("<edge ") == 7 and text.startswith("<?xml") and text.rstrip().endswith("</graphml>")


def test_command_line(spark, tmp_path):
    from fragspark.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.edgelist").write_text("\n".join(f"{a} {b}" for a, b in BRIDGED))
    main(["dismantle", "-l", f"{tmp_path}/in", "-o", f"{tmp_path}/runs", "-H", "degree", "CoreHD", "-t", "0.4"], spark)
    main(["dismantle", "-l", f"{tmp_path}/in", "-o", f"{tmp_path}/runs", "-H", "degree", "-t", "0.4"], spark)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2
    main(["table", "-f", f"{tmp_path}/runs", "-o", f"{tmp_path}/table"], spark)
    assert spark.read.option("header", True).csv(f"{tmp_path}/table").count() == 2
    main(["best", "-f", f"{tmp_path}/runs", "-o", f"{tmp_path}/best"], spark)
    main(["convert", "-i", f"{tmp_path}/in", "-o", f"{tmp_path}/conv"], spark)


def test_report(spark):
    runs = spark.createDataFrame([("n1", "a", 1.0, 2), ("n1", "b", 2.0, 1), ("n2", "a", 3.0, 1), ("n2", "a", 5.0, 9)], "network string, heuristic string, r_auc double, rem_num int")
    means = Q.long_means(runs, "r_auc")
    assert {(r.network, r.heuristic): r.r_auc for r in Q.with_average(Q.normalised(means, "r_auc"), "r_auc").collect()} == {("n1", "a"): 1, ("n1", "b"): 2, ("n2", "a"): 1, ("Average", "a"): 1, ("Average", "b"): 2}
    assert {r.heuristic for r in Q.complete_columns(means, "r_auc").collect()} == {"a"}
    assert {r.network for r in Q.complete_rows(means, "r_auc").collect()} == {"n1"}
    assert r"\textbf{1.0}" in Q.latex_table(Q.pivoted(means, "r_auc", ["a", "b"]).orderBy("network"))
    with pytest.raises(PySparkException):
        Q.one_row_each(runs).collect()
    assert str(Q.extend_filename("x/y.csv", None, "a", "b")) == "x/y_a_b.csv"
    assert Q.feature_subsets(["d"], ["k", "c"], 1, 2) == [["d", "k"], ["d", "c"], ["d", "k", "c"]]


def test_stream_equals_batch(spark, tmp_path):
    from fragspark.streaming.removals import event_counts, growing_components

    path = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    events = spark.read.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = event_counts(stream, late="3650 days").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, event_counts(events).collect()))
    edges(spark, BRIDGED).coalesce(1).write.parquet(f"{tmp_path}/edges")
    live = growing_components(spark.readStream.schema("network string, src long, dst long").parquet(f"{tmp_path}/edges"))
    q = live.writeStream.format("memory").queryName("grown").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("grown").collect()] == [("g", 7, 6)]


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'degree_rank' in e.queries() and not any(k.startswith('op') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_coreness_raises_without_a_fixpoint(spark):
    chain = edges(spark, [(i, i + 1) for i in range(12)])
    with pytest.raises(RuntimeError):
        P.coreness(chain, most_rounds=2)
    assert {r.core for r in P.coreness(chain).collect()} == {1}


def test_ensemble_takes_the_least_of_a_thousand_seeds(spark):
    rnd = random.Random(1)
    pairs = sorted({tuple(sorted(rnd.sample(range(18), 2))) for _ in range(30)})
    g = K.Graph([a for a, _ in pairs], [b for _, b in pairs])
    stop = 3
    sets = [K.generalized_dismantling(g, stop, s) for s in range(1, 1001)]
    best = min(sets, key=len)
    got = [r.v for r in M.get_EGND(edges(spark, pairs), stop / g.n - 1e-9).orderBy(F.desc("score")).collect()]
    assert got == g.ids[best].tolist() and len(best) < min(map(len, sets[:8]))


def test_whole_graphs_equal_brute_force(spark, tmp_path):
    from fragspark.queries import ORACLES, QUERIES, Whole, graph

    rnd = random.Random(8)
    line = [(rnd.randrange(12), rnd.randrange(15), rnd.randrange(6), float(rnd.choice((1, 20, 46, 48, 50)))) for _ in range(60)]
    orders = [(i, rnd.randrange(5), rnd.choice(("1-URGENT", "3-MEDIUM")), 1000.0 * i) for i in range(12)]
    events = [(i, f"2026-01-01 00:00:{i * 7 % 40:02d}", rnd.randrange(6), rnd.choice(("purchase", "view"))) for i in range(40)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    in_order = [u for _, _, u in sorted((t, i, u) for i, t, u, _ in events)]
    pairs = {
        "sp50": [(s * 2, p * 2 + 1) for _, p, s, _ in line],
        "partco": [(x[1], y[1]) for x in line for y in line if x[0] == y[0]],
        "custsupp": [(o[1] * 2, x[2] * 2 + 1) for o in orders for x in line if o[0] == x[0]],
        "useq": list(zip(in_order, in_order[1:], strict=False)),
    }
    for name, own in pairs.items():
        want = {(min(x), max(x)) for x in own if x[0] != x[1]}
        assert {(r.src, r.dst) for r in graph(spark, Whole(tmp_path), name).collect()} == want
        part = {(r.src, r.dst) for r in graph(spark, str(tmp_path), name).collect()}
        assert part != want if name == "useq" else part < want
    want = {v: sum(v in e for e in {tuple(sorted(x)) for x in pairs["partco"] if x[0] != x[1]}) for x in pairs["partco"] for v in x}
    assert {r.v: r.degree for r in QUERIES["whole_graph_degree"](spark, str(tmp_path)).collect()} == {v: n for v, n in want.items() if n}
    runs = {(o[2][0], f"m{o[1] % 7}") for o in orders}
    missing = {h: len({n for n, _ in runs}) - sum(x == h for _, x in runs) for _, h in runs}
    assert {r.heuristic: r.missing for r in QUERIES["whole_nan_census"](spark, str(tmp_path)).collect()} == missing and any(missing.values())
    assert len([x for x in ORACLES if x.startswith("whole_")]) == 22 and "whole_static_curve_random" not in ORACLES


def test_rounds_over_all_tasks_equal_plain_ones(spark):
    """Rows lie in several partitions that are not put together, as at scale; the plain rounds are dictionaries."""
    e = G.with_isolated(G.erdos_renyi(spark, "er", 60, 0.04, 3).union(G.erdos_renyi(spark, "other", 30, 0.08, 4)), spark.createDataFrame([("er", 900), ("er", 3)], "network string, v long")).repartition(5)
    near = {}
    for r in e.collect():
        own = near.setdefault(r.network, {})
        own.setdefault(r.src, set())
        own.setdefault(r.dst, set())
        if r.src != r.dst:
            own[r.src].add(r.dst)
            own[r.dst].add(r.src)
    label, core, rank, vector = {}, {}, {}, {}
    for net, own in near.items():
        n, x, y = len(own), dict.fromkeys(own, 1 / len(own)), dict.fromkeys(own, 1.0)
        alone = [v for v in own if not own[v]]
        for v in sorted(own):
            stack = [v] if (net, v) not in label else []
            while stack:
                u = stack.pop()
                if (net, u) not in label:
                    label[net, u] = v
                    stack += own[u]
        for k in range(n):
            left = dict(own)
            while weak := [v for v in left if len(own[v] & left.keys()) < k]:
                left = {v: own[v] for v in left if v not in weak}
            core.update({(net, v): k for v in left})
        for _ in range(7):
            spread = sum(x[v] for v in alone) / n
            x = {v: 0.15 / n + 0.85 * (sum(x[u] / len(own[u]) for u in own[v]) + spread) for v in own}
            y = {v: sum(y[u] for u in own[v]) for v in own}
            length = sum(z * z for z in y.values()) ** 0.5
            y = {v: z / length for v, z in y.items()}
        rank.update({(net, v): z for v, z in x.items()})
        vector.update({(net, v): z for v, z in y.items()})
    rows = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(P.components(e)) == label and rows(P.coreness(e)) == core
        assert rows(C.pagerank(e, 7)) == pytest.approx(rank) and rows(C.eigenvector(e, 7)) == pytest.approx(vector)
        ring = edges(spark, [(i, (i + 1) % 300) if i < 299 else (0, 299) for i in range(300)]).repartition(7)
        assert {r.component for r in P.components(ring).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ("er", 900, 0) in {tuple(r) for r in G.degrees(e).collect()} and label["er", 900] == 900


def test_rounds_end_by_tolerance(spark):
    e = edges(spark, [(0, i) for i in range(1, 6)] + [(1, 2)])
    close, far = ({r.v: r.score for r in C.pagerank(e, 500, tolerance=t).collect()} for t in (0.1, 1e-3))
    assert close == pytest.approx(far, abs=0.1) and close != far and sum(far.values()) == pytest.approx(1)
    x = {r.v: r.score for r in C.eigenvector(e, 500, 0.05).collect()}
    top = (x[1] + x[2] + x[3] + x[4] + x[5]) / x[0]
    assert all(abs(top * x[v] - sum(x[u] for u in near)) < 0.1 for v, near in {1: (0, 2), 2: (0, 1), 3: (0,), 4: (0,), 5: (0,)}.items())


def test_dependencies_come_from_stored_runs(spark):
    rnd = random.Random(4)
    e = edges(spark, sorted({tuple(sorted(rnd.sample(range(14), 2))) for _ in range(30)}))
    whole = M.run_methods(e, ["GND", "GNDR"], 0.3).collect()
    first = [tuple(r[c] for c in RUN_SCHEMA.names) for r in whole if r.heuristic == "GND"]
    again = M.run_methods(e, ["GNDR"], 0.3, done=spark.createDataFrame(first, RUN_SCHEMA)).collect()
    assert [(r.heuristic, r.removals) for r in again] == [(r.heuristic, r.removals) for r in whole if r.heuristic == "GNDR"] and again
    slim = spark.createDataFrame([("g", "GND", 0.3)], "network string, heuristic string, threshold double")
    assert [r.removals for r in M.run_methods(e, ["GNDR"], 0.3, done=slim).collect()] == [r.removals for r in again]
    bare = spark.createDataFrame([(*first[0][:5], [], *first[0][6:])], RUN_SCHEMA)
    with pytest.raises(PySparkException, match="no removals"):
        M.run_methods(e, ["GNDR"], 0.3, done=bare).collect()


def test_networks_keep_their_names_in_folders(spark, tmp_path):
    names = ["007", "1e3", "2026-01-01", "true", "a b"]
    rows = spark.createDataFrame([(n, "m", 1, 0.5, 0.25, None, True, 1.0, 2, None, None, 0.1) for n in names], RUN_SCHEMA)
    RUNS.append_runs(rows, f"{tmp_path}/runs")
    assert sorted(r.network for r in RUNS.read_runs(spark, [f"{tmp_path}/runs"]).collect()) == sorted(names)
