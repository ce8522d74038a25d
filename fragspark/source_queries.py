"""Registered queries of the readers, the writers and the rest of the report layer: files go to the shared folder and are read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import centrality as C
from .operators import components as P
from .operators import graph as G
from .operators import methods as M
from .operators import replay as R
from .plans import report as Q
from .queries import BEST, CURVE, HEURISTICS, MEANS, SOME, WITH, curve_sql, degree_scores, edges_cte, graph, made_up_weights, nested, query, rounded, runs, table
from .sources import graphs as L
from .sources import runs as U
from .tables import shared_path

EDGES = f"WITH {edges_cte('partco')} SELECT src, dst FROM e"
#: All suppliers and parts: vertices of the supplier-part graph, most of them without an edge in its slice.
VERTICES = "SELECT s_suppkey * 2 AS v FROM supplier UNION SELECT p_partkey * 2 + 1 FROM part"
OLD_D, NEW_D = "d AS (SELECT src AS v, count(*) AS degree FROM s GROUP BY src)", f"d AS (SELECT x.v, count(src) AS degree FROM ({VERTICES} UNION SELECT src FROM s) x LEFT JOIN s ON src = x.v GROUP BY x.v)"


def stored(spark, name: str) -> str:
    return shared_path(spark, name)


def supplied(spark, d) -> DataFrame:
    """The supplier-part graph with the suppliers and parts that have no edge."""
    ends = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("v")).union(table(spark, d, "part").select((F.col("p_partkey") * 2 + 1).alias("v")))
    return G.with_isolated(graph(spark, d, "sp50"), ends.select(F.lit("sp50").alias("network"), F.col("v").cast("long").alias("v")))


# Networks


@query(EDGES)
def load_edge_list(spark, d):
    at = stored(spark, "nets")
    graph(spark, d, "partco").select(F.concat_ws(" ", "src", "dst")).write.text(f"{at}/partco.el")
    return L.load_networks(spark, at).select("src", "dst")


@query(EDGES)
def load_headed_csv(spark, d):
    at = stored(spark, "nets")
    graph(spark, d, "partco").select(F.lit("partco").alias("network"), "src", "dst").coalesce(1).select("src", "dst").write.option("header", True).csv(f"{at}/partco.csv")
    return L.load_networks(spark, at).select("src", "dst")


@query("SELECT 'a' AS network, CAST(count(*) AS BIGINT) AS edges FROM nation UNION ALL SELECT 'b', count(*) FROM region")
def load_many_locations(spark, d):
    """Two folders and one that is not there; a filter on names and a bound on vertices leave the rest out."""
    at = stored(spark, "nets")
    table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", F.lit(900))).write.text(f"{at}/one/a.csv")
    table(spark, d, "region").select(F.concat_ws(" ", "r_regionkey", F.lit(900))).write.text(f"{at}/two/b.txt")
    table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", F.lit(0))).write.text(f"{at}/two/large.txt")
    return L.load_locations(spark, [f"{at}/one", f"{at}/none", f"{at}/two"], most_vertices=100).groupBy("network").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT 'a.csv' AS file UNION ALL SELECT 'b.csv'")
def list_network_files(spark, d):
    at = stored(spark, "nets")
    for name in ("b.csv", "a.csv", "c.el"):
        table(spark, d, "region").select(F.concat_ws(",", "r_regionkey", F.lit(9))).write.text(f"{at}/{name}")
    return spark.createDataFrame([(x.rsplit("/", 1)[-1],) for x in L.list_networks(spark, at, "*", ("csv",))], "file string")


@query(f"WITH {edges_cte('sp50').replace(OLD_D, NEW_D)} SELECT v, degree FROM d")
def load_graphml(spark, d):
    """GraphML with vertices that have no edge."""
    at = stored(spark, "nets")
    L.graphml_lines(supplied(spark, d)).select("value").write.text(f"{at}/sp50.graphml")
    return G.degrees(L.load_networks(spark, at, extensions=("graphml",))).select("v", "degree")


@query("SELECT n_regionkey AS a, n_nationkey + 5 AS b FROM nation")
def load_named_graphml(spark, d):
    """Names instead of numbers: a1 and b1 are two vertices, numbered in the order of names."""
    at = stored(spark, "nets")
    n = table(spark, d, "nation")
    lines = (
        spark.createDataFrame([(0, '<graphml><graph edgedefault="undirected">'), (3, "</graph></graphml>")], "k int, value string")
        .union(n.select(F.lit(1), F.format_string('<node id="b%02d"/>', F.col("n_nationkey")))).union(n.select(F.lit(1), F.format_string('<node id="a%d"/>', F.col("n_regionkey"))).distinct())
        .union(n.select(F.lit(2), F.format_string('<edge source="a%d" target="b%02d"/>', F.col("n_regionkey"), F.col("n_nationkey"))))
    )
    lines.repartition(1).sortWithinPartitions("k", "value").select("value").write.text(f"{at}/named.graphml")
    return L.graphml(spark, f"{at}/named.graphml")[1].select("a", "b")


@query(EDGES)
def load_adjacency(spark, d):
    at = stored(spark, "nets")
    near = graph(spark, d, "partco").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    near.select(F.concat_ws(" ", "src", F.concat_ws(" ", F.col("near").cast("array<string>")))).write.text(f"{at}/partco.adj")
    return L.load_networks(spark, at).select("src", "dst")


@query(f"WITH {edges_cte('sp50').replace(OLD_D, NEW_D)} SELECT v, degree FROM d")
def load_pajek(spark, d):
    at = stored(spark, "nets")
    e = supplied(spark, d)
    vertex = G.vertices_of(e).select(F.concat(F.col("v").cast("string"), F.lit(' "part or supplier"')))
    edge = e.where("src != dst").select(F.concat_ws(" ", "src", "dst", F.lit("1.0")))
    spark.createDataFrame([("*Vertices",)], "value string").union(vertex).union(edge).write.text(f"{at}/sp50.net")
    return G.degrees(L.load_networks(spark, at)).select("v", "degree")


@query("SELECT l_orderkey AS a, l_partkey AS b, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS DOUBLE) END AS weight FROM lineitem WHERE l_quantity = 50")
def load_weighted(spark, d):
    """Edge lists with and without a weight in a line."""
    at = stored(spark, "nets")
    line = table(spark, d, "lineitem").where("l_quantity = 50")
    line.select(F.concat_ws(" ", "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("string")))).write.text(f"{at}/w.txt")
    return L.edge_list(spark, f"{at}/w.txt").select("a", "b", "weight")


@query("SELECT s_suppkey AS a, s_nationkey + 1 AS b FROM supplier")
def zero_based_ids(spark, d):
    pairs = table(spark, d, "supplier").select(F.lit("x").alias("network"), (F.col("s_suppkey") + 1).alias("a"), (F.col("s_nationkey") + 2).alias("b"))
    return G.zero_based(pairs).select("a", "b")


@query("SELECT p_partkey AS v, CASE WHEN p_partkey < 100 THEN p_retailprice END AS price FROM part")
def attributes_join(spark, d):
    part = table(spark, d, "part").select(F.lit("x").alias("network"), F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("price"))
    return L.with_attributes(part.select("network", "v"), part.where("v < 100")).select("v", "price")


@query("SELECT n_nationkey AS v, n_regionkey * 0.5::DOUBLE AS score FROM nation")
def attributes_read(spark, d):
    """A value per line, by the vertices' order from 0, checked for gaps."""
    at = stored(spark, "attributes")
    n = table(spark, d, "nation")
    n.orderBy("n_nationkey").select((F.col("n_regionkey") * 0.5).cast("string").alias("value")).coalesce(1).write.text(f"{at}/x.txt")
    values = L.read_attributes(spark, f"{at}/x.txt", "score")
    return L.with_attributes(values.select("network", "v"), values, contiguous=True).select("v", "score")


@query("SELECT 'E' AS kind, r_regionkey AS first, 1500::BIGINT AS n FROM region UNION ALL SELECT 'V', r_regionkey, 1 FROM region")
def typed_lines(spark, d):
    """Lines of a letter and numbers, some of them long."""
    at = stored(spark, "lines")
    r = table(spark, d, "region")
    many = r.select(F.concat_ws(" ", F.lit("E"), "r_regionkey", F.concat_ws(" ", F.sequence(F.lit(2), F.lit(1500)).cast("array<string>"))))
    many.union(r.select(F.concat_ws(" ", F.lit("V"), "r_regionkey"))).union(r.select(F.lit("# remark"))).write.text(f"{at}/x.txt")
    return L.typed_lines(spark, f"{at}/x.txt").select("kind", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"))


@query(curve_sql("sp50", "degree DESC, v", SOME, CURVE).replace(OLD_D, NEW_D))
def isolated_static_curve(spark, d):
    """Vertices without edges count in N, in the stop size and in the shares."""
    e = supplied(spark, d)
    return rounded(R.static_curve(e, R.ranked(degree_scores(e), G.vertices_of(e)), 0.1).select("removal_num", "id", "lcc", "slcc"), "lcc", "slcc")


# Run files


def full_runs(spark, d) -> DataFrame:
    """runs with the columns of run files."""
    r = runs(spark, d).join(nested(spark, d), "run_id")
    return r.select("network", "heuristic", "slcc_peak_at", "lcc_size_at_peak", F.lit(0.25).alias("slcc_size_at_peak"), "removals", "static", "r_auc", "rem_num", F.lit(None).cast("double").alias("prediction_time"), F.lit(None).cast("double").alias("dismantle_time"), F.lit(0.1).alias("threshold"))


KEPT = "SELECT network, heuristic, rem_num, round(r_auc, 6) AS r_auc FROM runs"


@query(f"{WITH} {KEPT} WHERE network IN ('1', '2')")
def runs_append_read(spark, d):
    """Two appends to one folder, read back."""
    at = stored(spark, "runs")
    for x in ("1", "2"):
        U.append_runs(full_runs(spark, d).where(F.col("network") == x), at)
    return rounded(U.read_runs(spark, [at]).select("network", "heuristic", "rem_num", "r_auc"), "r_auc")


@query(f"{WITH} SELECT '00' || network AS network, heuristic, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT network || 'e3', heuristic, count(*) FROM runs GROUP BY ALL")
def runs_named_like_numbers(spark, d):
    """Network names such as 007 and 1e3 come back from the folders as they are."""
    at = stored(spark, "runs")
    for name in (F.concat(F.lit("00"), "network"), F.concat("network", F.lit("e3"))):
        U.append_runs(runs(spark, d).select(name.alias("network"), "heuristic", "rem_num"), at)
    return U.read_runs(spark, [at]).groupBy("network", "heuristic").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT network, heuristic, rem_num, slcc_peak_at % 5 + 1 AS points, round(CASE slcc_peak_at % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 WHEN 2 THEN 11 / 12.0 WHEN 3 THEN 25 / 24.0 ELSE 137 / 120.0 END, 6)::DOUBLE AS lcc FROM runs WHERE network = '1'")
def runs_csv_read(spark, d):
    """CSV files with literal removals, appended twice, read back."""
    at = f"{stored(spark, 'runs')}/x.csv"
    mine = full_runs(spark, d).where("network = '1'")
    U.export_csv(mine.where("rem_num < 20"), at)
    U.export_csv(mine.where("rem_num >= 20"), at)
    back = U.read_runs(spark, [at])
    return rounded(back.select("network", "heuristic", "rem_num", F.size("removals").alias("points"), F.aggregate("removals", F.lit(0.0), lambda a, x: a + x["lcc"]).alias("lcc")), "lcc")


@query(f"{WITH} SELECT network, count(*) AS n, round(sum(r_auc), 4) AS r_auc FROM runs GROUP BY network")
def runs_pruned_read(spark, d):
    """Without removals and without a column that is excluded: neither is read."""
    at = stored(spark, "runs")
    U.append_runs(full_runs(spark, d), at)
    return rounded(U.read_runs(spark, [at], include_removals=False, exclude=("prediction_time",)).groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.sum("r_auc").alias("r_auc")), "r_auc", digits=4)


@query(f"{WITH} {KEPT} WHERE network = '3' AND heuristic = 'm2'")
def run_point_read(spark, d):
    at = stored(spark, "runs")
    U.append_runs(full_runs(spark, d), at)
    return rounded(U.one_run(U.read_runs(spark, [at], include_removals=False), "3", "m2", 0.1).select("network", "heuristic", "rem_num", "r_auc"), "r_auc")


@query("SELECT unnest(['heuristic', 'lcc_size_at_peak', 'network', 'r_auc', 'rem_num', 'slcc_peak_at', 'static']) AS name")
def run_columns(spark, d):
    at = f"{stored(spark, 'runs')}/x.csv"
    U.export_csv(runs(spark, d).drop("run_id"), at)
    return spark.createDataFrame([(c,) for c in U.columns_of(spark, at)], "name string")


@query(f"{WITH} SELECT network, heuristic, round(r_auc * 2, 6) AS r_auc FROM runs WHERE rem_num < 5 UNION ALL SELECT network, heuristic, round(r_auc * 2, 6) FROM runs WHERE rem_num > 35")
def runs_file_callback(spark, d):
    """Two files, one that is missing, and a function over each file's rows."""
    at = stored(spark, "runs")
    U.append_runs(full_runs(spark, d).where("rem_num < 5"), f"{at}/a")
    U.append_runs(full_runs(spark, d).where("rem_num > 35"), f"{at}/b")
    got = U.read_runs(spark, [f"{at}/a", f"{at}/none", f"{at}/b"], False, raise_on_missing=False, callback=lambda df: df.withColumn("r_auc", F.col("r_auc") * 2))
    return rounded(got.select("network", "heuristic", "r_auc"), "r_auc")


@query("SELECT 0::BIGINT AS n, 12::BIGINT AS columns")
def runs_of_no_file(spark, d):
    got = U.read_runs(spark, [f"{stored(spark, 'runs')}/none"], raise_on_missing=False)
    return got.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len(got.columns)).cast("long"))


@query(f"{WITH} SELECT DISTINCT network, heuristic, rem_num, round(r_auc, 6) AS r_auc FROM ({BEST.format(keys='network', order='r_auc, rem_num', n=1)} UNION ALL {BEST.format(keys='network', order='rem_num, r_auc', n=1)})")
def best_runs_append(spark, d):
    """Best runs written as run rows; more rows than the input has would be an error."""
    at = stored(spark, "best")
    U.append_runs(Q.best_runs(runs(spark, d)), at)
    return rounded(spark.read.parquet(at).select(F.col("network").cast("string").alias("network"), "heuristic", "rem_num", "r_auc"), "r_auc")


@query(f"{WITH} SELECT network, round(avg(r_auc) FILTER (WHERE heuristic = 'm0'), 4) AS m0, round(avg(r_auc) FILTER (WHERE heuristic = 'm1'), 4) AS m1 FROM runs GROUP BY network")
def table_csv(spark, d):
    at = stored(spark, "table")
    U.export_table(Q.pivoted(runs(spark, d), "r_auc", ["m0", "m1"]), at)
    return rounded(spark.read.option("header", True).schema("network string, m0 double, m1 double").csv(at), "m0", "m1", digits=4)


@query(r"SELECT '\begin{tabular}{lrr}' AS line UNION ALL SELECT 'name & a & b \\ \hline' UNION ALL SELECT r_name || ' & ' || CASE WHEN r_regionkey <= 2 THEN '\textbf{' || r_regionkey || '}' ELSE r_regionkey::VARCHAR END || ' & ' || CASE WHEN r_regionkey >= 2 THEN '\textbf{2}' ELSE '2' END || ' \\' FROM region UNION ALL SELECT '\end{tabular}'")
def table_latex(spark, d):
    text = Q.latex_table(table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("a"), F.lit(2).alias("b")))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("SELECT unnest(['a/b_x_y.csv', 'runs_best.parquet', 'c.txt']) AS file")
def suffixed_filenames(spark, d):
    return spark.createDataFrame([(str(x),) for x in (Q.extend_filename("a/b.csv", None, "x", "y"), Q.extend_filename("runs.csv", ".parquet", "best"), Q.extend_filename("c.txt"))], "file string")


MARKED = "(VALUES ('m0', 'red', 'o'), ('m1', NULL, 's'), ('m2', 'blue', '^')) t(heuristic, plot_color, marker)"


@query(f"{WITH}, x AS (SELECT network, heuristic, CAST(unnest(range(1, slcc_peak_at % 5 + 2)) AS INTEGER) AS removal_num FROM runs) SELECT network, x.heuristic, removal_num, round(1 / (removal_num * 2), 6) AS lcc, plot_color, marker FROM x LEFT JOIN {MARKED} ON t.heuristic = x.heuristic")
def plot_points(spark, d):
    methods = spark.createDataFrame([("m0", "red"), ("m1", None), ("m2", "blue")], "heuristic string, plot_color string")
    return rounded(Q.plot_points(full_runs(spark, d), methods).select("network", "heuristic", "removal_num", "lcc", "plot_color", "marker"), "lcc")


# The report layer


@query(f"{WITH} SELECT network, heuristic, r_auc, run_id FROM runs")
def runs_without_columns(spark, d):
    return runs(spark, d).drop("slcc_peak_at", "lcc_size_at_peak", "static", "rem_num")


@query(f"{WITH} SELECT run_id, CASE network WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE network END AS network, CASE heuristic WHEN 'm3' THEN 'best of all' ELSE heuristic END AS heuristic FROM runs")
def runs_renamed(spark, d):
    named = Q.renamed_values(Q.renamed_values(runs(spark, d), "network", {"1": "one", "2": "two"}), "heuristic", {"m3": "best of all"})
    return named.select("run_id", "network", "heuristic")


@query(f'{WITH} SELECT run_id AS "Run Id", rem_num AS "Rem Num", r_auc AS "R Auc" FROM runs')
def runs_title_columns(spark, d):
    return Q.title_columns(runs(spark, d).select("run_id", "rem_num", "r_auc"))


@query(f"{WITH} SELECT run_id FROM runs WHERE rem_num % 3 = 1")
def runs_at_threshold(spark, d):
    """Thresholds that are equal but for the last bits of a double."""
    return Q.at_threshold(runs(spark, d).withColumn("threshold", (F.col("rem_num") % 3 + 1) * 0.1 + 1e-12), 0.2).select("run_id")


@query(f"{WITH} SELECT run_id FROM runs WHERE network IN ('1', '4')")
def runs_listed_networks(spark, d):
    return Q.listed(runs(spark, d), ["1", "4", "4", "no such network"]).select("run_id")


@query("SELECT unnest(['degree', 'degree,kcore', 'degree,chi', 'degree,kcore,chi']) AS features")
def feature_subsets(spark, d):
    return spark.createDataFrame([(",".join(x),) for x in Q.feature_subsets(["degree"], ["kcore", "chi"], 0, 2)], "features string")


@query(f"{WITH} SELECT run_id, rem_num FROM runs ORDER BY rem_num DESC, r_auc DESC LIMIT 50")
def runs_sorted(spark, d):
    return Q.sorted_runs(runs(spark, d), "rem_num", False).limit(50).select("run_id", "rem_num")


@query(f"{WITH} SELECT network, static, slcc_peak_at % 3 AS part, {', '.join(f'''round(avg(r_auc) FILTER (WHERE heuristic = '{h}'), 6) AS {h}''' for h in HEURISTICS)} FROM runs GROUP BY network, static, slcc_peak_at % 3")
def runs_pivot_many_keys(spark, d):
    return rounded(Q.pivoted(runs(spark, d).withColumn("part", F.col("slcc_peak_at") % 3), "r_auc", HEURISTICS, ["network", "static", "part"]), *HEURISTICS)


@query(f"{WITH} SELECT heuristic, {', '.join(f'''round(avg(r_auc) FILTER (WHERE network = '{n}'), 6) AS n{n}''' for n in '12345')} FROM runs GROUP BY heuristic")
def runs_transposed(spark, d):
    wide = Q.pivoted(runs(spark, d), "r_auc", list("12345"), "heuristic", "network")
    return rounded(wide.withColumnsRenamed({n: f"n{n}" for n in "12345"}), *(f"n{n}" for n in "12345"))


GAPS = f"{WITH}, means AS (SELECT rem_num, heuristic, avg(r_auc) AS r_auc FROM runs WHERE heuristic <> 'm1' OR rem_num < 30 GROUP BY ALL)"


def gaps(spark, d) -> DataFrame:
    return Q.long_means(runs(spark, d).where("heuristic <> 'm1' or rem_num < 30"), "r_auc", "rem_num")


@query(f"{GAPS} SELECT rem_num, heuristic, round(r_auc, 6) AS r_auc FROM means WHERE rem_num IN (SELECT rem_num FROM means GROUP BY rem_num HAVING count(*) = (SELECT count(DISTINCT heuristic) FROM means))")
def runs_complete_rows(spark, d):
    return rounded(Q.complete_rows(gaps(spark, d), "r_auc", "rem_num"), "r_auc").select("rem_num", "heuristic", "r_auc")


@query(f"{GAPS} SELECT rem_num, heuristic, round(r_auc, 6) AS r_auc FROM means WHERE heuristic IN (SELECT heuristic FROM means GROUP BY heuristic HAVING count(*) = (SELECT count(DISTINCT rem_num) FROM means))")
def runs_complete_columns(spark, d):
    return rounded(Q.complete_columns(gaps(spark, d), "r_auc", "rem_num"), "r_auc").select("rem_num", "heuristic", "r_auc")


@query(f"{MEANS} SELECT network, heuristic, round(r_auc, 6) AS r_auc FROM means UNION ALL SELECT network, 'Average', round(avg(r_auc), 6) FROM means GROUP BY network")
def runs_average_column(spark, d):
    return rounded(Q.with_average_column(Q.long_means(runs(spark, d), "r_auc"), "r_auc"), "r_auc")


@query(f"{WITH} SELECT network, heuristic, run_id FROM ({BEST.format(keys='network, heuristic', order='r_auc, rem_num', n=1)})")
def runs_one_each(spark, d):
    """Each network's one run of each heuristic; two would be an error."""
    return Q.one_row_each(Q.deduplicated(runs(spark, d))).select("network", "heuristic", "run_id")


@query(f"{WITH} SELECT heuristic, coalesce(min(CASE WHEN heuristic <> 'm2' THEN r_auc END), 'inf'::DOUBLE) AS r_auc FROM runs GROUP BY heuristic")
def runs_least_or_infinity(spark, d):
    return Q.least_or(runs(spark, d).withColumn("r_auc", F.when(F.col("heuristic") != "m2", F.col("r_auc"))), "r_auc", ["heuristic"])


@query(f"{WITH} SELECT round(avg(r_auc), 6) AS r_auc, round(avg(rem_num), 6) AS rem_num FROM runs")
def column_means(spark, d):
    return rounded(Q.column_means(runs(spark, d), "r_auc", "rem_num"), "r_auc", "rem_num")


@query(f"{WITH} SELECT run_id, CASE WHEN r_auc > 150 OR rem_num > 30 THEN 'stopped' ELSE 'done' END AS status, CASE WHEN r_auc > 150 OR rem_num > 30 THEN NULL ELSE rem_num END AS rem_num FROM runs")
def runs_early_stopped(spark, d):
    return R.early_stopped(runs(spark, d), 150, 30).select("run_id", "status", "rem_num")


# Scalars


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ER (' || c_custkey || 'K)' ELSE 'LFR p1 (' || c_custkey || 'K)' END AS label FROM customer WHERE c_custkey BETWEEN 1 AND 999")
def pretty_network(spark, d):
    c = table(spark, d, "customer").where("c_custkey between 1 and 999")
    er = F.concat(F.lit("ER_n"), F.col("c_custkey") * 1000, F.lit("_k4_3"))
    lfr = F.concat(F.lit("LFRp1_N"), F.col("c_custkey") * 1000, F.lit("_k6.0_maxk128_mu0.1_t12.2_t21.0_minc128_maxc640_S0_i1"))
    return c.select("c_custkey", S.pretty_network(F.when(F.col("c_custkey") % 2 == 0, er).otherwise(lfr)).alias("label"))


@query("SELECT c_custkey, CASE c_mktsegment || '_' || c_custkey % 3 WHEN 'BUILDING_1' THEN 'red' WHEN 'MACHINERY_2' THEN 'blue' END AS colour FROM customer")
def colour_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.colour_key(F.col("c_mktsegment"), F.col("c_custkey") % 3, {"BUILDING_1": "red", "MACHINERY_2": "blue"}).alias("colour"))


@query(f"{WITH} SELECT run_id, CAST(sum(run_id * i) AS BIGINT) AS ids FROM (SELECT run_id, unnest(range(1, slcc_peak_at % 5 + 2)) AS i FROM runs) GROUP BY run_id")
def removed_ids(spark, d):
    return nested(spark, d).select("run_id", F.aggregate(S.removed_ids(F.col("removals")), F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query(f"WITH {edges_cte('partco')} SELECT round(sum(-(degree / t) * log2(degree / t)), 6) AS entropy FROM d, (SELECT sum(degree)::DOUBLE AS t FROM d)")
def degree_entropy(spark, d):
    g = G.degrees(graph(spark, d, "partco"))
    total = g.groupBy("network").agg(F.sum("degree").cast("double").alias("total"))
    return rounded(g.join(total, "network").agg(F.sum(S.entropy_terms(F.col("degree"), F.col("total"))).alias("entropy")), "entropy")


# Vertex scores and attacks

HASHED = "CAST(concat('0x', substring(md5({text}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query(f"WITH {edges_cte('partco')} SELECT v, round(score, 9) AS score, CAST(row_number() OVER (ORDER BY score DESC, v) AS INTEGER) AS removal_num FROM (SELECT v, {HASHED.format(text="'5:' || v")} AS score FROM d)")
def random_rank(spark, d):
    scores = G.random_scores(G.vertices_of(graph(spark, d, "partco")), 5).withColumn("heuristic", F.lit("random"))
    return rounded(R.ranked(scores).select("v", "score", "removal_num"), "score", digits=9)


@query(f"SELECT a AS src, b AS dst FROM (SELECT x.range AS a, y.range AS b FROM range(200) x JOIN range(200) y ON x.range < y.range) WHERE {HASHED.format(text="'3:' || a || ':' || b")} < 0.15")
def random_graph(spark, d):
    return G.erdos_renyi(spark, "er", 200, 0.15, 3).select("src", "dst")


@query(f"""WITH ring AS (SELECT x.range AS id, y.range AS step FROM range(500) x, range(1, 3) y),
pairs AS (SELECT id AS a, CASE WHEN {HASHED.format(text="'1:' || id || ':' || step")} < 0.1 THEN CAST(floor({HASHED.format(text="'2:' || id || ':' || step")} * 500) AS BIGINT) ELSE (id + step) % 500 END AS b FROM ring)
SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM pairs WHERE a <> b""")  # fmt: skip
def small_world_graph(spark, d):
    return G.small_world(spark, "ring", 500, 4, 0.1, 1).select("src", "dst")


@query("SELECT 1990::BIGINT AS edges, 500::BIGINT AS vertices, true AS hub")
def preferential_graph(spark, d):
    """Each of the vertices 5 to 499 brings 4 edges or fewer where it picks one neighbour twice: here counts and the hub only."""
    e = G.preferential(spark, ["ba"], 500, 5, 0.3, 2)
    top = G.degrees(e).agg(F.max("degree").alias("top"))
    return e.agg(F.count(F.lit(1)).alias("edges")).join(top).select((F.col("edges") - 485).alias("edges"), F.lit(500).cast("long").alias("vertices"), (F.col("top") > 40).alias("hub"))


@query(f"""WITH RECURSIVE {edges_cte('custsupp')}, core(v, c) USING KEY (v) AS (
  SELECT v, degree FROM d
  UNION
  SELECT h.v, h.h FROM (
    SELECT v, max(least(c, i)) AS h FROM (SELECT s.src AS v, x.c, row_number() OVER (PARTITION BY s.src ORDER BY x.c DESC) AS i FROM s JOIN recurring.core AS x ON x.v = s.dst) GROUP BY v
  ) h JOIN recurring.core AS old ON old.v = h.v WHERE h.h < old.c
) SELECT src, dst FROM e WHERE src IN (SELECT v FROM core WHERE c >= 2) AND dst IN (SELECT v FROM core WHERE c >= 2)""")  # fmt: skip
def two_core_edges(spark, d):
    return P.k_core(graph(spark, d, "custsupp"), 2).select("src", "dst")


SQUARES = "SELECT CAST(k AS INTEGER) AS removal_num, round(CAST(max(size) AS DOUBLE) / n, 6) AS lcc, round((sum(size * size) - max(size) * max(size)) / CAST(n AS DOUBLE), 4) AS susceptibility FROM sizes, n GROUP BY k, n"


@query(curve_sql("useq", "degree DESC, v", "(SELECT n FROM n)", SQUARES))
def percolation_curve(spark, d):
    e = graph(spark, d, "useq")
    return rounded(rounded(R.percolation(e, R.ranked(degree_scores(e))).select("removal_num", "lcc", "susceptibility"), "lcc"), "susceptibility", digits=4)


@query(f"WITH {edges_cte('partco')} SELECT v, round(degree / (SELECT max(degree) FROM d), 6) AS degree, round(pow(degree - m, 2) / m, 6) AS chi_degree, 1.0::DOUBLE AS ones FROM d, (SELECT avg(degree) AS m FROM d)")
def feature_arrays(spark, d):
    x = C.feature_matrix(graph(spark, d, "partco"), ("degree", "chi_degree", "None"))
    return rounded(x.select("v", F.col("x")[0].alias("degree"), F.col("x")[1].alias("chi_degree"), F.col("x")[2].alias("ones")), "degree", "chi_degree")


@query(f"{curve_sql('sp50', 'degree DESC, v', SOME, '').rstrip()}, y AS (SELECT CAST(k AS INTEGER) AS removal_num, lcc / CAST(n AS DOUBLE) AS lcc FROM curve, n), z AS (SELECT *, sum(CASE WHEN removal_num > 1 THEN (lcc + was) / 2 ELSE 0 END) OVER (ORDER BY removal_num) AS area FROM (SELECT *, lag(lcc) OVER (ORDER BY removal_num) AS was FROM y)) SELECT removal_num, round(lcc, 6) AS lcc, area > 5 OR removal_num > 60 AS stopped FROM z WHERE removal_num <= coalesce((SELECT min(removal_num) FROM z WHERE area > 5 OR removal_num > 60), 1000000)")
def early_stopped_curve(spark, d):
    e = graph(spark, d, "sp50")
    curve = R.static_curve(e, R.ranked(degree_scores(e)), 0.1)
    return rounded(R.stopped_curves(curve, 5, 60).select("removal_num", "lcc", "stopped"), "lcc")


@query("SELECT * FROM (VALUES ('conv', 'w', 24::BIGINT, 276.0::DOUBLE), ('conv', 'left', 6, 15), ('full', 'w', 6, 15), ('full', 'b', 1, 0)) t(stack, part, size, total)")
def weights_kept(spark, d):
    """Weights to Parquet and back."""
    at = stored(spark, "weights")
    n = lambda *s: np.arange(np.prod(s), dtype=float).reshape(s)
    M.weights_table(spark, {M.parameter_name(F=4, L=[6, 1]): {"conv": [{"w": n(4, 2, 3), "left": n(2, 3)}], "full": [{"w": n(6, 1), "b": n(1)}]}}).write.parquet(at)
    back = M.weights_of(spark.read.parquet(at), "F4_L6x1")
    return spark.createDataFrame([(stack, part, int(x.size), float(x.sum())) for stack in ("conv", "full") for layer in back[stack] for part, x in layer.items()], "stack string, part string, size long, total double")


@query("SELECT unnest(['L3_H1x1', 'L5_H1x1', 'L5_H2']) AS model")
def models_to_train(spark, d):
    had = M.weights_table(spark, {"L3_H2": made_up_weights()})
    return M.missing_models([M.parameter_name(L=lr, H=h) for lr in (3, 5) for h in ([1, 1], 2)], had)


def weighted_query(key: str, **options) -> None:
    """A learned method with fixed, made-up weights: everything but the training."""

    def run(spark, d):
        e = graph(spark, d, "useq")
        rows = M.run_methods(e, [key], 0.1, options={"GDM": {"weights": made_up_weights()}, "CoreGDM": {"weights": made_up_weights(2)}, "FINDER_ND": {"weights": made_up_weights(2)}})
        return rows.select("network", "heuristic", "slcc_peak_at", "static", F.round("r_auc", 6).alias("r_auc"), "rem_num", "threshold")

    run.__name__ = f"method_{key.lower()}"
    query()(run)


for _key in ("GDM", "GDMR", "CoreGDM", "FINDER_ND", "adaptive_betweenness", "adaptive_closeness", "adaptive_pagerank"):
    weighted_query(_key)


@query()
def gdm_grid_best(spark, d):
    """The grid of models over a network, and the best run of each by the area."""
    e = graph(spark, d, "useq")
    grid = {M.parameter_name(F=4, S=s): {**made_up_weights(), "full": [{"w": made_up_weights()["full"][0]["w"] * s, "b": np.zeros(1)}]} for s in (-1, 1, 2)}
    return Q.first_of(M.gdm_grid(e, grid).select("network", "heuristic", F.round("r_auc", 6).alias("r_auc"), "rem_num"), ["network"], [F.col("r_auc"), F.col("rem_num")])
