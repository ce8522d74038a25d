"""Command line: python -m fragspark.cli dismantle|table|best|convert ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragspark")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("dismantle", help="run methods over the networks of folders")
    d.add_argument("-l", "--location", action="append", required=True)
    d.add_argument("-o", "--output", required=True)
    d.add_argument("-t", "--threshold", type=float, default=0.1)
    d.add_argument("-H", "--heuristics", nargs="+", required=True)
    d.add_argument("-F", "--filter", default="*")
    d.add_argument("-r", "--replay", default="static", choices=("static", "lcc", "core", "peak"))
    d.add_argument("-m", "--most-vertices", type=int)
    t = sub.add_parser("table", help="report of runs")
    t.add_argument("-f", "--file", nargs="+", required=True)
    t.add_argument("-q", "--query")
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-s", "--sort-column", default="r_auc")
    t.add_argument("-rn", "--row-nan", action="store_true")
    t.add_argument("-cn", "--column-nan", action="store_true")
    t.add_argument("-i", "--index", default="network")
    t.add_argument("-c", "--column", default="heuristic")
    b = sub.add_parser("best", help="each network's best runs")
    b.add_argument("-f", "--file", nargs="+", required=True)
    b.add_argument("-o", "--output", required=True)
    c = sub.add_parser("convert", help="edge lists of network files")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-eo", "--to", default="edgelist", choices=("edgelist", "csv", "adjacency", "pajek", "graphml", "parquet"))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from .operators.methods import REGISTRY, methods_table, run_methods
    from .plans import report
    from .sources import graphs, runs

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fragspark").getOrCreate()
    if a.command == "dismantle":
        edges = graphs.load_locations(spark, a.location, pattern=a.filter, most_vertices=a.most_vertices)
        keys = list(REGISTRY) if a.heuristics == ["all"] else a.heuristics
        done = runs.read_runs(spark, [a.output], include_removals=False, raise_on_missing=False)
        runs.append_runs(run_methods(edges, keys, a.threshold, a.replay, done), a.output)
    elif a.command == "table":
        plan = report.table_plan(runs.read_runs(spark, a.file, include_removals=False), methods_table(spark), a.sort_column, a.query, a.row_nan, a.column_nan)
        names = [r[0] for r in plan.select(a.column).distinct().orderBy(a.column).collect()]
        runs.export_table(report.pivoted(plan, a.sort_column, names, a.index, a.column), a.output)
    elif a.command == "best":
        runs.append_runs(report.best_runs(runs.read_runs(spark, a.file)), a.output)
    else:
        edges = graphs.load_networks(spark, a.input)
        {"edgelist": graphs.write_edge_list, "csv": lambda e, o: graphs.write_edge_list(e, o, ","), "adjacency": graphs.write_adjacency, "pajek": graphs.write_pajek, "graphml": graphs.write_graphml, "parquet": lambda e, o: e.write.partitionBy("network").parquet(o)}[a.to](edges, a.output)


if __name__ == "__main__":
    main()
