"""The relational layer over run rows: derive, filter, dedupe, rank, pivot, normalise, average, format. Long form until the last projection."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import title_label

KEY = ("network", "heuristic", "threshold")
SORTS = {"r_auc": ("r_auc", "rem_num"), "rem_num": ("rem_num", "r_auc")}


def average_damage(runs: DataFrame) -> DataFrame:
    return runs.withColumn("average_dmg", F.try_divide(1 - F.col("lcc_size_at_peak"), F.col("slcc_peak_at")))


def percent(runs: DataFrame, *columns: str) -> DataFrame:
    return runs.withColumns({c: F.col(c) * 100 for c in columns})


def dynamic_suffix(runs: DataFrame) -> DataFrame:
    return runs.withColumn("heuristic", F.when(~F.col("static"), F.concat("heuristic", F.lit(" (dynamic)"))).otherwise(F.col("heuristic")))


def short_names(runs: DataFrame, methods: DataFrame) -> DataFrame:
    """Registered methods get their short names, others a title. The table of methods is small, and Spark checks that before it broadcasts."""
    named = runs.join(methods.select("heuristic", "short_name"), "heuristic", "left")
    return named.withColumn("heuristic", F.coalesce("short_name", title_label(F.col("heuristic")))).drop("short_name")


def renamed_values(runs: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    if not names:
        return runs
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return runs.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def title_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace("_", " ").title() for c in df.columns))


def matching(runs: DataFrame, values: dict) -> DataFrame:
    """All of a dict of equalities, nulls equal to nulls."""
    return runs.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()), F.lit(True)))


def at_threshold(runs: DataFrame, threshold: float) -> DataFrame:
    return runs.where(F.col("threshold").cast("decimal(6,4)") == F.lit(threshold).cast("decimal(6,4)"))


def queried(runs: DataFrame, predicate: str | None) -> DataFrame:
    """Rows for which an SQL predicate holds."""
    return runs.where(F.expr(predicate)) if predicate else runs


def not_done(todo: DataFrame, runs: DataFrame) -> DataFrame:
    """(network, heuristic, threshold) without a run yet."""
    return todo.join(runs.select(*KEY).distinct(), list(KEY), "left_anti")


def dependency_runs(todo: DataFrame, runs: DataFrame, methods: DataFrame) -> DataFrame:
    """For each entry of todo whose method has a dependency that method's one run; raises where there are more or none."""
    wanted = todo.join(methods.select("heuristic", "depends_on").where("depends_on is not null"), "heuristic")
    had = runs.select("network", F.col("heuristic").alias("depends_on"), "threshold", F.struct(*runs.columns).alias("run"))
    found = wanted.join(had, ["network", "depends_on", "threshold"], "left")
    one = found.withColumn("n", F.count("run").over(Window.partitionBy("network", "heuristic", "threshold")))
    message = F.concat_ws(" ", F.lit("not one dependency run:"), "network", "heuristic", F.col("n").cast("string"))
    return one.withColumn("run", F.when(F.col("n") == 1, F.col("run")).otherwise(F.raise_error(message))).drop("n")


def param_grid(spark: SparkSession, valid=None, **values: list) -> DataFrame:
    """Every combination of the parameters' values for which valid(row as a dict) holds; the lists are short."""
    rows = [dict(zip(values, x, strict=True)) for x in product(*values.values())]
    return spark.createDataFrame([tuple(r.values()) for r in rows if valid is None or valid(r)], list(values))


def crossed(*frames: DataFrame, where: Column | None = None) -> DataFrame:
    """The grid of small parameter tables."""
    out = reduce(lambda a, b: a.crossJoin(b), frames)
    return out if where is None else out.where(where)


def feature_subsets(always: list[str], choices: list[str], least: int, most: int) -> list[list[str]]:
    return [always + list(c) for n in range(least, most + 1) for c in combinations(choices, n)]


def sorted_runs(runs: DataFrame, sort: str = "r_auc", ascending: bool = True) -> DataFrame:
    order = SORTS.get(sort, (sort,))
    return runs.orderBy(*(F.col(c).asc() if ascending else F.col(c).desc() for c in order))


def first_of(runs: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group; a tie goes by all columns that sort, so the choice is the same on every run."""
    rest = [c for c, t in runs.dtypes if not t.startswith("map")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return runs.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def deduplicated(runs: DataFrame, sort: str = "r_auc") -> DataFrame:
    """The best run of each (network, heuristic)."""
    return first_of(runs, ["network", "heuristic"], [F.col(c) for c in SORTS.get(sort, (sort,))])


def best_runs(runs: DataFrame, sorts: tuple[str, ...] = ("r_auc", "rem_num")) -> DataFrame:
    """Each network's best run by each sort, together, without repeats."""
    return reduce(DataFrame.unionByName, (first_of(runs, ["network"], [F.col(c) for c in SORTS[s]]) for s in sorts)).distinct()


def shown_first(runs: DataFrame, n: int, sort: str = "r_auc") -> DataFrame:
    return first_of(runs, ["network"], [F.col(c) for c in SORTS.get(sort, (sort,))], n)


def long_means(runs: DataFrame, value: str, index: list[str] | str = "network", column: str = "heuristic") -> DataFrame:
    """The mean of value per index and column."""
    keys = [index] if isinstance(index, str) else index
    return runs.groupBy(*keys, column).agg(F.avg(value).alias(value))


def normalised(means: DataFrame, value: str, over: str | list[str] = "network") -> DataFrame:
    """value by the least of its row (or, over another key, its column); null where the least is 0."""
    keys = [over] if isinstance(over, str) else over
    return means.withColumn(value, F.try_divide(F.col(value), F.min(value).over(Window.partitionBy(*keys))))


def complete_columns(means: DataFrame, value: str, index: str = "network", column: str = "heuristic") -> DataFrame:
    """Only columns with a value in every row."""
    n = means.agg(F.countDistinct(index).alias("rows"))
    full = means.where(F.col(value).isNotNull()).groupBy(column).agg(F.countDistinct(index).alias("n")).join(n, F.col("n") == F.col("rows")).select(column)
    return means.join(full, column, "left_semi")


def complete_rows(means: DataFrame, value: str, index: str = "network", column: str = "heuristic") -> DataFrame:
    return complete_columns(means, value, column, index)


def averages(means: DataFrame, value: str, column: str = "heuristic") -> DataFrame:
    return means.groupBy(column).agg(F.avg(value).alias(value))


def with_average(means: DataFrame, value: str, index: str = "network", column: str = "heuristic", label: str = "Average") -> DataFrame:
    """The rows, and one more whose index is `label` with the mean of each column."""
    return means.select(index, column, value).unionByName(averages(means, value, column).select(F.lit(label).alias(index), column, value))


def with_average_column(means: DataFrame, value: str, index: str = "network", column: str = "heuristic", label: str = "Average") -> DataFrame:
    """The rows, and one more column `label` with the mean of each row of the index."""
    return means.select(index, column, value).unionByName(averages(means, value, index).select(index, F.lit(label).alias(column), value))


def least_or(runs: DataFrame, value: str, keys: list[str], default: float = float("inf")) -> DataFrame:
    """The least value of each group, default where it has none: where an early stop begins."""
    return runs.groupBy(*keys).agg(F.coalesce(F.min(value).cast("double"), F.lit(default)).alias(value))


def listed(runs: DataFrame, names: list[str], column: str = "network") -> DataFrame:
    """Only the runs of listed networks; the list is a table, so it may be long."""
    return runs.join(runs.sparkSession.createDataFrame([(n,) for n in names], f"{column} string").distinct(), column, "left_semi")


def column_means(table: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of each column over all simulation rows."""
    return table.agg(*(F.avg(c).alias(c) for c in columns))


def scaled(means: DataFrame, value: str, factor: float = 100, digits: int = 1) -> DataFrame:
    """Times factor, rounded half to even."""
    return means.withColumn(value, F.bround(F.col(value) * factor, digits))


def clipped(means: DataFrame, value: str, most: float = 3) -> DataFrame:
    return means.withColumn(value, F.least(F.col(value), F.lit(float(most))))


def method_order(means: DataFrame, value: str, methods: DataFrame) -> DataFrame:
    """heuristic, includes_reinsertion, average, place: without reinsertion first, then by average."""
    avg = averages(means, value).join(methods.select("heuristic", "includes_reinsertion"), "heuristic", "left").withColumn("includes_reinsertion", F.coalesce("includes_reinsertion", F.lit(False)))
    return avg.withColumn("place", F.row_number().over(Window.orderBy("includes_reinsertion", value, "heuristic")))


def pivoted(means: DataFrame, value: str, columns: list[str], index: list[str] | str = "network", column: str = "heuristic") -> DataFrame:
    """The wide table; the list of columns spares the search for them. Index and column may be swapped."""
    keys = [index] if isinstance(index, str) else index
    return means.groupBy(*keys).pivot(column, columns).agg(F.avg(value))


def nan_census(means: DataFrame, value: str, index: str = "network", column: str = "heuristic") -> DataFrame:
    """column, missing: rows of the index without a value."""
    rows = means.agg(F.countDistinct(index).alias("rows"))
    return means.groupBy(column).agg(F.count(value).alias("n")).join(rows).select(column, (F.col("rows") - F.col("n")).alias("missing"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def one_row_each(runs: DataFrame) -> DataFrame:
    """The runs, or an error where a network has two of one heuristic."""
    n = F.count(F.lit(1)).over(Window.partitionBy("network", "heuristic"))
    return runs.withColumn("_n", n).withColumn("heuristic", F.when(F.col("_n") == 1, F.col("heuristic")).otherwise(F.raise_error(F.concat(F.lit("two runs of "), F.col("heuristic"))))).drop("_n")


def curve_points(runs: DataFrame) -> DataFrame:
    """network, heuristic and the fields of each removal: what a plot of curves shows."""
    return runs.select("network", "heuristic", F.inline("removals"))


#: Markers of plotted curves, dealt in this order.
MARKERS = ("o", "s", "^", "v", "D", "*", "P", "X")


def plot_points(runs: DataFrame, methods: DataFrame) -> DataFrame:
    """The points of the curves with each method's colour (null: the plotter's own) and its marker, by the method's place in the table of methods."""
    marks = F.array(*(F.lit(m) for m in MARKERS))
    place = F.row_number().over(Window.orderBy("heuristic")) - 1
    look = methods.select("heuristic", "plot_color", F.get(marks, place % len(MARKERS)).alias("marker"))
    return curve_points(runs).join(look, "heuristic", "left")


def latex_table(table: DataFrame, most_rows: int = 1000) -> str:
    """A LaTeX table of a wide, small table; each row's least number is bold."""
    rows = table.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    names = table.columns
    out = ["\\begin{tabular}{" + "l" + "r" * (len(names) - 1) + "}", " & ".join(names) + r" \\ \hline"]
    for r in rows:
        numbers = [v for v in r[1:] if isinstance(v, (int, float))]
        least = min(numbers, default=None)
        out.append(" & ".join([str(r[0]), *("" if v is None else rf"\textbf{{{v}}}" if v == least else str(v) for v in r[1:])]) + r" \\")
    return "\n".join([*out, "\\end{tabular}"])


def extend_filename(file: str | Path, extension: str | None = None, *suffixes: str) -> Path:
    """'a/b.csv', suffixes x and y -> 'a/b_x_y.csv'."""
    p = Path(file)
    return p.with_name("_".join([p.stem, *suffixes]) + (extension or p.suffix))


def table_plan(runs: DataFrame, methods: DataFrame, value: str = "r_auc", predicate: str | None = None, row_nan: bool = False, column_nan: bool = False) -> DataFrame:
    """The report in long form: filtered, labelled, averaged over repeats, normalised by each network's best, with the Average row, in percent."""
    named = short_names(dynamic_suffix(queried(average_damage(runs), predicate)), methods)
    means = long_means(named, value)
    means = complete_rows(means, value) if row_nan else means
    means = complete_columns(means, value) if column_nan else means
    return scaled(with_average(normalised(means, value), value), value)
