"""Graph files as edges(network, src, dst) or pairs(network, a, b, weight); the network is the file's stem."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import clean_edges, with_isolated, zero_based
from ..operators.ranges import numbered as places
from ..tables import written
from .places import numbered_lines

EXTENSIONS = ("graphml", "gt", "csv", "el", "edge", "edges", "edgelist", "txt", "adj", "adjacency", "net", "pajek", "parquet")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_networks(spark: SparkSession, location: str, pattern: str = "*", extensions: tuple[str, ...] = ("graphml", "gt")) -> list[str]:
    """Paths in location that fit pattern and an extension, sorted; an error if there are none. Any Hadoop file system."""
    fs, _ = _hadoop(spark, location)
    found = []
    for ext in extensions:
        found += [str(s.getPath()) for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{pattern}.{ext}")) or []]
    if not found:
        raise FileNotFoundError(f"no network fits {pattern} in {location}")
    return sorted(found)


def network_of_path(path: Column) -> Column:
    """The stem of the file; of a folder with a known ending, as Spark writes, that of the folder. Every line asks, so the path is cut without patterns that search all of it."""
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    ending = F.substring_index(folder, ".", -1)
    known = path.contains("/") & ending.isin(*EXTENSIONS) & (F.length(folder) > F.length(ending) + 1)
    stem = F.regexp_extract(F.substring_index(path, "/", -1), r"^(.*?)(\.[^.]*)?(\.(gz|bz2|xz|zst))?$", 1)
    return F.when(known, F.substring(folder, F.lit(1), F.length(folder) - F.length(ending) - 1)).otherwise(stem)


def network_of_file() -> Column:
    return network_of_path(F.col("_metadata.file_path"))


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(network_of_file().alias("network"), F.trim("value").alias("line")).where("line != '' and not line like '#%' and not line like '\\%%'")


def numbered(pairs: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (network, a, b, ...) and vertices (network, v) with names in place of ids -> the same with whole numbers.

    Where all names of a network are whole numbers, or all are n and a number, these are the ids; else its names are
    numbered from 0 in their order. A null name stays null. One reading tells a network's kind; ids that stand in the
    names need no join, only names of other networks are gathered and numbered, over ranges.
    """
    plain, dotted = (lambda c, form=form: F.coalesce(F.col(c).rlike(form), F.lit(True)) for form in (r"^-?\d{1,18}$", r"^n\d{1,18}$"))
    seen = pairs.groupBy("network").agg(F.every(plain("a") & plain("b")).alias("plain"), F.every(dotted("a") & dotted("b")).alias("dotted"))
    if vertices is not None:
        seen = seen.unionByName(vertices.groupBy("network").agg(F.every(plain("v")).alias("plain"), F.every(dotted("v")).alias("dotted")))
    kinds = written(seen.groupBy("network").agg(F.every("plain").alias("plain"), F.every("dotted").alias("dotted")), "kinds")  # one row per network
    other = kinds.where("not plain and not dotted").select("network")
    ids = None
    if not other.isEmpty():
        names = pairs.select("network", F.explode(F.array("a", "b")).alias("name"))
        if vertices is not None:
            names = names.unionByName(vertices.select("network", F.col("v").alias("name")))
        placed = written(places(names.join(F.broadcast(other), "network", "left_semi").where("name is not null").distinct(), ["network", "name"]), "names")
        first = placed.groupBy("network").agg(F.min("place").alias("first"))
        ids = placed.join(F.broadcast(first), "network").select("network", "name", (F.col("place") - F.col("first")).cast("long").alias("id"))

    def with_ids(rows: DataFrame, column: str) -> DataFrame:
        found = F.when(F.col("plain"), F.col(column).try_cast("long")).when(F.col("dotted"), F.substring(column, 2, 18).try_cast("long"))
        if ids is None:
            return rows.withColumn(column, found)
        return rows.join(ids.withColumnRenamed("name", column), ["network", column], "left").withColumn(column, found.otherwise(F.col("id"))).drop("id")

    rest = [c for c in pairs.columns if c not in ("network", "a", "b")]
    out = with_ids(with_ids(pairs.join(F.broadcast(kinds), "network"), "a"), "b").select("network", "a", "b", *rest)
    alone = None if vertices is None else with_ids(vertices.where("v is not null").join(F.broadcast(kinds), "network"), "v").select("network", "v")
    return out, alone


def edge_list(spark: SparkSession, paths, sep: str | None = None, one_based: bool = False) -> DataFrame:
    """Pairs a, b and a weight (null if the file has none) from lines of separated fields; sep None: white space, or commas in .csv files.

    A heading (the one line of a file of numbers whose first two fields are none) is left out; names become numbers by
    numbered(). A line of one field is a vertex without edges: the pair (a, a).
    """
    fields = F.split(F.trim("line"), r"[,\s]+" if sep is None else re.escape(sep))
    rows = _lines(spark, paths).select("network", fields.alias("f")).select("network", F.try_element_at("f", F.lit(1)).alias("a"), F.coalesce(F.try_element_at("f", F.lit(2)), F.try_element_at("f", F.lit(1))).alias("b"), F.try_element_at("f", F.lit(3)).try_cast("double").alias("weight"))
    odd = ~(F.col("a").rlike(r"^-?\d{1,18}$") & F.col("b").rlike(r"^-?\d{1,18}$"))
    heads = rows.groupBy("network").agg(F.count_if(odd).alias("odd"), F.count(F.lit(1)).alias("lines")).where("odd = 1 and lines > 1").select("network", F.lit(True).alias("headed"))
    rows = numbered(rows.join(heads, "network", "left").where(~(F.coalesce("headed", F.lit(False)) & odd)).drop("headed"))[0]
    return zero_based(rows) if one_based else rows


def adjacency_list(spark: SparkSession, paths) -> DataFrame:
    """Lines of a vertex and its neighbours; a vertex alone gives the pair (a, a)."""
    rows = _lines(spark, paths).select("network", F.split("line", r"\s+").alias("f"))
    ends = F.when(F.size("f") > 1, F.slice("f", 2, F.size("f"))).otherwise(F.slice("f", 1, 1))
    return numbered(rows.select("network", F.col("f")[0].alias("a"), F.explode(ends).alias("b")))[0].withColumn("weight", F.lit(None).cast("double"))


def pajek(spark: SparkSession, paths) -> DataFrame:
    """Edges and arcs of Pajek files: lines of numbers; vertex lines (a number and a label in quotes, or a number alone) give the pair (a, a)."""
    rows = _lines(spark, paths).where("not line like '*%'").select("network", "line", F.split("line", r"\s+").alias("f"))
    plain = F.forall("f", lambda x: x.rlike(r"^-?[0-9.]+$")) & (F.size("f") >= 2)
    return rows.select("network", F.col("f")[0].try_cast("long").alias("a"), F.when(plain, F.try_element_at("f", F.lit(2)).try_cast("long")).otherwise(F.col("f")[0].try_cast("long")).alias("b"), F.when(plain, F.try_element_at("f", F.lit(3)).try_cast("double")).alias("weight"))


def graphml(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(vertices(network, v), pairs) of GraphML files; names become numbers by numbered()."""
    name = network_of_file().alias("network")
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(paths).select(name, F.col("_id").cast("string").alias("v"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(paths).select(name, F.col("_source").cast("string").alias("a"), F.col("_target").cast("string").alias("b"))
    pairs, vertices = numbered(edges, nodes)
    return vertices, pairs.withColumn("weight", F.lit(None).cast("double"))


def typed_lines(spark: SparkSession, paths) -> DataFrame:
    """network, kind, ids: lines of a one-letter kind (D, E, S, V, F) and numbers."""
    f = F.split("line", r"\s+")
    return _lines(spark, paths).select("network", F.substring("line", 1, 1).alias("kind"), F.transform(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), lambda x: x.try_cast("long")).alias("ids")).where("kind rlike '[DESVF]'")


READERS = {"csv": edge_list, "el": edge_list, "edge": edge_list, "edges": edge_list, "edgelist": edge_list, "txt": edge_list, "adj": adjacency_list, "adjacency": adjacency_list, "net": pajek, "pajek": pajek}


def load_networks(spark: SparkSession, location: str, pattern: str = "*", extensions: tuple[str, ...] = EXTENSIONS, most_vertices: int | None = None) -> DataFrame:
    """Clean edges of all network files of a folder, and a row (v, v) for each vertex without edges, so that sizes count it.

    Networks with more than most_vertices vertices are left out. gt and pickle files are refused: the one needs its own
    library, the other is unsafe.
    """
    parts = []
    for path in list_networks(spark, location, pattern, extensions):
        ext = path.rsplit(".", 1)[-1].lower()
        if ext == "parquet":
            pairs = spark.read.parquet(path).withColumnsRenamed({"src": "a", "dst": "b"})
        elif ext == "graphml":
            nodes, pairs = graphml(spark, path)
            pairs = pairs.select("network", "a", "b").unionByName(nodes.select("network", F.col("v").alias("a"), F.col("v").alias("b")))
        elif ext in READERS:
            pairs = READERS[ext](spark, path)
        else:
            raise ValueError(f"no reader for {path}")
        parts.append(pairs.select("network", "a", "b"))
    out = reduce(DataFrame.unionByName, parts)
    edges = with_isolated(clean_edges(out), out.select("network", F.explode(F.array("a", "b")).alias("v")))
    if most_vertices is not None:
        n = edges.select("network", F.explode(F.array("src", "dst")).alias("v")).groupBy("network").agg(F.countDistinct("v").alias("n")).where(F.col("n") <= most_vertices)
        edges = edges.join(n.select("network"), "network", "left_semi")
    return edges


def load_locations(spark: SparkSession, locations: list[str], **options) -> DataFrame:
    """load_networks over several folders; missing ones are passed over."""
    out = None
    for x in locations:
        fs, p = _hadoop(spark, x)
        if fs.exists(p):
            part = load_networks(spark, x, **options)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"none of {locations} is there")
    return out


def with_attributes(vertices: DataFrame, attributes: DataFrame, contiguous: bool = False) -> DataFrame:
    """Vertices with the columns of a table (network, v, ...) beside them; contiguous: an error where a network's attributes are not those of vertices 0 to n - 1."""
    if contiguous:
        n = attributes.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        good = (F.col("n") == F.col("m")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
        checked = n.select("network", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("vertices are not 0 to n - 1 in "), F.col("network"))).cast("boolean")).alias("_good"))
        attributes = attributes.join(checked.where("_good"), "network").drop("_good")
    return vertices.join(attributes, ["network", "v"], "left")


def read_attributes(spark: SparkSession, paths, name: str = "value", sep: str = ",") -> DataFrame:
    """network, v, name: a value in each line is that of vertex 0, 1, ...; or lines of a vertex and its value."""
    lines = numbered_lines(spark, paths)
    rows = lines.select(network_of_path(F.col("file")).alias("network"), F.col("idx").alias("i"), F.col("value").alias("line")).where("trim(line) != ''")
    f = F.split(F.trim("line"), re.escape(sep))
    return rows.select("network", F.when(F.size(f) > 1, f[0].try_cast("long")).otherwise(F.col("i")).cast("long").alias("v"), F.element_at(f, -1).try_cast("double").alias(name))


def write_edge_list(edges: DataFrame, path: str, sep: str = " ") -> None:
    """A vertex without edges is a line of one field."""
    edges.select(F.when(F.col("src") == F.col("dst"), F.col("src").cast("string")).otherwise(F.concat_ws(sep, "src", "dst")).alias("value"), "network").write.partitionBy("network").text(path)


#: Vertices that one line of an adjacency list spans: a hub's neighbours take several lines.
SPAN = 1000


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Lines of a vertex and its higher neighbours, those of one span of ids in a line; a vertex without edges is a line of its own."""
    lines = edges.groupBy("network", "src", F.floor(F.col("dst") / SPAN).alias("span")).agg(F.array_sort(F.collect_set("dst")).alias("ends"))
    others = F.filter("ends", lambda x: x != F.col("src"))
    lines.select(F.concat_ws(" ", F.col("src").cast("string"), F.transform(others, lambda x: x.cast("string"))).alias("value"), "network").write.partitionBy("network").text(path)


def pajek_lines(edges: DataFrame) -> DataFrame:
    """network, k, i, j, value: Pajek's headings, vertices (numbered from 1 by their ids, which are their labels) and edges, to be sorted by the columns before the last."""
    ids = written(places(edges.select("network", F.explode(F.array("src", "dst")).alias("v")).distinct(), ["network", "v"]), "vertices")
    first = ids.groupBy("network").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    named = ids.join(first, "network").select("network", "v", "n", (F.col("place") - F.col("first") + 1).alias("i"))
    pairs = edges.where("src != dst").join(named.select("network", F.col("v").alias("src"), F.col("i").alias("a")), ["network", "src"]).join(named.select("network", F.col("v").alias("dst"), F.col("i").alias("b")), ["network", "dst"])
    none = F.lit(0).cast("long")
    return (
        first.select("network", F.lit(0).alias("k"), none.alias("i"), none.alias("j"), F.format_string("*Vertices %d", "n").alias("value"))
        .union(named.select("network", F.lit(1), "i", none, F.format_string('%d "%d"', "i", "v")))
        .union(first.select("network", F.lit(2), none, none, F.lit("*Edges")))
        .union(pairs.select("network", F.lit(3), "a", "b", F.format_string("%d %d", "a", "b")))
    )


def write_pajek(edges: DataFrame, path: str) -> None:
    """A folder per network whose files, by name, hold its Pajek text in order: a large network takes several."""
    order = ["network", "k", "i", "j"]
    pajek_lines(edges).repartitionByRange(*order).sortWithinPartitions(*order).select("network", "value").write.partitionBy("network").text(path)


def graphml_lines(edges: DataFrame) -> DataFrame:
    """network, value: the lines of each network's GraphML text, those of a network in order within one task."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'
    names = edges.select("network").distinct()
    vertex = edges.select("network", F.explode(F.array("src", "dst")).alias("v")).distinct()
    lines = (
        names.select("network", F.lit(0).alias("k"), F.lit(0).cast("long").alias("i"), F.lit(head).alias("value"))
        .union(vertex.select("network", F.lit(1), "v", F.format_string('<node id="n%d"/>', "v")))
        .union(edges.where("src != dst").select("network", F.lit(2), "src", F.format_string('<edge source="n%d" target="n%d"/>', "src", "dst")))
        .union(names.select("network", F.lit(3), F.lit(0).cast("long"), F.lit("</graph></graphml>")))
    )
    return lines.repartition("network").sortWithinPartitions("network", "k", "i", "value").select("network", "value")


def write_graphml(edges: DataFrame, path: str) -> None:
    """One GraphML text per network, in files partitioned by network."""
    graphml_lines(edges).write.partitionBy("network").text(path)
