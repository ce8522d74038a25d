"""Written networks against what was written."""

from pathlib import Path

from fragspark import cli
from fragspark.sources import graphs as IO


def networks(spark):
    rows = [("g", 3, 7), ("g", 3, 2500), ("g", 3, 9), ("g", 7, 9), ("g", 40, 40), ("h", 5, 6)]
    return spark.createDataFrame(rows, "network string, src long, dst long")


def lines(folder):
    return [x for f in sorted(Path(folder).glob("part-*")) for x in f.read_text().splitlines()]


def test_adjacency(spark, tmp_path):
    IO.write_adjacency(networks(spark), f"{tmp_path}/out")
    assert sorted(lines(f"{tmp_path}/out/network=g")) == ["3 2500", "3 7 9", "40", "7 9"]
    got = IO.adjacency_list(spark, f"{tmp_path}/out/network=g").select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(3, 7), (3, 9), (3, 2500), (7, 9), (40, 40)]


def test_pajek(spark, tmp_path):
    IO.write_pajek(networks(spark), f"{tmp_path}/out")
    assert lines(f"{tmp_path}/out/network=g") == ["*Vertices 5", '1 "3"', '2 "7"', '3 "9"', '4 "40"', '5 "2500"', "*Edges", "1 2", "1 3", "1 5", "2 3"]
    assert lines(f"{tmp_path}/out/network=h") == ["*Vertices 2", '1 "5"', '2 "6"', "*Edges", "1 2"]
    got = IO.pajek(spark, f"{tmp_path}/out/network=h").where("a != b").collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_convert_and_nothing_to_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "net.el").write_text("1 2\n2 3\n")
    cli.main(["convert", "-i", f"{tmp_path}/in", "-o", f"{tmp_path}/out", "-eo", "pajek"], spark)
    assert lines(f"{tmp_path}/out/network=net") == ["*Vertices 3", '1 "1"', '2 "2"', '3 "3"', "*Edges", "1 2", "2 3"]
    assert IO.pajek_lines(networks(spark).where("false")).collect() == []
