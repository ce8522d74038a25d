"""Row numbers within files against the files themselves."""

import pytest

from fragspark.sources import graphs as IO
from fragspark.sources import places as P
from fragspark.sources import runs as U


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def folder(tmp_path):
    texts = {"b.txt": [f"b{i} " + "x" * (i % 40) for i in range(300)], "a.txt": ["same", "same", "", "last"], "c.txt": [], "d.txt": [f"d{i}" for i in range(50)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    return texts


def test_lines_have_their_numbers_in_files_of_many_splits(spark, tmp_path, small_splits):
    texts = folder(tmp_path)
    rows = spark.read.text(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 4
    got = P.with_places(rows).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.idx, r.value) for r in got) == sorted((name, i, x) for name, lines in texts.items() for i, x in enumerate(lines))
    assert [r.value for r in sorted(got, key=lambda r: r.place)] == [x for name in sorted(texts) for x in texts[name]]
    assert sorted(r.place for r in got) == list(range(len(got)))


def test_one_row_of_a_file(spark, tmp_path, small_splits):
    texts = folder(tmp_path)
    one = spark.read.text(str(tmp_path / "b.txt"))
    assert [r.value for r in P.row_at(one, 257).collect()] == [texts["b.txt"][257]]
    assert P.row_at(one, 300).collect() == []
    assert P.with_places(spark.read.text(str(tmp_path / "c.txt"))).collect() == []


def test_columns_of_the_same_names_are_replaced(spark, tmp_path):
    spark.range(5).selectExpr("id", "'x' AS file", "-id AS idx", "7 AS place").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = P.with_places(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted((r.id, r.idx, r.place) for r in got) == [(i, i, i) for i in range(5)] and got[0].file.endswith(".parquet")


def test_runs_and_attributes_by_number(spark, tmp_path, small_splits):
    runs = spark.createDataFrame([("g", f"h{i}", i, [(1, i, 0.5, 0.25, 0.125)]) for i in range(40)], "network string, heuristic string, rem_num int, removals array<struct<removal_num int, id bigint, prediction double, lcc double, slcc double>>")
    at = f"{tmp_path}/runs.csv"
    U.export_csv(runs.coalesce(1), at)
    got = U.read_runs(spark, [at], bookkeeping=True).where("idx = 31").collect()
    assert [(r.heuristic, r.rem_num, r.place, r.removals[0].id) for r in got] == [("h31", 31, 31, 31)]
    (tmp_path / "net.csv").write_text("".join(f"{i / 2}\n" for i in range(200)) + "\n7\n")
    values = {r.v: r.value for r in IO.read_attributes(spark, str(tmp_path / "net.csv")).collect()}
    assert values == {**{i: i / 2 for i in range(200)}, 201: 7.0}
