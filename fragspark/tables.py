"""Tables in the folder that the driver and all executors share: where iterations cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Tables written and not yet deleted, those of each open scratch() in a list of its own; the first list goes at exit.
_open: list[list[DataFrame]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir; on one machine, where that is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="fragspark-")
        atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *done: DataFrame, dictionary: bool = True) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and reread: lineage ends here, and a lost executor loses nothing.

    Tables of written() in `done` are deleted: nothing reads them any more. The others stay until the scratch() around
    ends or, without one, until the driver exits. Without dictionary for columns whose values hardly ever repeat.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(compression="zstd", **{"parquet.enable.dictionary": str(dictionary).lower()}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    _open[-1].append(out)
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        for own in _open:
            own[:] = [x for x in own if x.written_at != t.written_at]


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators write inside are deleted at its end: results that read them must be written or collected by then."""
    _open.append([])
    try:
        yield
    finally:
        discard(*_open[-1])
        _open.pop()


def kept(table: DataFrame) -> DataFrame:
    """The table outlives the scratch() that it was written in, and belongs to the one around."""
    own = next((x for x in _open[-1] if x.written_at == table.written_at), None)
    if own is not None and len(_open) > 1:
        _open[-1].remove(own)
        _open[-2].append(own)
    return table


@atexit.register
def _leave() -> None:
    with suppress(Exception):  # the session may be gone, and its folder with it
        discard(*_open[0])
