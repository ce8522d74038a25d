"""What the operators of this subpackage share: reading, shared tables, text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, kept, scratch, shared_dir, shared_path, written  # noqa: F401  the operators take them from here

#: White space of the text rules: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores after them as make them differ from every column in taken."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; at a task's end the worker gives its free memory back, as it may stay idle beside other stages."""

    def run(batches):
        yield from fn(batches)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crammed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, by byte planes, compressed."""
    n, pack, parts = len(columns[0]), zstandard.ZstdCompressor(level=1).compress, []
    for c in columns:
        planes = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(n, 8).T
        used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
        parts += [bytes([used]), planes[:used].tobytes()]
    return n.to_bytes(4, "little") + pack(b"".join(parts))


def uncrammed(body: bytes, columns: int) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(body[:4], "little"), zstandard.ZstdDecompressor().decompress(body[4:]), 0, []
    for _ in range(columns):
        used = raw[at]
        full = np.zeros((n, 8), np.uint8)
        full[:, :used] = np.frombuffer(raw, np.uint8, used * n, at + 1).reshape(used, n).T
        out.append(full.reshape(-1).view("<u8"))
        at += 1 + used * n
    return out


def packed_words(words: list[bytes]) -> bytes:
    sizes = crammed(np.fromiter(map(len, words), np.int64, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpacked_words(body: bytes) -> list[bytes]:
    n = int.from_bytes(body[:4], "little")
    ends = np.cumsum(uncrammed(body[4 : 4 + n], 1)[0].astype(np.int64)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(body[4 + n :])
    return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def stepped(x: np.ndarray) -> np.ndarray:
    """Each number less the one before: rising ones pack smaller so."""
    return np.diff(x, prepend=0)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def first_of_each(sign: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the least place of each sign, and of all rows of another place than that of their sign's."""
    order = np.lexsort((*place[::-1], *sign[::-1]))
    if not len(order):
        return order, order
    new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in sign], axis=0)]
    lead = order[new]
    of = lead[np.cumsum(new) - 1]
    return lead, order[np.any([c[order] != c[of] for c in place], axis=0)]
