"""Removal sets that leave no cycle, by messages along edges.

Each vertex of the 2-core has a time: 0 for removed (cost 1), else the round in which it falls as a leaf, when at most one
neighbour has its time or a later one. A message of an edge tells its end what the part behind it costs at each time:
`before`, when the end's time is later, and `after`, when it is the one neighbour with the same or a later time. Messages
are rows of a table of directed edges with one array each. A round is one shuffle that brings the messages to their
vertex: there they are added up (sums, and the two least of what one exception gains), and each message's answer is the
total without its own part. What a task holds is bounded: a hub's messages wait in a file until their total is known.
A reinforcement pulls vertices to their best time, and the rounds end when no time changes any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from tempfile import TemporaryFile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .components import components, k_core
from .graph import both_ways, degrees

FAR = 1e9


def arrays(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` doubles from a column of binaries of that length."""
    if not len(column):
        return np.empty((0, width))
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, "<f8", len(column) * width, first).reshape(-1, width)


def binaries(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, "<f8"))])


def parts(messages: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each incoming message: the cost of a removed end, the cost of the part falling earlier, what it gains as the one exception."""
    columns = np.ascontiguousarray(messages.T)  # by time: numpy's loops run along the messages
    before, after = columns[:t], columns[t:]
    zero = before.min(0)
    earlier, later = np.full(before.shape, FAR), np.full(before.shape, FAR)
    earlier[1:] = np.minimum.accumulate(np.concatenate([before[:1], after[1:]]), 0)[:-1]
    later[1:] = after[1:]
    tail = np.minimum.accumulate(before[:0:-1], 0)[::-1]
    later[1:-1] = np.minimum(later[1:-1], tail[1:])
    return zero, np.ascontiguousarray(earlier.T), np.ascontiguousarray(np.minimum(0, later - earlier).T)


def merged(key: np.ndarray, rows: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals by key of rows (sum of zeros, sums of earlier, least gain, how often, next gain): distinct keys and their totals."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    out = np.empty((len(at), rows.shape[1]))
    out[:, : t + 1] = np.add.reduceat(rows[:, : t + 1], at) if len(at) else 0
    first, times, second = (rows[:, 1 + t * i : 1 + t * (i + 1)] for i in (1, 2, 3))
    if len(at):
        least = np.minimum.reduceat(first, at)
        of = np.repeat(least, np.diff(np.r_[at, len(key)]), axis=0)
        same = first == of
        out[:, 1 + t : 1 + 2 * t] = least
        out[:, 1 + 2 * t : 1 + 3 * t] = np.add.reduceat(np.where(same, times, 0), at)
        out[:, 1 + 3 * t :] = np.minimum.reduceat(np.where(same, second, first), at)
    return key[at], out


def totals(found: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """merged() of the parts of incoming messages by the vertex they come to."""
    zero, earlier, gain = found
    return merged(key, np.concatenate([zero[:, None], earlier, gain, np.ones(gain.shape), np.zeros(gain.shape)], 1), t)


def answers(found: tuple[np.ndarray, np.ndarray, np.ndarray], sent: np.ndarray, total: np.ndarray, bias: np.ndarray, t: int, damp: float) -> np.ndarray:
    """To each incoming message, given by its parts, the one that goes back, without that message's own part of the total."""
    zero, earlier, gain = found
    first, times, second = (total[:, 1 + t * i : 1 + t * (i + 1)] for i in (1, 2, 3))
    other = np.where((gain <= first) & (times == 1), second, first)
    after = bias + total[:, 1 : 1 + t] - earlier
    before = after + other
    after[:, 0] = before[:, 0] = bias[:, 0] + total[:, 0] - zero
    new = np.concatenate([before, after], 1)
    new -= np.ascontiguousarray(new.T).min(0)[:, None]
    return damp * sent + (1 - damp) * new


#: Rows of a round: a vertex (other null, message its pull) or a message that came to v from other, with what v sent last.
ROUND = "network string, v long, other long, message binary, sent binary, moved double, time int, still int"
_ROUND = pa.schema([("network", pa.string()), ("v", pa.int64()), ("other", pa.int64()), ("message", pa.binary()), ("sent", pa.binary()), ("moved", pa.float64()), ("time", pa.int32()), ("still", pa.int32())])
#: Messages of one vertex that a task holds; those of a larger hub wait in a file.
HELD_ROWS = 100_000


def _vertex_rows(own: pa.RecordBatch, total: np.ndarray, bias: np.ndarray, t: int, pull: float) -> pa.RecordBatch:
    """The vertices after a round: the next pull, their times and how long these stand."""
    cost = bias + total[:, 1 : 1 + t] + total[:, 1 + t : 1 + 2 * t]
    cost[:, 0] = bias[:, 0] + total[:, 0]
    time = cost.argmin(1)
    still = np.where(time == own.column("time").to_numpy(), own.column("still").to_numpy() + 1, 0)
    pulled = bias + np.minimum(50, pull * (cost - cost.min(1, keepdims=True)))
    none = [pa.nulls(len(time), _ROUND.field(c).type) for c in ("sent", "moved")]
    columns = [own.column("network"), own.column("v"), own.column("other"), binaries(pulled), *none, pa.array(time.astype(np.int32)), pa.array(still.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=_ROUND)


def _message_rows(got: pa.RecordBatch, found: tuple[np.ndarray, np.ndarray, np.ndarray], total: np.ndarray, bias: np.ndarray, t: int, damp: float) -> pa.RecordBatch:
    sent = arrays(got.column("sent"), 2 * t)
    new = answers(found, sent, total, bias, t, damp)
    none = [pa.nulls(len(new), pa.int32())] * 2
    columns = [got.column("network"), got.column("other"), got.column("v"), binaries(new), got.column("message"), pa.array(np.ascontiguousarray(np.abs(new - sent).T).max(0)), *none]
    return pa.RecordBatch.from_arrays(columns, schema=_ROUND)


def _kinds(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    vertex = rows.column("other").is_null()
    return rows.filter(vertex), rows.filter(pc.invert(vertex))


def _whole_vertices(rows: pa.RecordBatch, t: int, pull: float, damp: float, send: bool) -> Iterator[pa.RecordBatch]:
    """A round of vertices all of whose messages are among the rows."""
    of = np.cumsum(rows.column("other").is_null().to_numpy(False)) - 1  # a vertex comes before its messages
    own, got = _kinds(rows)
    mine = of[rows.column("other").is_valid().to_numpy(False)]
    total, bias = np.zeros((own.num_rows, 1 + 4 * t)), arrays(own.column("message"), t)
    found = parts(arrays(got.column("message"), 2 * t), t)
    key, sums = totals(found, mine, t)
    total[key] = sums
    yield _vertex_rows(own, total, bias, t, pull)
    if send and got.num_rows:
        yield _message_rows(got, found, total[mine], bias[mine], t, damp)


def _hub(chunks: Callable[[], Iterator[pa.RecordBatch]], t: int, pull: float, damp: float, send: bool) -> Iterator[pa.RecordBatch]:
    """The same of one vertex whose rows come in chunks, twice."""
    own, total = None, np.empty((0, 1 + 4 * t))
    for rows in chunks():
        vertex, got = _kinds(rows)
        own = vertex if vertex.num_rows else own
        total = np.concatenate([total, totals(parts(arrays(got.column("message"), 2 * t), t), np.zeros(got.num_rows, int), t)[1]])
        total = merged(np.zeros(len(total), int), total, t)[1]
    bias = arrays(own.column("message"), t)
    yield _vertex_rows(own, total, bias, t, pull)
    for rows in chunks() if send else ():
        got = _kinds(rows)[1]
        if got.num_rows:
            found = parts(arrays(got.column("message"), 2 * t), t)
            yield _message_rows(got, found, np.repeat(total, got.num_rows, 0), np.repeat(bias, got.num_rows, 0), t, damp)


def _round(rows: DataFrame, t: int, pull: float, damp: float, send: bool = True) -> DataFrame:
    """The rows after a round: messages meet their vertex in one shuffle, which gives it a new time, and its answers go out from there (without send: only times)."""

    def run(batches):
        held, n, file = [], 0, None  # rows of the last vertex seen, which may go on

        def spilled() -> Iterator[pa.RecordBatch]:
            file.seek(0)
            yield from pa.ipc.open_stream(file)
            yield from held

        def closed() -> Iterator[pa.RecordBatch]:
            if file is not None:
                writer.close()
                yield from _hub(spilled, t, pull, damp, send)
                file.close()
            elif held:
                yield from _whole_vertices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], t, pull, damp, send)

        for b in batches:
            if not b.num_rows:
                continue
            begins = np.flatnonzero(b.column("other").is_null().to_numpy(False))
            if file is not None and len(begins):  # a hub ends here
                held.append(b.slice(0, begins[0]))
                yield from closed()
                b, begins, held, file = b.slice(begins[0]), begins - begins[0], [], None
            if len(begins):
                held.append(b.slice(0, begins[-1]))
                if sum(x.num_rows for x in held):
                    yield from closed()
                held, n = [b.slice(begins[-1])], b.num_rows - begins[-1]
                continue
            held.append(b)
            n += b.num_rows
            if n > HELD_ROWS:
                if file is None:
                    file = TemporaryFile()
                    writer = pa.ipc.new_stream(file, b.schema)
                for x in held:
                    writer.write_batch(x)
                held, n = [], 0
        yield from closed()

    dealt = rows.repartition("network", "v").sortWithinPartitions("network", "v", "other")  # nulls, the vertices, come first
    return dealt.mapInArrow(run, ROUND)


def message_times(core: DataFrame, depth: int = 12, rounds: int = 10_000, force: float = 0.02, ramp: int = 20, damp: float = 0.1, noise: float = 1e-3, still: int = 5, tolerance: float = 1e-5) -> DataFrame:
    """network, v, time (0: removed) of the vertices of a 2-core (network, src, dst), by rounds of messages.

    The pull of the reinforcement grows by `force` over `ramp` rounds and on. Rounds end when no message moves by more
    than tolerance or no vertex changed its time in the last `still` rounds, at `rounds` at the latest.
    """
    t = depth + 1
    share = lambda i: F.pmod(F.xxhash64("network", "v", F.lit(i)), F.lit(1 << 20)) / float(1 << 20)

    @F.pandas_udf("binary")
    def field(*x: pd.Series) -> pd.Series:
        a = np.stack([c.to_numpy() for c in x], 1) * noise
        a[:, 0] += 1
        return pd.Series([r.tobytes() for r in np.ascontiguousarray(a, "<f8")])

    null = lambda kind: F.lit(None).cast(kind)
    vertices = degrees(core).select("network", "v", null("long").alias("other"), field(*(share(i) for i in range(t))).alias("message"), null("binary").alias("sent"), null("double").alias("moved"), F.lit(-1).alias("time"), F.lit(0).alias("still"))
    none = F.lit(bytes(16 * t))
    ways = both_ways(core).select("network", F.col("src").alias("v"), F.col("dst").alias("other"), none.alias("message"), none.alias("sent"), F.lit(FAR).alias("moved"), null("int").alias("time"), null("int").alias("still"))
    now = vertices.unionByName(ways)
    before: list[DataFrame] = []
    for r in range(rounds):
        now = written(_round(now, t, force * min(r / ramp, 50), damp, r < rounds - 1), "messages", *before, dictionary=False)
        before = [now]
        last = now.agg(F.min("still").alias("still"), F.max("moved").alias("moved")).first()
        if last.still is None or last.still >= still or last.moved is None or last.moved <= tolerance:
            break
    return written(now.where("other is null").select("network", "v", "time"), "times", *before)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that have no end among gone (network, v)."""
    return edges.join(gone.select("network", F.col("v").alias("src")), ["network", "src"], "left_anti").join(gone.select("network", F.col("v").alias("dst")), ["network", "dst"], "left_anti").select("network", "src", "dst")


def message_decycling(edges: DataFrame, depth: int = 12, rounds: int = 10_000, **options) -> DataFrame:
    """network, v: vertices whose removal leaves no cycle.

    Messages run on the 2-core. What cycles their times leave are broken in rounds: of the 2-core that is left, each
    vertex whose degree is the highest among its neighbours' goes (ties to the lowest vertex). Vertices without cycles
    around never go; a network without cycles gives no rows.
    """
    core = k_core(edges)
    times = message_times(core, depth, rounds, **options)
    gone = [times.where("time = 0").select("network", "v")]
    left = k_core(without(core, gone[0]))
    while not left.isEmpty():
        d = written(degrees(left), "degrees")
        ways = both_ways(left).join(d.select("network", F.col("v").alias("dst"), "degree"), ["network", "dst"])
        best = ways.groupBy("network", F.col("src").alias("v")).agg(F.max(F.struct("degree", (-F.col("dst")).alias("turned"))).alias("best"))
        top = written(d.join(best, ["network", "v"]).where(F.struct("degree", (-F.col("v")).alias("turned")) > F.col("best")).select("network", "v"), "top")
        gone.append(top)
        left = k_core(without(left, top))
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def cycles_left(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """network, vertices, edges, cycles: the number of independent cycles (edges - vertices + components) of what stays."""
    left = written(without(edges.where("src != dst"), gone), "left")
    n = left.groupBy("network").agg(F.count(F.lit(1)).alias("edges"))
    c = components(left).groupBy("network").agg(F.count(F.lit(1)).alias("vertices"), F.count_distinct("component").alias("components"))
    return n.join(c, "network").select("network", "vertices", "edges", (F.col("edges") - F.col("vertices") + F.col("components")).alias("cycles"))
