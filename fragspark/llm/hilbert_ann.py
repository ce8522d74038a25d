"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors to a few dimensions (an orthonormal random basis), shifts them, and orders
them by their place on a Hilbert curve. The order is cut into ranges at quantiles of a bounded sample, ties split by a
hash, so many copies of one vector fill no range beyond its size; every row lies in one range of each curve. A query
goes to its own range and the neighbouring ones (`share` of all rows to either side); what the windows hold is scored
with the original vectors, and the best of all curves are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

CURVES, DIMS, LEVELS, SHARE, RANGES, RANGE_ROWS, SAMPLE_ROWS, QUERY_ROWS = 4, 4, 8, 0.2, 20, 8192, 4096, 4096
DEALT = pa.schema([("curve", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("query", pa.bool_()), ("id", pa.int64()), ("vector", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**levels: Gray-code transposition, then bits interleaved."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(levels - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(levels - 1, 0, -1):
        turn ^= np.where((x[:, -1] & (1 << level)) > 0, (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(levels - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


class Curves:
    """The bases, shifts and scales of the curves, and where their orders are cut."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, ranges: int, curves: int = CURVES, dims: int = DIMS, seed: int = 11):
        g, d = np.random.default_rng(seed), sample.shape[1]
        self.bases = [np.linalg.qr(g.normal(size=(d, min(dims, d))))[0] for _ in range(curves)]
        self.shifts = [g.random(b.shape[1]) for b in self.bases]
        spread = [sample @ b for b in self.bases]
        self.low = [p.mean(0) - 3.5 * p.std(0) for p in spread]
        self.width = [np.maximum(7 * p.std(0), 1e-12) for p in spread]
        ties = self.ties(ids)
        self.cuts = []
        for c in range(curves):
            keys = self.keys(c, sample)
            order = np.lexsort((ties, keys))
            at = order[(np.arange(1, ranges) * len(order)) // ranges]
            self.cuts.append((keys[at], ties[at]))

    @staticmethod
    def ties(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)

    def keys(self, c: int, vectors: np.ndarray) -> np.ndarray:
        side = 1 << LEVELS
        place = ((vectors @ self.bases[c] - self.low[c]) / self.width[c] + self.shifts[c]) / 2
        return hilbert_keys(np.clip(place * side, 0, side - 1).astype(np.int64), LEVELS)

    def cells(self, c: int, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The range of each vector on curve c: how many cuts are not beyond its (key, tie)."""
        keys, ties = self.keys(c, vectors), self.ties(ids)
        cut_keys, cut_ties = self.cuts[c]
        low, high = np.searchsorted(cut_keys, keys, "left"), np.searchsorted(cut_keys, keys, "right")
        cell = low.copy()
        for i in np.flatnonzero(low < high):
            cell[i] = low[i] + np.searchsorted(cut_ties[low[i] : high[i]], ties[i], "right")
        return cell


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = F.col("vector")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, share: float = SHARE, curves: int = CURVES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every` the k rows of largest inner product found.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither do rows with a null
    id or with another length than most rows. Ties go to the smaller id. Rows that repeat an id count once (their best
    score) and are no candidates of their own id. With k rows or fewer in the windows, all are returned. Scores are inner products of
    the original vectors in double precision. The sample that places the cuts has SAMPLE_ROWS rows; every row is indexed.
    """
    vectors = usable(embeddings, id_col, vector_col)
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0].d, sizes[0].n
    vectors = vectors.where(F.size("vector") == d)
    ranges = max(1, min(RANGES, n // 256), -(-n // RANGE_ROWS) if n > RANGES * RANGE_ROWS else 1)
    reach = -(-int(1000 * share) * ranges // 1000)
    parts = max(1, -(-int(n / every * min(1, 2 * share)) // QUERY_ROWS))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    sent = embeddings.sparkSession.sparkContext.broadcast(Curves(np.array([r.vector for r in sample]), np.array([r.id for r in sample], np.int64), ranges, curves))

    def deal(batches):
        index = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            raw = [r.tobytes() for r in x]
            asks = np.flatnonzero(ids % every == 0)
            for c in range(curves):
                cells = index.cells(c, x, ids)
                for part in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c), pa.int32()), pa.array(cells, pa.int32()), pa.array(np.full(len(ids), part), pa.int32()), pa.array(np.zeros(len(ids), bool)), pa.array(ids), pa.array(raw, pa.binary())], schema=DEALT)
                rows = [(c, cell, int(ids[i] // every % parts), True, int(ids[i]), raw[i]) for i in asks for cell in range(max(0, cells[i] - reach), min(ranges, cells[i] + reach + 1))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), DEALT, strict=True)], schema=DEALT)

    def score(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        ids = table.column("id").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, d)
        out = []
        c_ids, c_x = ids[~asks], x[~asks]
        norm = np.sqrt((c_x * c_x).sum(1).max()) if len(c_x) else 0
        for start in range(0, int(asks.sum()) if len(c_x) else 0, 256):
            q_ids, q = ids[asks][start : start + 256], x[asks][start : start + 256]
            s = q @ c_x.T
            s[q_ids[:, None] == c_ids[None, :]] = -np.inf
            best = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
            for i, (qid, least) in enumerate(zip(q_ids.tolist(), best, strict=True)):
                # Products of one matrix call may differ in the last bit: near ties are scored again, each in the same order.
                near = np.flatnonzero((s[i] >= least - 1e-12 * norm * np.sqrt(q[i] @ q[i])) & (s[i] > -np.inf))
                again = (c_x[near] * q[i]).sum(1)
                top = np.lexsort((c_ids[near], -again))[:k]
                out.append((np.full(len(top), qid), c_ids[near][top], again[top]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    dealt = arrow_map(vectors, deal, "curve int, cell int, part int, query boolean, id long, vector binary")
    found = dealt.groupBy("curve", "cell", "part").applyInArrow(score, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
