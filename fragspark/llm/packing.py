"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents. Every round (a window of `window_sequences` sequences) adds a quantum to each
queue's credit: its target share of the window's tokens. A document goes out in the round in which its queue's credit
covers it; credit that does not cover the next document is the queue's deficit and is carried to the next round, over
windows and partitions, so no queue is ever ahead of its share, nor behind it by a document. A queue that is empty gets
nothing more, and the others go on in their proportions.

Credit only grows, so the round of a document is a function of its queue's tokens up to its end: a prefix sum over
tasks. The order of all documents is then (round, queue, tokens before); their places in it are a running sum over
ranges of that order, which Spark cuts at quantiles. Nothing walks a queue, no document is cut but at the ends of
sequences, and nothing is dropped or padded but the end of the last sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import arrow_map, written

SEQUENCE, WINDOW, END = 1024, 64, 0
#: Target proportions follow the queues' tokens to this power: below 1, small sources get more than they have in the corpus.
MIXTURE = 0.7
RANGE_DOCS = 500_000
DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("queue", pa.string()), ("task", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
DOCS_SQL = "row long, doc_id long, queue string, task long, before long, n long, ids binary"
PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
_held: dict = {}


def fast_encoder(path: str):
    """text -> ids as the tokenizers library gives them for the byte-level BPE file at path, by tiktoken's merges."""
    if path not in _held:
        import tiktoken

        from .bpe import PATTERN

        v = Vocabulary(path)
        ranks = {b: i for i, b in enumerate(v.token_bytes) if i not in set(v.special.values())}
        e = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)
        marks = tuple(v.special)
        _held[path] = lambda text: e.encode(text, allowed_special="all") if any(m in text for m in marks) else e.encode_ordinary(text)
    return _held[path]


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, queue, task, before, n, ids (16 or 32 bits each) of each row: `before` counts the queue's tokens earlier in the task."""

    def encode_all(batches):
        encode, task, before, number = fast_encoder(path), TaskContext.get().partitionId(), {}, 0
        for b in batches:
            out, held = [], 0
            for doc_id, text, queue in zip(*(b.column(i) for i in range(3)), strict=True):
                ids = np.array([*encode(text.as_py()), END], "<u4")
                queue = queue.as_py()
                at = before.get(queue, 0)
                before[queue] = at + len(ids)
                out.append(((task << 36) + number, doc_id.as_py(), queue, task, at, len(ids), (ids.astype("<u2") if ids.max() < 65536 else ids).tobytes()))
                held, number = held + len(ids), number + 1
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DOCS, strict=True)], schema=DOCS)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DOCS, strict=True)], schema=DOCS)

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), source.alias("queue"))
    return arrow_map(rows, encode_all, DOCS_SQL)


def queue_credits(rows: DataFrame, window: int, shares: dict[str, float] | None, power: float) -> DataFrame:
    """queue, task, base (the queue's tokens in earlier tasks), quantum (credit of a round), late (rounds that go before the queue's first)."""
    sums = rows.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    totals = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    if shares is None:
        totals = totals.withColumn("weight", F.pow("total", F.lit(power)))
    else:
        given = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "queue string, weight double")
        totals = totals.join(given, "queue", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = totals.withColumn("waits", F.col("weight") <= 0).withColumn("weight", F.when(F.col("waits"), F.col("total").cast("double")).otherwise(F.col("weight")))
    totals = written(totals, "totals")
    whole = {r.waits: r.weight for r in totals.groupBy("waits").agg(F.sum("weight").alias("weight")).collect()}  # two rows at most
    of = F.when(F.col("waits"), F.lit(whole.get(True, 1.0))).otherwise(F.lit(whole.get(False, 1.0)))
    totals = totals.withColumn("quantum", F.col("weight") / of * window)
    last = totals.where(~F.col("waits")).agg(F.max(F.ceil(F.col("total") / F.col("quantum")))).first()[0] or 0
    late = totals.select("queue", "quantum", F.when(F.col("waits"), F.lit(last)).otherwise(0).cast("long").alias("late"))
    return written(sums.withColumn("base", F.coalesce(ahead, F.lit(0))).join(late, "queue").select("queue", "task", "base", "quantum", "late"), "credits")


def served(rows: DataFrame, window: int, shares: dict[str, float] | None, power: float) -> DataFrame:
    """row, place: the tokens that go out before each document."""
    spark = rows.sparkSession
    credits = queue_credits(rows, window, shares, power)
    at = F.col("base") + F.col("before")
    # Division of doubles never falls as its dividend grows, so documents of one queue keep their order.
    round_of = (F.col("late") + F.ceil((at + F.col("n")) / F.col("quantum"))).cast("long")
    slim = rows.select("row", "queue", "task", "before", "n").join(credits, ["queue", "task"]).select("row", "queue", at.alias("at"), "n", round_of.alias("round"))
    ranges = max(1, -(-rows.count() // RANGE_DOCS))
    ranged = written(slim.repartitionByRange(ranges, "round", "queue", "at").withColumn("range", F.spark_partition_id()), "rounds")
    sums = sorted((r.range, r.n) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())  # one row for each RANGE_DOCS documents
    ends = np.cumsum([n for _, n in sums]).tolist()
    starts = spark.createDataFrame([(r, end - n) for (r, n), end in zip(sums, ends, strict=True)], "range int, start long")
    running = F.sum("n").over(Window.partitionBy("range").orderBy("round", "queue", "at").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("place", F.coalesce(running, F.lit(0))).join(starts, "range").select("row", (F.col("start") + F.col("place")).alias("place"))


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, window_sequences: int = WINDOW, shares: dict[str, float] | None = None, power: float = MIXTURE) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits each).

    A document is its ids and id 0 at the end; a null text is empty and gives the 0 alone; a null source, or a table
    without sources, is the queue "". shares: target weights of the sources by name, however many there are; a source
    that they leave out waits until the others are empty. Without them weights are the queues' tokens to `power` (1: each
    window mixes the sources as the corpus does). Rows that repeat are packed as often as they come; null ids stay null;
    a very long text is one document, cut at the ends of sequences only. Each token lies in exactly one piece, sequences
    are full but the last, an empty table gives no rows; columns other than doc_id, text and source are not read.
    """
    rows = written(tokenised(docs, path), "tokens")
    places = served(rows, window_sequences * sequence, shares, power)

    def cut(batches):
        for b in batches:
            out, held = [], 0
            for doc_id, n, place, raw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n", "place", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    m = min(n - done, sequence - place % sequence)
                    out.append((doc_id, done, m, n, place // sequence, place % sequence, ids[done : done + m].tobytes()))
                    done, place = done + m, place + m
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    placed = rows.select("row", "doc_id", "n", "ids").join(places, "row").select("doc_id", "n", "place", "ids")
    return arrow_map(placed, cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
