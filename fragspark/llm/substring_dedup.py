"""Substring deduplication by sliding sentence spans.

Every run of `span` consecutive sentences is hashed to 128 bits; the runs join globally; each sentence that a
non-first occurrence of a repeated run covers is removed. First is the smallest (doc_id, hash of the text, sentence
number). A batch of documents settles the repeats within it and sends each of its runs once, so a run that comes
everywhere meets as one row for each batch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, first_of_each, written

#: A piece of text up to its sentence ends or line ends; the pieces of a text, put together, are the text.
PIECE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
STRIPPED = " \t\r\n"
BATCH_SPANS = 400_000
SPANS = pa.schema([("later", pa.bool_()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int64())])
SPANS_SQL = "later boolean, hi long, lo long, doc_id long, key long, pos long"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def span_rows(rows: DataFrame, span: int) -> DataFrame:
    """rows(doc_id, key, text) -> each distinct span of a batch with its first place there, and the places of the later ones."""
    find, digest = re.compile(PIECE).findall, xxhash.xxh3_128_digest

    def spans(batches):
        digests: list[bytes] = []
        parts: list[tuple[int, int, int, int]] = []  # document, key, first sentence, spans

        def flush():
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            n = [p[3] for p in parts]
            doc, key, begin = (np.repeat(np.array([p[i] for p in parts], np.int64), n) for i in range(3))
            pos = begin + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lead, later = first_of_each((hashes[:, 0], hashes[:, 1]), (doc, key, pos))
            digests.clear()
            parts.clear()
            for own, told in ((lead, False), (later, True)):
                yield batch(SPANS, np.full(len(own), told), hashes[own, 0], hashes[own, 1], doc[own], key[own], pos[own])

        for b in batches:
            for doc_id, key, text in zip(*(b.column(i) for i in range(3)), strict=True):
                own = [x.encode() for p in find(text.as_py()) if (x := p.strip(STRIPPED))]
                for begin in range(0, len(own) - span + 1, BATCH_SPANS):
                    stop = min(len(own) - span + 1, begin + BATCH_SPANS)
                    digests.extend(digest(b"\x1f".join(own[i : i + span])) for i in range(begin, stop))
                    parts.append((doc_id.as_py(), key.as_py(), begin, stop - begin))
                    if len(digests) > BATCH_SPANS:
                        yield from flush()
        if parts:
            yield from flush()

    return arrow_map(rows, spans, SPANS_SQL)


def substring_dedup(docs: DataFrame, span: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_sentences, n_removed, kept_text.

    A null text is empty: no sentences, kept_text "". Texts with fewer than `span` sentences keep all. Rows with a null
    doc_id have no place in the order of occurrences: they are returned as they are. Rows with one doc_id and one text
    are the same document: their runs count as one occurrence; two texts under one doc_id are two documents. A very long
    text is split to sentences as a whole, its runs go out in blocks. An empty table gives no rows. Other columns are
    not read, so clashing names don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = written(span_rows(rows.where("doc_id is not null").select("doc_id", "key", "text"), span), "spans")
    once = spans.where("not later")
    first = once.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = once.join(first, ["hi", "lo"]).where("struct(doc_id, key, pos) != first").select("doc_id", "key", "pos")
    later = again.union(spans.where("later").select("doc_id", "key", "pos")).groupBy("doc_id", "key").agg(F.collect_set("pos").alias("starts"))
    find = re.compile(PIECE).findall

    def remove(batches):
        for b in batches:
            out = []
            for doc_id, text, starts in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "starts")), strict=True):
                pieces = find(text)
                drop = {i for s in starts or () for i in range(s, s + span)}
                kept, n = [], 0
                for p in pieces:
                    if p.strip(STRIPPED):
                        if n not in drop:
                            kept.append(p)
                        n += 1
                    else:
                        kept.append(p)
                out.append((doc_id, n, len(drop), "".join(kept) if drop else text))
            if out:
                yield batch(KEPT, *map(list, zip(*out, strict=True)))

    joined = rows.join(later.select(F.col("doc_id").alias("later_id"), F.col("key").alias("later_key"), "starts"), (F.col("doc_id") == F.col("later_id")) & (F.col("key") == F.col("later_key")), "left")
    return arrow_map(joined.select("doc_id", "text", "starts"), remove, "doc_id long, n_sentences long, n_removed long, kept_text string")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
