"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Three stages, each with the whole normalised content among its grouping keys, so equality never rests on a digest:

1. local: the map side of the salted aggregation folds the copies within each input split;
2. salted: the winners of the splits meet per (digest, salt, content), so the copies of one text are shared by up to `salts` tasks;
3. global: at most `salts` winners of each content meet per (digest, content).

The verdicts go back to the rows by (digest, salt), again at most 1/salts of a hot group in one task, and carry no text.
Texts are read twice: for the groups, and for a table of digests from which the rows get their verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_names, written


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in its original text stays, then the smallest id.
    A null text equals an empty one. A null id loses every tie; a group of null ids alone has a null keep_id.
    Rows that repeat both the id and the length of the kept row are the kept document again, and are kept too; each
    row counts in group_size. Very long texts are compared whole. Other columns of the input are neither read nor returned,
    so their names may clash with those used here. An empty table gives no rows.
    """
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).select(
        "doc_id", F.char_length("raw").alias("points"), F.translate("raw", WHITE, "").alias("content")
    )
    keyed = body.select(
        "doc_id", "points", "content", F.unhex(F.sha2("content", 256)).alias("digest"),
        F.xxhash64("content").alias("check"), F.octet_length("content").alias("bytes"),
        (F.monotonically_increasing_id() % salts).cast("int").alias("salt"),
    )
    sign = ["digest", "check", "bytes"]
    # ~id turns the order of ids round without overflow; a null id is the least, so it loses.
    best = F.struct("points", (F.bitwise_not("doc_id")).alias("turned"))
    salted = keyed.groupBy(*sign, "salt", "content").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("size"))
    winners = salted.repartition("digest").groupBy(*sign, "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    # Different contents under one digest, check and length would make the way back ambiguous: the job then stops.
    verdict = winners.groupBy(*sign).agg(F.count(F.lit(1)).alias("contents"), F.first("best").alias("best"), F.first("size").alias("size")).select(
        *sign, F.when(F.col("contents") > 1, F.raise_error(F.lit("different texts share a digest")).cast("long")).otherwise(F.bitwise_not("best.turned")).alias("keep_id"),
        F.col("best.points").alias("keep_points"), F.col("size").alias("group_size"),
    )
    rows = written(keyed.select("doc_id", "points", *sign, "salt"), "digests")  # read twice: texts are stripped and hashed for it once
    slots = rows.select(*sign, "salt").distinct().join(verdict, sign)
    return rows.join(slots, [*sign, "salt"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; rows that repeat a kept id and text stay once.

    Columns of docs may have any names. Nulls, ties and empty texts and tables go as exact_dedup says.
    """
    key_id, key_sha, times_of = free_names(docs.columns, "key_id", "key_sha", "times")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    verdict = exact_dedup(docs, id_col, text_col, salts).where("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(key_id), F.unhex("text_sha256").alias(key_sha))
    times = verdict.groupBy(key_id, key_sha).agg(F.count(F.lit(1)).alias(times_of))
    keyed = docs.withColumns({key_id: ident, key_sha: F.unhex(F.sha2(normalised(F.col(text_col)), 256))})
    # The keys are hashed, a partition's share of them at a time; the texts stream past and are not sorted.
    kept = keyed.join(times.hint("shuffle_hash"), [key_id, key_sha])
    again = kept.where(F.col(times_of) > 1).dropDuplicates([key_id, key_sha])
    return kept.where(F.col(times_of) == 1).unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))
