"""The corpus pipeline: quality, exact, near and substring duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. run() writes each stage's rows to the shared folder and goes on from there, so a lost executor costs one
stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragspark.llm.common import discard, kept, read, scratch, written
from fragspark.llm.exact_dedup import kept_documents
from fragspark.llm.ngram_join import near_deduplicated
from fragspark.llm.packing import pack
from fragspark.llm.quality import keep_quality
from fragspark.llm.queries import tokenizer_path
from fragspark.llm.suffix_dedup import cleaned_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1 stay; a null text is scored as an empty one, rows that repeat are scored each."""
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one document stays, the longest, then that of the smallest id; a null text equals an empty one, a null id loses ties."""
    return kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with similar word shingles the one with the smallest doc_id stays; texts without words link with nothing, rows without an id stay."""
    return near_deduplicated(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 240 bytes (no passage of over 50 words is shorter) go wherever they come again; their first place stays. Null texts are empty ones."""
    return cleaned_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences that the remaining texts fill; an empty text is the one token that ends it."""
    return pack(docs, tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packed)]

#: SQL can't express the classifier or the tokens: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():  # what the stage wrote on its way goes, its rows stay
            docs = kept(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
