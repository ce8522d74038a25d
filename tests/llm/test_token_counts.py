"""Token counts against the library, one text at a time."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from fragspark.llm import token_counts as T  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n  x", "a", "a  b\n\n c\t", "<s>hi</s> <unk> <0x0A>", "▁x ▁▁ y", "x▁", "ｆｕｌｌ ﬁ", "a\x00b", "​ 　x", " lead", "tail ", "1234 5,678.90", "İstanbul naïve Ünï", "日本語 の 文章", "😀😀 👩‍👩‍👧", "\r\n\x0b\x0c",
    "the the the " * 50, "x" * 5000, " " * 100, "word" * 3000 + " end", "....,,,,!!!! ---- ____",
]


def library(text):
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text or ""))


def test_counts_equal_the_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(r[0], r[1], "e", 1, 2) for r in rows], "doc_id long, text string, word string, n long, batch long")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in T.token_counts(docs, PATH).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), library(r[1])) for r in rows)


def test_small_batches_and_whole_documents_equal_the_library(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(docs, PATH).collect()} == want
    rows = docs.repartition(3)
    monkeypatch.setattr(T, "BUCKET_WORDS", 3000)
    monkeypatch.setattr(T, "numbered", lambda r, p, make=T.numbered: many(r, p, make, monkeypatch))
    assert {r.doc_id: r.n_tokens for r in T.token_counts(rows, PATH).collect()} == want


def many(rows, pattern, make, monkeypatch):
    """The batches of four tables, one after the other: a pre-token is then in many batches."""
    parts = [make(rows.where(f"doc_id % 4 = {i}"), pattern) for i in range(4)]
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out.union(p.selectExpr(f"batch + {i} * 1000000007L as batch", "n_words", "words", "doc_ids", "n_bytes", "body"))
    return out


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_no_pre_token_is_crossed_by_a_piece(spark):
    """Joined pre-tokens give as many pieces as apart, on every pair of a sample's neighbours."""
    import re

    find = re.compile(T.pre_token_pattern(PATH)).findall
    for text in TEXTS:
        if text:
            words = find(T.BLANK + text.replace(" ", T.BLANK))
            assert "".join(words) == T.BLANK + text.replace(" ", T.BLANK)
