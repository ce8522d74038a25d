import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fragspark.llm.quality import WordCodes, fit_quality
from fragspark.llm.queries import tokenizer_path
from fragspark.llm.suffix_dedup import PASSAGE

from .test_ngram_join import brute as components_of
from .test_suffix_dedup import brute as without_repeats

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, model = docs.columns, fit_quality(docs, labels)
    rows = docs.collect()
    want = [r for r, s in zip(rows, model.score([r.text for r in rows], WordCodes()), strict=True) if s >= 0.3]
    got = docs
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal got
        got = stages[name](spark, got, DATA)
        got = spark.createDataFrame(got.collect(), got.schema)
        assert name == "packing" or got.columns == columns

    step("quality")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want)
    step("exact")
    best: dict = {}
    for r in want:
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    want = list(best.values())
    assert sorted(got.collect()) == sorted(want)
    step("near")
    stay = {d for d, _, c in components_of([(r.doc_id, r.text) for r in want]) if d == c}
    want = sorted(r for r in want if r.doc_id in stay)
    assert sorted(got.collect()) == want
    step("substrings")
    texts = {r.doc_id: x[3].decode("utf-8", "ignore") for r, x in zip(want, without_repeats([r.text for r in want], PASSAGE, [r.doc_id for r in want]), strict=True)}
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {d: (t, len(t)) for d, t in texts.items()}
    step("packing")
    library = Tokenizer.from_file(tokenizer_path())
    pieces = got.collect()
    for d, t in texts.items():
        assert sum(p.length for p in pieces if p.doc_id == d) == len(library.encode(t, add_special_tokens=False).ids) + 1


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark):
    """Columns are named as the stages name their own; rows keep them whole."""
    names = ("_times", "_kept", "_key_id", "_key_sha", "key_id", "key_sha", "times", "kept_id", "kept_id_", "row", "spans", "kept", "digest", "block")
    text = " ".join(f"plain words number {i} of a long enough text" for i in range(40))
    rows = [(1, text, "en", "a", 1), (2, text, "en", None, 1), (3, None, None, "a", None), (None, "no id here, but some words", "en", "a", 1), (4, "", "en", "a", 0), (1, text, "en", "a", 1), (5, "x " * 30000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], schema)
    stages = dict(corpus_pipeline.STAGES)
    for table in (docs, docs.limit(0)):
        exact = stages["exact"](spark, table, DATA)
        near = stages["near"](spark, spark.createDataFrame(exact.collect(), exact.schema), DATA)
        whole = stages["substrings"](spark, spark.createDataFrame(near.collect(), near.schema), DATA)
        assert exact.columns == near.columns == whole.columns == docs.columns
        for got in (exact, near):
            found = got.collect()
            assert all(r[c].startswith(c) and r[c][len(c):] == r["row"][3:] for r in found for c in names)
        if table is docs:
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in near.collect()) == sorted([(1, len(text)), (0, 26), (3, 0), (5, 60000)])
            assert {r.doc_id for r in stages["packing"](spark, whole, DATA).collect()} == {1, None, 3, 5}
        else:
            assert not exact.collect() and not near.collect() and not whole.collect()
        assert set(stages["quality"](spark, table, DATA).columns) == set(docs.columns)
