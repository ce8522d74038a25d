import random

import pytest
from pyspark.sql import functions as F

from fragspark.llm import suffix_dedup as module
from fragspark.llm.suffix_dedup import Run, cleaned_documents, common, front_coded, merged, suffix_dedup


def brute(texts, length, places=None):
    """Per text: bytes, removed bytes, removed runs, the bytes left. places: (order of the document, identity) of each text; then each string stays where it comes first."""
    seen: dict = {}
    first: dict = {}
    bodies = [(t or "").encode() for t in texts]
    places = places or None
    for i, b in enumerate(bodies):
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            seen[x] = seen.get(x, 0) + 1
            if places:
                first[x] = min(first.get(x, (places[i], p)), (places[i], p))
    out = []
    for i, b in enumerate(bodies):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            if (first[x] != (places[i], p)) if places else seen[x] > 1:
                gone[p : p + length] = [True] * length
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus(seed, length, letters):
    rnd = random.Random(seed)
    rand = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    parts = [rand(rnd.randrange(5, 60)) for _ in range(14)]
    texts = ["".join(rnd.choice(parts) if rnd.random() < 0.4 else rand(rnd.randrange(1, 30)) for _ in range(rnd.randrange(0, 6))) for _ in range(120)]
    texts += [None, "", "a" * 90, texts[0], texts[1], rand(length - 1)]
    return [(i if i != 5 else None, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (7, parts[3] * 3, "k")]


def rows_of(got):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got.collect())


@pytest.mark.parametrize("hot", [50_000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_removes_what_brute_force_removes(spark, monkeypatch, hot, keep_first):
    for seed, length, letters in ((1, 12, "ab"), (2, 20, "abcdé"), (3, 16, "abc")):
        monkeypatch.setattr(module, "BATCH_PLACES", 60)
        rows = corpus(seed, length, letters)
        table = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
        keys = {(r.doc_id, r.text): r.k for r in table.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary")).alias("k")).collect()}
        places = [(-(2**63) if d is None else d, keys[d, t]) for d, t, _ in rows] if keep_first else None
        want = sorted(((d is not None, d or 0), *x) for (d, _, _), x in zip(rows, brute([r[1] for r in rows], length, places), strict=True))
        assert rows_of(suffix_dedup(table, length, keep_first=keep_first, hot=hot)) == want


def test_clashing_names_stay_with_their_rows(spark):
    rows = [(1, "x" * 30 + "one", "a", 5, None), (2, "x" * 30 + "two", "b", 6, 7), (None, None, None, None, None)]
    got = cleaned_documents(spark.createDataFrame(rows, "doc_id long, text string, key string, body int, spans int"), 20)
    assert got.columns == ["doc_id", "text", "key", "body", "spans"]
    # Strings of 20 x come first at the first x: all others go.
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "xone", "a", 5, None), (2, "two", "b", 6, 7), (None, "", None, None, None)], key=str)


def test_text_beyond_one_block(spark, monkeypatch):
    rnd = random.Random(9)
    rand = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n)).decode()
    passage = rand(700)
    long = rand(module.BLOCK - 300) + passage + rand(module.BLOCK) + passage[:450] + rand(50)
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame([(1, long), (2, rand(80) + passage)], "doc_id long, text string")).collect()}
    assert sum(s.stop - s.start for s in got[1].spans) >= 700 + 450 and len(got[1].spans) == 2
    assert got[1].spans[0].start <= module.BLOCK - 300 and len(got[2].kept) <= 80


def test_passages_of_over_fifty_words_go_where_they_come_again(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeiou") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rnd.randrange(55, 80)) for _ in range(20)]
    rows = [(i, " ".join([prose(60), passages[i % 20], prose(40)])) for i in range(100)]
    clean = [(1000 + i, prose(120)) for i in range(30)]
    got = {r.doc_id: r.text for r in cleaned_documents(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert all((passages[i % 20] in got[i]) == (i < 20) for i in range(100))
    assert all(got[i] == t for i, t in clean)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


def test_merge_gives_the_suffix_and_lcp_arrays():
    rnd = random.Random(4)
    runs = [[("".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 12)))).encode() for _ in range(rnd.randrange(1, 30))] for _ in range(7)]
    for k in (1, 2, 5, 7):
        coded = [Run(i, front_coded([(s, b"", 1, j, (0, i, j)) for j, s in enumerate(r)])) for i, r in enumerate(runs[:k])]
        got = [(r.head, shared) for r, shared in merged(coded)]
        want = sorted(s for r in runs[:k] for s in r)
        assert [g[0] for g in got] == want
        assert [g[1] for g in got][1:] == [common(a, b) for a, b in zip(want, want[1:], strict=False)]
