import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest

from fragspark.llm.quality import Model, WordCodes, passages, quality_scores


def test_gradients_equal_differences():
    m = Model()
    x, bags = passages(["a b c " * 40, "X!! " * 70, "", "1 2"], WordCodes())
    y = np.array([1, 0, 1, 0], np.float32)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    grads = m.gradients(x, bags, y)
    loss = lambda: -np.mean(y * np.log(p := m.forward(x, bags)[0]) + (1 - y) * np.log(1 - p))
    for k, at in (("W", (20, 3)), ("V", (1, 2)), ("U", (0, 1)), ("a", (2, 0)), ("c", (1, 0)), ("b", (4,)), ("c0", (0,))):
        if k == "W":
            at = (int(np.flatnonzero(x.any(0))[0]), 3)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-4
        up = loss()
        m.w[k][at] = old - 1e-4
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-4 - np.asarray(grads[k]).reshape(m.w[k].shape)[at]) < 1e-4


def test_a_passage_of_junk_decides(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(200)]
        if i % 4 == 0:
            k = rnd.randrange(150)
            words[k : k + 40] = [w.upper() + "!!" for w in words[k : k + 40]]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 4 > 0), "s"))
    rows += [(None, None, "s"), (9000, "", "s"), (1, rows[1][1], "s")]
    labels += [(None, 1, "s"), (5, None, "s")]
    got = quality_scores(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, score string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.9


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality_scores(docs, none).first().score == 0.5
    assert quality_scores(docs.limit(0), none).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no test data")
def test_held_out_accuracy_on_the_test_data():
    texts = {r["doc_id"]: r["text"] for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()}
    rows = [(r["doc_id"], r["quality"]) for r in ds.dataset("/root/testdata/sf0.01/labels.parquet").to_table().to_pylist()]
    seen = [(texts[d], q) for d, q in rows if zlib.crc32(str(d).encode()) % 5]
    held = [(texts[d], q) for d, q in rows if not zlib.crc32(str(d).encode()) % 5]
    scores = Model().fit([t for t, _ in seen], [q for _, q in seen]).score([t for t, _ in held], WordCodes())
    assert np.mean([(s >= 0.3) == bool(q) for s, (_, q) in zip(scores, held, strict=True)]) >= 0.9


def test_fit_holds_no_dense_passages():
    import tracemalloc

    from fragspark.llm.quality import SAMPLE_ROWS, WIDTH, Model

    texts = [" ".join(f"word{(i * j) % 97}" for j in range(480)) for i in range(300)]
    tracemalloc.start()
    Model().fit(texts, [i % 2 for i in range(300)], steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert SAMPLE_ROWS == 4000 and peak < 300 * 10 * WIDTH * 4
