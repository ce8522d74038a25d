"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. A passage is the shares of its words' hashed shapes, of their hashed forms, and of repeated words; a
tanh layer encodes it, gated attention (tanh and sigmoid branches, multiplied) weighs the passages of a text, and a
logistic layer scores the weighted representation. Only document labels are known, so the attention learns which
passages decide. Fitting takes a bounded sample of labelled rows to the driver; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, written

PASSAGE, SHAPES, FORMS, HIDDEN, GATE = 48, 256, 128, 16, 8
SAMPLE_ROWS, SAMPLE_BYTES, STEPS, RATE, THRESHOLD = 4000, 64 << 20, 450, 0.01, 0.3
WIDTH, MEMO_WORDS, BLOCK_WORDS = SHAPES + FORMS + 2, 200_000, 1 << 17
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
RUNS = re.compile(r"(.)\1+", re.S)


class Kinds(dict):
    """code point -> its kind, for str.translate."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS = Kinds()


def shape_of(word: str) -> str:
    """Letters by case, digits and other characters by kind, runs of one kind as one and two."""
    return RUNS.sub(r"\1\1", word.translate(KINDS))


class WordCodes(dict):
    """word -> its shape's and its form's place in a passage vector, in one number; words seen are kept, up to a bound."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(shape_of(word)) % SHAPES * FORMS + xxhash.xxh3_64_intdigest(word.lower()) % FORMS
        if len(self) < MEMO_WORDS:
            self[word] = code
        return code


def passages(texts: list[str], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(passages of all texts as rows of shares, passages of each text); a text without words has one passage of zeros."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(bags) - bags
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    row = np.repeat(first, n) + (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)) // PASSAGE
    rows = int(bags.sum())
    x = np.zeros((rows, WIDTH), np.float32)
    if len(flat):
        size = np.bincount(row, minlength=rows)
        share = 1 / np.maximum(1, size)
        cell, times = np.unique(row * WIDTH + flat // FORMS, return_counts=True)
        x.reshape(-1)[cell] = times * share[cell // WIDTH]
        cell, times = np.unique(row * WIDTH + SHAPES + flat % FORMS, return_counts=True)
        x.reshape(-1)[cell] = times * share[cell // WIDTH]
        same = np.flatnonzero((flat[1:] == flat[:-1]) & (row[1:] == row[:-1]))
        x[:, -2] = np.bincount(row[same], minlength=rows) * share
        own = np.unique(row * (SHAPES * FORMS) + flat) // (SHAPES * FORMS)
        x[:, -1] = 1 - np.bincount(own, minlength=rows) * share
    return x, bags


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """The weights, the forward pass, and Adam on the log loss by hand-made gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda *s: g.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = {"W": r(WIDTH, HIDDEN) * 4, "b": np.zeros(HIDDEN, np.float32), "V": r(HIDDEN, GATE), "U": r(HIDDEN, GATE), "a": r(GATE, 1), "c": r(HIDDEN, 1), "c0": np.zeros(1, np.float32)}

    def forward(self, x, bags):
        w, at = self.w, np.cumsum(bags) - bags
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = ((t * s) @ w["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        weight = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(h * weight[:, None], at)
        return sigmoid((z @ w["c"])[:, 0] + w["c0"][0]), (h, t, s, weight, z, at)

    def gradients(self, x, bags, y):
        w = self.w
        p, (h, t, s, weight, z, at) = self.forward(x, bags)
        d = ((p - y) / len(y)).astype(np.float32)
        dz = d[:, None] * w["c"].T
        rows = np.repeat(dz, bags, axis=0)
        dweight = (rows * h).sum(1)
        de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, at), bags))
        dt = de[:, None] * w["a"].T * s * (1 - t * t)
        ds = de[:, None] * w["a"].T * t * s * (1 - s)
        dh = (rows * weight[:, None] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": ((t * s).T @ de)[:, None], "c": z.T @ d[:, None], "c0": np.array([d.sum()])}

    def fit(self, texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 64, seed: int = 7) -> Model:
        y = np.array(labels, np.float32)
        codes, held = WordCodes(), []
        for text in texts:  # the passages of a text without their zeros
            x, _ = passages([text], codes)
            at = np.flatnonzero(x)
            held.append((len(x), at.astype(np.uint32), x.ravel()[at]))
        bags, g = np.array([n for n, *_ in held]), np.random.default_rng(seed)
        m, v, order = {k: 0 * a for k, a in self.w.items()}, {k: 0 * a for k, a in self.w.items()}, np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, g.permutation(len(y))])
            own, order = order[:batch], order[batch:]
            x = np.zeros((bags[own].sum(), WIDTH), np.float32)
            for j, start in zip(own, np.cumsum(bags[own]) - bags[own], strict=True):
                x[start : start + bags[j]].ravel()[held[j][1]] = held[j][2]
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in self.gradients(x, bags[own], y[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * (grad + 1e-5 * self.w[k])
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.w[k] = (self.w[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str], codes: WordCodes) -> np.ndarray:
        return self.forward(*passages(texts, codes))[0]


def held_out():
    """crc32 of the doc_id as text, mod 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | float:
    """A model of at most sample_rows labelled documents that are not held out, and of at most sample_bytes of text, picked by a hash of their ids.

    Of rows that repeat an id the one of the least text counts; of labels the least. Where one class is missing, the share
    of label 1 (0.5 without labels). So the driver gets no more than the bounds, whatever the table holds.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out())
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    one = written(texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")), "sample")  # sample_rows at most
    sizes = one.select("doc_id", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits = np.cumsum([r.bytes for r in sizes]) <= sample_bytes
    chosen = [r.doc_id for r, good in zip(sizes, fits, strict=True) if good]
    if len(chosen) < len(sizes):
        rows = one.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in chosen], "doc_id long")), "doc_id").collect()
    else:
        rows = one.collect()
    discard(one)
    rows.sort(key=lambda r: r.doc_id)
    found = [int(r.quality) for r in rows]
    if len(set(found)) < 2:
        return float(np.mean(found)) if found else 0.5
    return Model().fit([r.text for r in rows], found)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1; higher: label 1 likelier), predicted (1 if score >= threshold).

    Nothing but the text enters a score. A null text is empty; texts without words get the score of one empty passage.
    A null doc_id counts as held out. Rows that repeat get rows that repeat. Whole texts are scored.
    """
    model = fit_quality(docs, labels, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        codes, m = WordCodes(), sent.value
        for b in batches:
            texts, at = b.column(2).to_pylist(), 0
            while at < len(texts):  # blocks of bounded length
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) < BLOCK_WORDS * 4):
                    held += len(texts[stop])
                    stop += 1
                got = m.score(texts[at:stop], codes) if isinstance(m, Model) else np.full(stop - at, m)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), b.column(1).slice(at, stop - at), pa.array(got.astype(np.float64))], schema=SCORES)
                at = stop

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, score, "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `threshold` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample_rows))

    def keep(batches):
        codes, m = WordCodes(), sent.value
        for b in batches:
            at, column = 0, b.column(b.schema.names.index("text"))
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < BLOCK_WORDS * 4:
                    texts.append(column[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                got = m.score(texts, codes) if isinstance(m, Model) else np.full(len(texts), m)
                yield b.slice(at, len(texts)).filter(pa.array(got >= threshold))
                at += len(texts)

    return arrow_map(docs, keep, docs.schema)
