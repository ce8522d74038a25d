"""Source divergence against plain integer arithmetic over every term of every group."""

import random
import re
from collections import Counter

import pytest

from fragspark.llm import source_divergence as D


def plain(rows, least):
    docs = [((r[0] or ""), (r[1] or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[2] or "").translate({c: c + 32 for c in range(65, 91)})))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in d[2])
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for d in own:
            counts[d[1]].update({t: n for t, n in d[2].items() if t in kept})
        every = sum(counts.values(), Counter())

        def p(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        ps, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s in counts:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def some(seed, n=150):
    g = random.Random(seed)
    words = [a + b for a in ("ab", "Cd", "éß", "x", "日本") for b in ("", "E", "ñ", "zz")]
    rows = [(g.choice(["en", "fr", None]), g.choice(["s1", "s2", "s3", "é", None]), " ".join(g.choices(words, k=g.randint(0, 12))) + g.choice(["", "!", "\x00q"])) for _ in range(n)]
    return rows + [("en", "no terms", None), ("en", "no terms", "123 !?"), ("few", "a", "one"), ("few", "b", "two"), ("single", "only", "x"), ("en", "s1", "Ab " * 30000)] + [("en", "s2", "ab twin")] * 12


@pytest.mark.parametrize("shard_rows", [1_000_000, 20])
def test_divergence_equals_plain_arithmetic(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(D, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(D, "KEPT_ROWS", shard_rows)
    rows = some(3)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n long, rank long").repartition(4)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in D.source_divergence(docs).collect())
    assert got == plain(rows, 10)


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
