"""The prefix trie against a plain one: dictionaries over whole sequences."""

import hashlib
import random
import zlib

import pytest

from fragspark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, label long, depth long, content string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members, ends = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    found = {}

    def roll(p):
        leaves, saved = (0 if kids.get(p) else 1), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in kids.get(p, []):
            a, b = roll(k)
            leaves, saved = leaves + a, saved + b
        found[p] = (leaves, saved)
        return leaves, saved

    if members:
        roll(())
    return sorted(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), len(kids.get(p, [])), *found[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p in members
    )


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in T.prefix_trie(table, **options).collect())


def some(seed, convs=60, most=7, words=3):
    g = random.Random(seed)
    return [(c, i if g.random() < 0.9 else None, g.choice(["user", "bot", None]), g.choice(["a", "bb", "ç", "", None][:words])) for c in range(convs) for i in range(g.randint(1, most)) if c % 11 != 5]


@pytest.mark.parametrize("options", [{}, {"content_bits": 2}, {"label_bits": 2}, {"content_bits": 1, "label_bits": 1}])
def test_trie_equals_plain_one(spark, options):
    rows = some(1) if not options else some(2, convs=20, most=5, words=4)
    rows += [(None, 1, "user", "nobody's"), (3, 5, "user", "x" * 100000), (3, 5, "user", "x" * 100000)]
    assert got(spark, rows, **options) == plain(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(5, i, "user", f"t{i % 50}") for i in range(700)] + [(c, i, "user", f"t{i}") for c in range(5, 40) for i in range(700, 704) if c % 5]
    rows += [(6, i, "user", f"t{i % 50}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert T.placed(T.contents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role as role_key", "text as text_key", "1L as n_bytes"), 64)).where("conv_id = 5").select("part").distinct().count() > 1
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_and_empty(spark):
    alone = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    assert got(spark, alone) == plain(alone)
    assert got(spark, []) == []


def test_copies_end_at_one_node_in_order(spark):
    rows = [(c * 10, i, "user", f"same {i}") for c in range(300) for i in range(9)]
    assert got(spark, rows) == plain(rows)
