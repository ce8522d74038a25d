import random

from fragspark.llm.ngram_join import ngram_components


def brute(rows, percent=75, size=5):
    def words(t):
        import re

        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = {i: i for i, (d, _) in enumerate(rows)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(groups[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=220):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 4, 6, 7, 8, 9, 12, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rnd.randrange(len(w) + 1)
            op = rnd.randrange(3)
            if op == 0:
                w.insert(k, rnd.choice(vocab))
            elif op == 1 and k < len(w):
                w[k] = rnd.choice(vocab).upper()
            elif k < len(w) and len(w) > 1:
                del w[k]
        rows.append((i * 7 % 1000 - 300, rnd.choice([" ", "\n", "\t\x0b"]).join(w)))
    return rows + [(5001, None), (5002, ""), (5003, "  \n"), (None, rows[0][1]), (rows[3][0], rows[3][1])]


def test_components_equal_brute_force(spark):
    for seed, rare, tile in ((1, 64, 1 << 20), (2, 2, 1 << 20), (3, 0, 1 << 20), (4, 3, 400)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, digest string, n int")
        got = ngram_components(docs, rare=rare, tile=tile).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_hot_shingles_within_a_batch(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} {i} a{i} b{i}" if i % 2 else f"{common} {common} {i} {i * i} q r s t u v{i} w{i} x{i} " * 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
