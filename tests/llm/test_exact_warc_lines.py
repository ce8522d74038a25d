import hashlib
import random
import re

import duckdb

from fragspark.llm.exact_dedup import exact_dedup, kept_documents
from fragspark.llm.line_dedup import line_dedup
from fragspark.llm.queries import ORACLES
from fragspark.llm.substring_dedup import PIECE, substring_dedup
from fragspark.llm.warc import chunked, dechunked, parsed, read_warc, records_of, warc_round_trip, write_warc

WHITE = " \t\n\x0b\x0c\r"


def test_exact_dedup_equals_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \t\n\x0b\x0c\r é") for _ in range(rnd.randrange(0, 6))) for _ in range(300)] + [None, "", "x" * 100_000, "x" * 100_000 + " "]
    rows = [(i * 3 % 307 - 20 if i % 50 else None, t, "c", "d") for i, t in enumerate(texts)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, content string, digest string"), salts=3).collect()
    groups: dict = {}
    for d, t, *_ in rows:
        groups.setdefault("".join(c for c in t or "" if c not in WHITE), []).append((d, len(t or "")))
    want = []
    for key, members in groups.items():
        keep, n = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        want += [(d, keep, len(members), d == keep and k == n, hashlib.sha256(key.encode()).hexdigest()) for d, k in members]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_hot_text(spark):
    rows = [(i, "same  text" if i % 3 else f"t{i}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt int").repartition(8)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([1, *range(0, 3000, 3)])
    twice = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (None, "b", 1), (None, "c", 1)], "doc_id long, text string, salt int")
    assert sorted((r.text for r in kept_documents(twice).collect())) == ["a", "b", "c"]


def test_chunked_framing():
    for body in (b"", b"x", b"\r\n\r\n0\r\n" * 50, bytes(range(256)) * 40):
        assert dechunked(b"HTTP/1.1 200 OK\r\n\r\n" + chunked(body, 7)) == body
    assert dechunked(b"HTTP/1.1 200 OK\r\n\r\n5\r\nab") is None and dechunked(b"nothing") is None and dechunked(b"H\r\n\r\nzz\r\nab\r\n") is None


def test_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 3000
    rows = [(1, "http://a/ü b", long, "x"), (2, None, long, "x"), (3, "u", "small", "x"), (4, "u", "small", "x"), (5, "u\r\nX: y", None, "x"), (None, "u", long, "x"), (7, "u", "y" * 1000, "x"), (7, "u", "y" * 1000, "x"), (8, "u", "y" * 999, "x"), (9, "u", "y" * 999, "x")]
    got = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload string"), segment_bytes=1000).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == long and p != 2 else "response", 2 if h == long and p != 2 else None) for p, _, h, _ in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.valid for r in got) and {bytes(r.payload) for r in got if r.page_id == 2} == {long.encode()}
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives(spark, tmp_path):
    parts = list(records_of(1, "u", b"z" * 5000, hashlib.sha1(b"z" * 5000).hexdigest(), None, 1000, 400))
    (tmp_path / "a.warc").write_bytes(b"\r\n\r\n".join([*parts[:2], *parts[3:], b""]))
    (tmp_path / "b.warc").write_bytes(b"\r\n\r\n".join([*list(records_of(2, "u", b"ok", hashlib.sha1(b"ok").hexdigest(), None, 1000, 400)), b""]))
    got = {r.page_id: (r.valid, r.payload) for r in read_warc(spark, str(tmp_path)).collect()}
    assert got[1] == (False, None) and got[2][0] and bytes(got[2][1]) == b"ok"
    good = b"\r\n\r\n".join([*list(records_of(5, "u", b"ok", hashlib.sha1(b"ok").hexdigest(), None, 1000, 400)), b""])
    (tmp_path / "bad").mkdir()
    for name, body in {"cut": good + good[:-30], "headless": b"no archive at all", "untyped": good + b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", "endless": good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nab", "info": b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + good, "empty": b""}.items():
        (tmp_path / "bad" / f"{name}.warc").write_bytes(body)
    rows = read_warc(spark, str(tmp_path / "bad")).collect()
    assert [r.page_id for r in rows if r.valid] == [5] * 4 and len([r for r in rows if not r.valid]) == 4
    write_warc(spark.createDataFrame([(3, "u", "t" * 9000)], "page_id long, url string, html string"), f"{tmp_path}/w", segment_bytes=500, records_per_file=4)
    files = list((tmp_path / "w").glob("part*"))
    assert len(files) > 1 and all(len(list(parsed(f.read_bytes()))) <= 4 for f in files)


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(2)
    said = [f"{w} {w}{e}" for w in ("a", "b", "c", "d é") for e in (".", "!\n", "?! ", "")]
    texts = [" ".join(rnd.choice(said) for _ in range(rnd.randrange(0, 9))) for _ in range(80)] + [None, "", "\n\n", "No end", "x. " * 500]
    rows = [(i - 5 if i != 7 else None, t, 0) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.n_sentences, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, pos int")).collect()}
    seen, want = set(), set()
    for d, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        pieces = re.findall(PIECE, t or "")
        assert "".join(pieces) == (t or "")
        full = [i for i, p in enumerate(pieces) if p.strip(" \t\r\n")]
        gone = set()
        for i in range(len(full) - 2):
            key = tuple(pieces[j].strip(" \t\r\n") for j in full[i : i + 3])
            if key in seen:
                gone.update(full[i : i + 3])
            seen.add(key)
        want.add((d, len(full), len(gone), "".join(p for i, p in enumerate(pieces) if i not in gone)))
    assert {g for g in got if g[0] is not None} == want and len(got) == len(rows)


def lines_left(rows, k=2, window=2, long_words=20):
    """doc_id -> lines, removed lines, text left, by the rules spelt out: fingerprints, runs of window + k - 1 lines and long lines that came before go."""
    split = {d: [s for x in (t or "").split("\n") if (s := x.strip(" \t\r"))] for d, t in rows}
    seen, out = set(), {}
    for d, t in sorted(rows):
        own, gone = split[d], set()
        grams = [hashlib.md5("\n".join(own[i : i + k]).encode()).hexdigest() for i in range(len(own) - k + 1)]
        prints = {max(j for j in range(i, min(i + window, len(grams))) if grams[j] == min(grams[i : i + window])) for i in range(max(1, len(grams) - window + 1))} if grams else set()
        signs = [("print", i, k) for i in prints] + [("run", i, window + k - 1) for i in range(len(own) - window - k + 2)] + [("long", i, 1) for i, x in enumerate(own) if len(x.split()) >= long_words]
        for kind, i, n in sorted(signs, key=lambda s: s[1]):
            if (key := (kind, *own[i : i + n])) in seen:
                gone.update(range(i, i + n))
            seen.add(key)
        kept, n = [], 0
        for x in (t or "").split("\n"):
            full = bool(x.strip(" \t\r"))
            if not (full and n in gone):
                kept.append(x)
            n += full
        out[d] = n, len(gone), "\n".join(kept)
    return out


def line_tables():
    rnd = random.Random(3)
    lines = [f"line {i}" for i in range(12)] + [" ".join(f"w{j}" for j in range(i)) for i in (19, 20, 40)]
    texts = ["\n".join(rnd.choice([*lines, "", "\t" + lines[0] + " ", f"own {rnd.random()}"]) for _ in range(rnd.randrange(0, 14))) for _ in range(90)]
    texts += ["", "\n", "\n".join(lines), "\n".join(["z", *lines, "y"]), "\n".join(lines * 3), "p\nq", "p\nq\nr", "p\nq\nr", "a\n" * 900]
    texts += ["\n".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 12))) for _ in range(120)]
    return list(enumerate(texts))


def test_lines_equal_brute_force(spark):
    rows = line_tables()
    table = spark.createDataFrame([(d, t, 0) for d, t in rows] + [(None, rows[92][1], 0)], "doc_id long, text string, src int").repartition(7)
    got = line_dedup(table).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got if r.doc_id is not None} == lines_left(rows)
    assert [(r.n_removed, r.kept_text) for r in got if r.doc_id is None] == [(0, rows[92][1])]
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_equal_sql(spark):
    rows = line_tables()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({ORACLES['op5_line_dedup']})").fetchall()}
    assert want == {d: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, (n, gone, t) in lines_left(rows).items()}


def test_two_texts_under_one_id_are_two_documents(spark):
    rows = [(0, "A a. B b. C c.", 1), (1, "A a. B b. C c. More.", 1), (1, "X x. Y y. Z z. Own one.", 1), (1, "X x. Y y. Z z. Own one.", 1)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect())
    assert got == [(0, 0, rows[0][1]), (1, 0, rows[2][1]), (1, 0, rows[2][1]), (1, 3, " More.")]
    rows = [(0, "a\nb\nc", 1), (1, "a\nb\nc\nd", 1), (1, "x\ny\nz", 1), (1, "x\ny\nz", 1)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect())
    assert got == [(0, 0, "a\nb\nc"), (1, 0, "x\ny\nz"), (1, 0, "x\ny\nz"), (1, 3, "d")]


def test_spans_over_batches_and_very_long_texts(spark):
    said = [f"s{i}." for i in range(40)]
    rows = [(i, "".join(said[i % 10 : i % 10 + 6])) for i in range(60)] + [(100, "".join(f"u{i}. " for i in range(450_000)) + "".join(said[:3])), (101, "")]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[100].n_removed == 3 and got[100].n_sentences == 450_003 and got[101].kept_text == ""
    assert all(got[i].n_removed == 6 for i in range(10, 60)) and got[0].n_removed == 0
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lines_go_alone(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [f"a\n{long}\nb", f"c\n {long}\t\nd", long, "short line", "short line", f"{long}\ne\n{long}", f"{long} x"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(None, long), (3, long)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(1, 0, texts[0]), (2, 1, "c\nd"), (3, 1, ""), (3, 1, ""), (4, 0, texts[3]), (5, 0, texts[4]), (6, 2, "e"), (7, 0, texts[6])]


def test_runs_of_three_equal_brute_force_over_all_earlier_ones(spark):
    rnd = random.Random(5)
    texts = ["p\nq", "x\na\nb\ny", "1\na\nb\nc\n2", "3\na\nb\nc\n4"] + ["\n".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 12))) for _ in range(120)]
    got = {r.doc_id: r.kept_text.split("\n") for r in line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[3] == ["3", "4"]
    seen = set()
    for d, t in enumerate(texts):
        own, gone = t.split("\n"), set()
        for i in range(len(own) - 2):
            if (key := tuple(own[i : i + 3])) in seen:
                gone.update(range(i, i + 3))
            seen.add(key)
        left = iter([x for i, x in enumerate(own) if i not in gone])
        assert all(x in left for x in got[d] if x)  # what is kept, in order, is no more than brute force keeps
