import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fragspark.llm.bpe import Encoder, Lexicon, Vocabulary, bpe_decode, bpe_encode, compile_lexicon
from fragspark.llm.packing import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["the cat  sat\non the mat.", "", None, "naïve — “quotes”\t\tx\r\n\n", "a<|endoftext|>b's 123abc!!", "x" * 3000, " lead", "trail \n", "ﷺ𝂊\U0001e6d5's", "the cat  sat\non the mat."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int")


def test_encode_and_decode_equal_the_library(spark, library):
    rows = [(i if i != 4 else None, t, "s", 1) for i, t in enumerate(TEXTS)]
    got = bpe_decode(bpe_encode(docs(spark, rows), PATH, 5), PATH).collect()
    want = sorted((library.encode(t or "", add_special_tokens=False).ids, t or "") for t in TEXTS)
    assert sorted((list(r.ids), r.decoded) for r in got) == want
    assert bpe_encode(docs(spark, []), PATH).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {b"tap": (1, 2), b"taps": (1, 2, 3), b"top": (4, 2), b"tops": (4, 2, 3), b"": (9,)}
    held = Lexicon(compile_lexicon(words))
    assert {w: held.get(w) for w in words if w} == {w: v for w, v in words.items() if w}
    assert held.get_all([b"tops", b"x", b"", b"tap"]) == [(4, 2, 3), None, None, (1, 2)]
    assert held.get(b"ta") is None and held.get(b"tapsx") is None and held.get(b"zz") is None


def test_long_words_merge_alike():
    v = Vocabulary(PATH)
    for word in (b"ab" * 200, b"the" * 100, b"aaaaaaaa" * 30):
        assert v.merge_long([v.byte_ids[b] for b in word]) == tuple(Encoder(PATH).encode(word.decode()).tolist())


def test_groups_of_texts_encode_as_the_library_does(library, monkeypatch):
    from fragspark.llm import bpe

    rnd = random.Random(5)
    letters = [*"abcdeTHE  \n\n\t.,'\"s09\r\x0b\x1c\x85\u00a0\u3000", "the ", " of", "é", "ß", "中", "文", "🙂", "\u0301", "<|endoftext|>", "<|endof", "\ud7a3", "\u0c5c", "x" * 70]
    texts = ["".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 9, 60, 400]))) for _ in range(400)]
    texts += [" ".join("".join(rnd.choices("abcdefghijklmnop.,9", k=rnd.randrange(1, 14))) for _ in range(50)) + rnd.choice(["", " ", "\n"]) for _ in range(100)]
    v = Vocabulary(PATH)
    words = [w.encode() for t in texts for w in bpe.words_of(t)]
    assert v.merge_all(words) == [v.merge(w) for w in words] and v.merge_all([]) == []
    held = {w: v.merge(w) for w in words[::3] if len(w) <= 64}
    image = compile_lexicon(held)
    assert Lexicon(image).get_all(words) == [held.get(w) for w in words]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for memo, block in ((600_000, 1 << 20), (40, 50), (0, 1 << 20)):  # whole, full and no tables of words seen; texts in blocks
        monkeypatch.setattr(bpe, "MEMO_WORDS", memo)
        monkeypatch.setattr(bpe, "TEXT_BLOCK", block)
        for e in (Encoder(PATH), Encoder(PATH, image), Encoder(PATH, compile_lexicon({}))):
            for _ in range(2):
                assert [x.tolist() for x in e.encode_all(texts)] == want
            assert [e.encode(t).tolist() for t in texts[:50]] == want[:50] and len(e.ids.held) <= memo and len(e.pieces.held) <= memo // 2


def whole(pieces, sequence):
    """Each document's pieces follow each other, and all pieces together leave no hole and share no place."""
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) == own[0].doc_tokens
    at = 0
    for place, n in sorted((p.sequence_id * sequence + p.offset, p.length) for p in pieces):
        assert place == at and place % sequence + n <= sequence
        at += n
    return by_doc


def round_robin(queues, quanta):
    """Documents (queue, number) in the order in which rounds of credit serve them, one token of credit at a time in the end effect."""
    out, done, at = [], dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
    for r in range(1, 10**6):
        for q in sorted(queues):
            while at[q] < len(queues[q]) and math.ceil((done[q] + queues[q][at[q]]) / quanta[q]) <= r:
                done[q] += queues[q][at[q]]
                out.append((q, at[q]))
                at[q] += 1
        if len(out) == sum(map(len, queues.values())):
            return out


def test_every_token_has_one_place(spark, library):
    rows = [(i, (TEXTS[i % len(TEXTS)] or "") + " w" * (i * 13 % 700), None if i % 7 == 0 else f"s{i % 3}", i) for i in range(60)]
    for shares, power in ((None, 1.0), ({"s1": 3, "s2": 1}, 1.0), (None, 0.3), ({}, 1.0)):
        by_doc = whole(pack(docs(spark, rows), PATH, 64, 4, shares, power).collect(), 64)
        for i, text, *_ in rows:
            ids = [*library.encode(text, add_special_tokens=False).ids, 0]
            assert b"".join(p.ids for p in by_doc[i]) == b"".join(x.to_bytes(4, "little") for x in ids) and by_doc[i][0].doc_tokens == len(ids)
    assert pack(docs(spark, []), PATH).count() == 0
    assert pack(docs(spark, rows).drop("source", "n"), PATH, 64).count() >= 60


def test_order_is_that_of_rounds_of_credit(spark):
    rnd = random.Random(3)
    for n_queues in (1, 5, 30):
        queues: dict = {}
        for q in range(n_queues):  # among them queues of one token
            queues[f"q{q:03}"] = [rnd.choice([1, 1, 3, 40, 900]) for _ in range(rnd.choice([1, 2, 30]))]
        rows = [(q, k, n) for q, own in queues.items() for k, n in enumerate(own)]
        table = [(i, " ".join(["the"] * (n - 1)), q, k) for i, (q, k, n) in enumerate(rows)]
        shares = {q: rnd.choice([1, 2, 50]) for q in queues}
        pieces = pack(docs(spark, table).coalesce(1), PATH, 16, 8, shares).collect()
        by_doc = whole(pieces, 16)
        order = sorted(by_doc, key=lambda d: by_doc[d][0].sequence_id * 16 + by_doc[d][0].offset)
        quanta = {q: shares[q] / sum(shares.values()) * 128 for q in queues}
        assert [rows[d][:2] for d in order] == round_robin(queues, quanta)


def test_windows_keep_the_target_proportions(spark):
    rnd = random.Random(8)
    rows = [(i, "the " * rnd.randrange(1, 60), "big" if i % 3 else f"s{i % 40}", 1) for i in range(3000)]
    for shares in (None, {"big": 2, "s0": 1, "s3": 1}):
        by_doc = whole(pack(docs(spark, rows), PATH, 64, 16, shares, 0.5).collect(), 64)
        total: dict = {}
        for i, _, q, _ in rows:
            total[q] = total.get(q, 0) + by_doc[i][0].doc_tokens
        weight = {q: (n**0.5 if shares is None else shares.get(q, 0)) for q, n in total.items()}
        placed = sorted((p.sequence_id * 64 + p.offset, rows[p.doc_id][2], p.length) for own in by_doc.values() for p in own)
        given = dict.fromkeys(total, 0)
        for at, q, n in placed:
            given[q] += n
            now = at + n
            if any(given[x] + 70 > total[x] for x in total if weight[x]):  # until the first queue runs empty
                break
            for x in total:  # behind the share by one document and one round at most
                assert abs(given[x] - now * weight[x] / sum(weight.values())) <= 70 + 1024 * weight[x] / sum(weight.values()) + 70 * weight[x] / sum(weight.values()) * len(total)


def test_shares_hold_at_thousands_of_sources(spark):
    rows = [(i, "the cat", f"s{i}", 1) for i in range(3000)] + [(10_000 + i, "the cat", "loud", 1) for i in range(500)]
    pieces = pack(docs(spark, rows), PATH, 64, 16, {**{f"s{i}": 1 for i in range(3000)}, "loud": 3000}).collect()
    by_doc = whole(pieces, 64)
    place = {d: own[0].sequence_id * 64 + own[0].offset for d, own in by_doc.items()}
    loud = [place[10_000 + i] for i in range(500)]
    assert max(loud) < 2.2 * 500 * by_doc[0][0].doc_tokens  # half of all until they are out: not where a share is lost


def test_digest_columns(spark, library):
    from fragspark.llm.queries import op3_packing, op6_bpe

    row = docs(spark, [(1, TEXTS[0], "s", 1)])
    path = "/tmp/fragspark-test-digest"
    row.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    ids = library.encode(TEXTS[0], add_special_tokens=False).ids
    a, b = op6_bpe(spark, path).first(), op3_packing(spark, path).first()
    assert a.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and a.n_tokens == len(ids)
    assert b.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*ids, 0]))
