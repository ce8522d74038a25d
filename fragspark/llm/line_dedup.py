"""Line deduplication by winnowing over line hashes.

Lines (white space at their ends does not count, empty ones are left out) are hashed; every k consecutive lines give a
gram hash; of every `window` consecutive grams the least (rightmost of equals) is a fingerprint, so any run of
window + k - 1 equal lines shares one. Fingerprints join by position: each later occurrence meets an earlier one, the
match grows both ways over equal lines, and the later run goes. A fingerprint's other occurrences may share more lines
than the one it meets: its surroundings, every window + k - 1 lines around it, have first places of their own, and later
occurrences of these go too. A longer run that came before is the union of such surroundings, so none is missed. A line
of `long_words` words or more is a whole of its own: its later occurrences go, whatever stands around them. Earlier and
later are by (doc_id, hash of the text, line number).

A batch of documents settles the repeats within it and sends each fingerprint, surrounding and long line once, so what
comes everywhere meets as one row for each batch, and a document is the source of one match in each batch at most for
each of its fingerprints.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, first_of_each, written

STRIPPED = " \t\r"
BATCH_LINES = 200_000
#: Kinds of rows that a batch gives: a document's line hashes, first fingerprints, first whole runs, runs that go.
DOCUMENT, PRINT, WHOLE, GONE = range(4)
SIGNS_SQL = "kind int, hi long, lo long, doc_id long, key long, start long, stop long, lines binary"
SIGNS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("hi", "lo", "doc_id", "key", "start", "stop")), ("lines", pa.binary())])
RUNS_SQL = "doc_id long, key long, start long, stop long"
RUNS = pa.schema([(c, pa.int64()) for c in ("doc_id", "key", "start", "stop")])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lines_of(text: str) -> list[bytes]:
    return [s.encode() for x in text.split("\n") if (s := x.strip(STRIPPED))]


def line_hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def gram_hashes(own: list[bytes], k: int) -> np.ndarray:
    """The first 64 bits of the MD5 of every k consecutive lines, a line end between them: the order of fingerprints."""
    digests = b"".join([md5(b"\n".join(own[i : i + k])).digest()[:8] for i in range(len(own) - k + 1)])
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the window minima; fewer than `window` grams give their least one."""
    n = len(grams)
    if n < 1:
        return np.empty(0, np.int64)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)  # reversed: argmin then takes the rightmost
    return np.unique(n - 1 - (np.arange(len(view)) + view.argmin(1)))


def wholes(own: list[bytes], long_words: int) -> np.ndarray:
    """Rows (high, low half of a 128-bit hash, line number) of the lines of long_words words or more."""
    found = [(*divmod(xxhash.xxh3_128_intdigest(x), 1 << 64), i) for i, x in enumerate(own) if len(x.split()) >= long_words]
    return np.array(found, np.uint64).reshape(-1, 3)


def surroundings(lines: np.ndarray, n: int) -> np.ndarray:
    """Rows (high, low half of a hash) of every n consecutive lines: each holds a fingerprint, as it is one window of grams."""
    out = np.zeros((max(0, len(lines) - n + 1), 2), np.uint64)
    for j in range(n):
        for half, odd in enumerate((ODD, OTHER)):
            out[:, half] = (out[:, half] ^ lines[j : j + len(out)]) * odd
            out[:, half] ^= out[:, half] >> np.uint64(29 + 3 * half)
    return out


def matched_run(a: np.ndarray, i: int, b: np.ndarray, j: int, k: int, same: bool) -> tuple[int, int] | None:
    """The lines of a around i that equal those of b around j; None where the k lines differ. In one document runs do not overlap their source."""
    if i + k > len(a) or j + k > len(b) or not np.array_equal(a[i : i + k], b[j : j + k]):
        return None
    room = min(i, j) if not same else min(j, i - j - k if i - j > k else 0)
    left = 0
    while left < room and a[i - left - 1] == b[j - left - 1]:
        left += 1
    stop = min(len(a) - i, len(b) - j) if not same else min(len(a) - i, max(k, i - left - j))
    right = k
    while right < stop and a[i + right] == b[j + right]:
        right += 1
    return i - left, i + right


def grown(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]], k: int, same: bool):
    """The runs of a that grow from the places (in a, in b) where fingerprints are equal; no run is grown twice."""
    done: set[tuple[int, int]] = set()
    for i, j in sorted(places):
        if (i, j) not in done and (found := matched_run(a, i, b, j, k, same)):
            yield found
            done.update((x, x + j - i) for x in range(found[0], found[1] - k + 1))


def signs_of(k: int, window: int, long_words: int):
    """Turns batches of (doc_id, key, text) to the kinds of rows."""
    run = window + k - 1

    def rows(kind, hi, lo, doc, key, start, stop):
        return batch(SIGNS, np.full(len(hi), kind, np.int32), hi.view(np.int64), lo.view(np.int64), doc, key, start, stop, pa.nulls(len(hi), pa.binary()))

    def settled(held: dict):
        doc, key = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
        lines = [x[0] for x in held.values()]
        n = len(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, DOCUMENT), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(doc), pa.array(key), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x.tobytes() for x in lines], pa.binary())], schema=SIGNS)
        gone = []
        slot = np.repeat(np.arange(n), [len(x[1]) for x in held.values()])
        at, grams = (np.concatenate([x[i] for x in held.values()]) for i in (1, 2))
        lead, later = first_of_each((grams,), (doc[slot], key[slot], at))
        yield rows(PRINT, grams[lead], np.zeros(len(lead), np.int64), doc[slot[lead]], key[slot[lead]], at[lead], at[lead] + k)
        by_gram = lead[np.argsort(grams[lead])]
        source = by_gram[np.searchsorted(grams[by_gram], grams[later])]
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, j in zip(later.tolist(), source.tolist(), strict=True):
            pairs.setdefault((slot[i], slot[j]), []).append((int(at[i]), int(at[j])))
        for (i, j), places in pairs.items():
            gone += [(doc[i], key[i], *x) for x in grown(lines[i], lines[j], places, k, i == j)]
        if gone:
            d, q, start, stop = (np.array(x, np.int64) for x in zip(*gone, strict=True))
            yield rows(GONE, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), d, q, start, stop)
        # Whole runs: the surroundings and the long lines.
        parts = []
        for i, (x, _, _, long) in enumerate(held.values()):
            around = surroundings(x, run)
            parts.append((around[:, 0], around[:, 1], np.full(len(around), i), np.arange(len(around)), np.full(len(around), run)))
            parts.append((long[:, 0], long[:, 1], np.full(len(long), i), long[:, 2].astype(np.int64), np.ones(len(long), np.int64)))
        hi, lo, slot, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        lead, later = first_of_each((hi, lo), (doc[slot], key[slot], start))
        for kind, own in ((WHOLE, lead), (GONE, later)):
            yield rows(kind, hi[own], lo[own], doc[slot[own]], key[slot[own]], start[own], (start + size)[own])

    def cut(batches):
        held: dict[tuple[int, int], tuple] = {}
        lines = 0
        for b in batches:
            for doc_id, key, text in zip(*(b.column(i) for i in range(3)), strict=True):
                name = doc_id.as_py(), key.as_py()
                if name in held:
                    continue
                own = lines_of(text.as_py())
                if len(own) < k and not (own and (w := wholes(own, long_words)).size):
                    continue
                grams = gram_hashes(own, k)
                at = fingerprints(grams, window)
                held[name] = line_hashes(own), at, grams[at], wholes(own, long_words)
                lines += len(own) + 1
                if lines > BATCH_LINES:
                    yield from settled(held)
                    held, lines = {}, 0
        if held:
            yield from settled(held)

    return cut


def line_dedup(docs: DataFrame, k: int = 2, window: int = 2, long_words: int = 20) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text.

    A null text is empty. Texts of fewer than k lines keep all but lines of long_words words or more that came before
    (words: between ASCII white space). Rows with a null doc_id have no place in the order of occurrences: they are
    returned as they are. Rows with one doc_id and one text are one document; two texts under one doc_id are two. Any run
    of window + k - 1 lines or more that came before goes wherever it came; of shorter runs, k lines go where their gram
    is a fingerprint that came before. A very long text is held as a whole, with 8 bytes a line. An empty table gives no
    rows; other columns are not read.
    """

    def grow(batches):
        for b in batches:
            out = []
            for doc_id, key, a, src_doc, src_key, other, pairs in zip(*(b.column(x).to_pylist() for x in ("doc_id", "key", "lines", "src_doc", "src_key", "src_lines", "pairs")), strict=True):
                own, theirs = np.frombuffer(a, np.uint64), np.frombuffer(other, np.uint64)
                out += [(doc_id, key, *x) for x in grown(own, theirs, [(p["pos"], p["src_pos"]) for p in pairs], k, (doc_id, key) == (src_doc, src_key))]
            if out:
                yield batch(RUNS, *map(list, zip(*out, strict=True)))

    def remove(batches):
        for b in batches:
            out = []
            for doc_id, text, runs in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "runs")), strict=True):
                drop = {i for r in runs or () for i in range(r["start"], r["stop"])}
                kept, n = [], 0
                for line in text.split("\n"):
                    full = bool(line.strip(STRIPPED))
                    if not (full and n in drop):
                        kept.append(line)
                    n += full
                out.append((doc_id, n, len(drop), "\n".join(kept) if drop else text))
            if out:
                yield batch(KEPT, *map(list, zip(*out, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    signs = written(arrow_map(rows.where("doc_id is not null").select("doc_id", "key", "text"), signs_of(k, window, long_words), SIGNS_SQL), "lines")
    place = F.struct("doc_id", "key", "start")

    def again(kind: int, sign: list[str]) -> DataFrame:
        """The rows of a kind whose sign has an earlier place, with that place."""
        own = signs.where(F.col("kind") == kind)
        first = own.groupBy(*sign).agg(F.min(place).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return own.join(first, sign).where(place != F.col("src")).select("doc_id", "key", "start", "stop", "src")

    pairs = (
        again(PRINT, ["hi"]).groupBy("doc_id", "key", F.col("src.doc_id").alias("src_doc"), F.col("src.key").alias("src_key"))
        .agg(F.collect_list(F.struct(F.col("start").alias("pos"), F.col("src.start").alias("src_pos"))).alias("pairs"))
    )
    one = signs.where(F.col("kind") == DOCUMENT).groupBy("doc_id", "key").agg(F.max("lines").alias("lines"))
    source = one.select(F.col("doc_id").alias("src_doc"), F.col("key").alias("src_key"), F.col("lines").alias("src_lines"))
    matches = pairs.join(one, ["doc_id", "key"]).join(source, ["src_doc", "src_key"])
    gone = arrow_map(matches, grow, RUNS_SQL).unionByName(again(WHOLE, ["hi", "lo"]).drop("src")).unionByName(signs.where(F.col("kind") == GONE).select("doc_id", "key", "start", "stop"))
    runs = gone.groupBy(F.col("doc_id").alias("run_id"), F.col("key").alias("run_key")).agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    joined = rows.join(runs, (F.col("doc_id") == F.col("run_id")) & (F.col("key") == F.col("run_key")), "left").select("doc_id", "text", "runs")
    return arrow_map(joined, remove, "doc_id long, n_lines long, n_removed long, kept_text string")
