"""Suffix-array deduplication: a sparse suffix array, sorted by a distributed merge that knows common prefixes.

Which suffixes. A string of `length` bytes holds window minima of the hashes of its `gram`-byte substrings; they depend
on its bytes alone, so both places of a repeat have an anchor at the same offset. Only suffixes at anchors whose gram
comes again are sorted, cut at `length` bytes, each with the length - gram bytes before it (its context).

How. A batch of documents sends each of its grams once, with a count; the grams that come again go back to it. It sorts
their suffixes, those of one context as one entry, and front-codes them (common prefix with the one before, then the
rest); runs travel to the bucket of their gram. There a loser tree merges the runs: each head carries its common prefix
with the last suffix put out, which front coding and earlier matches give for free, heads of different prefixes are
ordered by that number alone, and equal ones are compared behind it, so no known prefix is read again. Out come the
suffix array and its LCP array. Intervals of the LCP array, from deep to shallow, and the order of the left contexts
give each entry its maximal matches (left bytes, right bytes), which go back to its batch. Every match rests on a
comparison of bytes.

Hot grams. A common passage is one entry per batch, however often it comes. A gram with more than `hot` contexts is cut
into nodes: node (a, b) holds the windows that begin a to b bytes before the anchor, and its places meet by the hash of
the bytes that all of these share. Nodes split until they have at most `hot` contexts, or are one window: its places
are then equal by a hash of all its bytes, and no bytes are gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, crammed, discard, table_of, uncrammed, written

#: PASSAGE: the least bytes of a passage of over 50 words, with room: 51 words of the test languages take 246 or more.
LENGTH, PASSAGE, BLOCK = 400, 240, 1 << 19
HOT, FAN, SIGN = 50_000, 8, 8
BATCH_PLACES, BATCH_ENTRIES, BUCKET_BYTES = 200_000, 50_000, 32 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
SIGNED_SQL = "kind int, batch long, sign long, n long, contexts long, d long, key long, pos long, body binary"
SIGNED = pa.schema([(k, pa.int32() if k == "kind" else pa.int64()) for k in ("kind", "batch", "sign", "n", "contexts", "d", "key", "pos")] + [("body", pa.binary())])
ASKED_SQL = "key long, times long, cold binary, hot binary, spans binary"
ASKED = pa.schema([("key", pa.int64()), ("times", pa.int64()), *((k, pa.binary()) for k in ("cold", "hot", "spans"))])
CUT_SQL = "kind int, bucket int, batch long, body binary"
CUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("body", pa.binary())])
TOLD = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("body", pa.binary())])
SPANS = pa.schema([("key", pa.int64()), ("spans", pa.binary())])
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class Roll:
    """Hashes of all substrings of `gram` bytes, from prefix sums of powers modulo 2^64."""

    def __init__(self, gram: int):
        self.gram, n = gram, BLOCK + 2 * LENGTH + 2 * gram
        base = 0x5851F42D4C957F2D
        self.power = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64), dtype=np.uint64)
        self.letters = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.power[: len(data)], out=s[1:])
        h = (s[self.gram :] - s[: -self.gram]) * self.inverse[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= ODD
        h ^= h >> np.uint64(29)
        return h


def sliding(x: np.ndarray, w: int, fold, fill) -> np.ndarray:
    """fold over each w consecutive values."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, fill, x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = fold.accumulate(rows, axis=1).reshape(-1)
    behind = fold.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return fold(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, roll: Roll, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the minima of each window of length bytes (all of equal ones)."""
    w, spots, hashes = length - roll.gram + 1, [], []
    for at in range(0, len(data) - length + 1, BLOCK):
        h = roll(data[at : at + BLOCK + length - 1])
        least = sliding(h, w, np.minimum, np.uint64(2**64 - 1))
        padded = np.zeros(len(h) + w - 1, np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        spot = np.flatnonzero(sliding(padded, w, np.maximum, np.uint64(0)) == h)
        spots.append(spot + at)
        hashes.append(h[spot])
    if not spots:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    spots, first = np.unique(np.concatenate(spots), return_index=True)
    return spots, np.concatenate(hashes)[first]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    n = min(len(a), len(b))
    step = 16
    while at < n:
        m = min(n, at + step)
        x, y = a[at:m], b[at:m]
        if x != y:
            diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return m - (diff.bit_length() + 7) // 8
        at, step = m, step * 4
    return n


def front_coded(rows: list[tuple]) -> bytes:
    """A run of sorted (sign and suffix, left context backwards, alone, entry, first place)."""
    rows.sort(key=lambda r: r[0])
    shared, last = [], b""
    for r in rows:
        shared.append(common(last, r[0]))
        last = r[0]
    parts = [
        np.array([len(rows)], "<u4").tobytes(), np.array([(c, len(r[0]) - c, len(r[1]), r[2]) for c, r in zip(shared, rows, strict=True)], "<u4").tobytes(),
        np.array([(r[3], *r[4]) for r in rows], "<i8").tobytes(), *(r[0][c:] for c, r in zip(shared, rows, strict=True)), *(r[1] for r in rows),
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


class Run:
    """Reads a front-coded run: head, and its common prefix with the suffix before it in the run."""

    def __init__(self, batch: int, body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body)
        self.batch, self.n = batch, int(np.frombuffer(raw, "<u4", 1)[0])
        self.facts = np.frombuffer(raw, "<u4", 4 * self.n, 4).reshape(-1, 4).tolist()
        self.places = np.frombuffer(raw, "<i8", 4 * self.n, 4 + 16 * self.n).reshape(-1, 4).tolist()
        self.raw, self.at, self.i, self.head = raw, 4 + 48 * self.n, -1, b""
        self.left_at = self.at + sum(f[1] for f in self.facts)

    def next(self) -> int:
        """Moves on; the common prefix of the new head with the last one, -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared, rest, left, self.alone = self.facts[self.i]
        self.head = self.head[:shared] + self.raw[self.at : self.at + rest]
        self.at += rest
        self.left = self.raw[self.left_at : self.left_at + left]
        self.left_at += left
        return shared


def merged(runs: list[Run]):
    """(run, common prefix with the one before) for each suffix of the runs in order, by a loser tree of prefix lengths."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    known = [0 if r.next() >= 0 else -1 for r in runs] + [-1] * (size - len(runs))  # common prefix with the last suffix put out

    def beats(a: int, b: int) -> bool:
        """Does the head of run a go before that of run b? The one that goes later learns its common prefix with the other."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka > kb  # the longer prefix shared with the last one out is the smaller suffix; -1, the end, goes last
        if ka < 0:
            return True
        x, y = runs[a].head, runs[b].head
        m = common(x, y, ka)
        first = m == len(x) or (m < len(y) and x[m] < y[m])
        known[b if first else a] = m
        return first

    losers, level, base = [0] * size, list(range(size)), size
    while len(level) > 1:
        base //= 2
        ahead = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            won = beats(a, b)
            ahead.append(a if won else b)
            losers[base + i // 2] = b if won else a
        level = ahead
    top = level[0]
    while known[top] >= 0:
        yield runs[top], known[top]
        known[top] = runs[top].next()
        node, now = (top + size) // 2, top
        while node:
            other = losers[node]
            if not beats(now, other):
                losers[node], now = now, other
            node //= 2
        top = now


def nearest_earlier(times: list[int], gaps: list[int]) -> list[int]:
    """For each item the largest common left context with an item of smaller time; gaps[i] is that of items i and i + 1."""
    n = len(times)
    best = [-1] * n
    for way in (1, -1):
        stack: list[tuple[int, int]] = []  # time, common context with the item below in the stack
        i = 0 if way > 0 else n - 1
        while 0 <= i < n:
            near = gaps[i - 1 if way > 0 else i] if stack else 0
            while stack and stack[-1][0] > times[i]:
                near = min(near, stack.pop()[1])
            if stack:
                best[i] = max(best[i], near)
            stack.append((times[i], near))
            i += way
    return best


def maximal(rights: list[int], lefts: list[bytes], length: int, times: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each suffix of a block the maximal matches (left, right) of at least `length` bytes with any other of the block, with times only with those of smaller time.

    rights[i]: common prefix of suffixes i and i + 1. Intervals of the LCP array are joined from deep to shallow, all of
    one depth at once; within each the nearest left contexts are neighbours in their order.
    """
    m = len(lefts)
    if m == 2:
        own = [(common(lefts[0], lefts[1]), rights[0])] if rights[0] + min(len(lefts[0]), len(lefts[1])) >= length else []
        own = [x for x in own if sum(x) >= length]
        return [own, own] if times is None else [own if times[0] > times[1] else [], own if times[1] > times[0] else []]
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]
    order = sorted(range(m), key=lefts.__getitem__)
    near = np.array([common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)] + [0], np.int64)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    owner = np.array(order)
    best = np.full(m, -1, np.int64)
    parts = {i: rank[i : i + 1] for i in range(m)}  # by first suffix of the interval
    begin = list(range(m))

    def root(a: int) -> int:
        while begin[a] != a:
            begin[a] = begin[begin[a]]
            a = begin[a]
        return a

    def joined(first: int, others: list[int], depth: int):
        both = np.sort(np.concatenate([parts.pop(x) for x in (first, *others)]))
        parts[first] = both
        for x in others:
            begin[x] = first
        gap = np.minimum.reduceat(near, both)[:-1]
        who = owner[both]
        if times is None:
            left = np.maximum(np.concatenate([[-1], gap]), np.concatenate([gap, [-1]]))
        else:
            left = np.array(nearest_earlier([times[x] for x in who.tolist()], gap.tolist()))
        better = (left > best[who]) & (left + depth >= length)
        for x, v in zip(who[better].tolist(), left[better].tolist(), strict=True):
            found[x].append((v, depth))
        best[who] = np.maximum(best[who], left)

    levels: dict[int, list[int]] = {}
    for i, r in enumerate(rights):
        levels.setdefault(r, []).append(i)
    for depth in sorted(levels, reverse=True):
        first, others = -1, []
        for i in levels[depth]:
            a = root(i)
            if others and a == others[-1]:
                others.append(i + 1)
            else:
                if others:
                    joined(first, others, depth)
                first, others = a, [i + 1]
        joined(first, others, depth)
    return found


def block_matches(runs: list[Run], length: int, keep_first: bool) -> dict[int, list[tuple[int, int, int]]]:
    """batch -> (entry, left, right) of the matches that the entries of a bucket's blocks still need."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    block, depths = [], []

    def close():
        if len(block) < 2:
            return
        times = None
        if keep_first:
            times = [0] * len(block)
            for t, i in enumerate(sorted(range(len(block)), key=lambda i: block[i][3][1:])):
                times[i] = t
        for (_, batch, alone, place), own in zip(block, maximal(depths[1:], [b[0] for b in block], length, times), strict=True):
            if alone or keep_first:
                found.setdefault(batch, []).extend((place[0], le, r) for le, r in own)

    for run, shared in merged(runs):
        if shared < SIGN:
            close()
            block, depths = [], []
        block.append((run.left, run.batch, run.alone, run.places[run.i]))
        depths.append(shared - SIGN)
    close()
    return found


def union_of(matches, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the matches (start, stop) of at least `length` bytes."""
    spans: list[tuple[int, int]] = []
    for start, stop in sorted((max(0, s), min(n, e)) for s, e in matches):
        if stop - start < length:
            continue
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], stop))
        else:
            spans.append((start, stop))
    return spans


class Places:
    """The places of a batch of documents: who has which sign where."""

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self.clear()

    def clear(self):
        self.slots: dict[int, int] = {}
        self.docs: list[int] = []
        self.times: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, doc_id: int | None, key: int, found) -> None:
        """found() -> signs, contexts, positions, and the node (a, b) of each."""
        if key in self.slots:
            self.times[self.slots[key]] += 1
            return
        slot = self.slots[key] = len(self.slots)
        self.docs.append(-(2**63) if doc_id is None else doc_id)
        self.times.append(1)
        sign, context, pos, a, b = found()
        self.parts.append((sign, context, np.full(len(sign), slot), pos, a, b))
        self.held += len(sign) + 1

    def rows(self):
        """One row for each sign (its places, contexts and first place), then the batch itself."""
        batch_id, self.number = (self.task << 24) + self.number, self.number + 1
        sign, context, slot, pos, a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, docs, times = np.array(list(self.slots), np.int64), np.array(self.docs, np.int64), np.array(self.times, np.int64)
        order = np.lexsort((pos, keys[slot], docs[slot], sign)) if len(sign) and (a == b).any() else np.argsort(sign, kind="stable")
        by_context = np.lexsort((context, sign))
        s, c = sign[by_context], context[by_context]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])] if len(s) else np.empty(0, bool)
        sign, slot, pos, a, b = (x[order] for x in (sign, slot, pos, a, b))
        first = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]]) if len(sign) else np.empty(0, np.int64)
        if len(first):
            leaf = pa.array(a[first] != b[first])  # no first place is needed there
            place = lambda x: pa.array(x[first], pa.int64(), mask=leaf.to_numpy(False))
            yield batch(
                SIGNED, np.zeros(len(first), np.int32), np.full(len(first), batch_id), sign[first], np.add.reduceat(times[slot], first), np.add.reduceat(fresh.astype(np.int64), first),
                place(docs[slot]), place(keys[slot]), place(pos), pa.nulls(len(first), pa.binary()),
            )
            body = [crammed(sign, slot, pos, a, b), crammed(keys, docs, times)]
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([batch_id]), *[pa.nulls(1, f.type) for f in list(SIGNED)[2:-1]], pa.array([len(body[0]).to_bytes(8, "little") + b"".join(body)], pa.binary())], schema=SIGNED)
        self.clear()


def node_sign(body: bytes, p: int, a: int, b: int, length: int) -> int | None:
    """Hash of the bytes that all windows of `length` bytes beginning a to b bytes before p share; None where no such window lies in body."""
    if p < a or p - b + length > len(body):
        return None
    return xxhash.xxh3_64_intdigest(body[p - a : p - b + length], a * 65_537 + b)


def split_node(a: int, b: int) -> list[tuple[int, int]]:
    cuts = np.unique(np.linspace(a, b + 1, min(FAN, b - a + 1) + 1).astype(int)).tolist()
    return [(x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False)]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None, carry: bool = False, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal runs of removed bytes), kept (the other bytes, put together).

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same document or another,
    overlapping or not; with keep_first only if it also starts at an earlier place, by (doc_id, hash of id and text,
    position). Strings are judged on the input and never cross documents. Texts are their UTF-8 bytes, null is empty,
    texts under `length` bytes keep all. Rows that repeat are documents of their own, and repeats of each other; with
    keep_first they are one document. A null doc_id is a document like any other, before all others. Two texts under
    one doc_id are two documents. Very long texts are hashed in blocks. An empty table gives no rows. Of the other
    columns none is read, so clashing names don't matter; with carry they come along in a struct `row` in place of
    doc_id, and kept is text without the bytes of letters cut in two.
    """
    spark = docs.sparkSession
    gram = gram or length // 2
    side = length - gram
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if carry else [])).withColumn("key", F.xxhash64("doc_id", "body"))
    long_enough = texts.where(F.length("body") >= length).select("doc_id", "key", "body")

    def signs_of(level: int):
        def run(batches):
            roll, held = Roll(gram), Places(TaskContext.get().partitionId())
            for b in batches:
                for doc_id, key, body, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist() if level else [None] * b.num_rows, strict=True):
                    body = body.as_py()

                    def grams(body=body):
                        at, kh = anchors(np.frombuffer(body, np.uint8), roll, length)
                        context = np.array([xxhash.xxh3_64_intdigest(body[max(0, p - side) : p + length], min(p, side)) for p in at.tolist()], np.uint64)
                        return kh.view(np.int64), context.view(np.int64), at, np.zeros(len(at), np.int64), np.full(len(at), side)

                    def children(body=body, nodes=nodes):
                        out = []
                        for p, a, z in zip(*(x.tolist() for x in uncrammed(nodes, 3)), strict=True):
                            context = xxhash.xxh3_64_intdigest(body[max(0, p - side) : p + length], min(p, side)) - (1 << 63)
                            out += [(sign - (1 << 63), context, p, x, y) for x, y in split_node(a, z) if (sign := node_sign(body, p, x, y, length)) is not None]
                        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5

                    held.add(doc_id, key, children if level else grams)
                    if held.held > BATCH_PLACES:
                        yield from held.rows()
            if held.parts:
                yield from held.rows()

        return run

    def ask(batches):
        for b in batches:
            for body, back in zip(b.column(0), b.column(1), strict=True):
                body, back = body.as_py(), back.values
                n = int.from_bytes(body[:8], "little")
                sign, slot, pos, a, z = (x.view(np.int64) for x in uncrammed(body[8 : 8 + n], 5))
                keys, docs_of, times = (x.view(np.int64) for x in uncrammed(body[8 + n :], 3))
                told = back.field("sign").to_numpy()
                order = np.argsort(told)
                at = order[np.minimum(np.searchsorted(told[order], sign), len(told) - 1)]
                here = told[at] == sign
                many = back.field("hot").to_numpy(zero_copy_only=False)[at]
                alike = here & many & (a == z)
                if keep_first:
                    first = [back.field(x).fill_null(0).to_numpy()[at] for x in ("d", "key", "pos")]
                    alike &= (first[0] != docs_of[slot]) | (first[1] != keys[slot]) | (first[2] != pos)
                kinds = (here & ~many, here & many & (a < z), alike)
                rows = []
                by_slot = np.argsort(slot, kind="stable")
                bounds = np.searchsorted(slot[by_slot], np.arange(len(keys) + 1))
                for i, key in enumerate(keys.tolist()):
                    own = by_slot[bounds[i] : bounds[i + 1]]
                    cold, warm, gone = (own[k[own]] for k in kinds)
                    if len(cold) + len(warm) + len(gone):
                        rows.append((key, int(times[i]), crammed(pos[cold], sign[cold]) if len(cold) else None, crammed(pos[warm], a[warm], z[warm]) if len(warm) else None, crammed(pos[gone] - a[gone], pos[gone] - a[gone] + length) if len(gone) else None))
                if rows:
                    yield batch(ASKED, *map(list, zip(*rows, strict=True)))

    # Level 0: all anchors; the levels after it: the nodes of hot grams.
    levels, entries, level, hot_docs, spent = [], 0, 0, long_enough, []
    while True:
        table = written(arrow_map(hot_docs, signs_of(level), SIGNED_SQL), "signs")
        known = table.where("kind = 0").groupBy("sign").agg(F.sum("n").alias("n"), F.sum("contexts").alias("contexts"), F.min(F.struct("d", "key", "pos")).alias("first")).where("n > 1")
        known = written(known.select("sign", (F.col("contexts") > hot).alias("hot"), "contexts", "first.*"), "known")
        sums = known.agg(F.sum(F.when(~F.col("hot"), F.col("contexts"))).alias("cold"), F.max("hot").alias("hot")).first()
        entries += sums.cold or 0
        back = table.where("kind = 0").select("batch", "sign").join(known.drop("contexts"), "sign").groupBy("batch").agg(F.collect_list(F.struct("sign", "hot", "d", "key", "pos")).alias("back"))
        asked = written(arrow_map(table.where("kind = 1").select("batch", "body").join(back, "batch").select("body", "back"), ask, ASKED_SQL), "asked")
        levels.append(asked.withColumn("level", F.lit(level)))
        spent += [table, known]
        if not sums.hot:
            break
        warm = asked.where("hot is not null").groupBy("key").agg(F.max("hot").alias("nodes"))
        hot_docs = long_enough.join(warm, "key").select("doc_id", "key", "body", "nodes")
        level += 1
    whole = reduce(DataFrame.union, levels)
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries * (length + side) // BUCKET_BYTES))

    def cut(batches):
        task, number = TaskContext.get().partitionId(), 0
        entry: dict[tuple, int] = {}
        facts, members, keys, docs_of = [], [], [], []

        def flush():
            nonlocal number
            batch_id, number = (task << 24) + number, number + 1
            count = [0] * len(facts)
            for e, _, _, times in members:
                count[e] += times
            first: list = [None] * len(facts)
            if keep_first:
                for e, slot, p, _ in members:
                    place = (docs_of[slot], keys[slot], p)
                    if first[e] is None or place < first[e]:
                        first[e] = place
            runs: dict[int, list] = {}
            for (sign, suffix, left), e in entry.items():
                runs.setdefault(sign % buckets, []).append((sign.to_bytes(SIGN, "big", signed=True) + suffix, left, int(count[e] == 1), e, first[e] or (0, 0, 0)))
            own = [crammed(*(np.array(x, np.int64) for x in zip(*(m[:3] for m in members), strict=True))), crammed(np.array(keys, np.int64), np.array(docs_of, np.int64)), crammed(np.array(facts, np.int64)[:, 0], np.array(facts, np.int64)[:, 1], np.array(count))]
            told = b"".join(len(x).to_bytes(8, "little") + x for x in own)
            out = [(0, bucket, batch_id, front_coded(r)) for bucket, r in runs.items()] + [(1, None, batch_id, told)]
            for x in (entry, facts, members, keys, docs_of):
                x.clear()
            return batch(CUT, *map(list, zip(*out, strict=True)))

        for b in batches:
            for doc_id, key, body, colds, times in zip(*(b.column(i) for i in range(5)), strict=True):
                body, slot = body.as_py(), len(keys)
                keys.append(key.as_py())
                docs_of.append(-(2**63) if doc_id.as_py() is None else doc_id.as_py())
                often = 1 if keep_first else min(2, times.as_py())
                for cold in colds.as_py():
                    pos, sign = uncrammed(cold, 2)
                    for p, s in zip(pos.tolist(), sign.view(np.int64).tolist(), strict=True):
                        x = (s, body[p : p + length], body[max(0, p - side) : p][::-1])
                        e = entry.setdefault(x, len(facts))
                        if e == len(facts):
                            facts.append((len(x[2]), len(x[1])))
                        members.append((e, slot, p, often))
                if len(facts) > BATCH_ENTRIES or len(members) > 8 * BATCH_ENTRIES:
                    yield flush()
        if members:
            yield flush()

    asked_of = whole.where("cold is not null").groupBy("key").agg(F.collect_set("cold").alias("colds"), F.sum(F.when(F.col("level") == 0, F.col("times")).otherwise(0)).alias("zero"), F.max("times").alias("some")).select("key", "colds", F.greatest("zero", "some").alias("times"))
    pieces = written(arrow_map(long_enough.join(asked_of, "key").dropDuplicates(["key"]).select("doc_id", "key", "body", "colds", "times"), cut, CUT_SQL), "suffixes")

    def merge(table: pa.Table) -> pa.Table:
        found = block_matches([Run(n, body) for n, body in zip(table.column("batch").to_pylist(), table.column("body").to_pylist(), strict=True)], length, keep_first)
        return table_of([(0, n, crammed(*(np.array(x, np.int64) for x in zip(*own, strict=True)))) for n, own in found.items() if own], TOLD)

    def resolve(table: pa.Table) -> pa.Table:
        """The removed strings of the documents of a batch."""
        extra, told = {}, None
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind:
                told = body
            else:
                for e, le, r in zip(*(x.tolist() for x in uncrammed(body, 3)), strict=True):
                    extra.setdefault(e, []).append((le, r))
        parts, at = [], 0
        while at < len(told):
            n = int.from_bytes(told[at : at + 8], "little")
            parts.append(told[at + 8 : at + 8 + n])
            at += 8 + n
        of, slot, pos = (x.view(np.int64) for x in uncrammed(parts[0], 3))
        keys, docs_of = (x.view(np.int64) for x in uncrammed(parts[1], 2))
        left, right, count = (x.view(np.int64) for x in uncrammed(parts[2], 3))
        full = count[of] > 1
        if keep_first:
            order = np.lexsort((pos, keys[slot], docs_of[slot], of))
            lead = order[np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])]
            full[lead] = False
        full &= left[of] + right[of] >= length
        whose, start, stop = [slot[full]], [(pos - left[of])[full]], [(pos + right[of])[full]]
        single = np.flatnonzero(~full)
        more = [(slot[i], pos[i] - le, pos[i] + r) for i, e in zip(single.tolist(), of[single].tolist(), strict=True) for le, r in extra.get(e, ())]
        if more:
            for held, x in zip((whose, start, stop), zip(*more, strict=True), strict=True):
                held.append(np.array(x, np.int64))
        whose, start, stop = (np.concatenate(x) for x in (whose, start, stop))
        order = np.argsort(whose, kind="stable")
        bounds = np.searchsorted(whose[order], np.arange(len(keys) + 1))
        rows = [(key, crammed(start[own], stop[own])) for i, key in enumerate(keys.tolist()) if len(own := order[bounds[i] : bounds[i + 1]])]
        return table_of(rows, SPANS)

    told = pieces.where("kind = 0").groupBy("bucket").applyInArrow(merge, "kind int, batch long, body binary").union(pieces.where("kind = 1").select("kind", "batch", "body"))
    spans = told.groupBy("batch").applyInArrow(resolve, "key long, spans binary").union(whole.where("spans is not null").select("key", "spans"))
    matches = spans.groupBy("key").agg(F.collect_set("spans").alias("matches"))
    discard(*spent)

    kept_type = "binary" if not carry else "string"

    def clean(batches):
        for b in batches:
            at = 0
            while at < b.num_rows:
                out, held, begin = [], 0, at
                while at < b.num_rows and held < 8 << 20:
                    body = b.column(1)[at].as_py()
                    own = [x for part in b.column(2)[at].as_py() or () for x in zip(*(y.view(np.int64).tolist() for y in uncrammed(part, 2)), strict=True)]
                    spans = union_of(own, len(body), length)
                    ends = [0, *(x for s in spans for x in s), len(body)]
                    kept = b"".join(body[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                    out.append((len(body), [{"start": s, "stop": e} for s, e in spans], kept.decode("utf-8", "ignore") if carry else kept))
                    held += len(body)
                    at += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, at - begin), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), SPAN, pa.string() if carry else pa.binary()), strict=True))], names=[b.schema.names[0], "n_bytes", "spans", "kept"])

    joined = texts.join(matches, "key", "left").select("row" if carry else "doc_id", "body", "matches")
    first = joined.select("row").schema.simpleString()[7:-1].replace("row:", "row ", 1) if carry else "doc_id long"
    return arrow_map(joined, clean, f"{first}, n_bytes long, spans array<struct<start: long, stop: long>>, kept {kept_type}")


def cleaned_documents(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """The rows of docs without the strings of `length` bytes that came at an earlier place; bytes of letters cut in two go too; n_chars, if there, follows."""
    got = suffix_dedup(docs, length, carry=True, keep_first=True)
    return got.select(*(F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c, t in docs.dtypes))
