"""N-gram Jaccard self-join by prefixes with token combinations.

1. Every document's distinct word shingles are hashed; the shingles of a batch of documents travel to the buckets of
   their hash as sorted, delta-coded blocks, where each one's document frequency is counted, and come back with it.
   A shingle that comes often within one batch travels as a count, so one hot shingle is one entry per batch.
2. Shingles are ordered by document frequency. Shingles of one document alone can match nothing: a document that has
   too few others is done.
3. The others index a prefix: rare shingles one by one, frequent ones (more than `rare` documents) in 2-combinations
   within hash classes. A class's first shingle counts nothing, so the prefix is extended until the shingles that count
   exceed those that a partner may miss: then two documents over the threshold share a shingle or a combination.
4. Documents that share any of these fall into one block (connected components over one star per index entry). Within
   a block, split into tiles of bounded size, the exact overlaps are counted against the documents not yet reached, so
   a group of mutual copies costs little more than one pass, and only a spanning forest leaves the task.

Equal sets are one class from step 3 on; they are never paired.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crammed, free_names, table_of, uncrammed, written
from .components import components

SHINGLE, PERCENT, RARE, HOT_IN_BATCH = 5, 75, 64, 64
BATCH_SHINGLES, TILE_SHINGLES, MEMO_WORDS = 1 << 19, 2 << 20, 100_000
BITS = 48  # of a shingle's hash that travel
ODD, HOT = np.uint64(0x9E3779B97F4A7C15), 0xFFFFFFFF
BLOCKS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
BACK = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("rare", pa.int64()), ("tokens", pa.binary())])
SIGNS = pa.schema([("sign", pa.int64()), ("rep", pa.int64())])
FOREST = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h


def shingles(text: str, size: int, word_hash: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII letters lower-cased, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * ODD
        h ^= h >> np.uint64(31)
    return np.unique(h)


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def class_counts(n: int, percent: int) -> set[int]:
    """How many hash classes frequent shingles fall in: that of the smaller document of a pair, for every partner possible."""

    def of(s: int) -> int:
        most, g = max(1, least_overlap(s, percent) - 1), 1
        while 2 * g <= min(most, s // 2):
            g *= 2
        return g

    return {of(s) for s in range(max(1, least_overlap(n, percent)), n + 1)}


def signatures(tokens: np.ndarray, n: int, rare: int, percent: int) -> set[int]:
    """What one set indexes. tokens: its shingles of two documents or more, by frequency; the first `rare` are rare."""
    need = n - least_overlap(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return set()
    out = set(map(int, tokens[: min(rare, need)].view(np.int64)))
    need -= rare
    if need <= 0:
        return out
    frequent = tokens[rare:].tolist()
    for g in class_counts(n, percent):
        held: dict[int, list[int]] = {}
        short = need
        for t in frequent:
            own = held.setdefault((t >> 7) % g, [])
            short -= bool(own)
            own.append(t)
            if not short:
                break
        for own in held.values():
            out.update(xxhash.xxh3_64_intdigest(b"%d %d %d" % (g, *sorted(pair))) - (1 << 63) for pair in combinations(own, 2))
    return out


def shingle_blocks(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    shift = np.uint64(BITS - (buckets.bit_length() - 1))

    def cut(batches):
        memo, task, number = WordHash(), TaskContext.get().partitionId(), 0
        ids, counts, digests, sets, held = [], [], [], [], 0

        def flush():
            nonlocal ids, counts, digests, sets, held, number
            if not ids:
                return
            batch, number = (task << 24) + number, number + 1
            h = np.concatenate(sets) >> np.uint64(64 - BITS)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(h)])
            hot = np.repeat(n >= HOT_IN_BATCH, n)
            lead = np.zeros(len(h), bool)
            lead[first] = True
            sink = pa.BufferOutputStream()
            local = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64()), "digest": pa.array(digests, pa.binary())})
            with pa.ipc.new_stream(sink, local.schema) as w:
                w.write_batch(local)
            own = sink.getvalue().to_pybytes()
            hot_body = crammed(np.diff(h[hot], prepend=np.uint64(0)), owner[hot])
            rows = [(batch % buckets, batch, 1, len(own).to_bytes(8, "little") + own + hot_body)]
            times = np.where(hot, np.repeat(n, n), 1).astype(np.uint64)
            sent = ~hot | lead
            h, owner, times = h[sent], np.where(hot, HOT, owner)[sent].astype(np.uint64), times[sent]
            bounds = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64))
            for r in range(buckets):
                a, b = bounds[r], bounds[r + 1]
                if b > a:
                    rows.append((r, batch, 0, crammed(np.diff(h[a:b], prepend=np.uint64(0)), owner[a:b], times[a:b])))
            ids, counts, digests, sets, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), BLOCKS, strict=True)], schema=BLOCKS)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), size, memo)
                ids.append(doc_id)
                counts.append(len(s))
                named = doc_id is not None and len(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if named else None)
                sets.append(s if named else s[:0])
                held += len(s)
                if held > BATCH_SHINGLES or len(ids) >= 60_000:
                    yield from flush()
        yield from flush()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), cut, "bucket int, batch long, kind int, body binary")


def count_bucket(table: pa.Table) -> pa.Table:
    """Back to each batch: its shingles of this bucket that two documents or more have, with their document frequency."""
    kinds, batches, bodies = (table.column(k).to_pylist() for k in ("kind", "batch", "body"))
    rows = [(b, 1, body) for k, b, body in zip(kinds, batches, bodies, strict=True) if k]
    parts = [(b, uncrammed(body, 3)) for k, b, body in zip(kinds, batches, bodies, strict=True) if not k]
    if parts:
        tokens = [np.cumsum(p[0], dtype=np.uint64) for _, p in parts]
        distinct, where = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(where, np.concatenate([p[2] for _, p in parts]).astype(np.float64)).astype(np.uint64)
        df, at = df[where], 0
        for (b, p), t in zip(parts, tokens, strict=True):
            f = df[at : at + len(t)]
            at += len(t)
            if (keep := f >= 2).any():
                rows.append((b, 0, crammed(np.diff(t[keep], prepend=np.uint64(0)), p[1][keep], f[keep])))
    return table_of(rows, BACK)


def sets_of_batch(percent: int, rare: int):
    def gather(table: pa.Table) -> pa.Table:
        """The documents of a batch, with the shingles of those that may have a partner, by document frequency."""
        tokens, owners, dfs, own = [], [], [], None
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            if kind:
                own = body
            else:
                t, o, f = uncrammed(body, 3)
                tokens.append(np.cumsum(t, dtype=np.uint64))
                owners.append(o)
                dfs.append(f)
        size = int.from_bytes(own[:8], "little")
        local = pa.ipc.open_stream(own[8 : 8 + size]).read_all().to_pydict()
        t, o, f = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (tokens, owners, dfs))
        hot_t, hot_o = uncrammed(own[8 + size :], 2)
        if len(hot_t):
            hot_t = np.cumsum(hot_t, dtype=np.uint64)
            lead = o == HOT
            known, freq = t[lead], f[lead]
            order = np.argsort(known)
            hot_f = freq[order][np.searchsorted(known[order], hot_t)]
            t, o, f = (np.concatenate([x[~lead], y]) for x, y in ((t, hot_t), (o, hot_o), (f, hot_f)))
        order = np.lexsort((t, f, o))
        t, o, f = t[order], o[order], f[order]
        bounds = np.searchsorted(o, np.arange(len(local["n"]) + 1, dtype=np.uint64))
        rows, seen = [], set()
        for i, (doc_id, n, digest) in enumerate(zip(local["doc_id"], local["n"], local["digest"], strict=True)):
            a, b = bounds[i], bounds[i + 1]
            wanted = digest is not None and digest not in seen and b - a >= max(1, least_overlap(n, percent))
            if wanted:
                seen.add(digest)
            rows.append((doc_id, n, digest, int((f[a:b] <= rare).sum()) if wanted else None, t[a:b].tobytes() if wanted else None))
        return table_of(rows, SETS)

    return gather


def linked(tokens: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each set a set of the same component over links: 100 * intersection >= percent * union."""
    count = len(tokens)
    root = np.arange(count)
    lengths = np.array([len(t) for t in tokens])
    _, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    owner = np.repeat(np.arange(count), lengths)
    ends = np.cumsum(lengths)
    times = np.bincount(flat)
    weight = np.bincount(owner, times[flat], minlength=count)
    free = np.ones(count, bool)

    def postings():
        keep = free[owner]
        f, o = flat[keep], owner[keep]
        order = np.argsort(f, kind="stable")
        return o[order], np.concatenate([[0], np.cumsum(np.bincount(f, minlength=len(times)))])

    docs, start = postings()
    left = built = count
    for seed in np.argsort(-weight, kind="stable"):
        if not free[seed]:
            continue
        free[seed], stack, left = False, [seed], left - 1
        while stack and left:
            if left < built // 2:
                docs, start = postings()
                built = left
            x = stack.pop()
            own = flat[ends[x] - lengths[x] : ends[x]]
            n = start[own + 1] - start[own]
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            both = np.bincount(docs[at], minlength=count)
            new = np.flatnonzero(free & (both > 0) & (100 * both >= percent * (sizes[x] + sizes - both)))
            if len(new):
                free[new], root[new] = False, root[x]
                left -= len(new)
                stack.extend(new.tolist())
    return root


def ngram_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, tile: int = TILE_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word shingles; shorter
    texts have their whole word sequence as one shingle. component_id is the least doc_id that links reach, the own one
    included. A null text is empty; empty texts link with nothing. A row with a null doc_id is counted but links with
    nothing and has a null component. Rows that repeat a doc_id are each in the component of their own text. Sets are
    compared by 48 bits of each shingle's hash: a wrong match within a pair has a chance of about 1e-9.
    """
    spark = docs.sparkSession
    buckets = 1 << max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    blocks = shingle_blocks(docs, size, buckets)
    counted = blocks.groupBy("bucket").applyInArrow(count_bucket, "batch long, kind int, body binary")
    sets = written(counted.groupBy("batch").applyInArrow(sets_of_batch(percent, rare), "doc_id long, n long, digest binary, rare long, tokens binary"), "sets")

    reps = written(sets.where("tokens is not null").groupBy("digest").agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.max("tokens").alias("tokens")).join(
        sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "digest").select("rep", "n", "rare", "tokens"), "reps")

    def index(batches):
        for b in batches:
            signs, owners = [], []
            for rep, n, few, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = signatures(np.frombuffer(raw, np.uint64), n, few, percent)
                signs.extend(own)
                owners.extend([rep] * len(own))
                if len(signs) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(owners, pa.int64())], schema=SIGNS)
                    signs, owners = [], []
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(owners, pa.int64())], schema=SIGNS)

    signs = arrow_map(reps, index, "sign long, rep long")
    centre = signs.groupBy("sign").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    block = components(signs.join(centre, "sign").where("rep != centre").select("rep", "centre"), "rep", "centre")

    placed = reps.join(block.withColumnRenamed("root", "block"), F.col("rep") == F.col("v")).select("block", "rep", "n", "tokens")
    weight = placed.groupBy("block").agg(F.ceil(F.sum(F.length("tokens") / 8) / tile).alias("parts"))
    # A block of p parts is checked as p * (p + 1) / 2 tiles of two parts each; nearly all blocks are one tile.
    dealt = placed.join(weight, "block").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).select(
        "block", "rep", "n", "tokens",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.struct(F.least(F.col("part"), other).alias("i"), F.greatest(F.col("part"), other).alias("j")))).alias("tile"),
    )

    def check(table: pa.Table) -> pa.Table:
        rep = np.array(table.column("rep").to_pylist(), np.int64)
        root = linked([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()], np.array(table.column("n").to_pylist(), np.int64), percent)
        there = root != np.arange(len(root))
        return pa.Table.from_arrays([pa.array(rep[there]), pa.array(rep[root[there]])], schema=FOREST)

    found = components(dealt.groupBy("block", "tile").applyInArrow(check, "a long, b long"), "a", "b")
    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")).join(found, F.col("rep") == F.col("v"), "left").select("digest", F.coalesce("root", "rep").alias("component"))
    return sets.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def near_deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; rows with a null doc_id stay, and so do rows that repeat the id that stays. Columns of docs may have any names."""
    (name,) = free_names(docs.columns, "kept_id")
    kept = ngram_components(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null"))
