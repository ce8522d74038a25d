"""Divergence of the sources of each language, counted and compared by DuckDB over shards of terms.

A batch of documents counts its terms by (lang, source) and leaves them packed. Shards by a hash of lang and term take
their part of every batch; in each, one DuckDB query keeps the terms of enough documents and sums their counts. With
the totals of all groups known, shards of the kept terms give by SQL the partial sums over pairs of sources and their
best terms; Spark merges sums and rankings.

Most sources lack most terms, so pairs are not compared term by term. With z a group's share of a term that it lacks,
f(p, q) = [f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)] + [f(p, zq) - f(zp, zq)] + [f(zp, q) - f(zp, zq)] + f(zp, zq):
the first bracket is 0 but where both have the term (a join within the shard), the next two need only how many terms a
group has at each count, the last one is a constant of the pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, crammed, packed_words, stepped, uncrammed, unpacked_words, written

#: Letters A to Z and every character beyond ASCII, in UTF-8 after A to Z are lowered.
TERM = rb"[a-z\x80-\xff]+"
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1_500_000
#: Rows (lang, source, term of a batch), and rows of kept terms, that a shard has on average.
SHARD_ROWS, KEPT_ROWS = 1_000_000, 250_000
TOP, SCALE = 10, 1_000_000_000
PACKED = [("langs", pa.binary()), ("sources", pa.binary()), ("words", pa.binary()), ("body", pa.binary())]
PACKED_SQL = "langs binary, sources binary, words binary, body binary"
COUNTED = pa.schema([("groups", pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))), ("n_rows", pa.int64()), *PACKED])
SHARDS = pa.schema([("shard", pa.int64()), *PACKED])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lead", pa.bool_())])
PARTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.int64())])

COUNTS_SQL = """
WITH k AS (SELECT lang, term FROM t GROUP BY ALL HAVING sum(docs) >= {least})
SELECT lang, source, term, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS lead
FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
"""
#: t: a row for each kept term of a group, with the group's total (own), the lang's (whole) and its number of terms (v).
PARTS_SQL = """
WITH w AS (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS every FROM t),
c AS (
  SELECT lang, source, term, n, (1 + {scale}::HUGEINT * (n + 2) // (own + 2 * v))::BIGINT AS p, (1 + {scale}::HUGEINT * 2 // (own + 2 * v))::BIGINT AS z, (1 + {scale}::HUGEINT * (every + 2) // (whole + 2 * v))::BIGINT AS q FROM w
), best AS (
  SELECT lang, source, term, f(p, q) AS value FROM c WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {top}
)
SELECT 'both' AS part, a.lang, a.source, b.source AS item, 0::BIGINT AS n, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z))::BIGINT AS value
FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'one', lang, source, NULL, n, count(*)::BIGINT FROM c GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, 0, value FROM best
"""


def database():
    """An own database in memory for a task: one thread, nothing on disk."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
    db.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
    return db


def counted(rows: DataFrame) -> DataFrame:
    """rows(lang, source, text) -> a row for each batch: its groups, and (group, term, occurrences, documents) packed."""

    def run(batches):
        find = re.compile(TERM).findall
        of: defaultdict[bytes, int] = defaultdict()
        of.default_factory = of.__len__
        groups: dict[tuple[str, str], int] = {}
        places, words, times, held, n = [], [], [], 0, 0

        def flush():
            place, word, count = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (places, words, times))
            key = word * len(groups) + place
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
            docs = np.diff(np.r_[first, len(key)])
            body = crammed(key[first] % len(groups), stepped(key[first] // len(groups)), np.add.reduceat(count, first) if len(key) else count, docs)
            langs, sources = (packed_words([g[i].encode() for g in groups]) for i in range(2))
            out = batch(COUNTED, [[{"lang": a, "source": b} for a, b in groups]], [len(first)], [langs], [sources], [packed_words(list(of))], [body])
            for c in (of, groups, places, words, times):
                c.clear()
            return out

        for b in batches:
            for lang, source, text in zip(*(b.column(i) for i in range(3)), strict=True):
                place = groups.setdefault((lang.as_py(), source.as_py()), len(groups))
                raw = text.as_buffer().to_pybytes().lower()
                found = Counter(find(raw))
                places.append(np.full(len(found), place, np.int64))
                words.append(np.fromiter((of[w] for w in found), np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
                held, n = held + len(raw), n + len(found)
                if held > BATCH_BYTES or n > BATCH_ROWS:
                    yield flush()
                    held = n = 0
        if groups:
            yield flush()

    return arrow_map(rows, run, f"groups array<struct<lang string, source string>>, n_rows long, {PACKED_SQL}")


def sharded(table: DataFrame, shards: int) -> DataFrame:
    """The batches' rows by shards of lang and term, packed again."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                langs, sources, words = (unpacked_words(b.column(k)[i].as_py()) for k in ("langs", "sources", "words"))
                if not words:
                    continue
                group, step, n, docs = (c.astype(np.int64) for c in uncrammed(b.column("body")[i].as_py(), 4))
                word = np.cumsum(step)
                of_word, of_lang = (np.fromiter(map(zlib.crc32, x), np.int64, len(x)) for x in (words, langs))
                shard = (of_word[word] + 31 * of_lang[group]) % shards
                order = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[order], return_index=True)
                out = []
                for k, at in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                    own_groups, g = np.unique(group[at], return_inverse=True)
                    own_words, w = np.unique(word[at], return_inverse=True)
                    names = (packed_words([x[j] for j in own_groups.tolist()]) for x in (langs, sources))
                    out.append((k, *names, packed_words([words[j] for j in own_words.tolist()]), crammed(g, stepped(w), n[at], docs[at])))
                yield batch(SHARDS, *map(list, zip(*out, strict=True)))

    return arrow_map(table.select("langs", "sources", "words", "body"), run, f"shard long, {PACKED_SQL}")


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n of the terms that at least `least` documents of the lang have; lead marks one row of each term."""

    def strings(body: bytes) -> pa.Array:
        return pa.array(unpacked_words(body), pa.binary()).cast(pa.string())

    def run(batches):
        db, shard = database(), None

        def close():
            for out in db.sql(COUNTS_SQL.format(least=least)).to_arrow_reader(100_000):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, KEPT, strict=True)], schema=KEPT)

        for b in batches:
            for i in range(b.num_rows):
                if b.column("shard")[i].as_py() != shard:
                    if shard is not None:
                        yield from close()
                    shard = b.column("shard")[i].as_py()
                    db.execute("CREATE OR REPLACE TABLE t (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
                group, step, n, docs = (c.astype(np.int64) for c in uncrammed(b.column("body")[i].as_py(), 4))
                lang, source, term = (strings(b.column(k)[i].as_py()) for k in ("langs", "sources", "words"))
                part = pa.table({"lang": lang.take(group), "source": source.take(group), "term": term.take(np.cumsum(step)), "n": n, "docs": docs})
                db.register("part", part)
                db.execute("INSERT INTO t SELECT * FROM part")
                db.unregister("part")
        if shard is not None:
            yield from close()
        db.close()

    return arrow_map(rows.sortWithinPartitions("shard"), run, "lang string, source string, term string, n long, lead boolean")


def parts_of(rows: DataFrame) -> DataFrame:
    """Of the kept terms of a shard: sums over pairs of sources that share terms, numbers of terms by count, the best terms of each group."""
    schema = pa.schema([(k, pa.string()) for k in ("lang", "source", "term")] + [(k, pa.int64()) for k in ("n", "own", "whole", "v")])

    def run(batches):
        db = database()
        db.execute("CREATE TABLE t (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, own BIGINT, whole BIGINT, v BIGINT)")
        for b in batches:
            db.register("part", pa.Table.from_batches([b.cast(schema)]))
            db.execute("INSERT INTO t SELECT * FROM part")
            db.unregister("part")
        for out in db.sql(PARTS_SQL.format(scale=SCALE, top=TOP)).to_arrow_reader(100_000):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, PARTS, strict=True)], schema=PARTS)
        db.close()

    return arrow_map(rows.select(*schema.names), run, "part string, lang string, source string, item string, n long, value long")


def share(n: str, total: str, v: str) -> str:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact at any count."""
    return f"1 + cast({SCALE} as decimal(38,0)) * ({n} + 2) div cast({total} + 2 * {v} as decimal(38,0))"


def gap(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def source_divergence(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a lang is from each other one (part "pair", all ranks), and the terms that it has most in excess of its lang (part "term", ranks to 10).

    Terms are runs of letters A to Z, lowered, and characters beyond ASCII; a lang keeps the terms of at least `least` of
    its documents. A null text, lang or source is ''. A group without terms, or a lang that keeps none, has its pairs
    (value 0 where no term is kept) and no terms; a lang with one source has no pairs. Rows that repeat are documents
    each; a very long text is counted as a whole; ties go by item in UTF-8. An empty table gives no rows. Columns other
    than text, lang and source are not read. A term in every text is one row for each batch and source in its shard.
    """
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    table = written(counted(rows), "counted")
    groups = table.select(F.inline("groups")).distinct()
    total = table.agg(F.sum("n_rows")).first()[0] or 0
    shards = max(1, -(-total // SHARD_ROWS))
    kept = written(kept_terms(sharded(table, shards).repartition(shards, "shard"), least), "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum(F.col("lead").cast("long")).alias("v"))
    own = groups.join(own, ["lang", "source"], "left").fillna(0, ["own", "v"])
    of_lang = own.groupBy("lang").agg(F.sum("own").alias("whole"), F.sum("v").alias("v"))
    totals = written(own.drop("v").join(of_lang, "lang"), "totals")
    parts = max(1, -(-kept.count() // KEPT_ROWS))
    found = written(parts_of(kept.join(totals, ["lang", "source"]).repartition(parts, "lang", "term")), "parts")

    # Groups that lack a term have the share z of it.
    z = totals.where("v > 0").withColumn("z", F.expr(share("0L", "own", "v")))
    a, b = z.select("lang", "source", "own", "v", "z"), z.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    other = F.col("source") != F.col("item")
    lack = a.join(b, "lang").where(other).select("lang", "source", "item", (F.col("v") * F.expr(gap("z", "y"))).alias("value"))
    times = found.where("part = 'one'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms"))
    times = times.join(a, ["lang", "source"]).withColumn("p", F.expr(share("n", "own", "v")))
    one = times.join(b, "lang").where(other).select("lang", "source", "item", (F.col("terms") * (F.expr(gap("p", "y")) - F.expr(gap("z", "y")))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = totals.where("v = 0").select("lang", "source")
    alone = none.join(none.select("lang", F.col("source").alias("item")), "lang").where(other).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    both = found.where("part = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = [x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for x in (one, both)]
    pairs = lack.unionByName(one).unionByName(both).unionByName(turned[0]).unionByName(turned[1]).unionByName(alone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").select("lang", "source", "item", "value")
    ranked = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")) for part, x in (("pair", pairs), ("term", best))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= TOP))
