"""Prefix trie of conversations by polynomial rolling fingerprints.

Each turn is a content: role and text, known by a 64-bit hash whose equal values are held against each other in full,
so that (hash, class) is as good as the content and no text goes further. A conversation's prefixes have polynomial
rolling fingerprints modulo two primes, found by numpy scans over ranges of the sorted turns; fragments of one
conversation in several ranges are put together by the same polynomial, so a conversation of any length is spread over
tasks. Rebuilt conversations, a head of one and the tail of another, get theirs by arithmetic on the two.

Prefixes of one depth and fingerprint are candidates for a node. Every member of a group is held against the group's
representative, its smallest conversation: the parent's group and the last turn's content must be the same, which by
induction over depths compares all turns. Where they are not, the group splits by content, and its children with it.

Parents get what their subtrees hold along the conversations instead of level by level: a node below is known by its
smallest conversation, which passes through all nodes above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch, written

#: Primes and bases of the two rolling sums; products stay below 2**63.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 741103597)
#: Turns of the base conversation that a rebuilt one begins with: less than this. Conversations that share a base: GROUP.
HEADS, GROUP = 9, 5
CHUNK_IDS = 1 << 16
ORDER = ("turn", "role_key", "text_key", "content", "kind")
PLACED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("sum", pa.int64()), ("content", pa.int64()), ("kind", pa.int64()), ("n_bytes", pa.int64())])
PLACED_SQL = "conv_id long, part long, at long, sum long, content long, kind long, n_bytes long"
MEMBERS = pa.schema([(k, pa.int64()) for k in ("conv_id", "depth", "label", "above", "content", "kind", "n_bytes", "last")])
MEMBERS_SQL = "conv_id long, depth long, label long, above long, content long, kind long, n_bytes long, last long"


def powers(lane: int, n: np.ndarray) -> np.ndarray:
    """BASES[lane] ** n modulo its prime."""
    p, out, square, left = PRIMES[lane], np.ones(len(n), np.int64), BASES[lane], n.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % p, out)
        square, left = square * square % p, left >> 1
    return out


def lanes(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 31, packed & 0x7FFFFFFF


def packed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one << 31) | two


def appended(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of a sequence of two parts from theirs; n is the length of the second."""
    return packed(*((b * powers(i, n) + a) % PRIMES[i] for i, (b, a) in enumerate(zip(lanes(before), lanes(after), strict=True))))


def without(whole: np.ndarray, head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of what follows a head: the last n turns of the whole."""
    return packed(*((w - h * powers(i, n)) % PRIMES[i] for i, (w, h) in enumerate(zip(lanes(whole), lanes(head), strict=True))))


def values(content: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A turn's term of either sum: low and high bits of its content's hash."""
    return (content + kind) % PRIMES[0], ((content >> 31) + kind) % PRIMES[1]


def scan(content: np.ndarray, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rolling sums within segments, whose first rows start marks; as many passes over the rows as the longest segment's length has bits."""
    place = np.arange(len(content))
    place -= np.maximum.accumulate(np.where(start, place, 0))
    out = []
    for i, (p, s) in enumerate(zip(PRIMES, values(content, kind), strict=True)):
        step = 1
        while (ahead := place >= step).any():  # s covers the last `step` rows at most
            at = np.flatnonzero(ahead)
            new = s.copy()
            new[at] = (s[at - step] * powers(i, np.array([step]))[0] + s[at]) % p
            s, step = new, step * 2
        out.append(s)
    return packed(*out)


def contents(rows: DataFrame, bits: int) -> DataFrame:
    """rows with content (a hash of role and text) and kind (0, but for contents that share a hash with another: their number)."""
    hashed = rows.withColumn("content", F.xxhash64("role", "text") if bits >= 64 else F.pmod(F.xxhash64("role", "text"), F.lit(1 << bits)))
    # Equal hashes are compared in full: the groups' keys are the contents themselves.
    distinct = hashed.groupBy("content", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    shared = distinct.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content")
    shared = written(shared, "collisions")
    if shared.isEmpty():
        return hashed.withColumn("kind", F.lit(0).cast("long"))
    kinds = hashed.join(shared, "content", "left_semi").select("content", "role", "text").distinct()
    kinds = written(kinds.withColumn("kind", (F.row_number().over(Window.partitionBy("content").orderBy("role", "text")) - 1).cast("long")), "kinds")
    return hashed.join(kinds, ["content", "role", "text"], "left").withColumn("kind", F.coalesce("kind", F.lit(0).cast("long")))


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, part (the range of the sorted turns), at (place within the conversation's fragment there, from 1), sum (the fragment's up to it)."""
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *ORDER[1:]]

    def run(batches):
        part, conv, count, held = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            own, content, kind = (b.column(k).to_numpy() for k in ("conv_id", "content", "kind"))
            start = np.r_[True, own[1:] != own[:-1]]
            sums = scan(content, kind, start)
            at = np.arange(len(own))
            at = at - np.maximum.accumulate(np.where(start, at, 0)) + 1
            if own[0] == conv:  # the last batch's conversation goes on
                n = int(np.argmax(np.r_[start[1:], True])) + 1
                sums[:n] = appended(np.full(n, held), sums[:n], at[:n])
                at[:n] += count
            conv, count, held = own[-1], int(at[-1]), int(sums[-1])
            yield batch(PLACED, own, np.full(len(own), part), at, sums, content, kind, b.column("n_bytes").to_numpy())

    slim = rows.select("conv_id", *ORDER, "n_bytes").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return arrow_map(slim.select("conv_id", "content", "kind", "n_bytes"), run, PLACED_SQL)


def whole_places(found: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), sum up to it, content, kind, n_bytes: fragments put together."""
    ends = found.groupBy("conv_id", "part").agg(F.max(F.struct("at", "sum")).alias("end"))
    split = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "end.at", "end.sum"))).alias("ends")).where(F.size("ends") > 1)
    before = []
    for r in split.toLocalIterator():  # a conversation in several ranges begins or ends one: at most two of them for each range
        n, s = 0, np.zeros(1, np.int64)
        for e in r.ends:
            before.append((r.conv_id, e.part, n, int(s[0])))
            n, s = n + e["at"], appended(s, np.array([e["sum"]]), np.array([e["at"]]))
    ahead = found.sparkSession.createDataFrame(before, "conv_id long, part long, n long, head long")
    joined = found.join(F.broadcast(ahead), ["conv_id", "part"], "left").select("conv_id", "at", "sum", "content", "kind", "n_bytes", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("head", F.lit(0).cast("long")).alias("head"))
    schema = pa.schema([(k, pa.int64()) for k in ("conv_id", "pos", "sum", "content", "kind", "n_bytes")])

    def run(batches):
        for b in batches:
            conv, at, sums, content, kind, size, n, head = (c.to_numpy() for c in b.columns)
            yield batch(schema, conv, n + at, appended(head, sums, at), content, kind, size)

    return arrow_map(joined, run, "conv_id long, pos long, sum long, content long, kind long, n_bytes long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The prefixes of all rebuilt conversations: conv_id, depth, label (fingerprint), above (the parent's), content, kind and n_bytes of the last turn, last (1 at a conversation's end). Depth 0 is left to those without turns."""
    heads = turns.where(F.col("pos") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sum", "content", "kind", "n_bytes"))).alias("heads"))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    own = sizes.join(heads, "conv_id").select("conv_id", "n", "heads", cut, base.alias("base"))
    known = own.join(own.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads")), "base", "left")
    known = known.withColumn("k", F.when(F.col("base_heads").isNull(), 0).otherwise(F.least(F.col("h"), F.size("base_heads").cast("long"))))
    sum_at = lambda heads, i: F.when((i > 0) & (i <= F.size(heads)), F.try_element_at(heads, F.greatest(i, F.lit(1)).cast("int"))["sum"]).otherwise(F.lit(0))
    known = written(
        known.select("conv_id", "n", "h", F.col("k").cast("long").alias("k"), sum_at(F.col("base_heads"), F.col("k")).cast("long").alias("head"), sum_at(F.col("heads"), F.col("h")).cast("long").alias("skipped"), F.slice("base_heads", 1, F.col("k").cast("int")).alias("base_heads")),
        "known",
    )
    tails = turns.join(known.where("n > h").select("conv_id", "n", "h", "k", "head", "skipped"), "conv_id").where("pos > h")

    def run(batches):
        for b in batches:
            conv, pos, sums, content, kind, size, n, h, k, head, skipped = (c.to_numpy() for c in b.columns)
            length = pos - h
            label = appended(head, without(sums, skipped, length), length)
            # The parent's sum: the last turn's value goes off again.
            above = packed(*((s - t) % p * pow(g, -1, p) % p for s, t, p, g in zip(lanes(label), values(content, kind), PRIMES, BASES, strict=True)))
            yield batch(MEMBERS, conv, k + length, label, above, content, kind, size, (pos == n).astype(np.int64))

    tail = arrow_map(tails.select("conv_id", "pos", "sum", "content", "kind", "n_bytes", "n", "h", "k", "head", "skipped"), run, MEMBERS_SQL)
    at = known.select("conv_id", "n", "h", "k", F.posexplode("base_heads").alias("i", "turn"), "base_heads")
    above = F.when(F.col("i") > 0, F.try_element_at("base_heads", F.greatest(F.col("i"), F.lit(1)))["sum"]).otherwise(F.lit(0).cast("long"))
    ends = ((F.col("i") + 1 == F.col("k")) & (F.col("n") <= F.col("h"))).cast("long")
    head = at.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "turn.sum", above.alias("above"), "turn.content", "turn.kind", "turn.n_bytes", ends.alias("last"))
    none = known.where("n <= h and k = 0").select("conv_id", *(F.lit(x).cast("long") for x in (0, 0, 0, 0, 0, 0, 1)))
    return tail.union(head).union(none)


def nodes_of(members: DataFrame) -> DataFrame:
    """One row per group of depth and label. lo and hi are the least and greatest (above, content, kind) in it: equal where all members agree with the representative, its smallest conversation."""
    last = F.struct("above", "content", "kind")
    return members.groupBy("depth", "label").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(last).alias("lo"), F.max(last).alias("hi"), F.max("n_bytes").alias("n_bytes"))


def split(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with labels such that each group has one parent and one last turn: groups that differ split by content, and their children after them, until none does."""
    number = 0
    while not (bad := nodes.where("lo != hi")).isEmpty():
        number += 1
        keys = ["depth", "label", "above", "content", "kind"]
        kinds = members.join(bad.select("depth", "label"), ["depth", "label"], "left_semi").groupBy(*keys).agg(F.min("conv_id").alias("first"))
        order = F.row_number().over(Window.partitionBy("depth", "label").orderBy("first", "above", "content", "kind"))
        moved = kinds.withColumn("i", order).where("i > 1").select(*keys, F.xxhash64(F.lit(number), *keys).alias("new"))
        moved = members.join(moved, keys, "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        parents = moved.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent"))
        moved = moved.join(parents, ["conv_id", "depth"], "left").withColumn("above", F.coalesce("parent", "above")).drop("parent")
        members = written(moved.select(*MEMBERS.names), "members", members)
        nodes = written(nodes_of(members.where("depth > 0")), "nodes", nodes)
    return members, nodes


def ahead_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the sum of value over the key's rows before: running sums within ranges of (key, order), and the ranges before added, so a key of any size is spread over tasks."""
    ranged = written(rows.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(key, "part").agg(F.sum(value).alias("s"))
    base = sums.withColumn("base", F.sum("s").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("base is not null").select(key, "part", "base")
    within = F.sum(value).over(Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("within", within).join(base, [key, "part"], "left").withColumn("before", F.coalesce("within", F.lit(0)) + F.coalesce("base", F.lit(0))).drop("within", "base", "part")


def joined_ids(ends: DataFrame) -> DataFrame:
    """depth, label, ends_sha256 of the conversations that end at each node, by rising id. Ranges of ids are joined to texts first; a node's texts then go through one running hash, in order, one at a time."""
    one = ends.groupBy("depth", "label").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("id"))
    several = ends.join(one.where("n > 1").select("depth", "label"), ["depth", "label"], "left_semi")
    schema = pa.schema([("depth", pa.int64()), ("label", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    done = pa.schema([("depth", pa.int64()), ("label", pa.int64()), ("ends_sha256", pa.string())])

    def chunks(batches):
        for b in batches:
            depth, label, conv = (b.column(k).to_numpy() for k in ("depth", "label", "conv_id"))
            cuts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (label[1:] != label[:-1])]) if len(conv) else conv
            stops = np.r_[cuts[1:], len(conv)]
            if len(conv):
                yield batch(schema, depth[cuts], label[cuts], conv[cuts], [",".join(map(str, conv[a:z].tolist())) for a, z in zip(cuts, stops, strict=True)])

    def hashes(batches):
        node, h = None, None
        for b in batches:
            out = []
            for depth, label, ids in zip(*(b.column(k).to_pylist() for k in ("depth", "label", "ids")), strict=True):
                if node != (depth, label):
                    if node is not None:
                        out.append((*node, h.hexdigest()))
                    node, h = (depth, label), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield batch(done, *map(list, zip(*out, strict=True)))
        if node is not None:
            yield batch(done, [node[0]], [node[1]], [h.hexdigest()])

    keys = ["depth", "label", "conv_id"]
    texts = arrow_map(several.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys), chunks, "depth long, label long, first long, ids string")
    many = arrow_map(texts.repartition("depth", "label").sortWithinPartitions("depth", "label", "first"), hashes, "depth long, label long, ends_sha256 string")
    return one.where("n = 1").select("depth", "label", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("ends_sha256")).union(many)


def prefix_trie(conversations: DataFrame, content_bits: int = 64, label_bits: int = 62) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first; turns of one number by role, then by the text's first 64 characters, then by
    a hash of the content, so repeated rows are repeated turns. Conversation c is rebuilt from the first h turns of
    c - c % 5 and its own turns after its first h, h = crc32(decimal c) % 9. A null role or text is empty; rows without
    a conv_id belong to no conversation and are left out. A node's conv_id is its smallest member; the root (depth 0) has
    all conversations, those without a turn too; an empty table has no root. Texts and conversations may be of any
    length. Other columns are not read. content_bits and label_bits weaken the hashes for tests; results don't depend on
    them.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = contents(rows, content_bits).select("conv_id", "turn", F.substring("role", 1, 64).alias("role_key"), F.substring("text", 1, 64).alias("text_key"), "content", "kind", F.octet_length("text").cast("long").alias("n_bytes"))
    found = written(placed(known), "turns")
    members = rebuilt(whole_places(found))
    if label_bits < 62:
        members = members.withColumns({k: F.when(F.col("depth") > (0 if k == "label" else 1), F.col(k) % (1 << label_bits)).otherwise(0).cast("long") for k in ("label", "above")})
    members = written(members, "members")
    nodes = written(nodes_of(members.where("depth > 0")), "nodes")
    members, nodes = split(members, nodes)
    return rolled_up(members, nodes)


def rolled_up(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Children, leaves and savings of every node from those of its subtree."""
    nodes = nodes.select("depth", "label", "n_convs", "conv_id", F.col("lo.above").alias("above"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("label")).agg(F.count(F.lit(1)).alias("n_children"))
    trie = written(nodes.join(children.where("depth > 0"), ["depth", "label"], "left").fillna(0, ["n_children"]), "trie")
    # What each conversation carries as the smallest one of nodes: their savings, and whether it ends in a leaf.
    carried = trie.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).where("saves > 0 or leaf > 0")
    sums = members.where("depth > 0").select("conv_id", "depth", "label").join(carried, "conv_id").groupBy("depth", "label").agg(F.sum("saves").alias("saves_below"), F.sum("leaf").alias("n_leaves"))
    trie_before = ahead_of(trie, "conv_id", "depth", "saves")
    ends = joined_ids(members.where("last = 1").select("depth", "label", "conv_id"))
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("label").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    root = members.where("last = 1").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).first()
    of_root = trie.agg(F.sum((F.col("depth") == 1).cast("long")).alias("children"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saves").alias("saves")).first()
    numbers = ["depth", "label", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parent = F.when(F.col("depth") == 1, F.lit(root.conv_id)).otherwise(F.col("parent_conv_id"))
    below = trie_before.join(sums, ["depth", "label"]).join(parents, ["depth", "above"], "left").withColumns({"parent_conv_id": parent, "saved_tokens": F.col("saves_below") - F.col("before")})
    top = [(0, 0, root.conv_id, None, root.n, of_root.children or 0, of_root.leaves or 1, of_root.saves or 0)] if root.n else []
    tops = trie.sparkSession.createDataFrame(top, ", ".join(f"{c} long" for c in numbers))
    found = below.select(*numbers).union(tops).join(ends, ["depth", "label"], "left")
    return found.select(*(c for c in numbers if c != "label"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
