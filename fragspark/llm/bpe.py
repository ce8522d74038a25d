"""Byte-level BPE: encoding through a minimal acyclic transducer of frequent words, and decoding.

Words are counted over all documents; the most frequent ones go with their ids into a minimal acyclic finite-state
transducer (shared prefixes and suffixes, ids as far towards the root as they are certain). Its flat image travels as
a broadcast of bounded size (`lexicon_words`), each Python worker memory-maps it from an unlinked file, and words that
it does not hold are merged exactly. A worker keeps the ids of words it has seen in a table of bounded size.
"""

from __future__ import annotations

import gc
import heapq
import json
import mmap
import struct
import tempfile
import uuid
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Letters and numbers that this regex module knows and the tokenizers library, with Unicode 16, does not.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Fixed value: the pattern that splits text into words before the merges, as the vocabulary's README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = regex.compile(PATTERN).findall
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HAS_NEWER = regex.compile(f"[{NEWER}]").search
WITHOUT_NEWER = regex.compile(
    "(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])").replace(r"?\p{L}", rf"?[\p{{L}}--[{NEWER}]]").replace(r"?\p{N}", rf"?[\p{{N}}--[{NEWER}]]")
).findall


def words_of(text: str) -> list[str]:
    return PLAIN(text) if text.isascii() or not HAS_NEWER(text) else WITHOUT_NEWER(text)


DOUBLE_WHITE = regex.compile(r"\s\s").search
SAFE_CUT = regex.compile(r"(?<=[^\s]) (?=[\p{L}])")
LEXICON_WORDS, LONGEST_WORD, MEMO_WORDS, TEXT_BLOCK, GROUP = 50_000, 64, 600_000, 1 << 20, 1 << 23
NO_END = 0xFFFFFFFF  # in a lexicon: no word ends at the node


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = i
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.int64(-1))  # the last one is none: a search past the end finds it
        self.pair_ranks = np.append(np.array(list(self.ranks.values()), np.int32)[order], np.int32(len(self.made)))
        self.made_ids = np.array(self.made, np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, len(made) for those that never merge."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs[:-1], keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], np.int32(len(self.made)))

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The same as merge of each word. Words of similar length go together, and each round merges one pair in each of them."""
        out: list = [()] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > 64:
                out[i] = self.merge_long([self.byte_ids[b] for b in w])
            elif w:
                classes.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        byte_ids = np.array(self.byte_ids, np.int32)
        for width, members in classes.items():
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
            ids, n = self.merge_block(byte_ids[raw], np.fromiter((len(words[i]) for i in members), np.int64, len(members)))
            flat, at = ids.tolist(), 0
            for i, k in zip(members, n.tolist(), strict=True):
                out[i] = tuple(flat[at : at + k])
                at += k
        return out

    def merge_block(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each row of byte ids, of which the first `lengths` count: all ids in a row, and how many each has."""
        m, width = ids.shape
        none = len(self.made)
        place = np.arange(width)
        alive = place < lengths[:, None]
        ranks = np.full((m, width), none, np.int32)  # of the pair that starts at each place
        ranks[:, :-1] = np.where(alive[:, 1:], self.ranks_of(ids[:, :-1], ids[:, 1:]), none)
        after = np.minimum(place + 1, lengths[:, None])  # the next id's place; the row's length where there is none
        before = np.tile(place - 1, (m, 1))
        rows = np.arange(m)
        while len(rows):
            i = ranks[rows].argmin(axis=1)  # the leftmost of the least
            least = ranks[rows, i]
            go = least < none
            rows, i, least = rows[go], i[go], least[go]
            j = after[rows, i]
            ids[rows, i] = self.made_ids[least]
            alive[rows, j], ranks[rows, j] = False, none
            k = after[rows, j]
            after[rows, i] = k
            right = k < lengths[rows]
            ranks[rows, i] = none
            r, x, y = rows[right], i[right], k[right]
            before[r, y] = x
            ranks[r, x] = self.ranks_of(ids[r, x], ids[r, y])
            h = before[rows, i]
            left = h >= 0
            r, x, y = rows[left], h[left], i[left]
            ranks[r, x] = self.ranks_of(ids[r, x], ids[r, y])
        return ids[alive], alive.sum(axis=1)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: always the pair of the least rank, leftmost of equals."""
        ids, rank, made, none = [self.byte_ids[b] for b in word], self.ranks.get, self.made, len(self.made)
        if len(ids) > 64:
            return self.merge_long(ids)
        ranks = [rank(pair, none) for pair in pairwise(ids)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same in O(n log n), over linked ids and a heap of pairs."""
        n, rank, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, *pair) for i, pair in enumerate(pairwise(ids)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return tuple(x for x in ids if x >= 0)

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Node:
    __slots__ = ("arcs", "ends", "final")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte: [node, ids]
        self.final, self.ends = False, ()


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The flat image of the minimal acyclic transducer that takes each word to its ids."""
    known: dict[tuple, Node] = {}
    path, last = [Node()], b""

    def settle(down_to: int) -> None:
        for i in range(len(last), down_to, -1):
            node = path.pop()
            key = (node.final, node.ends, tuple((b, id(t), o) for b, (t, o) in node.arcs.items()))
            path[i - 1].arcs[last[i - 1]][0] = known.setdefault(key, node)

    for word in sorted(w for w in words if w):
        ids, p = words[word], 0
        while p < min(len(word), len(last)) and word[p] == last[p]:
            p += 1
        settle(p)
        for b in word[p:]:
            path.append(Node())
            path[-2].arcs[b] = [path[-1], ()]
        path[-1].final = True
        for i in range(p):
            arc = path[i].arcs[word[i]]
            m = 0
            while m < min(len(arc[1]), len(ids)) and arc[1][m] == ids[m]:
                m += 1
            if rest := arc[1][m:]:
                arc[1], node = arc[1][:m], path[i + 1]
                for x in node.arcs.values():
                    x[1] = rest + x[1]
                if node.final:
                    node.ends = rest + node.ends
            ids = ids[m:]
        if p < len(word):
            path[p].arcs[word[p]][1] = ids
        else:
            path[p].ends = ids
        last = word
    settle(0)

    order, number = [path[0]], {id(path[0]): 0}
    for node in order:
        for t, _ in node.arcs.values():
            if id(t) not in number:
                number[id(t)] = len(order)
                order.append(t)
    pool: dict[tuple, int] = {}
    flat: list[int] = []

    def place(ids: tuple) -> int:
        if ids not in pool:
            pool[ids] = len(flat)
            flat.extend((len(ids), *ids))
        return pool[ids]

    keys, ends, targets, outs = [], [], [], []
    for i, node in enumerate(order):
        ends.append(place(node.ends) if node.final else NO_END)
        for b in sorted(node.arcs):
            t, o = node.arcs[b]
            keys.append(i << 8 | b)
            targets.append(number[id(t)])
            outs.append(place(o))
    parts = [np.array(x, kind).tobytes() for x, kind in ((keys, "<i8"), (ends, "<u4"), (targets, "<u4"), (outs, "<u4"), (flat, "<u4"))]
    return struct.pack("<6Q", *(len(x) for x in parts), 0) + b"".join(parts)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """A memory-mapped image of compile_lexicon: arcs by (node, byte), each with its target and the place of its ids."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # has no name: nothing stays when the worker goes
            f.write(image)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, parts = 48, []
        for n, kind in zip(struct.unpack_from("<6Q", self.map), ("<i8", "<u4", "<u4", "<u4", "<u4"), strict=False):
            width = int(kind[-1])
            parts.append(np.frombuffer(self.map, kind, n // width, at))
            at += n
        self.keys, self.ends, self.targets, self.outs, self.flat = parts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        return self.get_all([word])[0]

    def get_all(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None for those that the transducer does not take: all words take their next arc together."""
        found: list = [None] * len(words)
        if not len(self.keys) or not words:
            return found
        letters = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        arcs = np.zeros(len(letters), np.int64)  # the arc that each letter takes
        rows, node, taken = np.arange(len(words)), np.zeros(len(words), np.int64), []
        for step in range(int(lengths.max()) + 1):
            done = lengths[rows] == step
            taken.append((rows[done], node[done]))
            rows, node = rows[~done], node[~done]
            place = starts[rows] + step
            key = node << 8 | letters[place]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            rows, arc = rows[ok], arc[ok]
            arcs[place[ok]] = arc
            node = self.targets[arc].astype(np.int64)
        rows, node = (np.concatenate(x) for x in zip(*taken, strict=True))
        final = self.ends[node] != NO_END
        rows, node = rows[final], node[final]
        n = lengths[rows]
        # Each word's ids: those of its arcs in turn, then those of its last node.
        places = np.empty(int(n.sum()) + len(rows), np.int64)
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(places), bool)
        inner[last] = False
        places[inner] = self.outs[arcs[spread(starts[rows], n)]]
        places[last] = self.ends[node]
        sizes = self.flat[places].astype(np.int64)
        ids = self.flat[spread(places + 1, sizes)].tolist()
        bounds = [0, *np.cumsum(sizes)[last].tolist()]
        for i, (row, word) in enumerate(zip(rows.tolist(), bounds[1:], strict=True)):
            found[row] = tuple(ids[bounds[i] : word])
        return found


class WordIds:
    """The ids of words: from the lexicon, else by exact merging. Words seen are kept, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon, self.held = vocabulary, lexicon, {}

    def of(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """A table that holds the ids of all the words: those that were not seen are looked up and merged together."""
        held = self.held
        new = [w for w in words if w not in held]
        if not new:
            return held
        raw = [w.encode() for w in new]
        ids = self.lexicon.get_all([w if len(w) <= LONGEST_WORD else b"" for w in raw]) if self.lexicon else [None] * len(raw)
        rest = [i for i, x in enumerate(ids) if not x]
        for i, x in zip(rest, self.vocabulary.merge_all([raw[i] for i in rest]), strict=True):
            ids[i] = x
        if len(held) + len(new) <= MEMO_WORDS and max(map(len, raw)) <= LONGEST_WORD:
            held.update(zip(new, ids, strict=True))
            return held
        fits = [i for i, w in enumerate(raw) if len(w) <= LONGEST_WORD][: max(0, MEMO_WORDS - len(held))]
        held.update((new[i], ids[i]) for i in fits)
        return {**{w: held[w] for w in words if w in held}, **dict(zip(new, ids, strict=True))}


class PieceIds:
    """The ids of pieces between single white-space letters: each after a space, but those that begin with a line break.

    Pieces seen have a number each, up to a bound; their ids stand in one array.
    """

    def __init__(self, words: WordIds):
        self.words, self.held = words, {}
        self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int32)

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place and number of the ids of each piece, and the array that they stand in."""
        number = np.fromiter(map(self.held.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0)
        words, sizes = [], []
        for p in map(pieces.__getitem__, new.tolist()):
            core = p.rstrip(MARKS)
            if core.isalpha():  # letters, then marks: two words at most, without the pattern
                words.append(" " + core)
                if len(core) < len(p):
                    words.append(p[len(core) :])
            else:
                words += words_of(p if p[:1] == "\n" else " " + p)
            sizes.append(len(words))
        ids = list(map(self.words.of(set(words)).__getitem__, words))
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))][[0, *sizes]]
        known = len(self.lengths)
        lengths = np.r_[self.lengths, np.diff(ends)]
        flat = np.r_[self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))]
        number[new] = np.arange(known, known + len(new))
        kept = min(len(new), max(0, MEMO_WORDS // 2 - known))
        if kept:
            self.held.update((p, i) for i, p in enumerate(map(pieces.__getitem__, new[:kept].tolist()), known) if len(p) <= LONGEST_WORD)
            self.lengths, self.flat = lengths[: known + kept], flat[: len(self.flat) + int(ends[kept])]
        return (np.cumsum(lengths) - lengths)[number], lengths[number], flat


class Encoder:
    def __init__(self, path: str, image: bytes | None = None):
        self.vocabulary = Vocabulary(path)
        self.ids = WordIds(self.vocabulary, Lexicon(image) if image else None)
        self.pieces = PieceIds(self.ids)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")").split if self.vocabulary.special else lambda text: [text]
        self.marks = tuple(self.vocabulary.special)
        self.tokens = pa.array(self.vocabulary.token_bytes, pa.large_binary())

    def blocks(self, text: str):
        """The text cut where no word crosses, so that a very long text needs little at once."""
        at = 0
        while len(text) - at > 2 * TEXT_BLOCK:
            cut = SAFE_CUT.search(text, at + TEXT_BLOCK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def plain_ids(self, blocks: list[str]) -> list[np.ndarray]:
        """The ids of each block, by the pattern's words."""
        words = [words_of(b) for b in blocks]
        ids = self.ids.of(set(chain.from_iterable(words))).__getitem__
        return [np.fromiter(chain.from_iterable(map(ids, ws)), np.int32) for ws in words]

    def split_ids(self, blocks: list[str]) -> list[np.ndarray]:
        """The same for blocks in which no two white-space letters meet, with a line break put before each, by different pieces.

        Each white-space letter stands alone, so a space joins the piece after it, and pieces end there. A line break
        is a word of its own: it begins a piece, and the first one's id is left out again.
        """
        lists = pc.split_pattern(pa.array([b.replace("\n", " \n")[1:] for b in blocks], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        starts, lengths, flat = self.pieces.of(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        sizes = lengths[codes]
        out = flat[spread(starts[codes], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][lists.offsets.to_numpy()]
        return [out[a + 1 : b] for a, b in pairwise(ends.tolist())]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. All texts are worked on together."""
        parts: list[list] = [[] for _ in texts]
        split, plain = [], []  # (text, place in it, block)
        for number, text in enumerate(texts):
            for piece in self.split(text) if any(m in text for m in self.marks) else [text]:
                if piece in self.vocabulary.special:
                    parts[number].append(np.array([self.vocabulary.special[piece]], np.int32))
                    continue
                for block in self.blocks(piece):
                    led = "\n" + block
                    if DOUBLE_WHITE(led):
                        plain.append((number, len(parts[number]), block))
                    else:
                        split.append((number, len(parts[number]), led))
                    parts[number].append(None)
        for todo, encode in ((split, self.split_ids), (plain, self.plain_ids)):
            if todo:
                for (number, place, _), ids in zip(todo, encode([b for *_, b in todo]), strict=True):
                    parts[number][place] = ids
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_held: dict = {}


def encoder_of(path: str, key: str = "", image=None) -> Encoder:
    """One encoder per Python worker and lexicon."""
    if (path, key) not in _held:
        _held.clear()
        _held[path, key] = Encoder(path, image() if image else None)
        gc.freeze()  # the tables live as long as the worker: no need to walk them again and again
        gc.set_threshold(100_000, 50, 100)
    return _held[path, key]


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def id_lists(doc_ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))], schema=IDS)


def groups(texts: pa.Array, letters: int = GROUP):
    """The texts in lists of about `letters` letters, a longer text alone."""
    out, n = [], 0
    for text in texts:
        out.append(text.as_py())
        n += len(out[-1])
        if n >= letters:
            yield out
            out, n = [], 0
    if out:
        yield out


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word, a run without white space of fewer than LONGEST_WORD letters, comes in all documents."""

    def count(batches):
        for b in batches:
            for texts in groups(b.column(0)):
                words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string())).flatten()
                found = words.filter(pc.less(pc.utf8_length(words), LONGEST_WORD)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], schema=COUNTS)

    found = arrow_map(docs.select(F.coalesce("text", F.lit("")).alias("text")), count, "word string, n long")
    return found.where(F.length("word") < LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """The image of the transducer of the most frequent words of docs that come twice or more, at most `words`, each alone and after a space."""
    counts = written(word_counts(docs).where("n > 1"), "words")
    # A histogram of the counts in steps of a sixteenth of a factor of two tells from which count on `words` words are left: the driver gets no more.
    step = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():
        held += r.k
        if held > words:
            break
        least = r.step
    top = [] if least is None else counts.where(step >= least).select("word").collect()
    words = [w.encode() for w in {w for r in top for before in ("", " ") for w in words_of(before + r.word)}]
    return compile_lexicon(dict(zip(words, Vocabulary(path).merge_all(words), strict=True)))


def encoded(batches, path: str, key: str = "", image=None):
    """Batches of (doc_id, text) as batches of (doc_id, ids)."""
    encoder = encoder_of(path, key, image)
    for b in batches:
        at = 0
        for texts in groups(b.column(1)):
            found = encoder.encode_all(texts)
            yield id_lists(b.column(0).slice(at, len(texts)), found)
            at += len(texts)


def decoded(batches, path: str, key: str = "", image=None):
    """Batches of (doc_id, ids) with the texts that the ids stand for."""
    tokens = encoder_of(path, key, image).tokens
    for b in batches:
        lists = b.column(1)
        held = tokens.take(lists.flatten())
        places = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
        raw = memoryview(held.buffers()[2] or b"")
        sizes = lists.value_lengths().to_numpy()
        bounds = places[np.r_[0, np.cumsum(sizes)]].tolist()
        texts = [str(raw[x:y], "utf-8", "replace") for x, y in pairwise(bounds)]
        yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())], schema=TEXTS)


def bpe_encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, decode: bool = False) -> DataFrame:
    """doc_id and ids of each row of docs, exactly as the tokenizers library encodes with add_special_tokens=False; with decode also the decoded text.

    The strings of special tokens are special tokens. A null text is empty and has no ids. Rows that repeat give rows
    that repeat, a null doc_id stays null, other columns are not read. Texts of any length go in blocks of TEXT_BLOCK
    letters where no word crosses a border. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, lexicon_words))
    key = uuid.uuid4().hex

    def encode(batches):
        found = encoded(batches, path, key, lambda: held.value)
        return decoded(found, path, key, lambda: held.value) if decode else found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, encode, "doc_id long, ids array<int>" + ", decoded string" * decode)


def bpe_decode(encoded_rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, and decoded: the text that the ids stand for, special tokens included. Null ids are none."""
    rows = encoded_rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return arrow_map(rows, lambda batches: decoded(batches, path), "doc_id long, ids array<int>, decoded string")
