"""Token counts of whole texts without their ids: pieces are counted once for each distinct pre-token.

A pre-token is a stretch of text that no piece of the vocabulary crosses: blanks and the letters after them, or one
character that no longer piece holds. Merges never leave it, so a text's tokens are the sum of its pre-tokens' tokens.
A batch of texts numbers its distinct pre-tokens and keeps each document's frequencies by number. The pre-tokens of all
batches meet in buckets by hash, where the library counts the pieces of each distinct one; the counts go back to the
batches that have it and are summed there. Words, frequencies and counts travel packed, a row for each batch and bucket.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, crammed, packed_words, stepped, uncrammed, unpacked_words, written

BLANK = "▁"
#: Bytes of text and distinct pre-tokens of a batch, at most but for its last document.
BATCH_BYTES, BATCH_WORDS = 16 << 20, 400_000
#: Words of all batches that a bucket has on average: what the task of a bucket may have to keep apart.
BUCKET_WORDS = 500_000
BATCHES = pa.schema([("batch", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("body", pa.binary())])
BATCHES_SQL = "batch long, n_words long, words binary, doc_ids array<long>, n_bytes array<long>, body binary"
ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])
ANSWERS = pa.schema([("batch", pa.int64()), ("counts", pa.binary())])
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def pre_token_pattern(path: str) -> str:
    """A regular expression of the pre-tokens of a sentencepiece BPE model, for texts with BLANK for spaces.

    Raises where the method would not be exact: other models than BPE, texts that are normalised, user-defined symbols,
    pieces with a blank after another character.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm, piece_type = m.normalizer_spec, proto.ModelProto.SentencePiece
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if m.trainer_spec.model_type != m.trainer_spec.BPE or not plain or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("token counts need a BPE model with a blank before the text and no other normalisation")
    if any(p.type in (piece_type.USER_DEFINED, piece_type.UNUSED) for p in m.pieces):
        raise ValueError("the model has symbols that are found before any merge")
    joined = {p.piece for p in m.pieces if p.type == piece_type.NORMAL and len(p.piece) > 1}
    if any(BLANK in p.lstrip(BLANK) for p in joined):
        raise ValueError("the model has pieces with a blank after another character")
    letters = sorted({c for p in joined for c in p} - {BLANK})
    if "\n" in letters:
        raise ValueError("the model has pieces with line ends")
    inside = "".join(map(re.escape, letters))
    return f"{BLANK}*[{inside}]+|{BLANK}+|[\\s\\S]" if letters else f"{BLANK}+|[\\s\\S]"


def numbered(rows: DataFrame, pattern: str) -> DataFrame:
    """rows(doc_id, text) -> a row for each batch: its distinct pre-tokens, and (document, pre-token, frequency) by number."""

    def run(batches):
        find, task, number = re.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, sizes, docs, words, times = [], [], [], [], []
        of: defaultdict[str, int] = defaultdict()
        of.default_factory = of.__len__

        def flush():
            nonlocal number
            doc, word, count = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (docs, words, times))
            order = np.lexsort((word, doc))
            doc, word, count = doc[order], word[order], count[order]
            step = np.where(stepped(doc + 1) > 0, word, stepped(word))
            out = batch(BATCHES, [(task << 32) + number], [len(of)], [packed_words([w.encode() for w in of])], [list(ids)], [list(sizes)], [crammed(stepped(doc), step, count)])
            number += 1
            of.clear()
            for c in (ids, sizes, docs, words, times):
                c.clear()
            return out

        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                found = Counter(find(BLANK + text.replace(" ", BLANK))) if text else {}
                docs.append(np.full(len(found), len(ids), np.int64))
                words.append(np.fromiter((of[w] for w in found), np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                held += sizes[-1]
                if held > BATCH_BYTES or len(of) > BATCH_WORDS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return arrow_map(rows, run, BATCHES_SQL)


def asked(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, batch, places, words: the words of each batch by buckets of their hash, with their numbers in the batch."""

    def run(batches):
        for b in batches:
            for number, body in zip(b.column("batch").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = unpacked_words(body)
                of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(of, kind="stable")
                found, first = np.unique(of[order], return_index=True)
                out = [(k, number, crammed(stepped(i)), packed_words([words[j] for j in i.tolist()])) for k, i in zip(found.tolist(), np.split(order, first[1:]), strict=True)] if len(words) else []
                if out:
                    yield batch(ASKED, *map(list, zip(*out, strict=True)))

    return arrow_map(table.select("batch", "words"), run, "bucket long, batch long, places binary, words binary")


def answered(rows: DataFrame, path: str) -> DataFrame:
    """batch, counts: the numbers of a batch's words in a bucket and their pieces by the library, which each task asks once for each distinct word.

    A line end before the word, which no piece holds, keeps the library's own blank away.
    """

    def run(batches):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        extra, bucket, known = len(m.encode("\n")), None, {}
        for b in batches:
            for i in range(b.num_rows):
                if b.column("bucket")[i].as_py() != bucket:
                    bucket, known = b.column("bucket")[i].as_py(), {}
                words = unpacked_words(b.column("words")[i].as_py())
                new = [w for w in words if w not in known]
                for j in range(0, len(new), 4096):
                    part = new[j : j + 4096]
                    known.update(zip(part, [len(x) - extra for x in m.encode(["\n" + w.decode() for w in part], num_threads=1)], strict=True))
                counts = np.fromiter((known[w] for w in words), np.int64, len(words))
                yield batch(ANSWERS, [b.column("batch")[i].as_py()], [crammed(uncrammed(b.column("places")[i].as_py(), 1)[0], counts)])

    return arrow_map(rows.sortWithinPartitions("bucket"), run, "batch long, counts binary")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens as sentencepiece gives them for the BPE model at path, without begin and end.

    A null text is empty: 0 bytes, 0 tokens; strings like "<s>" in a text are ordinary text. Null doc_ids stay null, rows
    that repeat are counted each; a very long text is a batch of its own, no part of it is left out, and a word of any
    length is one pre-token. An empty table gives no rows. Columns other than doc_id and text are not read, so clashing
    names don't matter. A batch sends each pre-token once, so that one in every text is one row for each batch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    table = written(numbered(rows, pre_token_pattern(path)), "frequencies")
    buckets = max(1, -(-(table.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    counts = answered(asked(table, buckets).repartition(buckets, "bucket"), path).groupBy("batch").agg(F.collect_list("counts").alias("counts"))  # no more than a batch's words

    def total(batches):
        for b in batches:
            for i in range(b.num_rows):
                doc, step, times = (c.astype(np.int64) for c in uncrammed(b.column("body")[i].as_py(), 3))
                ids = b.column("doc_ids")[i].values
                n = np.zeros(len(ids), np.int64)
                if len(doc):
                    of = np.zeros(b.column("n_words")[i].as_py(), np.int64)
                    for body in b.column("counts")[i].as_py():
                        place, count = uncrammed(body, 2)
                        of[np.cumsum(place.astype(np.int64))] = count
                    doc = np.cumsum(doc)
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    word = np.cumsum(step)
                    word -= np.repeat(np.r_[0, word[first[1:] - 1]], np.diff(np.r_[first, len(doc)]))
                    n[doc[first]] = np.add.reduceat(of[word] * times, first)
                yield batch(COUNTS, ids, b.column("n_bytes")[i].values, n)

    joined = table.select("batch", "n_words", "doc_ids", "n_bytes", "body").join(counts, "batch", "left")
    return arrow_map(joined.select("n_words", "doc_ids", "n_bytes", "body", "counts"), total, "doc_id long, n_bytes long, n_tokens long")
