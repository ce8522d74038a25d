"""The registered queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import read
from .exact_dedup import exact_dedup
from .hilbert_ann import nearest
from .line_dedup import line_dedup
from .ngram_join import ngram_components
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .source_divergence import source_divergence
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .warc import warc_round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.coalesce(F.aggregate(F.transform("spans", lambda s: s.stop - s.start), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    return suffix_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe_encode(read(spark, sf_dir, "documents"), tokenizer_path(), decode=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op6_bpe": op6_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op7_hilbert_ann": op7_hilbert_ann,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op1_substring_dedup": r"""
WITH pieces AS (
  SELECT doc_id, i, x AS piece, trim(x, ' ' || chr(9) || chr(13) || chr(10)) AS sentence
  FROM (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS xs FROM documents))
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM pieces WHERE sentence <> ''
), spans AS (
  SELECT a.doc_id, a.pos, md5(a.sentence || chr(31) || b.sentence || chr(31) || c.sentence) AS h
  FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN numbered c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM spans) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later
), whole AS (
  SELECT p.doc_id, count(n.pos) AS n_sentences, count(g.pos) AS n_removed,
         coalesce(string_agg(p.piece, '' ORDER BY p.i) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM pieces p LEFT JOIN numbered n ON p.doc_id = n.doc_id AND p.i = n.i LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos
  GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN whole w ON d.doc_id = w.doc_id
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM q
""",
    "op5_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)
), cut AS (
  SELECT *, trim(x, ' ' || chr(9) || chr(13)) AS line FROM raw
), n AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM cut WHERE line <> ''
), g AS (
  SELECT doc_id, pos, md5(line || chr(10) || lead(line) OVER w) AS two, md5(line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w) AS three
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), p AS (
  SELECT *, lag(two) OVER w AS before, lead(two) OVER w AS after FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), signs AS (
  SELECT doc_id, pos, 2 AS size, two AS sign FROM p WHERE two IS NOT NULL AND (two < after OR two <= before OR (before IS NULL AND after IS NULL))
  UNION ALL SELECT doc_id, pos, 3, three FROM p WHERE three IS NOT NULL
  UNION ALL SELECT doc_id, pos, 1, line FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20
), later AS (
  SELECT doc_id, pos, size FROM (SELECT *, row_number() OVER (PARTITION BY size, sign ORDER BY doc_id, pos) AS k FROM signs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM later
), whole AS (
  SELECT cut.doc_id, count(n.pos) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY cut.i) FILTER (WHERE gone.pos IS NULL), '') AS kept
  FROM cut LEFT JOIN n ON cut.doc_id = n.doc_id AND cut.i = n.i LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.pos = gone.pos GROUP BY cut.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM whole
""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS x FROM w
), n AS (
  SELECT w.doc_id, count(x) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), lab(v, c) USING KEY (v) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT m.v, min(m.c) FROM (SELECT ways.b AS v, lab.c FROM lab JOIN ways ON ways.a = lab.v) m JOIN recurring.lab AS old ON old.v = m.v WHERE m.c < old.c GROUP BY m.v
)
SELECT n.doc_id, n.n AS n_shingles, lab.c AS component_id FROM n JOIN lab ON n.doc_id = lab.v
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM r
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), o AS (
  SELECT doc, lang, source, unnest(ws) AS term FROM d
), kept AS (
  SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  -- crc32 of the decimal id: each byte, then eight shifts
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda y: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, role, text FROM r
), p(conv_id, depth, key, size) AS (
  SELECT conv_id, 0::BIGINT, sha256('')::VARCHAR, 0::BIGINT FROM c
  UNION ALL SELECT s.conv_id, s.depth, sha256(p.key || sha256(s.role) || sha256(s.text)), octet_length(encode(s.text))::BIGINT FROM p JOIN s ON s.conv_id = p.conv_id AND s.depth = p.depth + 1
), l AS (
  SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id
), n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY depth, key
), up AS (
  SELECT n.depth, n.key, p.key AS above FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), kids AS (
  SELECT above AS key, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL
), w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS saves FROM n LEFT JOIN kids USING (depth, key)
), below AS (
  SELECT a.depth, a.key, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.saves) AS saved_tokens
  FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY ALL
)
SELECT w.conv_id, w.depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN below USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN w o ON o.depth = w.depth - 1 AND o.key = up.above
""",
}
