"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    conversation_trie,
    jaccard,
    language,
    lexical_search,
    line_dedup,
    media,
    mixing,
    neighbors,
    packing,
    pseudo_likelihood,
    quality,
    warc,
)
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    manifest = warc.write_archives(warc.chunk_table(table(spark, sf_dir, "pages")))
    return warc.pages_of(warc.read_archives(manifest, with_data=False)).drop("intact")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).taken().drop("source")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document."""
    return pseudo_likelihood.pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op5_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings."""
    return neighbors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.predicted(table(spark, sf_dir, "documents")).drop("spans")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among images drawn from all embeddings, and edits of every twentieth."""
    return media.copies(media.drawn(table(spark, sf_dir, "embeddings")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by their word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", odd), (-1, 1, "assistant", odd)],
        "conv_id long, turn long, role string, text string",
    )
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(own.unionByName(extra))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least five share."""
    left = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for each benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_neighbors": op5_neighbors,
    "op6_language": op6_language,
    "op7_media": op7_media,
    "op8_jaccard": op8_jaccard,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_lexical_search": op13_lexical_search,
}

# formatted_chars follows from the template: 20 control characters for a turn, =role or null for
# turns other than the user's, and one escape for each control string in a text
ORACLES = {
    "op9_chat": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(text) + len(regexp_extract_all(text,
    '<\\*/?s>|\[\\*/?INST\]|\[\\*/?ROLE\]')) AS escaped,
    CASE WHEN role = 'user' THEN 20 ELSE 20 + coalesce(len(role) + 1, 4) END AS frame
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), ''
    ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + frame)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op1_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
    "op5_neighbors": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    coalesce(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 0) AS norm,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 1) AS bad
  FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND bad = 0 AND norm > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id,
  coalesce(vec_id = component_id, false) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op8_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y USING (g)
  WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(n.n, 0)::BIGINT AS n_links
FROM sets LEFT JOIN c ON c.a = doc_id LEFT JOIN n ON n.a = doc_id
""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS mixed
  FROM documents
), n AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    source_size * 3 AS cap
  FROM n
), c AS (
  SELECT *, cap / weight AS ratio,
    sum(source_size) OVER () - sum(cap) OVER o + cap AS rest_words,
    sum(weight) OVER () - sum(weight) OVER o + weight AS rest_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, number)
), l AS (
  SELECT ratio AS r0, number AS n0, rest_words AS words0, rest_weight AS weight0 FROM c
  WHERE rest_words * weight <= cap * rest_weight ORDER BY ratio, number LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN (ratio, number) >= (r0, n0) THEN words0::DOUBLE * weight / weight0
      ELSE cap::DOUBLE END AS target
  FROM c, l
), p AS (
  SELECT doc_id, source, size,
    sum(size) OVER (PARTITION BY source ORDER BY mixed, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place
  FROM d
), q AS (
  SELECT p.*, t.source_size, t.target, floor(target + 0.5)::BIGINT AS quota
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(0,
    least(place + size, quota % source_size) - place) END::BIGINT AS taken
FROM q
""",
    "op11_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM d
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l
), h AS (
  SELECT key, max(doc_id) AS top FROM k WHERE len(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, coalesce(k.doc_id < h.top, false) AS goes FROM k LEFT JOIN h ON k.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM m GROUP BY r
""",
    # a turn's id is a digest of role and text; the CRC runs over the digits, eight steps for each
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'id': id, 'n': len(text)} ORDER BY turn NULLS FIRST, id) AS own FROM t GROUP BY conv_id
), h AS (
  SELECT *, xor(list_reduce([4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295) % 6 AS h
  FROM o
), s AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS turns
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s
), m AS (
  SELECT conv_id AS c, depth, len(turns) = depth AS ends,
    array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.id), '') AS k,
    CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END AS n
  FROM p
), n AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, left(k, 32 * (depth - 1)) AS up,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY k, depth
), ch AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.up = n.k AND ch.depth = n.depth
), a AS (SELECT unnest(range(0, depth + 1)) AS lvl, * FROM w),
sub AS (
  SELECT left(k, 32 * lvl) AS k, lvl AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * n) AS saved_tokens
  FROM a GROUP BY left(k, 32 * lvl), lvl
)
SELECT w.conv_id, w.depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves,
  sub.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN sub USING (k, depth) LEFT JOIN n up ON w.depth > 0 AND up.k = w.up AND up.depth = w.depth - 1
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS terms
  FROM documents
), s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), t AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, s GROUP BY term
), m AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM d, s),
i AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS impact FROM t JOIN w USING (term) JOIN m USING (r)
), h AS (
  SELECT item_id, r, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r
), k AS (
  SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM h JOIN m USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
""",
}
