"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_naming import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op10_block_naming"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""


@_query
def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@_query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op8_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip_digests

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)


@_query
def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .length_packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLES["op6_warc_zip"] = """
WITH t AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT t.page_id, t.payload_bytes, t.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND t.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND t.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM t LEFT JOIN f USING (payload_digest)
"""


@_query
def op2_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_diff import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op1_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .kdtree_search import integer_vectors, top_k

    return top_k(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), F.col("id") % 50 == 0)


ORACLES["op1_kdtree"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's bytes; ``crc_table`` must be in reach."""
    digits = f"list_transform(string_split(rtrim(regexp_replace(hex({text}), '(..)', '\\1 ', 'g')), ' '), lambda x: coalesce(TRY_CAST('0x' || x AS BIGINT), 0))"
    return f"(CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295], {digits}), lambda a, x: xor(a >> 8, crc_table[(xor(a, x) & 255) + 1])), 4294967295) END)"


_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table)"


@_query
def op11_pointer_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLES["op11_pointer_trie"] = rf"""
WITH raw AS (
  SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM raw), {_CRC_TABLE}),
b AS (SELECT c.*, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM raw GROUP BY 1) USING (base)),
t AS (SELECT b.conv_id, pos, digest, words FROM b JOIN raw r ON r.conv_id = base AND pos <= h
  UNION ALL SELECT b.conv_id, pos - h + least(h, n), digest, words FROM b JOIN raw r ON r.conv_id = b.conv_id AND pos > h),
l AS (SELECT conv_id, coalesce(ds, []) AS ds, coalesce(ws, []) AS ws FROM c LEFT JOIN (SELECT conv_id, list(digest ORDER BY pos) AS ds, list(words ORDER BY pos) AS ws FROM t GROUP BY 1) USING (conv_id)),
m AS (SELECT conv_id, ds, ws, unnest(range(len(ds) + 1)) AS depth FROM l),
n AS (SELECT depth, ds[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(max(ws[depth]), 0) AS own,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ds) = depth), '') AS ends FROM m GROUP BY ALL),
k AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (SELECT key[1:up] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.key = v.key LEFT JOIN n p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.key = v.key[1:v.depth - 1]
"""


@_query
def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve_sharding import assign_documents

    return assign_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"))


def _hilbert_sql() -> str:
    from .curve_sharding import walk_table

    walk = f"{walk_table(3)}"
    cell = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE (count({c}) OVER (ORDER BY {c} NULLS FIRST RANGE UNBOUNDED PRECEDING) * 64 + count({c}) OVER () - 1) // count({c}) OVER () - 1 END"
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32, source, lang, n_chars FROM documents, {_CRC_TABLE}),
c AS (SELECT doc_id, size, text_crc32, [{cell("source")}, {cell("lang")}, {cell("n_chars")}] AS cells FROM d),
h AS (SELECT *, list_reduce(list_concat([0::BIGINT], list_transform([5, 4, 3, 2, 1, 0], lambda k: ((cells[1] >> k) & 1) + 2 * ((cells[2] >> k) & 1) + 4 * ((cells[3] >> k) & 1))),
  lambda w, corner: ((w >> 10) << 13) + {walk}[(w & 1023) * 8 + corner + 1]) >> 10 AS curve FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS position, count(*) OVER () AS n FROM h)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(position * 24 // n AS INTEGER) AS shard,
  position - (position * 24 // n * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve, list_transform(cells, lambda x: CAST(x AS INTEGER)) AS cells
FROM p
"""


ORACLES["op12_hilbert_shards"] = _hilbert_sql()


@_query
def op13_pq_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pq_negatives import hard_negatives, labelled_vectors

    return hard_negatives(labelled_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")), F.col("id") % 100 == 0)


ORACLES["op13_pq_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.row AS anchor_row, a.vec_id AS anchor_id, o.row, o.vec_id, o.label = a.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.row <> o.row AND len(a.e) = len(o.e)
  WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, row) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_row, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_row = s.anchor_row AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""
