"""The queries of this subpackage: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import alignment, byte_bpe, chunk_prints, divergence, exact_dedup, jaccard_join, mixing, mpeg_audio, quality, sharding, token_counts, toxicity, url_filter

#: Fixed values of the contract: the URL rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, _labels(spark, sf_dir)))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each run, so that every run encodes all distinct texts."""
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(_documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digests(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_prints.compare_with_edits(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_mixing_sources, op3_token_counts, op4_toxicity, op5_sharding, op6_url_filters, op7_exact_dedup, op8_byte_level_bpe, op9_ngram_jaccard_join, op10_media_columns, op11_source_divergence, op12_token_alignment, op13_document_fingerprints)}


_URL_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
"""

_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


_MIX_SQL = """
WITH s AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM s GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM p
), l AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) / weight AS need,
    (CAST(sum(source_size) OVER () * 3 AS DOUBLE) / 2
      - coalesce(sum(source_size * 2) OVER (ORDER BY CAST(source_size * 2 AS DOUBLE) / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY CAST(source_size * 2 AS DOUBLE) / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w
), t AS (
  SELECT nth, source, source_size, least(coalesce(weight * (SELECT arg_min(lvl, (need, nth)) FROM l WHERE need > lvl), 0.0), CAST(source_size * 2 AS DOUBLE)) AS target FROM l
), e AS (
  SELECT *, CAST(floor(sum(target) OVER (ORDER BY nth) / sum(target) OVER () * 2147483648) AS BIGINT) AS hi FROM t WHERE target > 0
), i AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY nth), 0) AS lo, (source_size + 63) // 64 AS blocks FROM e
), g AS (
  SELECT t, (t % 2147483648 * 1327217885) % 2147483648 AS x
  FROM (SELECT unnest(range((SELECT CAST((sum(source_size) * 3 + 127) // 128 AS BIGINT) FROM p))) AS t)
), r AS (
  SELECT nth, blocks, row_number() OVER (PARTITION BY nth ORDER BY t) - 1 AS rank FROM g JOIN i ON x >= lo AND x < hi
), k AS (
  SELECT nth, rank % blocks AS block, count(*) AS times FROM r WHERE rank < blocks * 2 GROUP BY ALL
), a AS (
  SELECT s.doc_id, size, nth, source_size, target,
    CAST(sum(size) OVER (PARTITION BY nth ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS a
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN size > 0 THEN unnest(range(a // 64, (a + size - 1) // 64 + 1)) END AS block FROM a WHERE size > 0
), m AS (
  SELECT q.doc_id, sum((least(a + size, (q.block + 1) * 64) - greatest(a, q.block * 64)) * times) AS taken FROM q JOIN k ON q.nth = k.nth AND q.block = k.block GROUP BY q.doc_id
)
SELECT a.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM a LEFT JOIN m USING (doc_id)
"""


_SHARD_SQL = """
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS crc FROM range(256) r(b)
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, size, list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, crc[xor(x & 255, y) + 1])), 4294967295) AS text_crc32 FROM b, t
), p AS (
  SELECT *, sum(size) OVER w - size AS off, row_number() OVER w AS nth, sum(size) OVER () AS whole FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, CAST(least((2 * off + size) * 16 // (2 * whole), 15) AS INTEGER) AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

_NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS s FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)
), r(d, c) AS (
  SELECT a, a FROM e UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) m ON m.d = s.doc_id
"""

_DIVERGENCE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), m AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (m.n + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (any_value(a.all_n) + 5 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM c GROUP BY ALL) a USING (lang) GROUP BY ALL
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), y AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": _DIVERGENCE_SQL, "op2_mixing_sources": _MIX_SQL, "op5_sharding": _SHARD_SQL, "op6_url_filters": _URL_SQL, "op7_exact_dedup": _DEDUP_SQL, "op9_ngram_jaccard_join": _NEAR_SQL}
