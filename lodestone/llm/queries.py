"""Queries of this subpackage: one thin query per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, huffman, langid, media, minhash, mixing, periodic, token_counts, toxicity, urlfilter, variants, vectors, warc
from lodestone.llm.common import drop_stage

#: One record in so many is damaged in the copy that op7 audits.
FAULT_EVERY = 97
BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lengths = huffman.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2)
    return huffman.digests(huffman.read(files, lengths))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store(_table(spark, sf_dir, "documents"))).select("*", F.lower(F.hex("hash")).alias("feature")).drop("hash")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 1024)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored replica against a copy with planted faults; shard and at depend on the cluster and are left out."""
    replica = warc.write(_table(spark, sf_dir, "pages"))
    other = warc.with_faults(replica, FAULT_EVERY)
    found = warc.audit(replica, other)
    drop_stage(replica, other)  # what is left to do reads their leaves only
    return found.select("page_id", "offset", "length", "sha256", "damaged")


def op8_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_repetition(_table(spark, sf_dir, "documents"))))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, public_tokenizers.path(PIECES)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_huffman_ids": op1_huffman_ids,
    "op2_minhash": op2_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_png_media": op4_png_media,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_vector_links": op8_vector_links,
    "op9_mix_sources": op9_mix_sources,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_id": op12_language_id,
    "op13_spelling_variants": op13_spelling_variants,
}

_WARC_SQL = f"""
WITH records AS (
  SELECT page_id, concat('WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''), '>\r\nWARC-Target-URI: ', coalesce(url, ''),
    '\r\nWARC-Date: {warc.DATE}\r\nContent-Type: text/html\r\nContent-Length: ', octet_length(encode(coalesce(html, ''))), '\r\n\r\n', coalesce(html, ''), '\r\n\r\n') AS record
  FROM pages),
sized AS (SELECT page_id, CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS sha256 FROM records)
SELECT page_id, CAST(coalesce(sum(length) OVER (ORDER BY page_id NULLS FIRST, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
  length, sha256, {{crc}} % {FAULT_EVERY} = 0 AS damaged
FROM sized
"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 (reflected polynomial 0xEDB88320) of a text's UTF-8, in DuckDB SQL: bit by bit, as DuckDB has none."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = bit
    for _ in range(7):
        step = f"list_transform([{step}], lambda c: {bit})[1]"
    byte = f"list_transform([xor(acc, x)], lambda c: {step})[1]"
    values = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substring(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({values}, lambda acc, x: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


_MINHASH_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(2, len(w) - 2)), lambda k: array_to_string(w[k:k + 3], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS both_have FROM u a JOIN u b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * both_have >= 80 * (nx + ny - both_have)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT y, seen FROM r JOIN e ON x = node),
low AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN low ON low.node = c.rep
"""
_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT y, seen FROM r JOIN l ON x = node),
low AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN low ON node = vec_id LEFT JOIN n ON x = vec_id
"""

_PERIODIC_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
top AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR o.length * r.period = r.length * o.period AND (o.start < r.start OR o.start = r.start AND o.period < r.period)))),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
_VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= {variants.LEAST_LETTERS} GROUP BY doc_id, w),
h AS (SELECT w, k, {crc32_sql("concat(doc_id, ':', w)")} AS h FROM c),
spelt AS (SELECT CASE WHEN h % {variants.PLANTED} = 0 THEN left(w, CAST(h % length(w) AS INT)) || substring(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, k FROM h),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= {variants.LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {variants.LEAST_TIMES}),
cut AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut b JOIN words a ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM cut b JOIN words a ON a.word = b.rest),
near AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM links GROUP BY word),
first AS (SELECT word, min(near) AS near FROM links JOIN near USING (word) WHERE links.near_n = near.near_n GROUP BY word),
found AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {variants.FORM_TIMES} * n THEN near END AS form, CASE WHEN near_n >= {variants.FORM_TIMES} * n THEN near_n END AS form_n
  FROM words LEFT JOIN near USING (word) LEFT JOIN first USING (word)),
follow(word, far) AS (SELECT word, word FROM found UNION SELECT follow.word, form FROM follow JOIN found ON found.word = far WHERE form IS NOT NULL),
last AS (SELECT follow.word, far FROM follow JOIN found ON found.word = far WHERE form IS NULL)
SELECT word, form, far AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM found JOIN last USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": _PERIODIC_SQL,
    "op13_spelling_variants": _VARIANTS_SQL,
    "op2_minhash": _MINHASH_SQL,
    "op8_vector_links": _VECTOR_SQL,
    "op3_url_filter": urlfilter.judge_sql(),
    "op7_warc_fixity": _WARC_SQL.replace("{crc}", crc32_sql("CAST(page_id AS VARCHAR)")),
    "op9_mix_sources": mixing.mix_sql(),
}
