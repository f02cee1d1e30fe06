"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .audio import align
from .common import scratch_dir
from .conversations import conversation_key, damage, repair
from .hard_negatives import hard_negatives
from .license_scan import TEMPLATES, license_scan
from .mixing import copies
from .near_dedup import near_duplicates
from .pieces import encode_documents
from .quality_rules import quality_rules
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .token_files import digests, read_parts, write_tokens
from .toxicity import toxicity
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host, path)
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rule_host, rule_path, labels) AS (
  VALUES ('block', 'com', '/en/', 1), ('allow', 'example.com', '/en/7', 2), ('allow', 'net', '/de/', 1), ('block', 'example.net', '/de/8', 2), ('block', 'org', '/es/', 1)
), m AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY labels DESC NULLS LAST, length(rule_path) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound: a text's UTF-8 bytes are read as the samples of an 8-bit recording."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("audio"))
    return align(docs, sample="u1").drop("uid").withColumnRenamed("id", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = copies(_table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The three weights, the share of all words, the cap and the seed are those of ``copies``.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS budget,
    coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
), l AS (
  SELECT *, arg_min((budget - caps) / weights, caps) FILTER (WHERE most / weight > (budget - caps) / weights) OVER () AS level FROM r
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, coalesce(weight * level, most)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(coalesce(round(t.target / nullif(t.source_size, 0) * 16777216), 0) AS BIGINT) AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS place,
    CAST('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 6) AS BIGINT) AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(((place * rate + shift) // 16777216 - ((place - 1) * rate + shift) // 16777216) * size AS BIGINT) AS taken FROM p
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, keep_text=False)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read_parts(spark, folder)).withColumnRenamed("id", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), d AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w
), p(label, phrase) AS (
  SELECT label, string_split(x, ' ') FROM (VALUES ('gpl', 'gnu general public license'), ('apache', 'apache license'), ('cc-by', 'cc by'), ('mit', 'mit license')) v(label, x)
), i AS (SELECT k, ws, unnest(range(len(ws))) AS i FROM d), h AS (
  SELECT k, i, label FROM i JOIN p ON ws[i + 1] = phrase[1] AND list_slice(ws, i + 1, i + len(phrase)) = phrase
), b AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM h GROUP BY k
), t(label, own) AS (
  SELECT label, list_distinct(string_split(x, ' ')) FROM (VALUES @TEMPLATES@) v(label, x)
), l AS (
  SELECT k, list_distinct(regexp_extract_all(array_to_string(list_slice(us, i, i + 3), ' '), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws
  FROM (SELECT k, us, unnest(range(1, len(us) + 1)) AS i FROM (SELECT k, string_split(t, chr(10)) AS us FROM d))
), m AS (
  SELECT k, list(DISTINCT label) AS more, max(len(list_intersect(ws, own)) / len(own)) AS share
  FROM l JOIN t ON len(ws) >= ceil(round(0.8 * len(own), 9)) AND len(list_intersect(ws, own)) >= ceil(round(0.8 * len(own), 9)) GROUP BY k
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS score
FROM d LEFT JOIN b USING (k) LEFT JOIN m USING (k)
""".replace("@TEMPLATES@", ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of rows whose remainder isn't 1; the others are held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    found = toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, x.uid, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.q, x.q) AS BIGINT) AS score
  FROM v a JOIN v x ON a.uid <> x.uid AND a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.uid) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair(damage(turns)).report.drop("conv_id")
    every = turns.select(conversation_key(F.col("conv_id")).alias("key"), "conv_id").groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    hash_ = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.join(report, "key", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), hash_)


#: A recursion over places: for each grammar state (0 at the start, 1 after s, 2 after u, 3 after a) the least (cost, audit, text).
OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(regexp_extract_all(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '.'), lambda x: ascii(x)::BIGINT) AS marks FROM conversations
), m AS (
  SELECT o.* EXCLUDE (marks), xor(list_reduce(list_prepend(4294967295::BIGINT, marks), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS mark FROM o, tab
), d AS (
  SELECT conv_id, turn, CASE mark WHEN 4 THEN 'user' ELSE role END AS role, CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE mark WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE mark <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place, left(role, 1) AS ini,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), f AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS dup,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY place) || ini AS pair FROM n
), g AS (
  SELECT *, NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM f
), w AS (
  SELECT conv_id, place, role, text, ini, blank OR dup AS bad, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM g
), s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS place, 0 AS state, 0 AS cost, '' AS audit, NULL::VARCHAR AS body FROM w
  UNION ALL
  SELECT conv_id, place, state, cost, audit, body FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT i.conv_id, w.place, e.state, i.cost + e.cost AS cost, i.audit || e.edit AS audit, CASE WHEN e.line IS NULL THEN i.body ELSE coalesce(i.body || chr(10), '') || e.line END AS body
      FROM (
        SELECT conv_id, place, state, cost, audit, body FROM s
        UNION ALL SELECT conv_id, place, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I', coalesce(body || chr(10), '') || CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END FROM s
        UNION ALL SELECT conv_id, place, CASE state WHEN 2 THEN 2 ELSE 3 END, cost + 10, audit || 'II', coalesce(body || chr(10), '') || CASE state WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END FROM s
      ) i JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.place = i.place + 1,
      LATERAL (
        SELECT i.state AS state, 2 AS cost, 'D' AS edit, NULL::VARCHAR AS line
        UNION ALL SELECT CASE w.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, w.extra, 'K', w.role || ':' || w.text
          WHERE NOT w.bad AND ((w.ini = 's' AND i.state = 0) OR (w.ini = 'u' AND i.state <> 2) OR (w.ini = 'a' AND i.state = 2))
        UNION ALL SELECT CASE i.state WHEN 2 THEN 3 ELSE 2 END, 1 + w.extra, 'R', CASE i.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || w.text WHERE NOT w.bad
      ) e
    )
  ) WHERE best = 1
), z AS (
  SELECT conv_id, min(struct_pack(cost := s.cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit := audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    body := CASE state WHEN 1 THEN coalesce(body || chr(10), '') || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN coalesce(body || chr(10), '') || 'assistant:' ELSE coalesce(body, '') END)) AS x
  FROM s JOIN (SELECT conv_id AS c, max(place) AS final FROM w GROUP BY 1) ON conv_id IS NOT DISTINCT FROM c AND place = final GROUP BY conv_id
), r AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(x.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_audio_fingerprints": op3_audio_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_files": op8_token_files,
    "op9_license_scan": op9_license_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL, "op4_mixing": OP4_SQL, "op9_license_scan": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_conversation_repair": OP13_SQL,
}
