"""Registered queries of ranked search: inverted index, vector lists, their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersieve.functions.scalars import MARKED, PLAIN, fold
from tendersieve.operators.retrieval import TextIndex, VectorLists, hybrid
from tendersieve.plans.domain import table
from tendersieve.registry import query

c = F.col
#: Vectors are chunks of documents, this many of each.
CHUNKS = 4

WORDS = f"regexp_extract_all(lower(translate(coalesce(text, ''), '{MARKED}', '{PLAIN}')), '[a-z0-9]+')"
#: BM25 of documents against the terms asked by each query; needs tables w (doc_id, ws, ...) and asked (qid, term).
BM25 = """tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))), 6) AS score, count(*) AS terms
  FROM (SELECT DISTINCT qid, term FROM asked) JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


def first_words(docs: DataFrame, key: str, n: int = 6) -> DataFrame:
    """(qid, term): the different ones of the first n words of each text."""
    found = F.slice(F.regexp_extract_all(fold(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), 1, n)
    return docs.select(c(key).alias("qid"), F.explode(F.array_distinct(found)).alias("term"))


@query("search_bm25", f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), asked AS (SELECT doc_id AS qid, unnest(list_distinct(list_slice(ws, 1, 6))) AS term FROM w WHERE doc_id % 20 = 0), {BM25}
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc QUALIFY rank <= 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    index = TextIndex.build(docs.select("doc_id", "text"))
    return index.search(first_words(docs.where("doc_id % 20 = 0"), "doc_id"), 10).withColumnRenamed("key", "doc_id")


@query("search_all_words_in_scope", f"""WITH w AS (SELECT doc_id, lang, n_chars, {WORDS} AS ws FROM documents), asked AS (SELECT doc_id AS qid, unnest(list_distinct(list_slice(ws, 1, 3))) AS term FROM w WHERE doc_id % 20 = 0), {BM25},
  sz AS (SELECT qid, count(*) AS size FROM asked GROUP BY 1)
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc JOIN sz USING (qid) JOIN w USING (doc_id) WHERE terms = size AND lang IN ('en', 'de') AND n_chars >= 200 QUALIFY rank <= 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    index = TextIndex.build(docs.select("doc_id", "text", "lang", "n_chars"))
    found = index.search(first_words(docs.where("doc_id % 20 = 0"), "doc_id", 3), 10, c("lang").isin("en", "de") & (c("n_chars") >= 200), every=True)
    return found.withColumnRenamed("key", "doc_id")


EXPRESSIONS = {
    1: '"apache license" OR "mit license" -warranty',
    2: "the of OR license -\"apache license\"",
    3: 'licensed under "Version 2.0"',
    4: "Nonesuch OR zzz",
}


@query("search_web_expressions", f"""WITH w AS (SELECT doc_id, ' ' || array_to_string({WORDS}, ' ') || ' ' AS t, {WORDS} AS ws FROM documents),
  asked(qid, term) AS (VALUES (1, 'apache'), (1, 'license'), (1, 'mit'), (2, 'the'), (2, 'of'), (2, 'license'), (3, 'licensed'), (3, 'under'), (3, 'version'), (3, '2'), (3, '0')), {BM25},
  m AS (SELECT 1 AS qid, doc_id FROM w WHERE (contains(t, ' apache license ') OR contains(t, ' mit license ')) AND NOT contains(t, ' warranty ')
    UNION ALL SELECT 2, doc_id FROM w WHERE contains(t, ' the ') AND (contains(t, ' of ') OR contains(t, ' license ')) AND NOT contains(t, ' apache license ')
    UNION ALL SELECT 3, doc_id FROM w WHERE contains(t, ' licensed ') AND contains(t, ' under ') AND contains(t, ' version 2 0 '))
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc JOIN m USING (qid, doc_id) QUALIFY rank <= 25""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    return TextIndex.build(docs).web_search(docs, EXPRESSIONS, 25).withColumnRenamed("key", "doc_id")


def chunk_vectors(s: SparkSession, d: str) -> DataFrame:
    """(vec_id, embedding, owner, lang): vectors as chunks of documents, with the columns that scopes use."""
    owner = F.floor(c("vec_id") / CHUNKS).cast("long")
    return table(s, d, "embeddings").select("vec_id", "embedding", owner.alias("owner")).join(table(s, d, "documents").select(c("doc_id").alias("owner"), "lang"), "owner")


@query("hybrid_search", f"""WITH w AS (SELECT doc_id, lang, {WORDS} AS ws FROM documents), v AS (SELECT vec_id, vec_id // {CHUNKS} AS owner, lang, embedding FROM embeddings JOIN documents ON doc_id = vec_id // {CHUNKS}),
  asked AS (SELECT vec_id AS qid, unnest(list_distinct(list_slice(ws, 1, 6))) AS term FROM w JOIN v ON doc_id = owner WHERE vec_id % 20 = 0), {BM25},
  tr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc JOIN w USING (doc_id) WHERE lang <> 'fr' QUALIFY rank <= 50),
  vs AS (SELECT q.vec_id AS qid, v.vec_id, v.owner, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 AND v.lang <> 'fr'),
  vr AS (SELECT qid, owner, vec_id, row_number() OVER (PARTITION BY qid ORDER BY sign(s) * floor(abs(s) * 1e6 + 0.5) / 1e6 DESC, vec_id) AS rank FROM vs QUALIFY rank <= 50),
  u AS (SELECT qid, doc_id, 0.8::DOUBLE / (60 + rank) AS s, NULL AS vec_id, NULL AS rank FROM tr UNION ALL SELECT qid, owner, 1.2::DOUBLE / (60 + rank), vec_id, rank FROM vr),
  f AS (SELECT qid, doc_id, round(sum(s), 8) AS score, coalesce(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank), '') AS chunks FROM u GROUP BY 1, 2)
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 20""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs, vectors = table(s, d, "documents"), chunk_vectors(s, d)
    asking = vectors.where("vec_id % 20 = 0")
    scope = c("lang") != "fr"
    terms = first_words(asking.select("vec_id", c("owner").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id"), "vec_id")
    by_text = TextIndex.build(docs.select("doc_id", "text", "lang")).search(terms, 50, scope)
    lists = VectorLists.build(vectors)
    by_chunk = lists.search(asking.select(c("vec_id").alias("qid"), "embedding", c("vec_id").alias("own")), 50, scope)
    by_chunk = by_chunk.select("qid", F.floor(c("key") / CHUNKS).cast("long").alias("key"), c("key").alias("chunk"), "rank")
    return hybrid(by_text, by_chunk, 20, alpha=0.6).withColumnRenamed("key", "doc_id")


#: Of 16 lists; a recall of at least 0.9 is tested.
PROBES = 12


@query("vector_probes")
def _(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the nearest lists only: recall is measured in the tests."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    asking = vectors.where("vec_id % 20 = 0").select(c("vec_id").alias("qid"), "embedding", c("vec_id").alias("own"))
    return VectorLists.build(vectors).search(asking, 10, probes=PROBES).withColumnRenamed("key", "vec_id")
