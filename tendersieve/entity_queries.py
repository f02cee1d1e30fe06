"""Registered queries of names and companies: similar names, resolution, clusters and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tendersieve.functions.scalars import MARKED, company_name, fold
from tendersieve.operators.clusters import class_terms, cluster, features, summaries
from tendersieve.operators.resolution import resolve, similar_names
from tendersieve.operators.text import MARKERS
from tendersieve.plans.domain import table
from tendersieve.registry import query
from tendersieve.search_queries import WORDS
from tendersieve.sources.files import cut

c = F.col

# -- similar names and resolution ------------------------------------------------------------------


_WORD = f"A-Za-z0-9{MARKED}\u0130\u212a"


def party_names(s: SparkSession, d: str) -> DataFrame:
    """(id, name): the first three words of each document as a company's name."""
    # what may fold to letters and digits: three words of it hold the first three, so the rest of a text is not folded
    head = F.regexp_extract("text", f"^[^{_WORD}]*+[{_WORD}]++(?:[^{_WORD}]++[{_WORD}]++){{0,2}}", 0)
    first = F.regexp_extract(fold(F.coalesce(head, F.lit(""))), "^[^a-z0-9]*+([a-z0-9]++(?:[^a-z0-9]++[a-z0-9]++){0,2})", 1)
    return cut(table(s, d, "documents").select(c("doc_id").alias("id"), F.upper(F.regexp_replace(first, "[^a-z0-9]+", " ")).alias("name")), "names")


def misspelt(name: Column, by: Column) -> Column:
    """A name as it may come in: whole, without its fourth letter, two letters swapped, or with a legal form."""
    part = lambda i, n: F.substring(name, i, n)
    return F.when(by == 1, F.concat(part(1, 3), part(5, 1 << 20))).when(by == 2, F.concat(part(1, 1), part(3, 1), part(2, 1), part(4, 1 << 20))).when(by == 3, F.concat(name, F.lit(", S.L."))).otherwise(name)


@query("similar_names", f"""WITH n AS (SELECT doc_id % 7 AS k, upper(array_to_string(list_slice({WORDS}, 1, 3), ' ')) AS name FROM documents), a AS (SELECT DISTINCT name FROM n WHERE name <> ''),
  b AS (SELECT DISTINCT CASE k WHEN 1 THEN substr(name, 1, 3) || substr(name, 5) WHEN 2 THEN substr(name, 1, 1) || substr(name, 3, 1) || substr(name, 2, 1) || substr(name, 4) WHEN 3 THEN name || ', S.L.' ELSE name END AS name FROM n)
  SELECT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 9) AS similarity FROM a JOIN b ON b.name <> '' WHERE similarity >= 0.8""")
def _(s: SparkSession, d: str) -> DataFrame:
    names = party_names(s, d)
    return similar_names(names, names.select(misspelt(c("name"), c("id") % 7).alias("name")), 0.8, "edit").withColumn("similarity", F.round("similarity", 9))


def award_parties(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(award rows, registry): every document's name as a row, each third one's also as a company."""
    names = party_names(s, d)
    tax = F.concat(F.lit("FR"), c("id").cast("string"))
    registry = names.where("id % 3 = 0").select(c("id").alias("company_id"), company_name(c("name")).alias("alias"), F.when(c("id") % 2 == 0, tax).alias("tax"))
    kind = c("id") % 5
    rows = names.select("id", misspelt(c("name"), c("id") % 7).alias("name"), F.when(kind == 0, tax).when(kind == 1, F.concat(F.lit("FR"), (c("id") - c("id") % 6).cast("string"))).when(kind == 2, F.lit("B-1234567x")).alias("tax"))
    return rows, registry


@query("resolve_companies")
def _(s: SparkSession, d: str) -> DataFrame:
    return resolve(*award_parties(s, d))


# -- clusters of texts ----------------------------------------------------------------------------

STOP = tuple(sorted({w for words in MARKERS.values() for w in words}))
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query("class_terms", rf"""WITH w AS (SELECT coalesce(lang, '') AS lang, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 4 AND NOT list_contains({_STOP_SQL}, x)) AS ws FROM documents),
  g AS (SELECT lang, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), k AS (SELECT lang, term, count(*) AS k FROM g GROUP BY 1, 2),
  t AS (SELECT term, count(*) AS df FROM k GROUP BY 1 ORDER BY sum(k) DESC, term LIMIT 5000), n AS (SELECT count(DISTINCT lang) AS classes FROM w)
  SELECT lang, term, round((1 + ln(k)) * (ln((1.0 + classes) / (1 + df)) + 1), 9) AS weight, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INT) AS place FROM k JOIN t USING (term), n QUALIFY place <= 3""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.coalesce("lang", F.lit("")).alias("class"), "text")
    return class_terms(docs, STOP).withColumnRenamed("class", "lang")


@query("document_clusters")
def _(s: SparkSession, d: str) -> DataFrame:
    """All documents in three to eight clusters, whichever number has the greatest silhouette."""
    docs = table(s, d, "documents").select(c("doc_id").alias("key"), "text", "lang", "source", "n_chars")
    vectors, _ = features(docs.select("key", "text"), STOP)
    found = cluster(vectors, range(3, 9))
    terms = class_terms(docs.join(found.rows, "key").select(c("cluster").alias("class"), "text"), STOP)
    silhouette = F.lit(round(found.silhouettes.get(found.k, 0.0), 6)).alias("silhouette")
    return summaries(docs.drop("text"), found.rows, terms, "n_chars", ["lang", "source"]).select("*", silhouette)
