"""Several labels a row: every figure counts a row once per label, totals once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .overview import cents, count_if

c = F.col
OTHERS = "__OTHERS__"


def exploded(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.withColumn("tag", F.explode(F.array_distinct(tags)))


def entries(df: DataFrame, done: str) -> DataFrame:
    """Per label: rows, amount, rows of status ``done``."""
    return exploded(df).groupBy("tag").agg(F.count("*").alias("n"), cents(c("amount")).alias("amount"), count_if(c("status") == done).alias("done"))


def top_labels(df: DataFrame, n: int) -> DataFrame:
    return exploded(df).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("tag")).limit(n)


def crossed(df: DataFrame, key: str, top_keys: int, top_tags: int) -> DataFrame:
    """label x key counts, of the most frequent of both."""
    rows = exploded(df).select("tag", key)
    tags = top_labels(df, top_tags).select("tag")
    keys = df.where(c(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(top_keys).select(key)
    return rows.join(F.broadcast(tags), "tag", "left_semi").join(F.broadcast(keys), key, "left_semi").groupBy("tag", key).agg(F.count("*").alias("n"))


def evolution(df: DataFrame, n: int) -> DataFrame:
    """Month series of the n most frequent labels, the others as one."""
    tags = F.broadcast(top_labels(df, n).select(c("tag").alias("top")))
    rows = exploded(df).join(tags, c("tag") == c("top"), "left")
    return rows.groupBy(F.date_format("published", "yyyy-MM").alias("month"), F.coalesce("top", F.lit(OTHERS)).alias("tag")).agg(F.count("*").alias("n"), cents(c("amount")).alias("amount"))


def overlapping(df: DataFrame, tags: list[str], n: int) -> DataFrame:
    """The n largest rows with any of the labels, each once; unknown amounts last."""
    wanted = df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return wanted.orderBy(F.desc_nulls_last("amount"), F.asc("id")).limit(n).select("id", "amount")


def families(df: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """Per family of labels (they may overlap): rows and amount; and rows of any family."""
    has = {k: F.arrays_overlap("tags", F.array(*[F.lit(x) for x in v])) for k, v in members.items()}
    any_ = F.arrays_overlap("tags", F.array(*[F.lit(x) for v in members.values() for x in v]))
    figures = [F.struct(F.lit(k).alias("family"), count_if(h).alias("n"), cents(F.when(h, c("amount"))).alias("amount")) for k, h in has.items()]
    return df.agg(F.array(*figures).alias("f"), count_if(any_).alias("any_family")).select(F.explode("f").alias("x"), "any_family").select("x.*", "any_family")
