"""Contracting bodies: rankings, lead times, failure rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .overview import by_group, cents, count_if
from .percentiles import percentiles

c = F.col


def totals(tenders: DataFrame) -> DataFrame:
    """Rows, bodies and amount by way of one row a body, not a distinct count."""
    return by_group(tenders, "body").agg(F.sum("n").alias("n"), count_if(c("body").isNotNull()).alias("bodies"), cents(c("amount")).alias("amount"))


def ranking(tenders: DataFrame, n: int) -> DataFrame:
    """Bodies with most tenders and each one's modal kind (first of ties, null excluded)."""
    pairs = tenders.groupBy("body", "kind").agg(F.count("*").alias("k"), F.sum("amount").alias("a"))
    best = F.min(F.when(c("kind").isNotNull(), F.struct((-c("k")).alias("k"), c("kind").alias("kind"))))
    return pairs.groupBy("body").agg(F.sum("k").alias("n"), F.round(F.sum("a"), 2).alias("amount"), best.alias("m")).orderBy(F.desc("n"), F.asc("body")).limit(n).select("body", "n", "amount", c("m.kind").alias("modal_kind"))


def treemap(tenders: DataFrame, n: int) -> DataFrame:
    """Amount by body and kind of the n bodies with most tenders; positive amounts only."""
    pairs = by_group(tenders, "body", "kind")
    top = pairs.groupBy("body").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), F.asc("body")).limit(n).select("body")
    return pairs.join(F.broadcast(top), "body", "left_semi").where("amount > 0").select("body", "kind", "amount")


def lead_times(tenders: DataFrame, awards: DataFrame, key: str) -> DataFrame:
    """Whole days from publication to the best award of a tender, as percentiles a group; earlier awards don't count."""
    best = awards.groupBy("tender_id").agg(F.max_by("awarded_on", F.struct("awarded", "awarded_on")).alias("on"))
    days = F.floor((F.unix_seconds(c("on").cast("timestamp")) - F.unix_seconds(c("published").cast("timestamp"))) / 86400)
    rows = tenders.join(best, c("id") == c("tender_id")).withColumn("days", days.cast("double")).where("days >= 0")
    return percentiles(rows.select(key, "days"), [key], "days", [0.25, 0.5, 0.75], most=tenders.count()).select(key, "n", c("p")[0].alias("p25"), c("p")[1].alias("p50"), c("p")[2].alias("p75"))


def expected_award(tenders: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Publication plus the group's median days, and the range of its quartiles; null without a sample."""
    day = lambda p: F.date_format(F.date_add(F.to_date("published"), F.round(p).cast("int")), "yyyy-MM-dd")
    return tenders.join(stats, key, "left").select("id", day(c("p50")).alias("expected"), day(c("p25")).alias("earliest"), day(c("p75")).alias("latest"))


def failure_rates(tenders: DataFrame, failed: str) -> DataFrame:
    """Share of failed tenders a body, and a body and kind: grouping sets in one pass."""
    sets = tenders.groupingSets([[c("body"), c("kind")], [c("body")]], c("body"), c("kind"))
    rows = sets.agg(F.grouping("kind").cast("int").alias("all_kinds"), F.count("*").alias("n"), count_if(c("status") == failed).alias("failed"))
    return rows.where("all_kinds = 1 or kind is not null").withColumn("rate", F.round(c("failed") / c("n"), 6))


def by_source(tenders: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """One row a key with the number of tenders of each kind side by side."""
    return tenders.groupBy(key).pivot("kind", sources).agg(F.count(F.lit(1))).select(key, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(f"n{i}") for i, s in enumerate(sources)])


def first_in_region(awards: DataFrame, since: str) -> DataFrame:
    """Companies' first awards in a region that fall on or after a day."""
    w = Window.partitionBy("company_id", "region")
    first = awards.withColumn("first_on", F.min("awarded_on").over(w)).where(c("first_on") >= F.lit(since).cast("timestamp"))
    return first.groupBy("company_id", "region").agg(F.date_format(F.min("first_on"), "yyyy-MM-dd").alias("first_on"), F.count("*").alias("n"))
