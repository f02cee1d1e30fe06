"""Dashboard figures: totals, funnels, windows, concentration, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.functions.scalars import pct_delta
from tendersieve.operators.percentiles import percentiles
from tendersieve.sources.files import cut

c = F.col


def cents(column: Column) -> Column:
    """Sum of money to a hundredth of a cent: the order of additions no longer shows."""
    return F.round(F.sum(column), 4)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def kpis(tenders: DataFrame) -> DataFrame:
    return tenders.agg(F.count("*").alias("n"), cents(c("amount")).alias("amount"), F.round(F.avg("amount"), 2).alias("mean_amount"), F.countDistinct("body_id").alias("bodies"))


def by_group(tenders: DataFrame, *keys: str) -> DataFrame:
    """Count and amount of each group; null is a group."""
    return tenders.groupBy(*keys).agg(F.count("*").alias("n"), cents(c("amount")).alias("amount"))


def funnel(tenders: DataFrame, buckets: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: the number of tenders in each bucket of statuses, and of all, in one pass."""
    return tenders.agg(*[count_if(c("status").isin(*values)).alias(name) for name, values in buckets.items()], F.count("*").alias("total"))


def top_groups(tenders: DataFrame, key: str, n: int) -> DataFrame:
    return by_group(tenders, key).orderBy(F.desc("n"), F.asc(key)).limit(n)


def recent_and_previous(tenders: DataFrame, now: str, days: int) -> DataFrame:
    """The last days (open-ended) and as many before them."""
    now_ = F.lit(now).cast("timestamp")
    start, before = F.date_sub(now_, days), F.date_sub(now_, 2 * days)
    recent, previous = c("published") >= start, (c("published") >= before) & (c("published") < start)
    figures = tenders.agg(count_if(recent).alias("recent"), count_if(previous).alias("previous"), F.coalesce(cents(F.when(recent, c("amount"))), F.lit(0.0)).alias("recent_amount"))
    return figures.withColumn("change_pct", F.round(pct_delta(c("previous"), c("recent")), 2))


def concentration(tenders: DataFrame, key: str, n: int) -> DataFrame:
    """Amount of the n largest groups against all; groups without an amount don't rank."""
    sums = by_group(tenders, key).where("amount is not null").select(key, "amount")
    top = sums.orderBy(F.desc("amount"), F.asc(key)).limit(n).agg(cents(c("amount")).alias("top_amount"))
    return top.crossJoin(sums.agg(cents(c("amount")).alias("total_amount"))).withColumn("top_share", F.round(c("top_amount") / c("total_amount"), 6))


def cancel_rate(tenders: DataFrame, status: str, since: str) -> DataFrame:
    new = tenders.where(c("published") >= F.lit(since).cast("timestamp"))
    return new.agg(count_if(c("status") == status).alias("cancelled"), F.count("*").alias("total")).withColumn("rate", F.round(c("cancelled") / c("total"), 6))


def today(tenders: DataFrame, now: str, open_status: str) -> DataFrame:
    """Open tenders at or above the scope's 75th percentile of amounts, those of the last day, and the threshold."""
    p75 = percentiles(tenders, [], "amount", [0.75]).select(F.round(c("p")[0], 4).alias("p75"))
    day = F.date_sub(F.lit(now).cast("timestamp"), 1)
    open_ = c("status") == open_status
    return tenders.crossJoin(p75).groupBy("p75").agg(count_if(open_ & (c("amount") >= c("p75"))).alias("hot"), count_if(c("published") >= day).alias("new"), count_if(open_).alias("open"))


def award_indicators(awards: DataFrame) -> DataFrame:
    """Concentration of awarded amounts (HHI), single-bid share over known bids, and coverage."""
    company = awards.groupBy("company_id").agg(F.sum("awarded").alias("s"))
    share = c("s") / F.sum("s").over(Window.partitionBy()) * 100
    hhi = company.select((share * share).alias("q")).agg(F.round(F.sum("q"), 4).alias("hhi"), F.count("*").alias("companies"))
    rest = awards.agg(F.round(count_if(c("bids") == 1) / F.count("bids") * 100, 4).alias("single_bid_pct"), F.count("bids").alias("with_bids"), F.count("*").alias("awards"))
    return hhi.crossJoin(rest)


def compare_periods(tenders: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One row a figure: its value in two closed-open periods and the change in percent."""

    def within(p: tuple[str, str], name: str) -> DataFrame:
        own = kpis(tenders.where((c("published") >= F.lit(p[0]).cast("timestamp")) & (c("published") < F.lit(p[1]).cast("timestamp"))))
        return own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), c(k).cast("double").alias(name)) for k in own.columns])).alias("x")).select("x.*")

    return within(first, "before").join(within(second, "after"), "kpi").withColumn("change_pct", F.round(pct_delta(c("before"), c("after")), 2))


def systematic_sample(tenders: DataFrame, n: int) -> DataFrame:
    """Every ceil(total / n)-th tender, newest first.

    Tenders are dealt by range of the order; each partition numbers its own, after those of the partitions before it.
    """
    order = [F.desc_nulls_last("published"), F.desc("id")]
    dealt = cut(tenders.select("id", "published").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("k"))
    # one row a partition
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - c("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = dealt.withColumn("place", place).join(before, "part").withColumn("rn", (c("place") + c("before")).cast("int"))
    return numbered.where((c("rn") - 1) % F.ceil(c("total") / F.lit(n)) == 0).select("id", "rn")


def top_with_awards(tenders: DataFrame, awards: DataFrame, n: int) -> DataFrame:
    """The largest tenders with their first winner and what was awarded. The limit comes before the join."""
    top = tenders.where("amount is not null").orderBy(F.desc("amount"), F.asc("id")).limit(n).select("id", "amount")
    own = awards.join(F.broadcast(top.select(c("id").alias("tender_id"))), "tender_id", "left_semi")
    found = own.groupBy("tender_id").agg(F.min(F.struct("lot", "company")).alias("f"), cents(c("awarded")).alias("awarded"), F.count("*").alias("awards"))
    return top.join(found, c("id") == c("tender_id"), "left").select("id", "amount", c("f.company").alias("winner"), "awarded", F.coalesce("awards", F.lit(0)).alias("awards"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: how many values are neither null nor blank."""
    counts = df.agg(*[F.count(F.when(F.trim(c(k).cast("string")) != "", 1)).alias(k) for k in columns], F.count("*").alias("__n"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"), c(k).alias("filled"), c("__n").alias("n")) for k in columns])).alias("x")).select("x.*")
