"""Competition: discounts, shares, rivals, renewals, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.functions.scalars import band, competition_band, discount, urgency, valid_pair

from .overview import cents, count_if
from .percentiles import percentiles

c = F.col
#: Awards that a task joins and groups at a time.
PAIR_ROWS = 1 << 18


def discounts(awards: DataFrame, key: str, least: int) -> DataFrame:
    """Discount of comparable awards a group, of groups with enough of them."""
    rows = awards.where(valid_pair(c("budget"), c("awarded"))).withColumn("d", discount(c("budget"), c("awarded")) * 100)
    return rows.groupBy(key).agg(
        F.count("*").alias("contracts"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.min("d"), 4).alias("least"), F.round(F.max("d"), 4).alias("most"),
        cents(c("awarded")).alias("amount"), F.round(F.avg("bids"), 4).alias("bids"),
    ).where(c("contracts") >= least)


def discount_bias(awards: DataFrame) -> DataFrame:
    """Mean discount per award and per tender (sums first): what tenders of several lots distort."""
    d = discount(c("budget"), c("awarded")) * 100
    ok = awards.where(valid_pair(c("budget"), c("awarded")))
    tender = ok.groupBy("tender_id").agg(F.sum("budget").alias("budget"), F.sum("awarded").alias("awarded"))
    return ok.agg(F.round(F.avg(d), 4).alias("per_award")).crossJoin(tender.agg(F.round(F.avg(d), 4).alias("per_tender")))


def market_share(awards: DataFrame, segment: Column, n: int) -> DataFrame:
    """Companies of a segment by amount, with their share in percent."""
    rows = awards.where(segment).groupBy("company").agg(cents(c("awarded")).alias("amount"), F.count("*").alias("contracts"), F.round(F.avg("bids"), 4).alias("bids"))
    return rows.withColumn("share", F.round(c("amount") / F.sum("amount").over(Window.partitionBy()) * 100, 4)).orderBy(F.desc("amount"), F.asc("company")).limit(n)


def hhi(awards: DataFrame, segment: str, least: int) -> DataFrame:
    """Sum of squared shares (in percent) of a segment's companies, of segments with enough contracts."""
    own = awards.groupBy(segment, "company_id").agg(F.sum("awarded").alias("s"), F.count("*").alias("k"))
    total = own.groupBy(segment).agg(F.sum("s").alias("all_s"), F.sum("k").alias("contracts"), F.count("*").alias("companies"), F.sum(c("s") * c("s")).alias("q"))
    return total.where(c("contracts") >= least).select(segment, "contracts", "companies", F.round(c("q") / (c("all_s") * c("all_s")) * 10000, 4).alias("hhi"))


def competition(awards: DataFrame, key: str, least: int) -> DataFrame:
    """Mean over tenders of the most bids any of its awards had, and bands of it."""
    tender = awards.groupBy("tender_id", key).agg(F.max("bids").alias("b"))
    b = competition_band(c("b"))
    return tender.groupBy(key).agg(F.count("*").alias("tenders"), F.round(F.avg("b"), 4).alias("bids"), *[count_if(b == x).alias(f"band_{i}") for i, x in enumerate(("1", "2-4", "5+"))]).where(c("tenders") >= least)


def rivals(awards: DataFrame, segment: Column, own: int, n: int) -> DataFrame:
    """Companies of a segment by contracts, with their median discount and latest award; total rows beside."""
    rows = awards.where(segment)
    grouped = rows.groupBy("company_id").agg(F.count("*").alias("contracts"), F.round(F.percentile(F.when(valid_pair(c("budget"), c("awarded")), discount(c("budget"), c("awarded"))), 0.5), 6).alias("median_discount"), F.max_by("company", F.struct("awarded_on", "tender_id")).alias("name"))
    top = grouped.orderBy(F.desc("contracts"), F.asc("company_id")).limit(n).withColumn("is_own", c("company_id") == own)
    return rows.agg(F.count("*").alias("segment_awards")).join(top, F.lit(True), "left")


def head_to_head(awards: DataFrame, company: int) -> DataFrame:
    """Other companies with awards in the same tenders: how often, and both mean discounts."""
    d = discount(c("budget"), c("awarded"))
    mine = awards.where(c("company_id") == company).groupBy("tender_id").agg(F.avg(d).alias("own"))
    other = awards.where(c("company_id") != company).groupBy("tender_id", "company_id").agg(F.avg(d).alias("theirs"))
    return other.join(mine, "tender_id").groupBy("company_id").agg(F.count("*").alias("tenders"), F.round(F.avg("own"), 6).alias("own_discount"), F.round(F.avg("theirs"), 6).alias("their_discount"))


def renewals(awards: DataFrame, now: str, ahead: int, duration: int, n: int) -> DataFrame:
    """Contracts (award plus duration in months) that end in the next months, by amount and urgency."""
    today = F.lit(now).cast("date")
    rows = awards.withColumn("ends", F.add_months(F.to_date("awarded_on"), duration)).where((c("ends") >= today) & (c("ends") < F.add_months(today, ahead)))
    rows = rows.withColumn("days", F.datediff("ends", today))
    rows = rows.withColumn("score", F.round(c("awarded") * urgency(c("days"), 30 * ahead), 2))
    return rows.orderBy(F.desc("score"), F.asc("tender_id"), F.asc("lot"), F.asc("part_id")).limit(n).select("tender_id", "lot", "part_id", F.date_format("ends", "yyyy-MM-dd").alias("ends"), "days", "score")


def renewals_by_company(awards: DataFrame, now: str, ahead: int, duration: int, n: int) -> DataFrame:
    today = F.lit(now).cast("date")
    rows = awards.withColumn("ends", F.add_months(F.to_date("awarded_on"), duration)).where((c("ends") >= today) & (c("ends") < F.add_months(today, ahead)))
    return rows.groupBy("company").agg(F.count("*").alias("n"), cents(c("awarded")).alias("amount"), F.date_format(F.min("ends"), "yyyy-MM-dd").alias("nearest")).orderBy(F.desc("amount"), F.asc("company")).limit(n)


def breakdown(awards: DataFrame, key: str, n: int) -> DataFrame:
    rows = awards.where(F.trim(c(key)) != "").groupBy(key).agg(F.count("*").alias("n"), cents(c("awarded")).alias("amount"))
    return rows.withColumn("share", F.round(c("amount") / F.sum("amount").over(Window.partitionBy()) * 100, 1)).orderBy(F.desc("amount"), F.desc("n"), F.asc(key)).limit(n)


def partner_pairs(awards: DataFrame, least: int) -> DataFrame:
    """Unordered pairs of companies with awards in the same tender: the members of one tender are few (its lots).

    Rows are dealt by number, so that a task's sorts and groups are as large at any size of the input; hardly a pair
    repeats within a task of large tables, so pairs are grouped only where all of a pair are.
    """
    tasks = max(awards.sparkSession.sparkContext.defaultParallelism, math.ceil(awards.count() / PAIR_ROWS))
    member = awards.repartition(tasks, "tender_id").groupBy("tender_id", "company_id").agg(F.sum("awarded").alias("w"))
    a, b = member.select("tender_id", c("company_id").alias("a"), c("w").alias("wa")), member.select("tender_id", c("company_id").alias("b"), c("w").alias("wb"))
    met = a.join(b, "tender_id").where("a < b").select("a", "b", (c("wa") + c("wb")).alias("w")).repartition(2 * tasks, "a", "b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("amount")).where(c("n") >= least)


def same_day_winners(awards: DataFrame) -> DataFrame:
    """Awards of one tender, day and amount to several companies: probable joint ventures, and their share."""
    groups = awards.groupBy("tender_id", "awarded_on", "awarded").agg(F.count("*").alias("k"), F.countDistinct("company_id").alias("d"))
    return groups.agg(count_if(c("d") > 1).alias("candidates"), F.coalesce(F.sum(F.when(c("d") > 1, c("k"))), F.lit(0)).alias("rows"), F.sum("k").alias("all_rows"))


def opportunity_scores(tenders: DataFrame, bids: DataFrame, now: str, weights: dict[str, float], open_status: str) -> DataFrame:
    """0 to 100: amount between the scope's 10th and 90th percentile, expected competition, time left.

    ``bids`` has (segment, bids); parts without data count half. Bands: low, medium, high.
    """
    rows = tenders.where(c("status") == open_status)
    p = percentiles(rows, [], "amount", [0.1, 0.9]).select("p")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    rows = rows.crossJoin(p).join(bids, "segment", "left").withColumn("days", F.datediff(F.date_add("published", 60), F.lit(now).cast("date")))
    amount = F.when(c("p")[1] > c("p")[0], clamp((c("amount") - c("p")[0]) / (c("p")[1] - c("p")[0])))
    time = band(c("days"), [(0, "0"), (7, "0.5"), (91, "1"), (181, "0.7")], "0.3").cast("double")
    parts = {"amount": amount, "competition": 1 - clamp((c("bids") - 1) / 49), "time": time}
    score = sum((w * F.coalesce(parts[k], F.lit(0.5)) for k, w in weights.items()), F.lit(0.0)) / sum(weights.values()) * 100
    rows = rows.withColumn("score", F.round(score, 4))
    return rows.select("id", "score", band(c("score"), [(40, "low"), (70, "medium")], "high").alias("band"))


def price_cohort(awards: DataFrame, company_or_cpv: list[tuple[str, Column]], least: int) -> DataFrame:
    """Percentiles of the discount of the first cohort, from narrow to wide, that has enough members."""
    d = F.when(valid_pair(c("budget"), c("awarded")), discount(c("budget"), c("awarded")))
    rows = awards.withColumn("d", d).where("d is not null")
    level = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(name).alias("cohort"), when.alias("in")) for i, (name, when) in enumerate(company_or_cpv)])
    each = rows.select("d", F.explode(level).alias("x")).where("x.in").select("d", "x.level", "x.cohort")
    found = percentiles(each, ["level", "cohort"], "d", [0.25, 0.5, 0.75]).where(c("n") >= least).orderBy("level").limit(1)
    return found.select("cohort", "n", *[F.round(c("p")[i], 6).alias(f"p{q}") for i, q in enumerate((25, 50, 75))])
