"""Deadlines in business days, price points, contract histories, own funnel and workload, freshness, retention, emerging terms, ranked search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tendersieve.functions.scalars import easter, fold, inverse_price_points, is_business_day, proportional_points, stepped_points
from tendersieve.sources.files import cut

c = F.col


def business_deadlines(spark: SparkSession, n: int, first: str = "1990-01-01", last: str = "2100-12-31") -> DataFrame:
    """(day, due): the n-th business day after each day. One row a day of the range, whatever the data."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day").withColumn("b", is_business_day(c("day")).cast("int"))
    # the calendar has a fixed number of rows; its running count is not one over data
    counted = days.selectExpr("day", "b", "sum(b) OVER (ORDER BY day) AS nth")
    return counted.select("day", (c("nth") + n).alias("want")).join(counted.where("b = 1").select(c("nth").alias("want"), c("day").alias("due")), "want").select("day", "due")


#: Estimated value above which the tender documents of a contract type can be appealed; fixed values.
APPEAL_ABOVE = {"1": 100_000.0, "2": 100_000.0, "3": 3e6, "22": 3e6, "32": 3e6}


def appeal_deadlines(tenders: DataFrame, days: int = 15) -> DataFrame:
    """Tenders (id, type, value, published, nuts, notices) with ``due``, the last day to appeal; those without one are left out.

    A type with a known threshold, a value above it, a place outside the region with rules of its own, and
    a tender notice among the notices without a prior one, whose date the publication's would be.
    The calendar reaches from the first publication in question to well past the last.
    """
    notices = F.transform(F.split("notices", ","), F.trim)
    threshold = F.try_element_at(F.create_map(*[F.lit(x) for pair in APPEAL_ABOVE.items() for x in pair]), c("type"))
    can = (c("value") > threshold) & ~F.coalesce(F.startswith(F.upper("nuts"), F.lit("ES22")), F.lit(False))
    can &= F.array_contains(notices, "DOC_CN") & ~F.exists(notices, lambda x: F.startswith(x, F.lit("DOC_PIN")))
    open_ = tenders.where(can).withColumn("day", c("published").cast("date"))
    first, last = open_.agg(F.min("day"), F.date_add(F.max("day"), 4 * days + 60)).first()
    calendar = business_deadlines(tenders.sparkSession, days, str(first or "2000-01-01"), str(last or "2000-12-31"))
    return open_.join(calendar, "day").drop("day")


def price_points(bids: DataFrame, most: float, steps: list[tuple[float, float]], reckless: float) -> DataFrame:
    """Bids (tender_id, lot, cut, formula) with points against the best cut of their tender, and whether the cut is reckless.

    A formula that can't be calculated gives no points; cuts outside 0 to 1 leave.
    """
    sane = bids.where(c("cut").between(0, 1))
    best = sane.groupBy("tender_id").agg(F.max("cut").alias("best"))
    top = F.lit(most)
    points = F.when(c("formula").isin("proportional", "reckless_mark"), proportional_points(c("cut"), c("best"), top))
    points = points.when(c("formula") == "inverse_price", inverse_price_points(c("cut"), c("best"), top)).when(c("formula") == "steps", stepped_points(c("cut"), steps, top))
    return sane.join(best, "tender_id").select("tender_id", "lot", "formula", "cut", F.round(points, 2).alias("points"), (c("cut") > reckless).alias("reckless"))


#: What a change of status means; fixed values.
STATUS_EVENTS = {"ADJ": "award", "RES": "formalisation", "ANUL": "cancellation"}


def contract_events(versions: DataFrame) -> DataFrame:
    """Typed events from successive versions (id, version, status, amount, until); versions are numbered without gaps.

    Each version is joined to the one before by (id, version), so that no contract is one task's. The event's
    key is a digest of contract, version and field: reading a history again gives the same keys.
    """
    before = versions.select("id", (c("version") + 1).alias("version"), *[c(x).alias(f"{x}_0") for x in ("status", "amount", "until")])
    pairs = versions.join(before, ["id", "version"])
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_EVENTS.items() for x in pair]), F.upper("status")), F.lit("status_change"))
    same = F.abs(c("amount") - c("amount_0")) <= F.greatest(1e-5 * F.greatest(F.abs("amount"), F.abs("amount_0")), F.lit(1e-9))
    none = F.lit(None).cast("double")
    found = F.array_compact(F.array(
        F.when(~c("status").eqNullSafe(c("status_0")), F.struct(F.lit("status").alias("field"), named.alias("event"), none.alias("delta"))),
        F.when(~same, F.struct(F.lit("amount").alias("field"), F.lit("modification").alias("event"), F.round(c("amount") - c("amount_0"), 2).alias("delta"))),
        F.when(c("until") != c("until_0"), F.struct(F.lit("until").alias("field"), F.when(c("until") > c("until_0"), "extension").otherwise("modification").alias("event"), none.alias("delta"))),
    ))
    rows = pairs.select("id", "version", F.explode(found).alias("e")).select("id", "version", "e.*")
    return rows.withColumn("key", F.md5(F.concat_ws("|", c("id").cast("string"), c("version").cast("string"), "field")))


def modification_costs(changes: DataFrame, awarded: DataFrame) -> DataFrame:
    """(tender_id, lot, awarded, final, variation): the last modification's amount against the award, in percent.

    ``changes`` has tender_id, lot, contract, number, at and amount, ``awarded`` one row a lot. Lots with
    several contracts or a number twice have no amount of their own and are left out.
    """
    one = changes.groupBy("tender_id", "lot", "number").agg(F.count("*").alias("k"), F.min("contract").alias("c0"), F.max("contract").alias("c1"), F.max(F.struct("at", "amount")).alias("last"))
    per = one.groupBy("tender_id", "lot").agg(F.max("k").alias("k"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.max("last").alias("last")).where("k = 1 and c0 = c1")
    return per.join(awarded, ["tender_id", "lot"]).select("tender_id", "lot", "awarded", c("last.amount").alias("final"), F.round((c("last.amount") / c("awarded") - 1) * 100, 1).alias("variation"))


def own_funnel(pursuits: DataFrame) -> DataFrame:
    """By org: pursuits, submitted, won, lost, win_rate, won amount and median hours to a decision (whole hours)."""
    won, lost = c("outcome") == "won", c("outcome") == "lost"
    figures = pursuits.groupBy("org").agg(
        F.count("*").alias("n"), F.count("submitted").alias("submitted"), F.count_if(won).alias("won"), F.count_if(lost).alias("lost"),
        F.round(F.sum(F.when(won, c("amount")).otherwise(0.0)), 2).alias("amount"), F.percentile("hours", 0.5).alias("median_hours"),
    )
    return figures.withColumn("win_rate", F.round(F.try_divide("won", c("won") + c("lost")), 6))


def workload(open_: DataFrame, members: DataFrame, today: str, horizon: int) -> DataFrame:
    """Open pursuits by responsible member: all, submitted, overdue, due soon, without a next action; members without any stand with zeros.

    Pursuits of nobody come under null, those of somebody who is no member under their number.
    """
    day = F.lit(today).cast("date")
    working = c("status") != "submitted"
    flags = open_.select(
        "responsible", F.lit(1).alias("open"), (~working).cast("int").alias("submitted"), (working & (c("deadline") < day)).cast("int").alias("overdue"),
        (working & (c("deadline") >= day) & (c("deadline") <= F.date_add(day, horizon))).cast("int").alias("due_soon"),
        (working & (F.coalesce(F.trim("next_action"), F.lit("")) == "")).cast("int").alias("no_action"),
    )
    names = ["open", "submitted", "overdue", "due_soon", "no_action"]
    idle = members.select("responsible", *[F.lit(0).alias(n) for n in names])
    return flags.unionByName(idle).groupBy("responsible").agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names])


def freshness(arrivals: DataFrame, now: str, most_hours: dict[str, float], usual: float) -> DataFrame:
    """By source: rows, the last arrival, hours since, and whether that is longer than the source's limit."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in most_hours.items() for x in pair]), c("source")), F.lit(usual))
    last = arrivals.groupBy("source").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    lag = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 3600
    return last.withColumn("lag_hours", F.round(lag, 2)).withColumn("stale", F.coalesce(c("lag_hours") > limit, F.lit(True)))


def retention(tables: dict[str, tuple[DataFrame, str, int]], today: str) -> DataFrame:
    """(name, due): rows older than each table's term in days; rows without a date stay."""
    parts = [df.agg(F.lit(name).alias("name"), F.count_if(c(at) < F.date_sub(F.lit(today).cast("date"), days)).alias("due")) for name, (df, at, days) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retained(rows: DataFrame, at: str, days: int, today: str) -> DataFrame:
    """The rows that ``retention`` doesn't count."""
    return rows.where(c(at).isNull() | (c(at) >= F.date_sub(F.lit(today).cast("date"), days)))


def emerging_terms(docs: DataFrame, known: list[str], stop: list[str], least: int, n: int) -> DataFrame:
    """The n most frequent terms of three characters or more, by documents, that are no part of a known one, each with the start of its first document."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-záéíóúñü0-9/\-]{3,})"), F.lit(1)))
    # counts and least ids alone are aggregated; the starts of the n first documents are read afterwards
    of = docs.select("doc_id", F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    fresh = ~c("term").isin(*stop) & ~F.exists(F.array(*[F.lit(k) for k in known]), lambda k: F.contains(k, c("term")))
    top = cut(of.where(fresh & (c("n") >= least)).orderBy(F.desc("n"), F.asc("term")).limit(n), "terms")
    heads = docs.select("doc_id", "text").join(F.broadcast(top), c("doc_id") == c("first")).where(F.array_contains(terms, c("term")))
    return top.select("term", "n").join(heads.groupBy("term").agg(F.min(F.substring("text", 1, 120)).alias("example")), "term", "left")


def search(docs: DataFrame, every: list[str], any_: list[str], none: list[str], n: int) -> DataFrame:
    """Documents with every term of one list, one of another and none of a third; by occurrences against length.

    The score is the number of places over 1 + ln(1 + words), so that long texts don't win by length.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    rows = docs.select("doc_id", padded.alias("t"))
    has = lambda w: F.contains(c("t"), F.lit(f" {w} "))
    places = lambda w: (F.length("t") - F.length(F.replace("t", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
    wanted = F.lit(True)
    for w in every:
        wanted &= has(w)
    if any_:
        some = F.lit(False)
        for w in any_:
            some |= has(w)
        wanted &= some
    for w in none:
        wanted &= ~has(w)
    size = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))
    score = F.round(sum((places(w) for w in [*every, *any_]), F.lit(0.0)) / (1 + F.log(1.0 + size)), 6)
    return rows.where(wanted).select("doc_id", score.alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(n)


def reckless_cuts(awards: DataFrame, percent: float) -> DataFrame:
    """Awards whose price cut is at least so many percent; both amounts must be positive."""
    percent_off = F.round((1 - c("awarded") / c("budget")) * 100, 4)
    return awards.where((c("budget") > 0) & (c("awarded") > 0) & (percent_off >= percent)).select("tender_id", "lot", percent_off.alias("cut_percent"))


#: Bits of a number below its level; targets that a task groups at a time; counts of a level that are broadcast.
LEVEL_BITS, TARGETS, FEW = 56, 1 << 18, 1 << 16


def cohort_levels(targets: DataFrame, history: DataFrame, least: int) -> DataFrame:
    """(id, level, n): the first of seven cohorts of at least ``least`` past awards, else the first with any.

    Both sides have body, code, size (a band of amounts) and competition; the levels loosen from all four to none.
    History is counted by all four once and the other levels from these counts, each written before its join, so that
    few of them are broadcast and a key of very many targets can be split. A target stays one row through all joins; what was found is
    dealt by number, so that a task groups as many rows at any size of the input. The last level is one number for all.
    """
    levels = (("body", "code", "size", "competition"), ("body", "code", "size"), ("code", "size", "competition"), ("code", "size"), ("code",), ("size",))
    names = levels[0]
    tuples = cut(history.groupBy(*names).agg(F.count("*").alias("n")), "tuples")
    total = tuples.agg(F.sum("n")).first()[0] or 0
    found = targets.select("id", *names)
    for i, keys in enumerate(levels, 1):
        known = tuples.dropna(subset=list(keys))
        counts = known if keys == names else cut(known.groupBy(*keys).agg(F.sum("n").alias("n")), "counts")
        found = found.join(counts.withColumnRenamed("n", f"n{i}").hint("broadcast" if counts.count() <= FEW else "merge"), list(keys), "left")
    # level and number as one, so that no struct has to be sorted for its least
    packed = [F.when(c(f"n{i}").isNotNull(), F.lit(i << LEVEL_BITS) + c(f"n{i}")) for i in range(1, len(levels) + 1)]
    enough = F.coalesce(*[F.when(c(f"n{i}") >= least, x) for i, x in enumerate(packed, 1)])
    found = cut(found.select("id", enough.alias("enough"), F.coalesce(*packed).alias("any")), "found")
    best = found.repartition(max(1, math.ceil(found.count() / TARGETS)), "id").groupBy("id").agg(F.min("enough").alias("enough"), F.min("any").alias("any"))
    every = F.lit((len(levels) + 1 << LEVEL_BITS) + total)
    chosen = F.coalesce("enough", F.when(F.lit(total >= least), every), "any", F.when(F.lit(total > 0), every))
    return best.select("id", chosen.alias("x")).where("x is not null").select("id", F.shiftright("x", LEVEL_BITS).cast("int").alias("level"), c("x").bitwiseAND((1 << LEVEL_BITS) - 1).alias("n"))


#: Shares of a Poisson variable of mean 1 that are at most 0, 1, 2, ...
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917, 0.999990, 0.999999)


def bootstrap_precision(points: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(low, high): 2.5 and 97.5 % of the average precision over resamples of (id, score, truth).

    A row counts in a resample as often as a Poisson variable of mean 1 says (0 to 9, as far as 24 bits of a digest of seed,
    resample and id tell), which is how sampling with replacement looks in large tables and needs no draw by rank.
    Scores are grouped first: windows run over the distinct scores of a resample.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), c("r").cast("string"), c("id").cast("string")))
    # six digits in order of text are in order of value; rows that are drawn no time add nothing, so no filter takes the digest twice
    below = [f"{math.ceil(x * (1 << 24)):06x}" for x in POISSON]
    drawn = points.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", F.substring(digest, 1, 6))
    times = F.coalesce(*[F.when(c("u") < x, k) for k, x in enumerate(below)], F.lit(len(POISSON)))
    g = drawn.withColumn("k", times).groupBy("r", "score").agg(F.sum(c("k") * c("truth")).alias("hits"), F.sum("k").alias("n")).where("n > 0")
    steps = g.selectExpr("r", "hits", "sum(hits) OVER (PARTITION BY r ORDER BY score DESC) AS tp", "sum(n) OVER (PARTITION BY r ORDER BY score DESC) AS seen", "sum(hits) OVER (PARTITION BY r) AS positives")
    ap = steps.groupBy("r").agg(F.sum(c("hits") / c("positives") * c("tp") / c("seen")).alias("ap"))
    return ap.agg(F.round(F.percentile("ap", 0.025), 6).alias("low"), F.round(F.percentile("ap", 0.975), 6).alias("high"), F.count("*").alias("resamples"))
