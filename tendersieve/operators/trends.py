"""Series over time: buckets, comparisons, running totals, seasons, forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .overview import cents, count_if

c = F.col


def series(tenders: DataFrame, step: str) -> DataFrame:
    """Count and amount a day, week (its Monday) or month."""
    return tenders.groupBy(F.date_format(F.date_trunc(step, "published"), "yyyy-MM-dd").alias("bucket")).agg(F.count("*").alias("n"), cents(c("amount")).alias("amount"))


def heatmap(tenders: DataFrame, key: str) -> DataFrame:
    return tenders.groupBy(F.date_format("published", "yyyy-MM").alias("month"), key).agg(F.count("*").alias("n"))


def year_over_year(tenders: DataFrame, now: str) -> DataFrame:
    t = F.lit(now).cast("timestamp")
    this = (c("published") >= F.date_sub(t, 365)) & (c("published") < t)
    last = (c("published") >= F.date_sub(t, 730)) & (c("published") < F.date_sub(t, 365))
    figures = tenders.agg(count_if(this).alias("n"), count_if(last).alias("n_before"), cents(F.when(this, c("amount"))).alias("amount"), cents(F.when(last, c("amount"))).alias("amount_before"))
    return figures.withColumn("change_pct", F.when(c("n_before") > 0, F.round((c("n") - c("n_before")) / c("n_before") * 100, 4)))


def histogram(tenders: DataFrame, edges: list[float]) -> DataFrame:
    """Half-open bins between the edges; below the first and null fall out, the last is open."""
    bins = [F.struct(F.lit(float(a)).alias("low"), count_if((c("amount") >= a) & (c("amount") < b) if b else c("amount") >= a).alias("n")) for a, b in zip(edges, [*edges[1:], None], strict=True)]
    return tenders.agg(F.array(*bins).alias("bins")).select(F.explode("bins").alias("x")).select("x.*")


def waterfall(monthly: DataFrame) -> DataFrame:
    """Change against the bucket before and the running total. One row a bucket, so one task suffices."""
    w = Window.orderBy("bucket")
    return monthly.select("bucket", "n", (c("n") - F.lag("n", 1, 0).over(w)).alias("delta"), F.sum("n").over(w).alias("total"))


def peak(buckets: DataFrame) -> DataFrame:
    """The bucket with most, the earliest of ties."""
    return buckets.agg(F.min_by("bucket", F.struct(-c("n"), c("bucket"))).alias("bucket"), F.max("n").alias("n"))


def due_calendar(tenders: DataFrame, since: str, until: str, days: int) -> DataFrame:
    """Deadlines (published plus days) a day, in [since, until)."""
    due = F.date_add(c("published"), days)
    rows = tenders.withColumn("due", due).where((c("due") >= F.lit(since).cast("date")) & (c("due") < F.lit(until).cast("date")))
    return rows.groupBy(F.date_format("due", "yyyy-MM-dd").alias("due")).agg(F.count("*").alias("n"))


def due_kpis(tenders: DataFrame, today: str, days: int) -> DataFrame:
    """Due today, in the next seven days, in the rest of the month; bounds are exclusive."""
    due, t = F.date_add(c("published"), days), F.lit(today).cast("date")
    month_end = F.add_months(F.trunc(t, "month"), 1)
    return tenders.select(due.alias("due")).agg(
        count_if(c("due") == t).alias("today"), count_if((c("due") > t) & (c("due") < F.date_add(t, 8))).alias("week"), count_if((c("due") > t) & (c("due") < month_end)).alias("month"),
    )


def ranked_series(awards: DataFrame, key: str, n: int) -> DataFrame:
    """Month series of the n keys with the largest amounts."""
    top = awards.groupBy(key).agg(cents(c("awarded")).alias("total")).orderBy(F.desc("total"), F.asc(key)).limit(n).select(key)
    return awards.join(F.broadcast(top), key, "left_semi").groupBy(key, F.date_format("awarded_on", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), cents(c("awarded")).alias("amount"))


def seasonality(tenders: DataFrame) -> DataFrame:
    """Mean number published in each calendar month; months of the span without any count as zero."""
    monthly = tenders.groupBy(F.trunc("published", "month").alias("m")).agg(F.count("*").alias("n"))
    spine = monthly.agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month"))).alias("m"))
    return spine.join(monthly, "m", "left").groupBy(F.month("m").alias("month")).agg(F.round(F.sum(F.coalesce("n", F.lit(0))) / F.count("*"), 6).alias("mean_n"), F.count("*").alias("seen"))


def _holt_winters(y: np.ndarray, ahead: int, season: int = 12) -> tuple[np.ndarray, float]:
    """Additive smoothing with the best of a small grid of factors; a line where no two seasons are known."""
    n = len(y)
    if n < 2 * season:
        slope, level = np.polyfit(np.arange(n), y, 1) if n > 1 else (0.0, float(y[0]) if n else 0.0)
        fit = level + slope * np.arange(n)
        return level + slope * np.arange(n, n + ahead), float(np.std(y - fit)) if n else 0.0
    best: tuple[float, np.ndarray, float] | None = None
    for a in (0.1, 0.3, 0.6):
        for b in (0.01, 0.1):
            for g in (0.1, 0.3):
                level, trend = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season
                seasonal = list(y[:season] - level)
                error = []
                for t in range(n):
                    s = seasonal[t]
                    error.append(y[t] - level - trend - s)
                    new = a * (y[t] - s) + (1 - a) * (level + trend)
                    trend = b * (new - level) + (1 - b) * trend
                    seasonal.append(g * (y[t] - new) + (1 - g) * s)
                    level = new
                sse = float(np.square(error).sum())
                if best is None or sse < best[0]:
                    best = sse, level + trend * np.arange(1, ahead + 1) + np.array([seasonal[n + k % season] for k in range(ahead)]), float(np.std(error))
    return best[1], best[2]


def forecast(monthly: DataFrame, key: str, ahead: int) -> DataFrame:
    """Months ahead for each key, with a band of 1.5 deviations, never below zero. Rows: (key, bucket, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        months = pd.period_range(pdf.bucket.iloc[0][:7], pdf.bucket.iloc[-1][:7], freq="M")
        y = pdf.set_index(pdf.bucket.str[:7]).n.reindex(months.astype(str), fill_value=0).to_numpy(float)
        mean, spread = _holt_winters(y, ahead)
        bucket = pd.period_range(months[-1] + 1, periods=ahead, freq="M").astype(str)
        return pd.DataFrame({key: pdf[key].iloc[0], "month": bucket, "n": np.maximum(mean, 0), "low": np.maximum(mean - 1.5 * spread, 0), "high": np.maximum(mean + 1.5 * spread, 0)})

    return monthly.groupBy(key).applyInPandas(run, f"{key} string, month string, n double, low double, high double")
