"""Drift, calibration, ranking quality and anomalies, as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col


def psi(reference: DataFrame, current: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Population stability index of ``value`` over bins between the cuts; one row."""
    bin_ = sum((F.when(c(value) > x, 1).otherwise(0) for x in cuts), F.lit(0))

    def shares(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(c(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"))
        return rows.select("bin", (c("k") / F.sum("k").over(Window.partitionBy())).alias(name), F.sum("k").over(Window.partitionBy()).alias(f"n_{name}"))

    both = shares(reference, "r").join(shares(current, "s"), "bin", "full_outer")
    eps = 1 / F.greatest(F.max("n_r").over(Window.partitionBy()), F.max("n_s").over(Window.partitionBy()))
    r, s = F.coalesce("r", eps), F.coalesce("s", eps)
    return both.select(((s - r) * F.log(s / r)).alias("part")).agg(F.round(F.sum("part"), 6).alias("psi"), F.count("*").alias("bins"))


def calibration_error(rows: DataFrame, score: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    b = F.least(F.floor(score * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(truth).alias("y"))
    return per.agg(F.round(F.sum(c("n") * F.abs(c("p") - c("y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def thresholds(rows: DataFrame, score: Column, truth: Column) -> DataFrame:
    """(score, tp, n, positives): what lies at or above each distinct score. Sums over scores, not rows."""
    per = rows.groupBy(score.alias("score")).agg(F.sum(truth).alias("k"), F.count("*").alias("m"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select("score", "k", F.sum("k").over(down).alias("tp"), F.sum("m").over(down).alias("n"), F.sum("k").over(Window.partitionBy()).alias("positives"))


def average_precision(points: DataFrame) -> DataFrame:
    """Sum of recall steps times precision; null without positives."""
    ap = F.sum(F.try_divide("k", "positives") * c("tp") / c("n"))
    return points.agg(F.round(ap, 6).alias("average_precision"))


def best_f_beta(points: DataFrame, beta: float) -> DataFrame:
    """The threshold of the greatest F-beta, the highest of ties."""
    b2 = beta * beta
    f = F.round((1 + b2) * c("tp") / (c("n") + b2 * c("positives")), 6).alias("f")
    best = points.select("score", f).agg(F.max(F.struct("f", "score")).alias("x"))
    return best.select(c("x.score").alias("threshold"), "x.f")


def bands(points: DataFrame, least_precision: float, most_lost: float) -> DataFrame:
    """The least threshold of enough precision and the greatest that loses few positives."""
    sure = F.min(F.when(c("tp") >= least_precision * c("n"), c("score")))
    safe = F.max(F.when(c("tp") >= (1 - most_lost) * c("positives"), c("score")))
    return points.agg(sure.alias("sure_from"), safe.alias("none_below"))


def anomalies(rows: DataFrame, key: str, value: str, sigma: float, least: int) -> DataFrame:
    """Rows above their group's mean plus sigma deviations (population), of groups with enough rows and spread."""
    stats = rows.where(c(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__spread"), F.count("*").alias("__n")).where((c("__n") >= least) & (c("__spread") > 0))
    return rows.join(stats, key).where(c(value) > c("__mean") + sigma * c("__spread")).select("id", key, value)


def spike(rows: DataFrame, at: str, day: str, factor: float) -> DataFrame:
    """The day's count against ``factor`` times the mean of the thirty days before."""
    d, when = F.lit(day).cast("date"), F.to_date(at)
    counts = rows.agg(F.count(F.when(when == d, 1)).alias("today"), (F.count(F.when((when < d) & (when >= F.date_sub(d, 30)), 1)) / 30).alias("mean"))
    return counts.select("today", F.round("mean", 6).alias("mean"), (c("today") > factor * c("mean")).alias("is_spike"))


def agreement(pairs: DataFrame, label: str, truth: Column, answer: Column) -> DataFrame:
    """F1 per label and over all (label null)."""
    tp, fp, fn = F.count(F.when(truth & answer, 1)), F.count(F.when(~truth & answer, 1)), F.count(F.when(truth & ~answer, 1))
    sets = pairs.groupingSets([[c(label)], []], c(label))
    return sets.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).select(label, "tp", "fp", "fn", F.round(F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"))
