"""Text classifier: fitted on the past, calibrated on what came after, with a threshold by cost."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col
STEP = 0.005


class TooFewRows(ValueError):
    """A part of the data lacks rows or one of the classes."""


def later_share(rows: DataFrame, day: str, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(earlier, later): the last ``share`` of the rows by (day, key), to the row; the cut lies in one day, which alone is ordered.

    Null days come first. Rows that tie in both are dealt out as one order has them.
    """
    per_day = rows.groupBy(day).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(c(day).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = cut(per_day.select(c(day).alias("day__"), "n", before.alias("before")), "days")  # a row a day
    total = days.agg(F.sum("n")).first()[0] or 0
    first = int(total * (1.0 - share))
    edge = days.where((c("before") <= first) & (c("before") + c("n") > first)).collect()
    if not edge:
        return rows, rows.limit(0)
    at = F.lit(edge[0]["day__"])
    same = cut(rows.where(c(day).eqNullSafe(at)).withColumn("place__", F.row_number().over(Window.orderBy(key))), "edge")
    taken = first - edge[0]["before"]
    early = rows.where(c(day).isNull() & at.isNotNull() | (c(day) < at)).unionByName(same.where(c("place__") <= taken).drop("place__"))
    return early, rows.where(c(day).isNotNull() & at.isNull() | (c(day) > at)).unionByName(same.where(c("place__") > taken).drop("place__"))


def _counts(size: int) -> PipelineModel:
    """Words and pairs of a text as places of ``counts``: nothing of it is learned."""
    return PipelineModel([
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}_]+"), NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="word_counts", numFeatures=size, binary=True), HashingTF(inputCol="pairs", outputCol="pair_counts", numFeatures=size, binary=True),
        VectorAssembler(inputCols=["word_counts", "pair_counts"], outputCol="counts"),
    ])


def _fit(rows: DataFrame) -> PipelineModel:
    """By ``counts``; both classes weigh the same in all."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weight = F.when(c("label") == 1.0, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0]))
    steps = Pipeline(stages=[IDF(inputCol="counts", outputCol="features", minDocFreq=2), LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=50)])
    return steps.fit(rows.select("label", "counts", weight.alias("weight")))


def _raw(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("words", "pairs", "word_counts", "pair_counts", "counts", "features", "rawPrediction", "probability", "prediction")


@dataclass
class Classifier:
    base: PipelineModel
    calibration: object
    method: str
    metadata: dict = field(default_factory=dict)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with text; null is empty) with ``raw`` and the calibrated ``probability``."""
        raw = _raw(self.base, rows.withColumn("text", F.coalesce("text", F.lit(""))))
        return calibrated(self.calibration, raw)


def _margin(rows: DataFrame) -> DataFrame:
    p = F.least(F.greatest("raw", F.lit(1e-9)), F.lit(1 - 1e-9))
    return VectorAssembler(inputCols=["margin__"], outputCol="margin").transform(rows.withColumn("margin__", F.log(p / (1 - p))))


def calibrate(rows: DataFrame, method: str = "isotonic"):
    """Model of label (0.0, 1.0) by ``raw``: ``isotonic`` steps or a ``sigmoid`` of the log odds."""
    if method == "isotonic":
        return IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="probability").fit(rows.withColumn("raw", F.round("raw", 12)))
    if method == "sigmoid":
        return LogisticRegression(featuresCol="margin", labelCol="label", probabilityCol="both__", rawPredictionCol="r__", predictionCol="p__").fit(_margin(rows))
    raise ValueError(f"isotonic or sigmoid, not {method}")


def calibrated(model, rows: DataFrame) -> DataFrame:
    if hasattr(model, "boundaries"):
        return model.transform(rows.withColumn("raw", F.round("raw", 12))).withColumn("probability", F.least(F.greatest("probability", F.lit(0.0)), F.lit(1.0)))
    return model.transform(_margin(rows)).withColumn("probability", vector_to_array("both__")[1]).drop("margin__", "margin", "both__", "r__", "p__")


def train(rows: DataFrame, day: str, key: str, *, share: float = 0.2, method: str = "isotonic", size: int = 1 << 15, least: int = 40, least_later: int = 10) -> Classifier:
    """Fit on the earlier rows (text, label), calibrate on the later ``share``, then fit anew on all and keep the calibration.

    Rows without a label take no part; a null text is empty. Raises ``TooFewRows`` where a part has too few rows or one class only.
    """
    words = _counts(size)
    texts = rows.where(c("label").isNotNull()).select(c(day).alias("day"), c(key).alias("key"), c("label").cast("double").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    known = cut(words.transform(texts).select("day", "key", "label", "counts"), "labelled")  # each text is taken apart once, both fits read its counts
    early, late = (cut(x, "fold") for x in later_share(known, "day", "key", share))
    sizes = {}
    for name, part, fewest in (("earlier", early, 2), ("later", late, least_later), ("all", known, least)):
        counts = {r["label"]: r["n"] for r in part.groupBy("label").agg(F.count("*").alias("n")).collect()}
        sizes[name] = sum(counts.values())
        if sizes[name] < fewest or not counts.get(1.0) or not counts.get(0.0):
            raise TooFewRows(f"{name}: {counts}")
    fold = calibrate(cut(_raw(_fit(early), late).select("label", "raw"), "raw"), method)
    return Classifier(PipelineModel([*words.stages, *_fit(known).stages]), fold, method, {"n_fit": sizes["earlier"], "n_calibration": sizes["later"], "n": sizes["all"]})


def grid_counts(rows: DataFrame, score: str, label: str, step: float = STEP) -> DataFrame:
    """(step, positives, n) of the rows by how many grid steps their score reaches: all that thresholds of the grid depend on."""
    reached = F.floor(c(score) / step + 1e-9).cast("int")
    return rows.where(c(score).isNotNull() & c(label).isNotNull()).groupBy(reached.alias("step")).agg(F.sum(c(label).cast("long")).alias("positives"), F.count("*").alias("n"))


def _best(cells: np.ndarray, beta: float, step: float) -> tuple[int, float, float, float]:
    """(step of the first greatest F-beta, it, precision, recall) of rows (positives, negatives) a grid step."""
    tp = np.cumsum(cells[::-1, 0])[::-1].astype(float)
    fp = np.cumsum(cells[::-1, 1])[::-1].astype(float)
    all_ = tp[0]
    f = (1 + beta**2) * tp / np.maximum((1 + beta**2) * tp + beta**2 * (all_ - tp) + fp, 1e-300)
    last = math.ceil(1 / step - 1e-9) - 1
    at = 1 + int(np.argmax(np.round(f[1 : last + 1], 12)))
    return at, float(f[at]), float(tp[at] / max(tp[at] + fp[at], 1)), float(tp[at] / max(all_, 1))


def tune_threshold(rows: DataFrame, score: str, label: str, *, cost_fp: float = 1.0, cost_fn: float = 1.0, step: float = STEP, resamples: int = 500, seed: int = 7) -> dict | None:
    """The threshold on the grid of greatest F-beta, beta the root of cost_fn / cost_fp, with how it varies over resampled rows.

    Rows that reach the same grid step and have the same label are alike, so resamples are drawn from their numbers: at most two
    cells a step go to the driver. Resamples of one class choose nothing. None without both classes.
    """
    if cost_fp <= 0 or cost_fn <= 0:
        raise ValueError("costs must be positive")
    beta = math.sqrt(cost_fn / cost_fp)
    cells = np.zeros((math.ceil(1 / step - 1e-9) + 2, 2), np.int64)
    for r in grid_counts(rows, score, label, step).collect():
        cells[min(max(r["step"], 0), len(cells) - 1)] += (r["positives"], r["n"] - r["positives"])
    n = int(cells.sum())
    if not cells[:, 0].sum() or not cells[:, 1].sum():
        return None
    at, f, precision, recall = _best(cells, beta, step)
    draw = np.random.default_rng(seed)
    chosen = []
    for drawn in draw.multinomial(n, (cells / n).ravel(), size=resamples):
        other = drawn.reshape(cells.shape)
        if other[:, 0].sum() and other[:, 1].sum():
            chosen.append(_best(other, beta, step)[0] * step)
    low, middle, high = np.percentile(chosen, [5, 50, 95]) if chosen else (math.nan,) * 3
    return {
        "threshold": round(at * step, 9), "fbeta": f, "precision": precision, "recall": recall, "beta": beta, "sigma": float(np.std(chosen)) if chosen else math.nan,
        "p5": float(low), "p50": float(middle), "p95": float(high), "resamples": len(chosen),
    }
