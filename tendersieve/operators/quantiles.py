"""Discount quantiles by a tree on histogram bins with pinball loss, and how well intervals hold in a later period.

Rows are coded once: each feature as a bin, the target as one of its quantile bins. A level of the tree needs the numbers of
rows by (leaf, feature, bin, target bin, half), whose size depends on the tree and the bins alone and never on the rows; the driver
picks each leaf's best cut from them. Leaves get the quantiles of their own rows by a mergeable sketch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tendersieve.sources.files import cut

c = F.col
QUANTILES = (0.1, 0.5, 0.9)
ACCURACY = 10_000
#: Coverage of the 80 % band below which one warns, or finds it broken; pairs that a judgement takes. Fixed values.
WARN, BROKEN, FEWEST = 0.65, 0.50, 30


def _code(rows: DataFrame, feature: str, bins: int) -> Column:
    """A feature's bin: numbers by quantile cuts, other values by falling number of rows with all rarer ones in the last; null is 0."""
    if rows.schema[feature].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or rows.schema[feature].dataType.typeName().startswith("decimal"):
        cuts = sorted(set(rows.agg(F.percentile_approx(c(feature).cast("double"), [i / bins for i in range(1, bins)], ACCURACY).alias("q")).first()["q"] or []))
        return F.when(c(feature).isNull(), 0).otherwise(1 + sum((F.when(c(feature) > x, 1).otherwise(0) for x in cuts), F.lit(0)))
    common = [r[feature] for r in rows.where(c(feature).isNotNull()).groupBy(feature).agg(F.count("*").alias("n"), F.avg("target__").alias("y")).orderBy(F.desc("n"), feature).limit(bins - 1).orderBy("y", feature).collect()]
    return F.when(c(feature).isNull(), 0).otherwise(F.coalesce(*[F.when(c(feature) == v, i) for i, v in enumerate(common, 1)], F.lit(len(common) + 1)))


def _points(hist: np.ndarray) -> np.ndarray:
    """The target bin of each quantile (rows x quantiles) for rows of target counts."""
    n, below = hist.sum(axis=1), np.cumsum(hist, axis=1)
    return np.stack([np.minimum((below < q * n[:, None]).sum(axis=1), hist.shape[1] - 1) for q in QUANTILES], axis=1)


def _losses(hist: np.ndarray, values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Pinball loss of each row of target counts, summed over the quantiles, if they are foretold at ``points``."""
    below, weighed = np.cumsum(hist, axis=1), np.cumsum(hist * values, axis=1)
    i, total = np.arange(len(hist)), np.zeros(len(hist))
    for q, at in zip(QUANTILES, points.T, strict=True):
        x = values[at]
        total += q * (weighed[i, -1] - weighed[i, at] - x * (below[i, -1] - below[i, at])) + (1 - q) * (x * below[i, at] - weighed[i, at])
    return total


@dataclass
class QuantileTree:
    """``codes`` give a feature's bin, ``splits`` node -> (feature, last bin that goes left); node i has the children 2i and 2i + 1."""

    codes: dict[str, Column]
    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    leaves: dict[int, tuple[float, ...]] = field(default_factory=dict)

    def leaf(self, at: int = 1, coded: bool = False) -> Column:
        """A row's leaf, from its features or their codes."""
        if at not in self.splits:
            return F.lit(at)
        feature, last = self.splits[at]
        code = c(f"code_{feature}") if coded else self.codes[feature]
        return F.when(code <= last, self.leaf(2 * at, coded)).otherwise(self.leaf(2 * at + 1, coded))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p10, p50, p90."""
        held = rows.withColumn("leaf__", self.leaf())
        values = [F.coalesce(*[F.when(c("leaf__") == k, v[i]) for k, v in self.leaves.items()], F.lit(None).cast("double")).alias(x) for i, x in enumerate(("p10", "p50", "p90"))]
        return held.select(*rows.columns, *values)


def fit_tree(rows: DataFrame, target: str, features: list[str], *, depth: int = 3, bins: int = 32, target_bins: int = 64, least: int = 200, gain: float = 0.03) -> QuantileTree:
    """A tree of at most ``depth`` cuts a way whose leaves hold at least ``least`` rows; a cut found in one half of the
    rows must lower the loss of the other half in its leaf by the share ``gain``.

    Rows without the target take no part; unknown values of a feature go where rare ones do, null where the least go. Without rows
    the tree predicts null.
    """
    known = cut(rows.where(c(target).isNotNull()).withColumn("target__", c(target).cast("double")).select("target__", *features), "known")
    tree = QuantileTree({f: _code(known, f, bins) for f in features})
    edges = sorted(set(known.agg(F.percentile_approx("target__", [i / target_bins for i in range(1, target_bins)], ACCURACY).alias("q")).first()["q"] or []))
    ybin = sum((F.when(c("target__") > x, 1).otherwise(0) for x in edges), F.lit(0))
    half = F.pmod(F.xxhash64("target__", *features), F.lit(2)).cast("int").alias("half")
    coded = cut(known.select("target__", ybin.alias("y"), half, *[tree.codes[f].alias(f"code_{f}") for f in features]), "coded")
    means = {r["y"]: r["m"] for r in coded.groupBy("y").agg(F.avg("target__").alias("m")).collect()}
    if not means:
        return tree
    values = np.array([means.get(i, 0.0) for i in range(len(edges) + 1)])
    open_ = {1}
    for _ in range(depth):
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), c(f"code_{f}").alias("b")) for f in features]))
        held = coded.withColumn("leaf", tree.leaf(coded=True)).where(c("leaf").isin(*open_))
        hist: dict[tuple[int, str], np.ndarray] = {}
        for r in held.select("leaf", "y", "half", each.alias("x")).groupBy("leaf", "x.f", "x.b", "y", "half").agg(F.count("*").alias("n")).collect():
            hist.setdefault((r["leaf"], r["f"]), np.zeros((2, bins + 2, len(values))))[r["half"], r["b"], r["y"]] += r["n"]
        best: dict[int, tuple[float, str, int]] = {}
        for (leaf, feature), (one, other) in sorted(hist.items()):
            whole = one.sum(axis=0)[None, :]
            left = np.cumsum(one, axis=0)[:-1]
            left_other = np.cumsum(other, axis=0)[:-1]
            n_left, n = left.sum(axis=1) + left_other.sum(axis=1), one.sum() + other.sum()
            fits = np.flatnonzero((n_left >= least) & (n - n_left >= least))
            if not len(fits):
                continue
            points = [_points(x) for x in (left[fits], whole - left[fits], whole)]
            saved = _losses(whole, values, points[2])[0] - _losses(left[fits], values, points[0]) - _losses(whole - left[fits], values, points[1])
            k = int(np.argmax(np.round(saved, 9)))
            # the cut of one half of the rows must also foretell the other half better
            rest, part = other.sum(axis=0)[None, :], left_other[fits[k]][None, :]
            before = _losses(rest, values, points[2])[0]
            after = _losses(part, values, points[0][k][None, :])[0] + _losses(rest - part, values, points[1][k][None, :])[0]
            if before - after > gain * before and before - after > best.get(leaf, (0.0,))[0] + 1e-9:
                best[leaf] = (float(before - after), feature, int(fits[k]))
        for leaf, (_, feature, last) in best.items():
            tree.splits[leaf] = (feature, last)
        open_ = {child for leaf in best for child in (2 * leaf, 2 * leaf + 1)}
        if not open_:
            break
    found = coded.withColumn("leaf", tree.leaf(coded=True)).groupBy("leaf").agg(F.percentile_approx("target__", list(QUANTILES), ACCURACY).alias("q"))
    tree.leaves = {r["leaf"]: tuple(r["q"]) for r in found.collect()}
    return tree


def coverage(rows: DataFrame, truth: str) -> DataFrame:
    """One row (n, coverage, mae, bias, status) of p10, p50, p90 against what came true; pairs with a null are left out."""
    y = c(truth)
    pairs = rows.where(y.isNotNull() & c("p10").isNotNull() & c("p50").isNotNull() & c("p90").isNotNull())
    found = pairs.agg(F.count("*").alias("n"), F.avg(((y >= c("p10")) & (y <= c("p90"))).cast("double")).alias("x"), F.avg(F.abs(y - c("p50"))).alias("mae"), F.avg(y - c("p50")).alias("bias"))
    status = F.when(c("n") < FEWEST, "no data").when(c("x") < BROKEN, "broken").when(c("x") < WARN, "warn").otherwise("ok")
    return found.select("n", F.round("x", 4).alias("coverage"), F.round("mae", 4).alias("mae"), F.round("bias", 4).alias("bias"), status.alias("status"))


def paired_error(rows: DataFrame, truth: str, old: str, new: str, z: float = 2.0) -> DataFrame:
    """One row (n, delta, error, better): mean difference of absolute errors, new less old, with its standard error.

    ``better`` where the new one errs less by more than z standard errors, over enough pairs.
    """
    pairs = rows.where(c(truth).isNotNull() & c(old).isNotNull() & c(new).isNotNull())
    diff = F.abs(c(truth) - c(new)) - F.abs(c(truth) - c(old))
    found = pairs.agg(F.count("*").alias("n"), F.avg(diff).alias("d"), F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("s")).withColumn("e", F.try_divide("s", F.sqrt("n")))
    better = F.coalesce((c("n") >= FEWEST) & (c("d") < -z * c("e")), F.lit(False))
    return found.select("n", F.round("d", 6).alias("delta"), F.round("e", 6).alias("error"), better.alias("better"))
