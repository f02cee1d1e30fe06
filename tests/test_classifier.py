import datetime as dt
import math
import random

import numpy as np
import pytest

from tendersieve.operators import classifier as C
from tendersieve.operators.evaluation import calibration_error
from pyspark.sql import functions as F


def test_later_share_to_the_row(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(6))] * 5])) for i in range(83)]
    for share in (0.0, 0.2, 0.5, 1.0):
        early, late = C.later_share(spark.createDataFrame(rows, "id long, day date"), "day", "id", share)
        order = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.date(1, 1, 1), r[0]))]
        at = int(83 * (1 - share))
        assert sorted(r["id"] for r in early.collect()) == sorted(order[:at]) and sorted(r["id"] for r in late.collect()) == sorted(order[at:])
    early, late = C.later_share(spark.createDataFrame([], "id long, day date"), "day", "id", 0.5)
    assert early.count() == late.count() == 0


@pytest.mark.parametrize("cost_fn", [1.0, 4.0])
def test_threshold_by_cost_equals_the_sweep(spark, cost_fn):
    rnd = random.Random(2)
    rows = [(p := round(rnd.random(), 3), int(rnd.random() < p)) for _ in range(500)] + [(0.0, 0), (1.0, 1), (0.5, 1), (0.005, 0)]
    df = spark.createDataFrame([*rows, (None, 1), (0.3, None)], "p double, y int")
    got = C.tune_threshold(df, "p", "y", cost_fn=cost_fn)
    beta2 = cost_fn
    best = (-1.0, 0.0)
    for i in range(1, 200):
        t = i * 0.005
        tp = sum(y for p, y in rows if p >= t - 1e-9)
        fp = sum(1 - y for p, y in rows if p >= t - 1e-9)
        fn = sum(y for _, y in rows) - tp
        f = (1 + beta2) * tp / ((1 + beta2) * tp + beta2 * fn + fp)
        if f > best[0] + 1e-12:
            best = (f, t)
    assert got["fbeta"] == pytest.approx(best[0]) and got["threshold"] == pytest.approx(best[1]) and got["beta"] == pytest.approx(math.sqrt(beta2))
    assert got["p5"] <= got["p50"] <= got["p95"] and got["resamples"] == 500
    assert C.tune_threshold(df.where("y = 1"), "p", "y") is None
    with pytest.raises(ValueError, match="costs"):
        C.tune_threshold(df, "p", "y", cost_fp=0)


def pav(x, y):
    steps = []
    for v in np.unique(x):
        steps.append([y[x == v].mean(), (x == v).sum()])
        while len(steps) > 1 and steps[-2][0] > steps[-1][0]:
            b, a = steps.pop(), steps.pop()
            steps.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    out, at = {}, 0
    values = [s[0] for s in steps for _ in range(int(s[1]))]
    for v in np.unique(x):
        out[v] = values[at]
        at += (x == v).sum()
    return out


def test_calibration_is_the_isotonic_fit(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 2), 0.0) for _ in range(300)]
    rows = [(p, float(rnd.random() < p**3)) for p, _ in rows]
    df = spark.createDataFrame(rows, "raw double, label double")
    got = C.calibrated(C.calibrate(df), df).select("raw", "probability").distinct().collect()
    want = pav(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert all(r["probability"] == pytest.approx(want[r["raw"]]) for r in got)
    even = C.calibrated(C.calibrate(df, "sigmoid"), df)
    error = lambda d, p: calibration_error(d, F.col(p), F.col("label")).first()["ece"]
    assert error(even, "probability") < error(df, "raw") and error(C.calibrated(C.calibrate(df), df), "probability") < 0.03
    with pytest.raises(ValueError, match="sigmoid"):
        C.calibrate(df, "other")


def test_learns_what_is_told(spark):
    rnd = random.Random(4)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), " ".join(rnd.choices("abcdefgh", k=9)) + (" server cloud" if i % 4 == 0 else " road bridge"), int(i % 4 == 0)) for i in range(240)]
    rows += [(900, dt.date(2024, 1, 2), None, 0), (901, None, "", 0), (902, None, "server", None)]
    df = spark.createDataFrame(rows, "id long, day date, text string, label int")
    model = C.train(df, "day", "id", size=1 << 10)
    scored = model.score(df).collect()
    assert len(scored) == 243 and all((r["probability"] > 0.5) == bool(r["label"]) for r in scored if r["label"] is not None)
    assert model.metadata == {"n_fit": 193, "n_calibration": 49, "n": 242}
    with pytest.raises(C.TooFewRows):
        C.train(df.limit(0), "day", "id")
    with pytest.raises(C.TooFewRows, match="earlier|later"):
        C.train(df.withColumn("label", F.col("id").between(231, 239).cast("int")), "day", "id")


def test_texts_are_taken_apart_once(spark, monkeypatch):
    """Both fits and the calibration read written counts, no text; the model scores texts as its fit saw them."""
    rnd = random.Random(6)
    rows = [(i, i // 5, " ".join(rnd.choices("abcdefgh", k=7)) + (" server" if i % 3 == 0 else " bridge"), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, day int, text string, label int")
    written, write = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, tag: (written.append((tag, df.columns)), write(df, tag))[1])
    model = C.train(df, "day", "id", size=1 << 10)
    assert ("labelled", ["day", "key", "label", "counts"]) in written and not any("text" in columns for _, columns in written)
    assert [type(x).__name__ for x in model.base.stages[-2:]] == ["IDFModel", "LogisticRegressionModel"]
    assert all((r["probability"] > 0.5) == bool(r["label"]) for r in model.score(df).collect())
