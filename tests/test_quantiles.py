import random

import numpy as np
import pytest

from tendersieve.operators import quantiles as Q


def made(n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind, size = rnd.choice(["a", "b", "c", None]), rnd.choice([1, 2, 5, 9, None])
        centre = {"a": 0.05, "b": 0.2}.get(kind, 0.4) + (0.1 if size is not None and size > 4 else 0.0)
        rows.append((kind, size, rnd.random(), centre + rnd.gauss(0, 0.02) if i % 100 else None))
    return rows


SCHEMA = "kind string, size int, noise double, y double"


def test_losses_are_the_least_pinball_losses():
    rnd = np.random.default_rng(2)
    values = np.sort(rnd.random(9))
    for _ in range(20):
        counts = rnd.integers(0, 6, 9)
        y = np.repeat(values, counts)
        if len(y):
            want = sum(min(np.where(y >= x, q * (y - x), (1 - q) * (x - y)).sum() for x in values) for q in Q.QUANTILES)
            hist = counts[None, :].astype(float)
            assert Q._losses(hist, values, Q._points(hist))[0] == pytest.approx(want)


def test_tree_finds_what_matters_and_its_band_holds(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    tree = Q.fit_tree(df, "y", ["kind", "size", "noise"], depth=4, least=50)
    assert {f for f, _ in tree.splits.values()} == {"kind", "size"}
    later = tree.predict(spark.createDataFrame(made(seed=9), SCHEMA))
    row = Q.coverage(later, "y").first()
    assert row["n"] == 2970 and abs(row["coverage"] - 0.8) <= 0.05 and row["mae"] < 0.03 and row["status"] == "ok"
    # leaves hold the quantiles of their rows
    told = df.where("y is not null").withColumn("leaf", tree.leaf()).collect()
    for leaf, q in tree.leaves.items():
        own = np.sort([r["y"] for r in told if r["leaf"] == leaf])
        assert np.allclose(q, [own[int(np.ceil(x * len(own))) - 1] for x in Q.QUANTILES])


def test_same_tree_for_any_partitioning(spark):
    df = spark.createDataFrame(made(900), SCHEMA)
    a, b = (Q.fit_tree(x, "y", ["kind", "size"], least=50) for x in (df, df.repartition(6)))
    assert a.splits == b.splits and a.leaves.keys() == b.leaves.keys()


def test_paired_error_and_its_standard_error(spark):
    rnd = random.Random(5)
    rows = [(y := rnd.random(), y + rnd.gauss(0, 0.2), y + rnd.gauss(0, 0.1)) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "y double, old double, new double")
    d = np.array([abs(y - n) - abs(y - o) for y, o, n in rows])
    row = Q.paired_error(df, "y", "old", "new").first()
    assert tuple(row) == (200, round(d.mean(), 6), round(d.std(ddof=1) / np.sqrt(200), 6), True)
    assert tuple(Q.paired_error(df.limit(0), "y", "old", "new").first()) == (0, None, None, False)


def test_no_rows_and_few_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    tree = Q.fit_tree(empty, "y", ["kind", "size"])
    row = tree.predict(spark.createDataFrame(made(5), SCHEMA)).first()
    assert row["p10"] is row["p50"] is row["p90"] is None
    assert Q.coverage(tree.predict(empty), "y").first()["status"] == "no data"
