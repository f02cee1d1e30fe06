import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendersieve.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, Cell string"


def brute(rows, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by the contract's words; anchors have an id divisible by 10."""
    sound = [
        (i, r[0], r[2], [int(np.floor(256 * x)) for x in r[1]]) for i, r in enumerate(rows)
        if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])
    ]
    place = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, id_, label, q in sound:
        if id_ is None or id_ % 10:
            continue
        scores = [(sum(a * b for a, b in zip(q, v)), n, j, lab) for j, n, lab, v in sound if j != i]
        for p in sorted([x for x in scores if x[3] == label], key=place)[:positives]:
            band = [x for x in scores if x[3] != label and 30 * p[0] <= 100 * x[0] <= 90 * p[0]]
            out += [(id_, p[1], k, x[1], p[0], x[0]) for k, x in enumerate(sorted(band, key=place)[:negatives], 1)]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()), key=str)


def clustered(n, seed, width=6):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)], rnd.randrange(3), "x") for i in range(n)]


@pytest.mark.parametrize("split", [None, (8, 16)])
def test_equals_brute_force(spark, monkeypatch, split):
    if split:  # several groups, splits and parts; the tasks get the values with the closures
        monkeypatch.setattr(H, "GROUP", split[0])
        monkeypatch.setattr(H, "PART", split[1])
    rows = clustered(160, 1)
    assert run(spark, rows, pivots=12) == brute(rows)


def test_ties_repeats_nulls_and_short_vectors(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2, "") for i in range(24)]
    rows += [(10, [1.0, 1.0], 0, ""), (12, [1.0, 1.0], 0, "")]  # repeated
    rows += [(None, [2.0, 1.0], 0, None), (30, None, 1, ""), (31, [1.0, None], 1, ""), (32, [float("nan"), 1.0], 0, ""), (33, [float("inf"), 1.0], 0, ""), (34, [1.0, 1.0], None, "")]
    rows += [(40, [], 0, ""), (41, [3.0], 1, ""), (50, [-1.0, 0.5, 4.0], 1, "")]
    assert run(spark, rows) == brute(rows)


def test_copies_only_where_bounds_allow(spark):
    # two far clusters: rows of one can't reach the scores that requests of the other want
    rows = [(i, [10.0 + i % 7 / 50, 0.0] if i % 2 else [0.0, 10.0 + i % 5 / 50], i % 3, "") for i in range(300)]
    placed = H.vectors(spark.createDataFrame(rows, SCHEMA), F.col("label"))
    space = H._space(placed, placed.where("vec_id % 10 = 0"), 8)
    cells = placed.select("uid", "vec_id", "label", "vec").mapInArrow(space.locate(False), "uid long, vec_id long, label long, vec binary, cell int, distance double, square double")
    group = {"cell": 0, "radius": 1.0, "square": 2560.0**2, "least_square": 2560.0**2, "high": H.ANY, "splits": 1}
    near = cells.mapInArrow(H._route(space, [group], {0: 2500 * 2500}, 1), "cell int, split int, part int, uid long, vec_id long, label long, vec binary")
    assert 0 < near.count() < 300


def test_empty_table_too_great_and_scores_of_zero(spark):
    assert run(spark, []) == []
    rows = [(i, [0.0, 0.0], i % 2, "") for i in range(12)]
    assert run(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="too great|fit a long"):
        run(spark, [(0, [1e30], 0, ""), (1, [1e30], 0, "")])


def test_same_result_for_any_partitioning(spark):
    rows = clustered(80, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    a = [sorted(map(str, H.hard_negatives(d, F.col("vec_id") % 10 == 0).collect())) for d in (df, df.repartition(7))]
    assert a[0] == a[1]
