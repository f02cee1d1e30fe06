import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tendersieve.operators import allotment as A


def plain(sizes, total):
    sizes = {k: v for k, v in sizes.items() if v > 0}
    if total >= sum(sizes.values()):
        return sizes
    if total <= len(sizes):
        return dict.fromkeys(sorted(sizes, key=lambda k: (-sizes[k], k))[:total], 1)
    units, free, quota = total - len(sizes), set(sizes), {}
    while True:
        weight = sum(math.sqrt(sizes[k]) for k in free)
        over = {k for k in free if math.sqrt(sizes[k]) / weight * units > sizes[k] - 1}
        if not over or units <= 0:
            break
        for k in over:
            quota[k] = sizes[k]
            units -= sizes[k] - 1
        free -= over
    share = {k: math.sqrt(sizes[k]) / weight * units for k in free}
    left = units - sum(math.floor(x) for x in share.values())
    lucky = sorted(free, key=lambda k: (-round(share[k] - math.floor(share[k]), 9), -sizes[k], k))[:left]
    return quota | {k: 1 + math.floor(share[k]) + (k in lucky) for k in free}


@pytest.mark.parametrize("sizes, totals", [
    ({"a": 100, "b": 100, "c": 100}, (1, 2, 3, 4, 10, 299, 300, 500)), ({"a": 10_000, "b": 3, "c": 1, "d": 0}, (2, 3, 8, 50, 9_000)), ({"a": 1, "b": 1, "c": 1, "d": 2}, (2, 4, 5)), ({}, (5,)),
    ({f"s{i}": random.Random(i).randrange(400) for i in range(30)}, (29, 31, 200, 3000)),
])
def test_quotas_equal_the_plain_rule_and_are_exact(spark, sizes, totals):
    df = spark.createDataFrame(list(sizes.items()), "stratum string, size long")
    for total in totals:
        got = {r["stratum"]: r["quota"] for r in A.allot(df, total).collect()}
        assert got == plain(sizes, total) and sum(got.values()) == min(total, sum(sizes.values()))
        assert all(0 < q <= sizes[k] for k, q in got.items())


def test_a_total_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        A.allot(spark.createDataFrame([("a", 1)], "stratum string, size long"), 0)


def test_draw_takes_the_quota_of_least_hash(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None) for i in range(200)] + [(500, "d")]
    df = spark.createDataFrame(rows, "id long, k string")
    got = {}
    for r in A.draw(df.repartition(5), F.col("k"), "id", 40).collect():
        got.setdefault(r["stratum"], set()).add(r["id"])
    sizes = {k: sum(x == k for _, x in rows) for k in "abcd"}
    for k, quota in plain(sizes, 40).items():
        order = sorted((i for i, x in rows if x == k), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert got[k] == set(order[:quota])


def test_split_stays(spark):
    rows = [("a", None), ("b", "tune"), ("c", "holdout"), ("d", "other"), (None, None)]
    got = {r["id"]: r["half"] for r in spark.createDataFrame(rows, "id string, given string").withColumn("half", A.split(F.col("id"), F.col("given"))).collect()}
    assert got == {i: g if g in ("tune", "holdout") else ("tune", "holdout")[hashlib.sha256((i or "").encode()).digest()[0] % 2] for i, g in rows}
