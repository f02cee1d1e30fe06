import random

import pytest
from pyspark.sql import functions as F

from tendersieve.operators.percentiles import percentiles


@pytest.mark.parametrize("accuracy, whole", [(10, 0), (10_000, 0), (10_000, 1 << 20)])
def test_equal_to_the_whole_values(spark, accuracy, whole):
    """Without whole groups, a low accuracy takes the large ones through the bounds."""
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None, "c"]), rnd.choice([None, float(rnd.randrange(9)), rnd.gauss(0, 50), 7.0])) for _ in range(3000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(q) for q in shares])).alias("p"))
    got = percentiles(df, ["k"], "v", shares, accuracy, whole)
    same = lambda d: sorted((str(r["k"]), r["n"], r["p"]) for r in d.collect())
    assert same(got) == same(want)
    whole = percentiles(df, [], F.col("v"), [0.5], accuracy, whole).first()
    assert whole["p"][0] == df.agg(F.percentile("v", 0.5)).first()[0] and whole["n"] == df.where("v is not null").count()


def test_no_values(spark):
    empty = spark.createDataFrame([], "k string, v double")
    for whole in (-1, 9):
        assert percentiles(empty, ["k"], "v", [0.5], whole=whole).count() == 0
        assert tuple(percentiles(empty, [], "v", [0.5], whole=whole).first()) == (0, None)


def test_bounds_go_to_the_rows_and_not_a_group_to_one_task(spark):
    rows = spark.createDataFrame([("a", float(i % 11)) for i in range(500)] + [(None, 1.0)], "g string, v double")
    found = percentiles(rows, ["g"], "v", [0.25, 0.5], accuracy=20, whole=10)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # the join of one row a group with one row a group may remain
    assert plan.count("SortMergeJoin") <= 1 and "BroadcastHashJoin" in plan
    assert {r["g"]: (r["n"], r["p"]) for r in found.collect()} == {"a": (500, [2.0, 5.0]), None: (1, [1.0, 1.0])}
