import random

from pyspark.sql import functions as F

from tendersieve.llm.prefix import running_sum


def test_columns_of_the_caller_named_part_are_kept(spark):
    rng = random.Random(3)
    rows = [(p, s, rng.randint(0, 9)) for p in range(5) for s in range(20)]
    shuffled = rng.sample(rows, len(rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_sum(spark.createDataFrame(shuffled, "part int, seq int, n int"), [], ["part", "seq"], F.col("n"), "end").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, {}
    for p, s, n in rows:
        total += n
        want[p, s] = (n, total)
    assert len(out) == len(rows) and {(r.part, r.seq): (r.n, r.end) for r in out} == want
