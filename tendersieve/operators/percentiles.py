"""Exact percentiles without a task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col
ACCURACY = 10_000
#: Values of a group that one task may hold.
WHOLE = 1 << 21


def percentiles(rows: DataFrame, keys: list[str], value: str | Column, shares: list[float], accuracy: int = ACCURACY, whole: int = WHOLE, most: int | None = None) -> DataFrame:
    """(keys, n, p): the numbers of values and their percentiles as ``percentile`` interpolates them, one row a group.

    Rows, then groups, are counted first (``most``: a bound on rows that the caller knows). Where no group has more than
    ``whole`` values, a task gathers a group's. Beyond, a mergeable sketch
    bounds each percentile between two values that few values lie between, and another pass counts what lies below
    and the different values between; groups of at most 4 * ``accuracy`` values need no bounds. ``rows`` are read in each
    pass: write them first where they are dear. Nulls are no values, and a group
    of nulls only has none: 0 and null; null keys are a group; without keys an empty table gives 0 and null.
    """
    v = (c(value) if isinstance(value, str) else value).cast("double")
    own = rows.select(*keys, v.alias("v__"))
    most = rows.count() if most is None else most
    if most > whole:
        most = own.groupBy(*keys).agg(F.count("v__").alias("n__")).agg(F.max("n__")).first()[0] or 0
    if most <= whole:
        return own.groupBy(*keys).agg(F.count("v__").alias("n"), F.percentile("v__", F.array(*[F.lit(float(q)) for q in shares])).alias("p"))
    margin = 2 / accuracy
    ends = [[min(1.0, max(0.0, q + sign * margin)) for q in shares] for sign in (-1, 1)]
    told = own.groupBy(*keys).agg(F.count("v__").alias("n"), *[F.percentile_approx("v__", x, accuracy).alias(f"{name}__") for name, x in zip(("low", "high"), ends)])
    # written, so that Spark knows how small it is and doesn't deal a group's rows to one task to meet its bounds
    told = cut(told, "told")
    few = c("n") <= 4 * accuracy
    inf = F.lit(float("inf"))
    bounds = told.select(*[c(k).alias(f"{k}__b") for k in keys], *[F.array(*[F.when(few, e).otherwise(c(f"{name}__")[i]) for i in range(len(shares))]).alias(f"{name}__") for name, e in (("low", -inf), ("high", inf))])
    on = F.lit(True)
    for k in keys:
        on = on & c(k).eqNullSafe(c(f"{k}__b"))
    met = own.where("v__ is not null").join(bounds, on) if keys else own.where("v__ is not null").crossJoin(bounds)  # one row of bounds
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c("low__")[i].alias("low"), c("high__")[i].alias("high")) for i in range(len(shares))]))
    spread = met.select(*keys, "v__", each.alias("x__")).where(c("v__") <= c("x__.high"))
    # what lies below a bound counts as one value, null, that comes first
    counts = spread.groupBy(*keys, c("x__.i").alias("i__"), F.when(c("v__") >= c("x__.low"), c("v__")).alias("value__")).agg(F.count("*").alias("k__"))
    up = Window.partitionBy(*keys, "i__").orderBy(c("value__").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("to__", F.sum("k__").over(up))
    total = told.select(*[c(k).alias(f"{k}__b") for k in keys], c("n").alias("n__"))
    placed = placed.join(total, on) if keys else placed.crossJoin(total)
    placed = placed.withColumn("at__", F.element_at(F.array(*[F.lit(float(q)) for q in shares]), c("i__") + 1) * (c("n__") - 1))
    here = lambda x: F.max(F.when((x < c("to__")) & (x >= c("to__") - c("k__")), c("value__")))
    at = c("at__")
    found = placed.groupBy(*keys, "i__", "at__").agg(here(F.floor(at)).alias("a__"), here(F.ceil(at)).alias("b__"))
    mixed = F.when(F.floor(at) == F.ceil(at), c("a__")).otherwise((F.ceil(at) - at) * c("a__") + (at - F.floor(at)) * c("b__"))
    listed = F.array_sort(F.collect_list(F.struct(c("i__"), mixed.alias("p"))))
    wide = found.groupBy(*[c(k).alias(f"{k}__b") for k in keys]).agg(F.transform(listed, lambda x: x["p"]).alias("p"))
    if not keys:
        return told.select("n").join(wide.where(F.size("p") > 0), F.lit(True), "left")
    return told.select(*keys, "n").join(wide, on, "left").select(*keys, "n", "p")
