"""Samples by stratum: quotas by the root of size with caps and largest remainder, and splits that stay when rows are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col
#: Roots are summed as decimals, so that sums don't depend on the order of rows.
_ROOT = "decimal(38,12)"


def allot(strata: DataFrame, total: int) -> DataFrame:
    """(stratum, quota) of (stratum, size): quotas that sum up to ``total``, or to all rows where there are fewer.

    A stratum gets its whole size if ``total`` is enough for all; one each for the largest if it is not more than the strata
    that have rows. Otherwise each gets one, and the rest goes by the root of size; who would get more than it has gets all it
    has, and what it leaves is shared anew until nobody does. Fractions go to the largest remainders, then to the larger
    stratum, then by name. Strata without rows get no line.
    """
    if total <= 0:
        raise ValueError(f"the total must be positive, not {total}")
    held = cut(strata.where("size > 0").select("stratum", c("size").cast("long").alias("size"), F.sqrt("size").cast(_ROOT).alias("root")), "strata")
    n, every = held.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if total >= every:
        return held.select("stratum", c("size").alias("quota"))
    if total <= n:
        return held.orderBy(F.desc("size"), "stratum").limit(total).select("stratum", F.lit(1).cast("long").alias("quota"))
    units, free, full = total - n, held, None
    while True:
        weight = free.agg(F.sum("root")).first()[0]
        share = c("root").cast("double") / float(weight or 1) * units
        over = cut(free.where(share > c("size") - 1).select("stratum", "size"), "full")
        some = over.agg(F.count("*"), F.coalesce(F.sum(c("size") - 1), F.lit(0))).first()
        if not some[0]:
            break
        full = over if full is None else full.unionByName(over)
        units -= some[1]
        free = cut(free.join(over.select("stratum"), "stratum", "left_anti"), "free")
        if units <= 0 or free.isEmpty():
            break
    out = free.select("stratum", "size", (share if units > 0 else F.lit(0.0)).alias("share")).select("stratum", "size", F.floor("share").cast("long").alias("whole"), (c("share") - F.floor("share")).alias("rest"))
    out = cut(out, "shares")
    left = max(0, units) - (out.agg(F.sum("whole")).first()[0] or 0)
    lucky = out.orderBy(F.desc(F.round("rest", 9)), F.desc("size"), "stratum").limit(max(0, left)).select("stratum", F.lit(1).alias("more"))
    quotas = out.join(lucky, "stratum", "left").select("stratum", (1 + c("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))
    return quotas if full is None else quotas.unionByName(full.select("stratum", c("size").alias("quota")))


def draw(rows: DataFrame, stratum: Column, id_: str, total: int) -> DataFrame:
    """``rows`` with ``stratum``: of each stratum its quota, those of least MD5 of the id; a null stratum takes no part."""
    named = rows.withColumn("stratum", stratum).where("stratum is not null")
    quotas = allot(named.groupBy("stratum").agg(F.count("*").alias("size")), total)
    most = quotas.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    # the literal bound lets Spark keep no more rows a task than any quota before it shuffles
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(c(id_).cast("string")), id_))
    placed = named.withColumn("place__", place).where(c("place__") <= int(most))
    return placed.join(quotas, "stratum").where(c("place__") <= c("quota")).drop("place__", "quota")


def split(id_: Column, given: Column | None = None, parts: tuple[str, str] = ("tune", "holdout")) -> Column:
    """Which half a row belongs to: the one given, else by the first byte of the id's SHA-256, so that new rows move no old one."""
    even = F.conv(F.substring(F.sha2(F.coalesce(id_.cast("string"), F.lit("")), 256), 1, 2), 16, 10).cast("int") % 2 == 0
    own = F.when(even, parts[0]).otherwise(parts[1])
    return own if given is None else F.when(given.isin(*parts), given).otherwise(own)
