"""Joins, set operations, windows, pages: the shapes that list and review screens need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col


def with_child_at_least(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, condition: Column) -> DataFrame:
    """Parents that have a child meeting the condition (EXISTS)."""
    return parents.join(children.where(condition).select(c(child_key).alias(parent_key)), parent_key, "left_semi")


def without_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without any child (NOT EXISTS; null keys stay)."""
    return parents.join(children.select(c(child_key).alias(parent_key)), parent_key, "left_anti")


def merged_sources(sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row a key with each source's value side by side and how many sources have it."""
    named = [df.select(key, c(value).alias(name)) for name, df in sources.items()]
    merged = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    return merged.withColumn("sources", sum((F.when(c(n).isNotNull(), 1).otherwise(0) for n in sources), F.lit(0)))


def latest_child(children: DataFrame, key: str, order: list[str], pick: list[str]) -> DataFrame:
    """The last child of each parent in ``order``: an aggregate, so no group is sorted in one task."""
    best = F.max_by(F.struct(*pick), F.struct(*order)).alias("x")
    return children.groupBy(key).agg(best).select(key, *[c(f"x.{p}").alias(p) for p in pick])


def predecessors(rows: DataFrame, keys: list[str], at: str, id_: str) -> DataFrame:
    """Each row's previous one of the same keys (as-of, strictly before in (at, id))."""
    w = Window.partitionBy(*keys).orderBy(at, id_)
    return rows.select(id_, *keys, F.lag(id_).over(w).alias("previous"), F.lag(at).over(w).alias("previous_at"))


def longest_prefix_rule(rows: DataFrame, rules: list[tuple[str, str]], value: str) -> DataFrame:
    """The label of the longest rule that the value starts with; the rules are literals, so nothing is joined."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    label = reduce(lambda acc, r: acc.when(c(value).startswith(r[0]), r[1]), ordered[1:], F.when(c(value).startswith(ordered[0][0]), ordered[0][1]))
    return rows.withColumn("rule", label)


def stratified_sample(rows: DataFrame, stratum: str, id_: str, quota: int, seed: str) -> DataFrame:
    """The ``quota`` rows of each stratum whose digest of id and seed is least."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(c(id_).cast("string"), F.lit(seed))), c(id_))
    return rows.withColumn("rn", F.row_number().over(w)).where(c("rn") <= quota)


def keyset_page(rows: DataFrame, sort: str, id_: str, after: tuple[object, int] | None, size: int, descending: bool = False) -> DataFrame:
    """The page behind a cursor, ``sort`` in either direction with nulls last, id (in the same direction) as tiebreak: a predicate and a top-k."""
    if after is not None:
        v, i = after
        later = c(id_) < i if descending else c(id_) > i
        beyond = (c(sort) < F.lit(v)) if descending else (c(sort) > F.lit(v))
        rows = rows.where((c(sort).isNull() & later) if v is None else beyond | ((c(sort) == F.lit(v)) & later) | c(sort).isNull())
    order = [c(sort).desc_nulls_last(), c(id_).desc()] if descending else [c(sort).asc_nulls_last(), c(id_).asc()]
    return rows.orderBy(*order).limit(size)


def offset_page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def _beside(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``per`` has for their keys, null keys alike; ``per`` is written first, so that rows of a hot key can be split."""
    own = {k: f"{k}__per" for k in keys}
    told = cut(per.withColumnsRenamed(own), "per")
    on = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(o)) for k, o in own.items()])
    return rows.join(told, on).drop(*own.values())


def canonical(rows: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """One row of each group of duplicates, by preference. Only the first is asked for: each task keeps one a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*prefer)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def current_version(rows: DataFrame, keys: list[str], newest: list[Column], value: str) -> DataFrame:
    """All rows with the newest version's value of their group."""
    first = canonical(rows, keys, newest).select(*keys, c(value).alias("current"))
    return _beside(rows, first, keys)


def exact_then_like(rows: DataFrame, id_: str, name: str, term: str, n: int) -> DataFrame:
    """The row of that id first, then rows whose name holds the term."""
    exact = rows.where(c(id_).cast("string") == term).select(id_, name, F.lit(1).alias("exact"))
    like = rows.where(F.contains(F.lower(name), F.lit(term.lower())) & (c(id_).cast("string") != term)).select(id_, name, F.lit(0).alias("exact"))
    return exact.unionByName(like).orderBy(F.desc("exact"), F.asc(id_)).limit(n)


def total_beside(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with the number of all: the total comes from an aggregate, not a window over everything."""
    return rows.orderBy(*order).limit(n).crossJoin(rows.agg(F.count("*").alias("total")))


def duplicates(rows: DataFrame, sure: list[str], maybe: list[str], id_: str) -> DataFrame:
    """(id, canonical, status, score): same ``sure`` keys confirm a duplicate of the least id, same ``maybe`` keys leave it pending."""
    first = rows
    for name, keys in (("by_sure", sure), ("by_maybe", maybe)):
        first = _beside(first, rows.groupBy(*keys).agg(F.min(id_).alias(name)), keys)
    confirmed = c("by_sure") < c(id_)
    found = first.where(confirmed | (c("by_maybe") < c(id_)))
    return found.select(id_, F.when(confirmed, c("by_sure")).otherwise(c("by_maybe")).alias("canonical"), F.when(confirmed, "confirmed").otherwise("pending").alias("status"), F.when(confirmed, 1.0).otherwise(0.8).alias("score"))
