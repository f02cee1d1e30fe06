"""Standing rules as a table: intervals joined by halving buckets, windows of each rule's own, what was told before left out.

``match_rules`` gives every pair, which grows with rules times tenders. What a rule tells (its newest rows) and its totals
come without them: rules that ask the same segment, region and prefix form a class. For its totals, tenders of a class lie in
buckets of days that any rule's interval is a few of; for the newest rows, tenders and rules are gone through in order of amount.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col
DAY_ZERO = 1 << 19
DAY_BITS = 20
#: Days between evaluations by frequency; rules of any other are daily. Fixed values.
EVERY = {"immediate": 0, "daily": 1, "weekly": 7}


def cover(low: Column, high: Column, bits: int) -> Column:
    """The fewest (level, node) halving buckets that make up the whole numbers from low to below high, both from 0 to 2 ** bits."""
    start = F.struct(low.cast("long").alias("l"), F.greatest(low, high).cast("long").alias("r"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(a: Column, level: Column) -> Column:
        open_ = a["l"] < a["r"]
        odd_l, odd_r = open_ & (a["l"] % 2 == 1), open_ & (a["r"] % 2 == 1)
        at = lambda node: F.array(F.struct(level.cast("int").alias("level"), node.alias("node")))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        l, r = a["l"] + odd_l.cast("long"), a["r"] - odd_r.cast("long")
        new = F.concat(a["out"], F.when(odd_l, at(a["l"])).otherwise(none), F.when(odd_r & (l <= r), at(r)).otherwise(none))
        return F.struct(F.shiftright(l, 1).alias("l"), F.shiftright(F.greatest(l, r), 1).alias("r"), new.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda a: a["out"])


def interval_join(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, bits: int) -> DataFrame:
    """Rows of ``points`` beside each row of ``intervals`` with low <= value < high; whole numbers from 0 to below 2 ** bits.

    An interval is cut into at most 2 * bits halving buckets and a point lies in one bucket a level, so the join is by equal keys and
    each pair meets once. Only levels that intervals use are made for points. Rows with a null among the three have no partner; columns of
    the two tables must differ.
    """
    # longs throughout: a bucket's number and a shifted value must be of one kind
    cuts = intervals.where(c(low).isNotNull() & c(high).isNotNull()).select("*", F.explode(cover(c(low), c(high), bits)).alias("bucket__")).select("*", c("bucket__.level").alias("level__"), c("bucket__.node").alias("node__")).drop("bucket__")
    levels = sorted(r[0] for r in cuts.select("level__").distinct().collect())  # at most one a bit
    if not levels:
        return points.limit(0).crossJoin(intervals.limit(0))
    every = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(c(value).cast("long"), n).alias("node")) for n in levels])
    spread = points.where(c(value).isNotNull()).select("*", F.explode(every).alias("bucket__")).select("*", c("bucket__.level").alias("level__"), c("bucket__.node").alias("node__")).drop("bucket__")
    return spread.join(cuts, ["level__", "node__"]).drop("level__", "node__")


def cover8(low: Column, high: Column, levels: int) -> Column:
    """(level, node) buckets of 8 ** level numbers that make up those from low to below high, at most 14 a level."""
    kind = "array<struct<level:int,node:bigint>>"
    start = F.struct(low.cast("long").alias("l"), F.greatest(low, high).cast("long").alias("r"), F.array().cast(kind).alias("out"))

    def step(a: Column, level: Column) -> Column:
        l, r = F.shiftleft(F.shiftright(a["l"] + 7, 3), 3), F.shiftleft(F.shiftright(a["r"], 3), 3)
        last = (l >= r) | (level == levels)
        nodes = lambda x, y: F.when(x < y, F.transform(F.sequence(x, y - 1), lambda n: F.struct(level.cast("int").alias("level"), n.alias("node")))).otherwise(F.array().cast(kind))
        new = F.when(last, nodes(a["l"], a["r"])).otherwise(F.concat(nodes(a["l"], l), nodes(r, a["r"])))
        at = lambda x: F.when(last, F.lit(0).cast("long")).otherwise(F.shiftright(x, 3))
        return F.struct(at(l).alias("l"), at(r).alias("r"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda a: a["out"])


def _classes(rules: DataFrame, tenders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``class__``: equal for rules that ask the same segment, region and prefix; a tender has a row for each class that it meets."""
    asks = ["segment", "region", "prefix"]
    kinds = cut(rules.select(*asks).distinct().withColumn("class__", F.monotonically_increasing_id()), "classes")
    lengths = [r[0] for r in kinds.where("prefix is not null").select(F.length("prefix")).distinct().collect()]
    null = F.lit(None).cast("string")
    options = {"segment": [c("segment")], "region": [c("region")], "prefix": [F.substring("code", 1, n) for n in lengths]}
    own = tenders
    for k, found in options.items():
        own = own.withColumn(f"{k}__", F.explode(F.array_distinct(F.array(null, *found))))
    fits = reduce(lambda a, b: a & b, [c(f"{k}__").eqNullSafe(c(f"{k}__k")) for k in asks])
    met = own.join(kinds.select("class__", *[c(k).alias(f"{k}__k") for k in asks]), fits).select("class__", *tenders.columns)
    known = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"{k}__k")) for k in asks])
    return rules.join(kinds.select("class__", *[c(k).alias(f"{k}__k") for k in asks]), known).select("class__", *rules.columns), met


def rule_totals(rules: DataFrame, tenders: DataFrame) -> DataFrame:
    """(rule_id, n, amount, newest): number, sum of amounts and greatest id of what ``match_rules`` gives for each rule that has any.

    In each bucket of days tenders and rules are put in order of amount, so a rule finds the totals of what comes before it.
    """
    rules = cut(rules.withColumn("row__", F.monotonically_increasing_id()), "rules")
    dated = tenders.where("published is not null").withColumn("day__", day(c("published")).cast("long"))
    ends = dated.agg(F.min("day__"), F.max("day__")).first()
    if ends[0] is None:
        return rules.limit(0).select("rule_id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("amount"), F.lit(0).cast(tenders.schema["id"].dataType).alias("newest"))
    levels = max(1, math.ceil(math.log(ends[1] - ends[0] + 2, 8)))
    asking, met = _classes(rules, dated.withColumn("day__", c("day__") - ends[0]).select("id", "segment", "region", "code", "amount", "day__").repartition("id"))
    first = F.greatest(F.coalesce(day(c("since")) - ends[0], F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(day(c("until")) - ends[0], F.lit(ends[1] - ends[0] + 1)), F.lit(ends[1] - ends[0] + 1))
    asking = cut(asking.select("class__", "row__", c("least").alias("amount"), F.explode(cover8(first, last, levels)).alias("b")).select("class__", c("b.level").alias("level"), c("b.node").alias("node"), "row__", "amount"), "asking")
    used = sorted(r[0] for r in asking.select("level").distinct().collect())
    # rules without a least amount come last, after tenders without an amount
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("day__", 3 * k).alias("node")) for k in used] or [F.lit(None).cast("struct<level:int,node:bigint>")]))
    lying = met.select("class__", at.alias("b"), "id", "amount").select("class__", c("b.level").alias("level"), c("b.node").alias("node"), F.lit(None).cast("long").alias("row__"), "amount", "id", c("amount").isNull().cast("int").alias("turn"))
    both = lying.unionByName(asking.withColumn("id", F.lit(None).cast(tenders.schema["id"].dataType)).withColumn("turn", F.when(c("amount").isNull(), 2).otherwise(0)))
    before = Window.partitionBy("class__", "level", "node").orderBy("turn", F.desc("amount"), c("row__").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    tender = c("row__").isNull()
    told = both.select("row__", F.count(F.when(tender, 1)).over(before).alias("n"), F.sum(F.when(tender, c("amount"))).over(before).alias("amount"), F.max("id").over(before).alias("newest")).where("row__ is not null and n > 0")
    whole = told.groupBy("row__").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.max("newest").alias("newest"))
    return whole.join(rules.select("row__", "rule_id"), "row__").groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.max("newest").alias("newest"))


#: Tenders and rules of a part of the sweep, in the mean; and cells of amounts by which tenders that no rule comes to are told.
BETWEEN, CELLS = 1 << 15, 64


def _before(most: int):
    """Of a class's newest tenders by place, and rows without a tender for other places: for each place the ``most`` newest of all places before it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        places = rows["place"].to_numpy()
        state, out = rows.slice(0, 0), [rows.slice(0, 0)]
        for place in np.unique(places).tolist():
            out.append(state.set_column(rows.schema.get_field_index("place"), rows.schema.field("place"), pa.repeat(pa.scalar(place, rows.schema.field("place").type), len(state))))
            lo, hi = np.searchsorted(places, [place, place + 1])
            state = pa.concat_tables([state, rows.slice(lo, hi - lo)])
            state = state.filter(state["published"].is_valid())
            state = state.take(pa.compute.sort_indices(state, [("published", "descending"), ("id", "ascending")], null_placement="at_start")[:most])
        return pa.concat_tables(out)

    return run


def _carried(rows: DataFrame, most: int, places: DataFrame | None = None) -> DataFrame:
    """(class__, place, id, published, day__): for each place of ``rows`` or ``places`` the newest tenders of its class at earlier places of ``rows``."""
    newest = Window.partitionBy("class__", "place").orderBy(F.desc("published"), "id")
    heads = rows.select("class__", "place", "id", "published", "day__").withColumn("nth", F.row_number().over(newest)).where(c("nth") <= most).drop("nth")
    if places is not None:
        heads = heads.unionByName(places.select("class__", "place").distinct(), allowMissingColumns=True)
    return heads.groupBy("class__").applyInArrow(_before(most), heads.schema)


def _sweep(limit: int, most: int):
    """Of parts in order of amount: the newest tenders so far are kept, and each rule takes those that it was not told of from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        newest: list[tuple] = []  # (-published, whether there is an id, id, -day)
        ids: list = []
        days: list[int] | None = None
        for batch in batches:
            turn, part, kind = (batch.column(k).to_numpy() for k in ("turn", "part", "class__"))
            # null where the row is a rule
            published = batch.column("published").cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy()
            day_ = batch.column("day__").to_numpy()
            new = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(turn)], strict=True):
                if at != (at := (part[lo], kind[lo])):
                    newest, days = [], None
                rows = np.arange(lo, hi)
                if len(newest) == most:  # all but what is as new as the last of them
                    rows = rows[(turn[lo:hi] == RULE) | (published[lo:hi] >= -newest[-1][0])]
                own, known = batch.column("id").take(pa.array(rows)).to_pylist(), batch.column("known__").take(pa.array(rows)).to_pylist()
                who: list[int] = []
                counts: list[int] = []
                found: list = []
                ages: list[int] = []
                for k, r in enumerate(rows.tolist()):
                    if turn[r] != RULE:
                        x = (-int(published[r]), own[k] is not None, own[k], -int(day_[r]))
                        if len(newest) < most or x < newest[-1]:
                            insort(newest, x)
                            del newest[most:]
                            days = None
                        continue
                    if days is None:
                        ids, days = [x[2] for x in newest], [x[3] for x in newest]
                    n = bisect_right(days, -int(day_[r]))
                    if known[k]:
                        seen = set(known[k])
                        told = [i for i in range(n) if ids[i] not in seen][:limit]
                        found += [ids[i] for i in told]
                        ages += [newest[i][0] for i in told]
                        n = len(told)
                    else:
                        n = min(n, limit)
                        found += ids[:n]
                        ages += [x[0] for x in newest[:n]]
                    who.append(r)
                    counts.append(n)
                    if len(found) >= 1 << 16:
                        yield _told(batch, who, counts, found, ages)
                        who, counts, found, ages = [], [], [], []
                if found:
                    yield _told(batch, who, counts, found, ages)

    return run


def _told(batch: pa.RecordBatch, who: list[int], counts: list[int], found: list, ages: list[int]) -> pa.RecordBatch:
    n = np.array(counts, np.int64)
    place = np.arange(1, len(found) + 1) - np.repeat(np.cumsum(n) - n, n)
    columns = [batch.column("rule_id").take(pa.array(np.repeat(np.array(who, np.int64), n))), pa.array(found, batch.schema.field("id").type), pa.array(place.astype(np.int32)), pa.array(ages, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["rule_id", "id", "place", "age"])


#: Order at equal amounts: what comes from parts before, tenders, rules.
CARRIED, TENDER, RULE = 0, 1, 2


def _newest(rules: DataFrame, tenders: DataFrame, told: DataFrame, limit: int) -> DataFrame:
    """(rule_id, id, place, age): for each row of ``rules`` its newest ``limit`` tenders that it was not told of; a greater age is an older one.

    Tenders and rules of a class are put in order of amount, the greatest first, so a rule's tenders are those before it, and as the newest
    of them come first, no more of them are kept on the way than any rule takes and was told of. The order is cut into parts by number of
    rows; each begins with what the parts before it would have kept. Tenders of a cell of amounts that are older than so many
    of the cells above, which every rule that comes to them takes first, are left out before.
    """
    rules = rules.withColumn("low__", day(c("since"))).where("low__ is not null")
    least = rules.agg(F.min("low__")).first()[0]
    fresh = tenders.where("published is not null").withColumn("day__", day(c("published"))).where(c("day__") >= F.lit(least))
    fresh = cut(fresh.select("id", "published", "segment", "region", "code", (c("amount") + F.lit(0.0)).alias("amount"), "day__"), "fresh")  # no -0.0
    known = told.select("rule_id", "id").join(fresh.select("id"), "id", "left_semi").groupBy("rule_id").agg(F.collect_set("id").alias("known__"))
    rules = cut(rules.join(known, "rule_id", "left").select("rule_id", "segment", "region", "prefix", "low__", (c("least") + F.lit(0.0)).alias("least"), "known__"), "rules")
    most = limit + (rules.agg(F.max(F.size("known__"))).first()[0] or 0)
    most = max(most, limit)  # the size of null may be -1
    bounds = np.unique(fresh.where("amount is not null and not isnan(amount)").approxQuantile("amount", [i / CELLS for i in range(1, CELLS)], 0.25 / CELLS))

    def place(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        # the greatest first, NaN above all, null last
        return pd.Series(np.where(np.isnan(x), 0, 1 + len(bounds) - np.searchsorted(bounds, x, "right")))

    cell = F.when(c("amount").isNull(), len(bounds) + 2).otherwise(F.pandas_udf(place, "long")(F.coalesce("amount", F.lit(0.0))))
    asking, met = _classes(rules, fresh)
    met = met.select("class__", "id", "published", "day__", "amount", cell.alias("place"))
    above = _carried(met, most).groupBy("class__", "place").agg(F.count("*").alias("n__"), F.min("published").alias("oldest__")).where(c("n__") >= most)
    met = met.join(F.broadcast(cut(above, "above")), ["class__", "place"], "left").where("oldest__ is null or published >= oldest__")

    ids, dates, whose = (tenders.schema["id"].dataType, tenders.schema["published"].dataType, rules.schema["rule_id"].dataType)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    listed = rules.schema["known__"].dataType
    kept = cut(met.select("class__", F.lit(TENDER).alias("turn"), "amount", "id", "published", "day__", none(whose, "rule_id"), none(listed, "known__")), "kept")
    both = kept.unionByName(asking.select("class__", F.lit(RULE).alias("turn"), c("least").alias("amount"), none(ids, "id"), none(dates, "published"), c("low__").alias("day__"), "rule_id", "known__"))
    several = max(1, (kept.count() + rules.count()) // BETWEEN)
    laid = both.repartitionByRange(several, "class__", F.desc_nulls_last("amount"), "turn", F.xxhash64("id", "rule_id")).withColumn("part", F.spark_partition_id())
    laid = cut(laid, "laid")
    placed = laid.withColumnRenamed("part", "place")
    carried = _carried(placed.where(c("turn") == TENDER), most, placed).withColumnRenamed("place", "part")
    carried = carried.select("class__", F.lit(CARRIED).alias("turn"), none("double", "amount"), "id", "published", "day__", none(whose, "rule_id"), none(listed, "known__"), "part")
    dealt = laid.unionByName(carried).repartition(several, "part")
    dealt = dealt.sortWithinPartitions("part", "class__", c("turn") != CARRIED, F.desc_nulls_last("amount"), "turn")
    return dealt.mapInArrow(_sweep(limit, most), f"rule_id {whose.simpleString()}, id {ids.simpleString()}, place int, age long")


def day(x: Column) -> Column:
    return F.datediff(x, F.lit("1970-01-01").cast("date")) + DAY_ZERO


def match_rules(rules: DataFrame, tenders: DataFrame) -> DataFrame:
    """(rule_id, and the tender's columns) of each tender inside a rule's window that meets the rule's conditions.

    ``rules``: (rule_id, since, until, and of segment, region, prefix, least what a rule may ask; null asks nothing); the window takes
    the day ``since`` and ends before ``until``; a null end is open. ``tenders``: (id, published, segment, region, code, amount).
    """
    first, last = F.lit(0), F.lit((1 << DAY_BITS) - 1)
    own = rules.select(
        "rule_id", F.coalesce(day(c("since")), first).alias("low__"), F.coalesce(day(c("until")), last).alias("high__"),
        c("segment").alias("want_segment"), c("region").alias("want_region"), c("prefix").alias("want_prefix"), c("least").alias("want_least"),
    )
    met = interval_join(tenders.withColumn("day__", day(c("published"))), "day__", own, "low__", "high__", DAY_BITS)
    wants = [
        c("want_segment").isNull() | (c("want_segment") == c("segment")), c("want_region").isNull() | (c("want_region") == c("region")),
        c("want_prefix").isNull() | F.startswith("code", "want_prefix"), c("want_least").isNull() | (c("amount") >= c("want_least")),
    ]
    return met.where(reduce(lambda a, b: a & b, wants)).select("rule_id", *tenders.columns)


def evaluate_rules(rules: DataFrame, tenders: DataFrame, told: DataFrame, now: str, lookback: int = 30, grace: int = 2, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """((rule_id, id, place) of what to tell, (rule_id, last) of every rule that was looked at).

    ``rules`` are those of ``match_rules`` with (frequency, last). A rule is due when it was never told or its frequency's days
    have passed at ``now``. Its window begins ``grace`` days before the last time, as rows may come in late, or ``lookback`` days
    before now. What ``told`` (rule_id, id) holds is left out before the newest ``limit`` rows of a rule are
    taken, so that the next turn goes on with the rest; ties go by id.
    """
    at = F.lit(now).cast("timestamp")
    days = F.coalesce(*[F.when(c("frequency") == k, v) for k, v in EVERY.items()], F.lit(1))
    due = rules.where(c("last").isNull() | (F.unix_timestamp(at) - F.unix_timestamp("last") >= days * 86400))
    since = F.coalesce(F.date_sub(F.to_date("last"), grace), F.date_sub(F.to_date(at), lookback))
    windows = due.drop("since", "until").select("*", since.alias("since"), F.lit(None).cast("date").alias("until"))
    windows = cut(windows.withColumn("rows__", F.count("*").over(Window.partitionBy("rule_id"))), "windows")
    tell = _newest(windows.where("rows__ = 1"), tenders, told, limit).select("rule_id", "id", "place")
    several = windows.where("rows__ > 1")
    if not several.isEmpty():  # rows of one rule_id are told of as one rule
        place = F.row_number().over(Window.partitionBy("rule_id").orderBy("age", "id"))
        tell = tell.unionByName(_newest(several, tenders, told, limit).withColumn("place", place).where(c("place") <= limit).select("rule_id", "id", "place"))
    return tell, due.select("rule_id", at.alias("last"))
