"""Sharding by a k-d tree over metadata, split at distributed weighted medians.

Equal texts form one point (they stay together): its weight is their bytes, its coordinates are
metadata (by default language, source, size and id; of the first of the group in id order). All
leaves are split at a level at once: the widest dimension of each (its range against the whole
table's), cut where half of the leaf's weight lies below. A cut is searched by halving ranges with
histograms of ``BINS`` bins a leaf, which the driver reads (leaves x BINS rows, whatever the input);
points of equal value at the cut are told apart by a hash, so that ties don't spoil the balance.
The point at a cut goes to the side that leaves the lesser error, and never leaves a side empty.
With ``shards``, a point as heavy as an even share of what is left gets a shard of its own first, and
the sides of a cut hold shards in proportion to their weight.
Splitting goes on until ``shards`` leaves are reached, or, with ``target_bytes``, until every leaf
has at most so many or is one point.

Defined cases: null is the empty text (size 1: every row counts its bytes plus 1); null metadata
lie below all other values; an empty table gives an empty result, a table with fewer texts than
shards leaves shards empty; rows of equal text and id are numbered in the order they are read;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, text_key
from .prefix import running_sum

BINS = 4096
#: A cut is close enough when the bin it falls in has at most this share of a shard's bytes.
CLOSE = 1e-4


def as_number(column: Column, kind: str) -> Column:
    """A whole number that orders like the value: itself, or the first seven bytes of a string. Null is -1."""
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 7)), 14, "0")
        number = F.conv(head, 16, 10).cast("long")
    else:
        number = column.cast("long")
    return F.coalesce(number, F.lit(-1).cast("long"))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _search(points: DataFrame, key: str, goals: dict[int, float], close: dict[int, float]) -> dict[int, tuple[int, int, int, int]]:
    """For each leaf the range of ``key`` at which the weight from below reaches ``goal``: (first, last, weight below it, its weight).

    Ranges shrink to one bin a round, until they are one value or weigh at most ``close``.
    """
    spark = points.sparkSession
    ends = points.where(F.col("leaf").isin(list(goals))).groupBy("leaf").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    span = {r["leaf"]: (r["lo"], r["hi"], 0) for r in ends}  # low, high, weight below low
    done: dict[int, tuple[int, int, int, int]] = {}
    while span:
        step = {k: max(1, -(-(hi - lo + 1) // BINS)) for k, (lo, hi, _) in span.items()}
        bounds = _small(spark, [(k, lo, hi, step[k]) for k, (lo, hi, _) in span.items()], "leaf int, lo long, hi long, step long")
        inside = points.join(bounds, "leaf").where(F.col(key).between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy("leaf", F.expr(f"cast(({key} - lo) div step as int)").alias("bin")).agg(F.sum("weight").alias("w")).collect()
        by: dict[int, dict[int, int]] = {}
        for r in bins:
            by.setdefault(r["leaf"], {})[r["bin"]] = r["w"]
        left = {}
        for k, (lo, hi, below) in span.items():
            for b in sorted(by.get(k, {})):
                if below + by[k][b] >= goals[k]:
                    break
                below += by[k][b]
            at = lo + b * step[k]
            last = min(hi, at + step[k] - 1)
            if step[k] == 1 or by[k][b] <= close[k]:
                done[k] = (at, last, below, by[k][b])
            else:
                left[k] = (at, last, below)
        span = left
    return done


def _alone(points: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(k1, k2) of the points that weigh as much as what the lighter ones leave for a shard: each fills one."""
    total, out = points.agg(F.sum("weight").alias("w")).first()["w"], []
    for r in points.orderBy(F.desc("weight"), "k1", "k2").select("k1", "k2", "weight").limit(shards).collect():
        if r["weight"] * (shards - len(out)) < total:
            break
        out.append((r["k1"], r["k2"]))
        total -= r["weight"]
    return out


def split(points: DataFrame, dims: list[str], shards: int | None, target_bytes: int | None) -> DataFrame:
    """``points`` (k1, k2, weight, h and the dims) with ``leaf``."""
    points = points.withColumn("leaf", F.lit(0))
    whole = points.agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    if not whole["w"]:
        return points
    alone = _alone(points, shards) if shards else []
    if alone:
        own = _small(points.sparkSession, [(k1, k2, i) for i, (k1, k2) in enumerate(alone)], "k1 long, k2 long, own int")
        points = materialize(points.join(own, ["k1", "k2"], "left").withColumn("leaf", F.coalesce("own", F.lit(len(alone)))).drop("own"), "leaves")
        if whole["n"] == len(alone):
            return points
    # leaf -> how many shards it still holds (or None: split while too heavy)
    open_: dict[int, int | None] = {len(alone): shards - len(alone) if shards else None}
    parted: list[tuple[int, int, int]] = []  # (old leaf, new leaf, shards of both)
    number = len(alone) + 1
    while True:
        stats = points.where(F.col("leaf").isin(list(open_))).groupBy("leaf").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()
        of = {r["leaf"]: r for r in stats}
        # shards go by the weight that a side really got, at most one a point
        for k, new, held in parted:
            a, b = of[k], of[new]
            share = round(held * a["w"] / (a["w"] + b["w"]))
            open_[k] = min(max(share, 1, held - b["n"]), held - 1, a["n"])
            open_[new] = held - open_[k]
        cut: dict[int, tuple[str, float, int]] = {}
        for r in stats:
            held = open_[r["leaf"]]
            if r["n"] > 1 and (held > 1 if held else r["w"] > target_bytes):
                width = {d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in dims}
                half = (held // 2) / held if held else 0.5
                cut[r["leaf"]] = (max(dims, key=lambda d: (width[d], d)), half * r["w"], r["w"])
        if not cut:
            break
        close = {k: CLOSE * w / (open_[k] or max(1, w // target_bytes)) for k, (_, _, w) in cut.items()}
        spark = points.sparkSession
        axis = _small(spark, [(k, d) for k, (d, _, _) in cut.items()], "leaf int, axis string")
        value = F.coalesce(*[F.when(F.col("axis") == d, F.col(d)) for d in dims])
        keyed = points.join(axis, "leaf").select("leaf", "weight", "h", value.alias("v"))
        found = _search(keyed, "v", {k: goal for k, (_, goal, _) in cut.items()}, close)
        ties = keyed.join(_small(spark, [(k, at, last) for k, (at, last, _, _) in found.items()], "leaf int, at long, last long"), "leaf").where("v between at and last").select("leaf", "weight", "h")
        tied = _search(ties, "h", {k: cut[k][1] - below for k, (_, _, below, _) in found.items()}, close)
        rows, then, parted = [], {}, []
        for k, (d, goal, weight) in cut.items():
            at, last, below, _ = found[k]
            tie, tie_last, tie_below, tie_weight = tied[k]
            # the point at the cut goes where the error is less, but never leaves a side empty
            without, with_ = below + tie_below, below + tie_below + tie_weight
            sides = [(abs(w - goal), w, h) for w, h in ((without, tie - 1), (with_, tie_last)) if 0 < w < weight]
            if not sides:  # points of one hash
                continue
            new, number = number, number + 1
            rows.append((k, d, at, last, min(sides)[2], new))
            then[k] = then[new] = None
            if open_[k]:
                parted.append((k, new, open_[k]))
        if not rows:
            break
        moves = _small(spark, rows, "leaf int, axis string, at long, last long, tie long, new int")
        beyond = (value > F.col("last")) | ((value >= F.col("at")) & (F.col("h") > F.col("tie")))
        points = points.join(moves, "leaf", "left").withColumn("leaf", F.when(beyond, F.col("new")).otherwise(F.col("leaf"))).drop("axis", "at", "last", "tie", "new")
        points = materialize(points, "leaves")
        open_ = then
    return points


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, size, text_crc32, shard, slot); give ``shards`` or ``target_bytes``.

    Metadata columns of ``by`` that ``docs`` lacks are left out. Slots number a shard's rows from 0 by id.
    """
    by = tuple(c for c in by if c in docs.columns)
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *text_key(text),
        *[as_number(F.col(f"`{c}`"), kinds[c]).alias(f"d{i}") for i, c in enumerate(by)],
    )
    rows = materialize(rows, "sizes")
    first = F.min(F.struct(F.coalesce(F.col("id").cast("long"), F.lit(-1).cast("long")).alias("d_id"), *[f"d{i}" for i in range(len(by))], F.col("size").alias("d_size"))).alias("m")
    points = rows.groupBy("k1", "k2").agg(F.sum("size").alias("weight"), first).select("k1", "k2", "weight", "m.*", F.shiftrightunsigned("k1", 1).alias("h"))
    leaves = split(materialize(points, "points"), ["d_id", *[f"d{i}" for i in range(len(by))], "d_size"], shards, target_bytes)
    placed = rows.select("uid", "id", "size", "text_crc32", "k1", "k2").join(leaves.select("k1", "k2", F.col("leaf").alias("shard")), ["k1", "k2"]).drop("k1", "k2")
    numbered = running_sum(placed, ["shard"], ["id", "uid"], F.lit(1), "slot")
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
