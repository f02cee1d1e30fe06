"""Mixing sources to target weights by systematic sampling.

Word counts are summed a source; the budget is shared by weight, and what a capped source
cannot take is reshared among the others until none is above its cap. A document's expected
copies are target / size of its source. Within a source the documents are ordered by size and
id and their expected copies summed up; with one random offset a source, a document comes out
once for each whole number that its part of the running sum crosses. Ordered by size, the
words taken stay within about one long document of the target.

Sums are whole numbers (2**-24 copies), so their order doesn't matter and reruns agree. Offsets
come from a hash of the source and the seed.

Defined cases: null or empty texts have size 0 and may come out, as zero words; null is a source
of its own, after all others; repeated rows are documents of their own; with no words at all
nothing is taken; an empty table gives an empty result; extra columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, materialize, numbered
from .prefix import running_sum

WEIGHTS = (3.0, 1.0, 2.0)
UNIT = 1 << 24


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null has none."""
    white = "[\\x20\\x09-\\x0D]"
    n = F.size(F.split(text, f"{white}+")) - F.when(text.rlike(f"^{white}"), 1).otherwise(0) - F.when(text.rlike(f"{white}\\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(n, F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    A source is capped once its part by weight reaches its cap. Ordered by cap / weight the capped
    ones come first, so one running sum finds the water level: k sources are capped where the level
    of the rest, (budget - caps so far) / (weights left), first falls below the next one's ratio.
    The table has a row for each source, not for each document.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    i = F.row_number().over(turn) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    line = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    rows = rows.withColumn("caps", F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("caps")) / F.col("left")
    free = F.col("most") / F.col("weight") > level
    rows = rows.withColumn("level", F.min(F.when(free, F.struct(F.col("caps"), level.alias("level")))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset, in units below one copy: 24 bits of a digest of seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("long")


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: (uid, id, size, source, source_size, target, copies); uid numbers the rows."""
    return _copies(docs, F.monotonically_increasing_id(), id_col, text_col, source_col, weights, share, cap, seed)


def _copies(docs: DataFrame, uid: Column, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int) -> DataFrame:
    rows = docs.select(
        uid.alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
    )
    rows = materialize(rows, "words")  # the texts are read once
    # the expected copies are the same for all documents of a source: their running sum is place * rate
    ranked = running_sum(rows, ["source"], ["size", "id", "uid"], F.lit(1), "place")
    goal = targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    joined = ranked.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.coalesce(F.round(F.try_divide(F.col("target"), F.col("source_size")) * UNIT), F.lit(0)).cast("long")
    joined = joined.withColumn("rate", rate).withColumn("shift", offset(F.col("source"), seed))
    crossed = F.expr(f"(place * rate + shift) div {UNIT} - ((place - 1) * rate + shift) div {UNIT}")
    return joined.select("uid", "id", "size", "source", "source_size", F.col("target").cast("double").alias("target"), crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as systematic sampling takes it."""
    name = free_name(docs.columns, "uid")
    times = free_name([*docs.columns, name], "copies")
    rows = numbered(docs, name)
    taken = _copies(rows, F.col(name), id_col, text_col, source_col, weights, share, cap, seed).where("copies > 0")
    joined = rows.join(taken.select(F.col("uid").alias(name), F.col("copies").alias(times)), name)
    return joined.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
