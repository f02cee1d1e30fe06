"""Figures computed ahead: a rolled-up cube with mergeable counts, kept until it expires, with the live figures as fallback.

The cube has a row for each month and combination of dimensions, so any scope that names values of dimensions and whole months
is a sum of its rows. Different bodies are counted exactly, from the bodies of each of its rows. A snapshot is a folder of its own; it
counts once its line in the journal is written, which is last, so a reader never meets half a snapshot.
"""

from __future__ import annotations

import calendar
import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersieve.operators import overview
from tendersieve.plans.scope import TenderFilter

c = F.col
DIMENSIONS = ("region", "segment", "status", "kind")
_JOURNAL = "folder string, computed_at timestamp, dimensions string"


def _cube(tenders: DataFrame, dimensions: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    keyed = tenders.withColumn("month", F.trunc("published", "month"))
    figures = keyed.groupBy("month", *dimensions).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.count("amount").alias("with_amount"))
    # a row for each body: bitmaps of 4 KB each would hold a few bodies of a month and combination only
    bodies = keyed.where(c("body_id").isNotNull()).select("month", *dimensions, "body_id").distinct()
    return figures, bodies


def write_snapshot(tenders: DataFrame, path: str, computed_at: str, dimensions: tuple[str, ...] = DIMENSIONS) -> str:
    """Compute the cube of ``tenders`` (published, amount, body_id and the dimensions) and enter it in the journal under ``path``.

    Null values of a dimension, and tenders without a date, are kept as rows of their own. Returns the snapshot's folder.
    """
    spark = tenders.sparkSession
    folder = f"{path}/snapshot-{uuid.uuid4().hex}"
    for name, part in zip(("figures", "bodies"), _cube(tenders, dimensions)):
        part.write.parquet(f"{folder}/{name}")
    line = spark.createDataFrame([(folder, dt.datetime.fromisoformat(computed_at), ",".join(dimensions))], _JOURNAL)
    line.coalesce(1).write.mode("append").parquet(f"{path}/journal")
    return folder


def _months(scope: TenderFilter) -> tuple[dt.date | None, dt.date | None] | None:
    """The first days of the first month and of the one after the last, or None where the scope cuts a month."""
    since = dt.date.fromisoformat(scope.since[:10]) if scope.since else None
    until = dt.date.fromisoformat(scope.until[:10]) if scope.until else None
    if since and (since.day != 1 or len(scope.since) > 10) or until and (len(scope.until) > 10 or until.day != calendar.monthrange(until.year, until.month)[1]):
        return None
    return since, until + dt.timedelta(days=1) if until else None


_FIELDS = {"region": "regions", "status": "statuses", "kind": "kinds", "segment": None}


def answers(scope: TenderFilter, dimensions: tuple[str, ...] = DIMENSIONS) -> bool:
    """Whether the cube's rows add up to the scope: values of its dimensions and whole months, nothing else."""
    known = {"since", "until", *(_FIELDS[x] for x in dimensions if _FIELDS.get(x))}
    if "kind" in dimensions:
        known.add("not_kinds")
    empty = TenderFilter()
    return _months(scope) is not None and all(getattr(scope, f) == getattr(empty, f) for f in scope.__dataclass_fields__ if f not in known)


@dataclass
class Snapshot:
    figures: DataFrame
    bodies: DataFrame
    computed_at: dt.datetime
    dimensions: tuple[str, ...]

    def kpis(self, scope: TenderFilter) -> DataFrame:
        """The row of ``overview.kpis`` for a scope that ``answers`` allows."""
        since, until = _months(scope)
        only = TenderFilter(regions=scope.regions, statuses=scope.statuses, kinds=scope.kinds, not_kinds=scope.not_kinds)

        def inside(rows: DataFrame) -> DataFrame:
            rows = only.apply(rows)
            rows = rows.where(c("month") >= F.lit(since)) if since else rows
            return rows.where(c("month") < F.lit(until)) if until else rows

        sums = inside(self.figures).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), overview.cents(c("amount")).alias("amount"), F.sum("with_amount").alias("k"))
        merged = inside(self.bodies).agg(F.countDistinct("body_id").alias("bodies"))
        return sums.crossJoin(merged).select("n", "amount", F.round(F.try_divide("amount", "k"), 2).alias("mean_amount"), "bodies")  # one row each


def read_snapshot(spark: SparkSession, path: str, now: str, max_age: int) -> Snapshot | None:
    """The newest snapshot in the journal, or None if there is none or it is more than ``max_age`` seconds old."""
    try:
        journal = spark.read.schema(_JOURNAL).parquet(f"{path}/journal")
    except AnalysisException:
        return None
    last = journal.orderBy(F.desc("computed_at"), F.desc("folder")).limit(1).collect()
    if not last or (dt.datetime.fromisoformat(now) - last[0]["computed_at"]).total_seconds() > max_age:
        return None
    figures, bodies = (spark.read.parquet(f"{last[0]['folder']}/{x}") for x in ("figures", "bodies"))
    return Snapshot(figures, bodies, last[0]["computed_at"], tuple(last[0]["dimensions"].split(",")))


def kpis(tenders: DataFrame, scope: TenderFilter, path: str, now: str, max_age: int = 26 * 3600) -> DataFrame:
    """The figures of a scope, and whether they are ``live``: from a snapshot that is young enough and answers the scope, else live."""
    found = read_snapshot(tenders.sparkSession, path, now, max_age)
    if found and answers(scope, found.dimensions):
        return found.kpis(scope).withColumn("live", F.lit(False))
    return overview.kpis(scope.apply(tenders)).withColumn("live", F.lit(True))
