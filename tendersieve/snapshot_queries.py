"""Registered queries of figures computed ahead."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersieve.operators.snapshots import kpis, write_snapshot
from tendersieve.plans.domain import tenders
from tendersieve.plans.scope import TenderFilter
from tendersieve.registry import query
from tendersieve.sources.files import scratch

#: Scope and the same as SQL; the last two are beyond the cube and come live.
SCOPES = {
    "all": (TenderFilter(), "true"),
    "asia": (TenderFilter(regions=("ASIA",)), "region = 'ASIA'"),
    "two regions, open": (TenderFilter(regions=("ASIA", "EUROPE"), statuses=("O",)), "region IN ('ASIA', 'EUROPE') AND status = 'O'"),
    "whole months": (TenderFilter(since="1995-02-01", until="1996-04-30"), "published >= '1995-02-01' AND published < '1996-05-01'"),
    "not low": (TenderFilter(not_kinds=("5-LOW",), until="1997-12-31"), "(kind IS NULL OR kind <> '5-LOW') AND published < '1998-01-01'"),
    "nowhere": (TenderFilter(regions=("MOON",)), "region = 'MOON'"),
    "part of a month": (TenderFilter(since="1995-02-10"), "published >= '1995-02-10'"),
    "by amount": (TenderFilter(least=100000.0), "amount >= 100000"),
}
_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS scope, {'true' if name in ('part of a month', 'by amount') else 'false'} AS live, count(*) AS n, round(sum(amount), 4) AS amount, round(avg(amount), 2) AS mean_amount, count(DISTINCT body_id) AS bodies FROM x WHERE {sql}"
    for name, (_, sql) in SCOPES.items()
)


@query("snapshot_figures", f"WITH x AS (SELECT * FROM @t) {_SQL}")
def _(s: SparkSession, d: str) -> DataFrame:
    """A cube is written, then read for each scope that it answers; the others are computed live."""
    rows = tenders(s, d, "id", "published", "amount", "body_id", "region", "segment", "status", "kind")
    path = f"{scratch(s)}/snapshots-{uuid.uuid4().hex}"
    write_snapshot(rows, path, "1998-06-01T04:00:00")
    found = [kpis(rows, scope, path, "1998-06-01T12:00:00").select(F.lit(name).alias("scope"), "live", "n", "amount", "mean_amount", "bodies") for name, (scope, _) in SCOPES.items()]
    return reduce(DataFrame.unionByName, found)
