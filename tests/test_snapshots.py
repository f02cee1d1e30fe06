import datetime as dt
import random

import pytest

from tendersieve.operators import overview, snapshots as N
from tendersieve.plans.scope import TenderFilter

SCHEMA = "id long, published timestamp, amount double, body_id long, region string, segment string, status string, kind string"


def made(spark, n=400):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        when = None if i % 40 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 300))
        rows.append((i, when, rnd.choice([None, 10.25, 1e6]), rnd.choice([None, 5, 40_000, 3_000_000, rnd.randrange(60)]), rnd.choice(["N", "S", "", None]), rnd.choice(["A", "B"]), rnd.choice(["O", "F", None]), rnd.choice(["k1", "k2", None])))
    return spark.createDataFrame(rows, SCHEMA)


SCOPES = [
    TenderFilter(), TenderFilter(regions=("N",)), TenderFilter(regions=("N", "S"), statuses=("O",)), TenderFilter(kinds=("k1",)), TenderFilter(not_kinds=("k1",)), TenderFilter(since="2024-02-01"),
    TenderFilter(since="2024-02-01", until="2024-05-31", regions=("S",)), TenderFilter(until="2024-02-29"), TenderFilter(regions=("X",)), TenderFilter(since="2030-01-01"),
]


def test_parity_with_live_figures_for_every_scope(spark, tmp_path):
    rows = made(spark)
    N.write_snapshot(rows, str(tmp_path), "2025-01-01T04:00:00")
    for scope in SCOPES:
        got = N.kpis(rows, scope, str(tmp_path), "2025-01-01T05:00:00").first()
        assert not got["live"]
        assert tuple(got)[:4] == tuple(overview.kpis(scope.apply(rows)).first()), scope


@pytest.mark.parametrize("scope", [TenderFilter(since="2024-02-02"), TenderFilter(until="2024-02-28"), TenderFilter(least=5.0), TenderFilter(text="x"), TenderFilter(tags=("A",)), TenderFilter(since="2024-02-01 10:00:00")])
def test_what_the_cube_cannot_add_up(scope):
    assert not N.answers(scope)


def test_expiry_fallback_and_the_newest_wins(spark, tmp_path):
    rows, path = made(spark, 50), str(tmp_path)
    assert N.read_snapshot(spark, path, "2025-01-01T00:00:00", 60) is None
    assert N.kpis(rows, TenderFilter(), path, "2025-01-01T00:00:00").first()["live"]
    N.write_snapshot(rows.limit(0), path, "2025-01-01T00:00:00")
    assert tuple(N.kpis(rows, TenderFilter(), path, "2025-01-01T01:00:00").first()) == (0, None, None, 0, False)
    N.write_snapshot(rows, path, "2025-01-02T00:00:00")
    assert N.kpis(rows, TenderFilter(), path, "2025-01-02T01:00:00").first()["n"] == 50
    assert N.read_snapshot(spark, path, "2025-01-02T00:01:00", 60) is not None
    assert N.read_snapshot(spark, path, "2025-01-02T00:01:01", 60) is None


def test_another_set_of_dimensions(spark, tmp_path):
    rows, path = made(spark, 80), str(tmp_path)
    N.write_snapshot(rows, path, "2025-01-01T00:00:00", ("region",))
    assert not N.kpis(rows, TenderFilter(regions=("N",)), path, "2025-01-01T01:00:00").first()["live"]
    assert N.kpis(rows, TenderFilter(statuses=("O",)), path, "2025-01-01T01:00:00").first()["live"]


def test_a_cube_keeps_bodies_and_no_bitmap_for_each_few_of_them(spark, tmp_path):
    at = dt.datetime(2024, 1, 5)
    rows = [(i, at, 1.0, i * 50_000 % 400_000, "N", "A", "O", "1") for i in range(20)] + [(20, at, 1.0, None, "N", "A", "O", "1")]
    tenders = spark.createDataFrame(rows, "id long, published timestamp, amount double, body_id long, region string, segment string, status string, kind string")
    N.write_snapshot(tenders, str(tmp_path), "2024-02-01T00:00:00")
    found = N.read_snapshot(spark, str(tmp_path), "2024-02-01T01:00:00", 86400)
    assert sorted(r["body_id"] for r in found.bodies.collect()) == [k * 50_000 for k in range(8)]
    assert found.kpis(TenderFilter()).first()["bodies"] == 8
