import datetime as dt
import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tendersieve.operators import procurement as P


def test_appeals_of_any_year(spark):
    rows = [(i, "1", 200_000.0, dt.datetime(year, 5, 5), "ES30", "DOC_CN") for i, year in enumerate((1989, 2024, 2130))] + [(9, "1", 5.0, dt.datetime(1850, 1, 1), "ES30", "DOC_CN"), (10, "1", 200_000.0, None, "ES30", "DOC_CN")]
    df = spark.createDataFrame(rows, "id long, type string, value double, published timestamp, nuts string, notices string")
    got = {r["id"]: r["due"] for r in P.appeal_deadlines(df).select("id", "due").collect()}
    assert got.keys() == {0, 1, 2} and all(dt.timedelta(days=19) <= got[i] - r[3].date() <= dt.timedelta(days=30) for i, r in enumerate(rows[:3]))
    wide = {r["day"]: r["due"] for r in P.business_deadlines(spark, 15, "2024-01-01", "2024-12-31").collect()}
    assert got[1] == wide[dt.date(2024, 5, 5)]
    assert P.appeal_deadlines(df.limit(0)).count() == 0


LEVELS = (("body", "code", "size", "competition"), ("body", "code", "size"), ("code", "size", "competition"), ("code", "size"), ("code",), ("size",), ())
COLUMNS = ("body", "code", "size", "competition")


def test_cohorts_loosen_to_all(spark):
    history = [("b1", "c1", "s1", "k1")] * 3 + [("b2", "c1", "s1", "k2")] * 2 + [("b3", "c9", None, "k1")] * 2 + [(None, None, "s5", None)]
    targets = [(1, "b1", "c1", "s1", "k1"), (2, "b2", "c1", "s1", "k2"), (3, "b9", "c7", "s5", "k9"), (4, None, None, None, None), (5, "b3", "c9", "s9", "k1")]
    frames = spark.createDataFrame(targets, "id long, body string, code string, size string, competition string"), spark.createDataFrame(history, "body string, code string, size string, competition string")
    for least in (1, 2, 3, 5, 50):
        want = {}
        for id_, *own in targets:
            at = dict(zip(COLUMNS, own))
            counts = []
            for level, keys in enumerate(LEVELS, 1):
                if all(at[k] is not None for k in keys):
                    n = sum(all(h[COLUMNS.index(k)] == at[k] for k in keys) for h in history)
                    counts += [(level, n)] if n else []
            want[id_] = next((x for x in counts if x[1] >= least), counts[0])
        assert {r["id"]: (r["level"], r["n"]) for r in P.cohort_levels(*frames, least).collect()} == want
    assert P.cohort_levels(frames[0], frames[1].limit(0), 1).count() == 0


def test_cohorts_are_dealt_by_number_whatever_the_join(spark, monkeypatch):
    """A target goes through as one row, ids are grouped in as many tasks as they need, without a sort of structs."""
    history = [(f"b{i % 3}", f"c{i % 2}", "s1", None if i % 5 == 0 else "k1") for i in range(40)]
    targets = [(i // 2, f"b{i % 4}", f"c{i % 3}", "s1" if i % 7 else None, "k1") for i in range(30)]
    frames = spark.createDataFrame(targets, "id long, body string, code string, size string, competition string"), spark.createDataFrame(history, "body string, code string, size string, competition string")
    want = {}
    for id_, *own in targets:
        counts = [(level, sum(all(h[COLUMNS.index(k)] == own[COLUMNS.index(k)] for k in keys) for h in history)) for level, keys in enumerate(LEVELS, 1)]
        want.setdefault(id_, []).extend((n < 5, level, n) for level, n in counts if n)
    monkeypatch.setattr(P, "TARGETS", 7)
    for few in (0, 1 << 16):
        monkeypatch.setattr(P, "FEW", few)
        out = P.cohort_levels(*frames, 5)
        assert {r["id"]: (r["level"], r["n"]) for r in out.collect()} == {k: min(v)[1:] for k, v in want.items()}
        plan = out._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan and "hashpartitioning(id#" in plan


def test_resamples_draw_as_a_poisson_variable(spark):
    n = 20_000
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("5"), F.lit("1"), F.col("id").cast("string"))), 1, 6), 16, 10).cast("long") / (1 << 24)
    times = F.coalesce(*[F.when(digest < x, k) for k, x in enumerate(P.POISSON)], F.lit(len(P.POISSON)))
    counts = Counter({r["k"]: r["n"] for r in spark.range(n).groupBy(times.alias("k")).agg(F.count("*").alias("n")).collect()})
    assert abs(sum(k * v for k, v in counts.items()) / n - 1) < 0.02 and max(counts) >= 5


def test_first_documents_of_terms_are_those_with_an_id(spark):
    rows = [(None, "zebra without id"), (7, "zebra late"), (5, "zebra first"), (5, "another of the same id"), (9, None)]
    got = P.emerging_terms(spark.createDataFrame(rows, "doc_id long, text string"), ["license"], ["the"], 3, 5).collect()
    assert [tuple(r) for r in got] == [("zebra", 3, "zebra first")]


def test_bootstrap_equals_row_by_row_and_takes_a_digest_once(spark):
    rows = [(i, i % 7, int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, score int, truth int")
    aps = []
    for r in range(1, 9):
        drawn = []
        for i, score, truth in rows:
            u = int(hashlib.md5(f"5:{r}:{i}".encode()).hexdigest()[:6], 16) / (1 << 24)
            drawn += [(score, truth)] * next((k for k, x in enumerate(P.POISSON) if u < x), len(P.POISSON))
        ap = 0.0
        for score in sorted({s for s, _ in drawn}):
            above = [t for s, t in drawn if s >= score]
            ap += sum(t for s, t in drawn if s == score) / sum(t for _, t in drawn) * sum(above) / len(above)
        aps.append(ap)
    got = P.bootstrap_precision(df, 8, 5)
    assert [round(x, 6) for x in (got.first()["low"], got.first()["high"])] == [round(float(x), 6) for x in np.percentile(aps, [2.5, 97.5])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
