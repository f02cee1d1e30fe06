import datetime as dt
import random

from pyspark.sql import functions as F

from tendersieve.operators import standing as T


def test_cover_is_the_interval_and_small(spark):
    pairs = [(0, 0), (0, 1), (3, 5), (5, 6), (1, 15), (0, 16), (7, 7), (9, 4), (6, 13)]
    got = spark.createDataFrame(pairs, "l int, r int").select("l", "r", T.cover(F.col("l"), F.col("r"), 4).alias("x")).collect()
    for row in got:
        held = [n for x in row["x"] for n in range(x["node"] << x["level"], (x["node"] + 1) << x["level"])]
        assert sorted(held) == list(range(row["l"], row["r"])) and len(row["x"]) <= 8


def test_interval_join_equals_all_pairs_without_a_loop(spark):
    rnd = random.Random(2)
    points = [(i, rnd.choice([None, rnd.randrange(1024)])) for i in range(200)]
    spans = [(i, *rnd.choice([(a := rnd.randrange(1024), a + rnd.randrange(300)), (None, 5), (9, None), (0, 1023)])) for i in range(150)]
    joined = T.interval_join(spark.createDataFrame(points, "p int, v int"), "v", spark.createDataFrame(spans, "s int, low int, high int"), "low", "high", 10)
    want = sorted((p, s) for p, v in points for s, a, b in spans if None not in (v, a, b) and a <= v < b)
    assert sorted((r["p"], r["s"]) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert T.interval_join(spark.createDataFrame(points, "p int, v int"), "v", spark.createDataFrame([], "s int, low int, high int"), "low", "high", 10).count() == 0


RULES = "rule_id long, since date, until date, segment string, region string, prefix string, least double, frequency string, last timestamp"
TENDERS = "id long, published timestamp, segment string, region string, code string, amount double"


def data(n=300, m=120, seed=5):
    rnd = random.Random(seed)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    tenders = [(i, rnd.choice([None, *[dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 90))] * 9]), rnd.choice(["A", "B", None]), rnd.choice(["N", "S"]), rnd.choice(["45000", "45210", "72000", None]), rnd.choice([None, 1.0, 50.0])) for i in range(n)]
    rules = []
    for i in range(m):
        since = rnd.choice([None, day(rnd.randrange(90))])
        until = rnd.choice([None, day(rnd.randrange(110))])
        last = rnd.choice([None, dt.datetime(2024, 3, 20) + dt.timedelta(hours=rnd.randrange(240))])
        rules.append((i, since, until, rnd.choice([None, "A"]), rnd.choice([None, "N"]), rnd.choice([None, "45", "7200"]), rnd.choice([None, 10.0]), rnd.choice(["immediate", "daily", "weekly", None]), last))
    return rules, tenders


def meets(r, t):
    return (r[3] in (None, t[2])) and (r[4] in (None, t[3])) and (r[5] is None or (t[4] or "").startswith(r[5])) and (r[6] is None or (t[5] is not None and t[5] >= r[6]))


def test_rules_each_with_its_window(spark):
    rules, tenders = data()
    want = sorted((r[0], t[0]) for r in rules for t in tenders if t[1] and (r[1] is None or t[1].date() >= r[1]) and (r[2] is None or t[1].date() < r[2]) and meets(r, t))
    got = T.match_rules(spark.createDataFrame(rules, RULES), spark.createDataFrame(tenders, TENDERS))
    assert sorted((r["rule_id"], r["id"]) for r in got.collect()) == want


def test_due_rules_tell_what_is_new_and_go_on(spark):
    rules, tenders = data()
    now = dt.datetime(2024, 3, 30, 8)
    every = {"immediate": 0, "weekly": 7}
    due = [r for r in rules if r[8] is None or (now - r[8]).total_seconds() >= 86400 * every.get(r[7], 1)]
    told, turns = set(), []
    frames = spark.createDataFrame(rules, RULES), spark.createDataFrame(tenders, TENDERS)
    for _ in range(2):
        want = set()
        for r in due:
            start = r[8].date() - dt.timedelta(days=2) if r[8] else now.date() - dt.timedelta(days=30)
            fresh = [t for t in tenders if t[1] and t[1].date() >= start and meets(r, t) and (r[0], t[0]) not in told]
            want |= {(r[0], t[0], k) for k, t in enumerate(sorted(fresh, key=lambda t: (-t[1].timestamp(), t[0]))[:3], 1)}
        events, state = T.evaluate_rules(*frames, spark.createDataFrame(sorted(told), "rule_id long, id long"), str(now), limit=3)
        assert {tuple(x) for x in events.collect()} == want
        assert sorted(x["rule_id"] for x in state.collect()) == [r[0] for r in due]
        turns.append(len(want))
        told |= {x[:2] for x in want}
    assert turns[0] and turns[1]


def test_totals_of_rules_are_those_of_all_pairs(spark):
    rules, tenders = data(400, 150, 9)
    want = {}
    for r in rules:
        own = [t for t in tenders if t[1] and (r[1] is None or t[1].date() >= r[1]) and (r[2] is None or t[1].date() < r[2]) and meets(r, t)]
        if own:
            amounts = [t[5] for t in own if t[5] is not None]
            want[r[0]] = (len(own), sum(amounts) if amounts else None, max(t[0] for t in own))
    got = T.rule_totals(spark.createDataFrame(rules, RULES), spark.createDataFrame(tenders, TENDERS))
    assert {r["rule_id"]: (r["n"], r["amount"], r["newest"]) for r in got.collect()} == want
    assert T.rule_totals(spark.createDataFrame(rules, RULES), spark.createDataFrame([], TENDERS)).count() == 0


def test_newest_rows_of_a_rule_come_without_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(T, "BETWEEN", 20)
    rnd = random.Random(3)
    now = dt.datetime(2024, 3, 30)
    tenders = [(i, now - dt.timedelta(minutes=rnd.randrange(20000)), "A", "N", "45", rnd.choice([5.0, float(rnd.randrange(1000))])) for i in range(2000)]
    rules = [(i, None, None, None, None, None, rnd.choice([None, 5.0, 4.5, float(rnd.randrange(1000))]), "daily", None) for i in range(60)]
    told = [(r[0], t[0]) for r in rules[:20] for t in rnd.sample(tenders, 30)]
    frames = [spark.createDataFrame(x, k) for x, k in ((rules, RULES), (tenders, TENDERS), (told, "rule_id long, id long"))]
    got = {tuple(x) for x in T.evaluate_rules(*frames, str(now), limit=3)[0].collect()}
    known = set(told)
    want = set()
    for r in rules:
        fresh = [t for t in tenders if meets(r, t) and (r[0], t[0]) not in known]
        want |= {(r[0], t[0], k) for k, t in enumerate(sorted(fresh, key=lambda t: (-t[1].timestamp(), t[0]))[:3], 1)}
    assert got == want
    start = (now - dt.timedelta(days=30)).date()
    windows = spark.createDataFrame([(*r[:1], start, *r[2:]) for r in rules], RULES)
    # every pair would be some 60,000 rows
    assert T._newest(windows, *frames[1:], 3).count() < 20000


def test_a_rule_comes_to_its_newest_rows_only(spark, monkeypatch):
    """No more rows than are told, over parts and cells that cut equal amounts; rows of one rule_id count as one rule."""
    monkeypatch.setattr(T, "BETWEEN", 50)
    rnd = random.Random(8)
    now, nan = dt.datetime(2024, 3, 30), float("nan")
    amount = lambda: rnd.choice([None, nan, -0.0, 0.0, 5.0, 5.0, float(rnd.randrange(40))])
    tenders = [(rnd.choice([None, i]), now - dt.timedelta(hours=rnd.randrange(1200)), rnd.choice("AB"), "N", rnd.choice(["45", "72"]), amount()) for i in range(1500)]
    rules = [(rnd.randrange(70) if i % 3 else 1000 + i, None, None, rnd.choice([None, "A"]), None, rnd.choice([None, "45"]), amount(), "daily", rnd.choice([None, now - dt.timedelta(days=rnd.randrange(1, 20))])) for i in range(150)]
    told = [(r[0], t[0]) for r in rules[:60] for t in rnd.sample(tenders, 100)]
    order = lambda x: -1 if x is None else float("inf") if x != x else x
    want, known = [], set(told)
    for rule in {r[0] for r in rules}:
        fresh = []
        for r in rules:
            start = r[8].date() - dt.timedelta(days=2) if r[8] else now.date() - dt.timedelta(days=30)
            fresh += [t for t in tenders if r[0] == rule and t[1].date() >= start and meets((*r[:6], None), t) and (r[6] is None or t[5] is not None and order(t[5]) >= order(r[6])) and (t[0] is None or (rule, t[0]) not in known)]
        want += [(rule, t[0], k) for k, t in enumerate(sorted(fresh, key=lambda t: (-t[1].timestamp(), t[0] is not None, t[0] or 0))[:4], 1)]
    frames = [spark.createDataFrame(x, k) for x, k in ((rules, RULES), (tenders, TENDERS), (told, "rule_id long, id long"))]
    key = lambda x: (x[0], x[2])
    assert sorted((tuple(x) for x in T.evaluate_rules(*frames, str(now), limit=4)[0].collect()), key=key) == sorted(want, key=key)
    windows = frames[0].withColumn("since", F.lit((now - dt.timedelta(days=30)).date()))
    assert 0 < T._newest(windows, *frames[1:], 4).count() <= 4 * len(rules)
