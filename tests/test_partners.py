import random
from collections import Counter
from itertools import combinations

from tendersieve.operators import market


def test_tasks_of_pairs_grow_with_the_awards(spark, monkeypatch):
    """A task's rows are bounded by number, whatever the size of the table; pairs are those of plain Python."""
    monkeypatch.setattr(market, "PAIR_ROWS", 40)
    rnd = random.Random(4)
    rows = [(rnd.randrange(120), rnd.randrange(15), 1.0) for _ in range(600)]
    found = market.partner_pairs(spark.createDataFrame(rows, "tender_id long, company_id long, awarded double"), 2)
    assert found.rdd.getNumPartitions() >= 600 / 40
    members = {}
    for tender, company, _ in rows:
        members.setdefault(tender, set()).add(company)
    want = Counter(p for m in members.values() for p in combinations(sorted(m), 2))
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert market.partner_pairs(spark.createDataFrame([], "tender_id long, company_id long, awarded double"), 1).count() == 0
