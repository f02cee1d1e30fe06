import math
import re

from tendersieve.llm.mixing import UNIT, copies, mix, targets, word_count


def water(sizes, weights, budget, cap):
    """Brute force: cap whoever is above, reshare, repeat."""
    capped = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(capped.values())
        goal = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if goal[s] > cap * sizes[s]}
        if not over:
            return goal | capped
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, "c": 50, "d": 0}, {"a": 1, "b": 1000}, {"a": 5, "b": 5, "c": 5}):
        weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3.0, 1.0, 2.0), 1.5, 2.0).collect()
        expected = water(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
        for r in rows:
            assert math.isclose(r.target, expected[r.source], rel_tol=1e-12, abs_tol=1e-9), (sizes, r)


def test_copies(spark):
    texts = ["", None, " a b c\x0b", "\n\n", "x"] + ["w " * (i % 37) for i in range(400)]
    rows = [(i if i % 9 else None, t, [None, "a", "b", "b", "ç"][i % 5], i) for i, t in enumerate(texts)] + [(1, None, "a", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = copies(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.size for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - own[0].target) <= 2 * max(r.size for r in own)
        assert all(0 <= r.copies <= 2 for r in own)
        rate = round(own[0].target / max(1, own[0].source_size) * UNIT)
        assert abs(sum(r.copies for r in own) - len(own) * rate / UNIT) <= 1
    again = {(r.uid, r.copies) for r in copies(docs).collect()}
    assert again == {(r.uid, r.copies) for r in got}
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert copies(docs).count() == 0 and mix(docs).count() == 0
    only = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in copies(only).collect()] == [(0, 0.0, 0)] * 2
    assert only.select(word_count(only.text)).count() == 2
