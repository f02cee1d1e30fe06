import random

from tendersieve.llm.graph import connected_components


def test_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3), (5, None)]
    name = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = name.setdefault(a, a), name.setdefault(b, b)
            name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted(name.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
