import random

import pytest

from tendersieve.operators.louvain import louvain


def modularity(edges, label):
    total = sum(2 * w for _, _, w in edges)
    k, inside = {}, 0.0
    for a, b, w in edges:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
        inside += 2 * w * (label[a] == label[b])
    sums = {}
    for n, x in k.items():
        sums[label[n]] = sums.get(label[n], 0) + x
    return inside / total - sum(x * x for x in sums.values()) / total**2


def plain(edges):
    """Node by node in order, then on the communities."""
    member = {n: n for a, b, _ in edges for n in (a, b)}
    graph = list(edges)
    while True:
        nodes = sorted({n for a, b, _ in graph for n in (a, b)})
        near = {n: {} for n in nodes}
        k = dict.fromkeys(nodes, 0.0)
        for a, b, w in graph:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        total = sum(k.values())
        label = {n: n for n in nodes}
        sums = dict(k)
        moved, again = False, True
        while again:
            again = False
            for n in nodes:
                to = {}
                for o, w in near[n].items():
                    to[label[o]] = to.get(label[o], 0) + w
                sums[label[n]] -= k[n]
                score = lambda x: to.get(x, 0) - k[n] * sums[x] / total
                best = max(sorted(to), key=score, default=label[n])
                if score(best) > score(label[n]) + 1e-9:
                    label[n], moved, again = best, True, True
                sums[label[n]] += k[n]
        if not moved:
            return member
        member = {n: label[x] for n, x in member.items()}
        joined = {}
        for a, b, w in graph:
            key = tuple(sorted((label[a], label[b])))
            joined[key] = joined.get(key, 0) + w
        graph = [(a, b, w) for (a, b), w in joined.items()]


def cliques(n, size):
    edges = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i)]
    return edges + [(c * size, ((c + 1) % n) * size + 1, 1.0) for c in range(n)]


def planted(seed):
    rnd = random.Random(seed)
    return [(i, j, rnd.choice([1.0, 2.0])) for i in range(60) for j in range(i) if rnd.random() < (0.5 if i % 4 == j % 4 else 0.03)]


def run(spark, edges):
    rows, value = louvain(spark.createDataFrame(edges, "a long, b long, w double"))
    return {r["node"]: r["community"] for r in rows.collect()}, value


@pytest.mark.parametrize("edges", [cliques(6, 5), planted(1), planted(2)], ids=["cliques", "planted", "planted again"])
def test_modularity_of_the_plain_version(spark, edges):
    got, value = run(spark, edges)
    assert value == pytest.approx(modularity(edges, got))
    assert value >= modularity(edges, plain(edges)) - 1e-9
    assert all(got[label] == label and label <= node for node, label in got.items())


def test_ties_and_swaps_settle(spark):
    # two nodes that would change places for ever, a square of ties, a star, loops and repeated edges
    edges = [(1, 2, 1.0), (10, 11, 1.0), (11, 12, 1.0), (12, 13, 1.0), (13, 10, 1.0), (20, 21, 1.0), (20, 22, 1.0), (20, 23, 1.0), (30, 30, 2.0), (30, 31, 1.0), (31, 30, 1.0)]
    got, value = run(spark, edges)
    assert got[1] == got[2] == 1 and got[21] == got[22] == got[23] == got[20] and got[30] == got[31]
    assert value == pytest.approx(modularity(edges, got)) and value >= modularity(edges, plain(edges)) - 1e-9


def test_nulls_and_empty_graphs(spark):
    rows, value = louvain(spark.createDataFrame([(None, 1, 1.0), (2, 3, 0.0), (4, 5, None)], "a long, b long, w double"))
    assert rows.count() == 0 and value == 0.0
