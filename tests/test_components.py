from tendersieve.operators import graph


def test_labels_are_not_broadcast(spark, monkeypatch):
    """Labels are a row a node: each round's broadcast would go through the driver."""
    plans = []

    def cut(df, tag):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(graph, "cut", cut)
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert plans and not any("Broadcast" in p for p in plans)
