"""Identity and partner graphs: tokens, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col


def tokens(rows: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(row, token): a token of each column that has a value."""
    parts = F.array_compact(F.array(*[F.when(F.trim(c(k).cast("string")) != "", F.concat(F.lit(f"{k}:"), c(k).cast("string"))) for k in columns]))
    return rows.select(c(id_).alias("row"), F.explode(parts).alias("token"))


def token_edges(rows: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(a, b): each row and the least row that shares a token with it, and a loop at each row.

    Stars have the components of all pairs that share a token, and one edge a token of a row.
    """
    held = cut(tokens(rows, id_, columns), "tokens")
    hub = cut(held.groupBy("token").agg(F.min("row").alias("b")), "hubs")
    return held.join(hub, "token").select(c("row").alias("a"), "b").unionByName(rows.select(c(id_).alias("a"), c(id_).alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b).

    A label points to a lesser node. In each round the least label of the neighbours' labels is offered to
    the node and to the node that its label names, and labels jump to their label's label, until nothing
    changes: whole trees join at once, so rounds grow with the logarithm of the nodes and not with
    the length of paths. Rounds are written, so lineage stays short; labels are a row a node and never broadcast.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(c("b").alias("a"), c("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(c("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        top = label.select(c("node").alias("component"), c("component").alias("top"))
        up = cut(label.join(top.hint("merge"), "component").select("node", "component", "top"), "tops")
        near = both.join(up.select(c("node").alias("b"), "top").hint("merge"), "b").groupBy("a").agg(F.min("top").alias("m"))
        step = cut(up.join(near.hint("merge"), up.node == near.a).select("node", "component", "top", "m"), "steps")
        offers = step.select("node", F.least("component", "top", "m").alias("new"), c("component").alias("old")).unionByName(step.select(c("component").alias("node"), c("m").alias("new"), F.lit(None).alias("old")))
        told = cut(offers.groupBy("node").agg(F.min("new").alias("component"), F.min("old").alias("old")), "labels")
        label = told.select("node", "component")
        if told.where("component <> old").isEmpty():
            return label


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation over weighted edges (a, b, w): ties go to the least label."""
    both = cut(edges.select("a", "b", "w").unionByName(edges.select(c("b").alias("a"), c("a").alias("b"), "w")), "edges")
    label = both.select(c("a").alias("node")).distinct().withColumn("community", c("node"))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-c("w")).alias("w"), "community")).alias("x"))
        label = cut(best.select(c("a").alias("node"), c("x.community").alias("community")), "communities")
    return label


def degrees(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a").unionByName(edges.select(c("b").alias("a")))
    return both.groupBy("a").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), F.asc("a")).limit(n)


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value a key, the least of ties, null excluded."""
    counts = rows.where(c(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    return counts.groupBy(key).agg(F.min(F.struct((-c("k")).alias("k"), c(value).alias("v"))).alias("x")).select(key, c("x.v").alias("modal"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")
