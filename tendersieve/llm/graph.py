"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); label is the least node of its component.

    Alternating large-star and small-star steps until only stars are left: every node ends
    up linked to its component's least node. Each step keeps at most the number of edges it got
    (a star is never expanded into pairs) and needs a number of rounds logarithmic in the nodes.
    The least neighbours, one row a node, are written before they are joined, so that the edges
    of a star's centre can be split over tasks. Null ends and loops are left out; an empty table
    gives an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "near")
        # large star: link each larger neighbour to the least of the neighbourhood
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large")
        # small star: link the node itself and its smaller neighbours to the least one
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        small = materialize(small.distinct(), "small")
        discard(e, near, large, least)
        e = small
        several = e.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
        if several.unionByName(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")).isEmpty():
            break  # every edge leads from a node of no other edge to the centre of a star
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
