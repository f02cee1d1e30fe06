"""Communities by modularity: moves of nodes between communities, then the same on the graph of communities, until nothing gains.

A round moves all gaining nodes of one hash half at once. Such moves are judged by their joint result: they stand if modularity
rises. Else the round moves one node a community at most, where no community is left or joined by two: then gains
add up exactly, modularity rises by their sum, and so the rounds must end. Gains are compared with a small slack and ties go to
the least community, so equal gains cause no swaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tendersieve.sources.files import cut

c = F.col
SLACK = 1e-10


def _links(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """(node, to, w): weight of a node's arcs into each community."""
    return cut(arcs.join(state.select(c("node").alias("b"), c("community").alias("to")), "b").groupBy(c("a").alias("node"), "to").agg(F.sum("w").alias("w")), "links")


def _modularity(links: DataFrame, state: DataFrame, total: float) -> float:
    own = links.withColumnRenamed("to", "community")
    inside = state.join(own, ["node", "community"], "left").agg(F.sum(c("loop") + F.coalesce("w", F.lit(0.0))).alias("x"))
    apart = state.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(c("k") * c("k")).alias("y"))
    row = inside.crossJoin(apart).first()  # one row each
    return row["x"] / total - row["y"] / total**2


def _moves(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """(node, community, to, gain): each node's best move that gains."""
    sums = state.groupBy(c("community").alias("to")).agg(F.sum("k").alias("sum"))
    here = state.join(sums.withColumnRenamed("to", "community").withColumnRenamed("sum", "own"), "community")
    stay = links.select("node", c("to").alias("community"), c("w").alias("stays"))
    here = here.join(stay, ["node", "community"], "left")
    gain = 2 * (c("w") - F.coalesce("stays", F.lit(0.0))) / total - 2 * c("k") * (c("sum") - c("own") + c("k")) / total**2
    each = here.join(links, "node").where("to <> community").join(sums, "to").select("node", "community", "to", F.round(gain, 12).alias("gain")).where(c("gain") > SLACK)
    best = each.groupBy("node").agg(F.min(F.struct((-c("gain")).alias("loss"), "to", "community")).alias("x"))
    return best.select("node", c("x.community").alias("community"), c("x.to").alias("to"), (-c("x.loss")).alias("gain"))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch a community: those that are first by gain at both of their communities."""
    ends = moves.select("node", "gain", F.explode(F.array("community", "to")).alias("at"))
    first = ends.groupBy("at").agg(F.min(F.struct((-c("gain")).alias("loss"), "node")).alias("x")).select("at", c("x.node").alias("node"))
    both = first.groupBy("node").agg(F.count("*").alias("n")).where("n = 2").select("node")
    return moves.join(both, "node")


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    return cut(state.join(moves.select("node", "to"), "node", "left").select("node", "k", "loop", F.coalesce("to", "community").alias("community")), "state")


def _level(arcs: DataFrame, nodes: DataFrame, total: float, rounds: int) -> tuple[DataFrame, float, bool]:
    """(state, modularity, whether a node moved) once no move gains."""
    state, moved = nodes.withColumn("community", c("node")), False
    links = _links(arcs, state)
    best = _modularity(links, state, total)
    for number in range(rounds):
        moves = cut(_moves(links, state, total), "moves")
        if moves.isEmpty():
            break
        # half of the gaining nodes at a time, as neighbours that move together undo each other's gain
        half = moves.where(F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0)
        new = _moved(state, half)
        new_links = _links(arcs, new)
        value = _modularity(new_links, new, total)
        if value <= best + SLACK:
            new = _moved(state, _apart(moves))
            new_links = _links(arcs, new)
            value = _modularity(new_links, new, total)
        state, links, best, moved = new, new_links, value, True
    return state, best, moved


def louvain(edges: DataFrame, rounds: int = 1000) -> tuple[DataFrame, float]:
    """((node, community), modularity) of undirected edges (a, b, w); a community is named by its least node.

    Several edges of a pair add up, loops count for their node. Edges with a null end, or a weight that is null or not
    positive, are left out, and nodes with them. An empty graph gives an empty result and 0. ``rounds`` a level is
    far beyond need: rounds end by themselves.
    """
    sound = edges.where("a is not null and b is not null and w > 0").select("a", "b", c("w").cast("double").alias("w"))
    arcs = cut(sound.unionByName(sound.select(c("b").alias("a"), c("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "arcs")
    member, value = None, 0.0
    while True:
        # an arc from a node to itself holds twice the weight inside
        nodes = arcs.groupBy(c("a").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(c("a") == c("b"), c("w")).otherwise(0.0)).alias("loop"))
        nodes = cut(nodes, "nodes")
        total = nodes.agg(F.sum("k")).first()[0]
        if member is None:
            member = nodes.select("node", c("node").alias("community"))
            if not total:
                return member, 0.0
        state, value, moved = _level(arcs.where("a <> b"), nodes, total, rounds)
        if not moved:
            break
        to = state.select(c("node").alias("community"), c("community").alias("to"))
        member = cut(member.join(to, "community").select("node", c("to").alias("community")), "members")
        ends = [state.select(c("node").alias(x), c("community").alias(f"{x}_to")) for x in ("a", "b")]
        arcs = cut(arcs.join(ends[0], "a").join(ends[1], "b").groupBy(c("a_to").alias("a"), c("b_to").alias("b")).agg(F.sum("w").alias("w")), "arcs")
    names = member.groupBy("community").agg(F.min("node").alias("name"))
    return member.join(names, "community").select("node", c("name").alias("community")), value
