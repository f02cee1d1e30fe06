"""Hard negatives by an exact Voronoi-partitioned nearest-neighbour join over inner products.

1. Components become floor(256 * x); scores are integer inner products. With M the greatest norm, a row x stands
   at (x, sqrt(M^2 - |x|^2)) and an anchor q at (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 * score, so the greatest
   scores are the least distances.
2. A bounded number of rows are pivots. Each row knows its nearest pivot and the distance to it; each anchor belongs to
   the group of its nearest pivot among the first few, with the group's greatest distance as radius.
3. A request asks for the k best rows of an anchor's own label, or of other labels, with scores in a band. The rows
   of one hash in ``FIRST`` are joined first; the k-th score found is a sure lower bound from then on.
4. By the triangle inequality a row's distance to its pivot and the distances between pivots bound the scores it
   can have with any anchor of a group. It is copied to the groups only that it may still serve.
5. Groups are split into at most ``GROUP`` anchors and copied rows into about ``PART`` rows a task; there scores are
   computed for all pairs of the two blocks at once, and each request keeps its k best at most.
   What the blocks keep is ranked per request.

Defined cases: rows with a null label or vector, or with a component that is null or not finite, take no part; nor do
anchors without an id. A missing component of a shorter vector counts as 0. Ties go to the smaller id, null
ids last. A repeated row is a row of its own: it may be its twin's positive, and a repeated anchor
gives its rows again. A hundred times a score must fit a long, else the job ends with an error that says so. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialize, numbered

PIVOTS = 64
GROUP = 256
PART = 8192
FIRST = 16
ANY = (1 << 62) - 1


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers from their bytes, zeros behind shorter ones."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v.as_py(), np.int64)
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 55:
        return a @ b.T
    raise ValueError("a hundred inner products of these vectors may not fit a long")


@dataclass
class Space:
    """The pivots in one coordinate more than the vectors, and the square of the greatest norm."""

    pivots: np.ndarray
    width: int
    square: float
    groups: int

    def nearest(self, m: np.ndarray, as_anchor: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest pivot, distance to it, squared norm) of each row of ``m``."""
        x = m.astype(float)
        squares = (x * x).sum(axis=1)
        last = np.zeros(len(x)) if as_anchor else np.sqrt(np.maximum(0.0, self.square - squares))
        pivots = self.pivots[: self.groups] if as_anchor else self.pivots
        to = np.maximum(0.0, (squares + last * last)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (np.column_stack([x, last]) @ pivots.T))
        near = to.argmin(axis=1)
        return near, np.sqrt(to[np.arange(len(x)), near]), squares

    def locate(self, as_anchor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near, distance, squares = self.nearest(_matrix(batch.column("vec"), self.width), as_anchor)
                more = [pa.array(near.astype(np.int32)), pa.array(distance), pa.array(squares)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "distance", "square"])

        return run


def vectors(rows: DataFrame, label: Column) -> DataFrame:
    """(uid, vec_id, label, vec): the rows that take part, numbered and written, components as 64-bit integers in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.floor(256.0 * np.array(v.as_py(), float)) for v in batch.column("embedding")]
            if any(np.abs(x).max(initial=0) >= 2.0**60 for x in whole):
                raise ValueError("a component is too great for a long")
            bytes_ = [x.astype(np.int64).tobytes() for x in whole]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(bytes_, pa.binary())], names=["vec_id", "label", "vec"])

    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where("label is not null and embedding is not null").where(sound)
    return numbered(kept.mapInArrow(pack, "vec_id long, label long, vec binary"), "uid")


def _space(rows: DataFrame, anchors: DataFrame, pivots: int) -> Space:
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(v.as_py(), np.int64).astype(float) for v in batch.column("vec")]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sizes], pa.int64()), pa.array([float(x @ x) for x in sizes], pa.float64())], names=["width", "square"])

    size = rows.select("vec").mapInArrow(norms, "width long, square double").agg(F.max("width").alias("width"), F.max("square").alias("square")).first()
    width, square = size["width"] or 0, size["square"] or 0.0
    some = _matrix(pa.array([r["vec"] for r in rows.select("vec", "uid").orderBy(F.xxhash64("uid")).limit(pivots).collect()], pa.binary()), width).astype(float)
    last = np.sqrt(np.maximum(0.0, square - (some * some).sum(axis=1)))
    return Space(np.column_stack([some, last]), width, square, max(1, min(len(some), anchors.count() // GROUP)))


_REQUEST = ["a", "b", "vec", "label", "same", "low", "high"]


def _route(space: Space, groups: list, least: dict[int, int], parts: int):
    """Copies each row to the (group, split) pairs that it may serve."""
    between = np.sqrt(np.maximum(0.0, ((space.pivots[:, None, :] - space.pivots[None, : space.groups, :]) ** 2).sum(axis=2)))
    slack = 1e-6 * (space.square + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            for g in groups:
                apart = between[cell, g["cell"]]
                near = np.maximum(0.0, np.maximum(apart - d, d - apart) - g["radius"])
                far = apart + d + g["radius"]
                best = (g["square"] + space.square - near * near) / 2 + slack
                worst = (g["least_square"] + space.square - far * far) / 2 - slack
                at = np.flatnonzero((best >= least[g["cell"]]) & (worst <= g["high"]))
                if not len(at):
                    continue
                rows = batch.take(pa.array(at))
                uid = rows.column("uid").to_numpy().astype(np.uint64)
                part = ((uid * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
                for split in range(g["splits"]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), x, np.int32)) for x in (g["cell"], split)] + [pa.array(part.astype(np.int32)), *(rows.column(c) for c in ("uid", "vec_id", "label", "vec"))],
                        names=["cell", "split", "part", "uid", "vec_id", "label", "vec"],
                    )

    return run


def _local(k: int, width: int):
    def run(requests: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if requests.num_rows and rows.num_rows:
            a, first = np.unique(requests.column("a").to_numpy(), return_index=True)
            score = _products(_matrix(requests.column("vec").take(pa.array(first)), width), _matrix(rows.column("vec"), width))
            uid, label = rows.column("uid").to_numpy(), rows.column("label").to_numpy()
            ids = rows.column("vec_id").combine_chunks()
            order = np.lexsort((uid, ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)))
            score, uid, label, ids = score[:, order], uid[order], label[order], ids.take(pa.array(order))
            for i, q in enumerate(requests.select(["a", "b", "label", "same", "low", "high"]).to_pylist()):
                own = score[np.searchsorted(a, q["a"])]
                # rows are in order of id, so that a stable sort settles ties
                fits = np.flatnonzero(((label == q["label"]) == q["same"]) & (own >= q["low"]) & (own <= q["high"]) & (uid != q["a"]))
                fits = fits[np.argsort(-own[fits], kind="stable")[:k]]
                for column, values in zip(out, (np.full(len(fits), q["a"]), np.full(len(fits), q["b"]), own[fits], uid[fits], ids.take(pa.array(fits)).to_pylist()), strict=True):
                    column.extend(values)
        names = ["a", "b", "score", "uid", "vec_id"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    return run


def _joined(requests: DataFrame, rows: DataFrame, n_rows: int, k: int, space: Space) -> DataFrame:
    """(a, b, score, uid, vec_id): for each request at most k of the rows of each part."""
    ends = requests.groupBy("cell").agg(
        F.max("distance").alias("radius"), F.max("square").alias("square"), F.min("square").alias("least_square"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("split").alias("split"),
    )
    groups = [{**r.asDict(), "splits": r["split"] + 1} for r in ends.collect()]  # a row a group, at most as many as pivots
    parts = max(1, math.ceil(n_rows / PART))
    copied = rows.mapInArrow(_route(space, groups, {g["cell"]: g["low"] for g in groups}, parts), "cell int, split int, part int, uid long, vec_id long, label long, vec binary")
    asked = requests.select("cell", "split", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *_REQUEST)
    keys = ["cell", "split", "part"]
    return asked.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInArrow(_local(k, space.width), "a long, b int, score long, uid long, vec_id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_rows(requests: DataFrame, rows: DataFrame, k: int, space: Space) -> DataFrame:
    """(a, b, rank, score, uid, vec_id): the k best rows of each request (a, b, vec, label, same, low, high and its group's
    cell, split, distance, square), ranked by falling score."""
    drawn = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(FIRST)) == 0
    n = rows.count()
    first = materialize(_best(_joined(requests, rows.where(drawn), math.ceil(n / FIRST), k, space), k), "first")
    sure = first.where(F.col("rank") == k).select("a", "b", F.col("score").alias("sure"))
    raised = requests.join(sure, ["a", "b"], "left").withColumn("low", F.greatest("low", F.coalesce("sure", "low"))).drop("sure")
    rest = _joined(materialize(raised, "raised"), rows.where(~drawn), n, k, space)
    return _best(first.drop("rank").unionByName(rest), k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    ``is_anchor`` is a condition on vec_id, ``label`` replaces the column. Of each anchor the first ``positives`` rows of its
    label, and for each of them the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's.
    """
    numbered_rows = vectors(rows, F.col("label") if label is None else label)
    anchors = numbered_rows.where(is_anchor & F.col("vec_id").isNotNull())
    space = _space(numbered_rows, anchors, pivots)
    if not len(space.pivots):
        return numbered_rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    located = "uid long, vec_id long, label long, vec binary, cell int, distance double, square double"
    columns = ["uid", "vec_id", "label", "vec"]
    placed = materialize(numbered_rows.select(*columns).mapInArrow(space.locate(False), located), "cells")
    asking = anchors.select(*columns).mapInArrow(space.locate(True), located)
    # anchors of a group are split by hash, into as many tasks as GROUP asks for
    size = asking.groupBy("cell").agg(F.count("*").alias("n"))
    split = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / GROUP)).cast("int").alias("split")
    asking = materialize(asking.join(size, "cell").select(F.col("uid").alias("a"), F.col("vec_id").alias("anchor_id"), "label", "vec", "cell", "distance", "square", split), "anchors")
    every = asking.drop("anchor_id").select("*", F.lit(0).alias("b"), F.lit(True).alias("same"), F.lit(-ANY).alias("low"), F.lit(ANY).alias("high"))
    near = materialize(best_rows(every, placed, positives, space), "positives").select("a", F.col("rank").alias("b"), F.col("score").alias("p"), F.col("vec_id").alias("positive_id"))
    # least and greatest whole score n with low * p <= 100 * n <= high * p
    least, most = (F.expr(f"({x} - pmod({x}, 100L)) div 100") for x in (f"(-{low} * p)", f"({high} * p)"))
    banded = near.join(asking.drop("anchor_id"), "a").select("*", F.lit(False).alias("same"), (-least).alias("low"), most.alias("high")).where("low <= high")
    found = best_rows(materialize(banded.drop("p", "positive_id"), "bands"), placed, negatives, space)
    named = found.join(near, ["a", "b"]).join(asking.select("a", "anchor_id"), "a")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
