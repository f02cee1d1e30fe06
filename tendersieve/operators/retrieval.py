"""Ranked search over text and vectors from indexes that are written once.

Text: an inverted index of (term, block, postings). A block is at most 8,192 documents in a row, so one task makes whole postings
of a block without any shuffle. A search meets all queries with a few blocks first; in the others, what is known of a query's n-th score
leaves out blocks whose greatest impacts stay below it, and documents that hold only terms of little weight. What it returns is exact.

Vectors: rows in lists by nearest centroid, with the distance to it. A search scores a query's nearest lists, then
of the others the rings that the triangle inequality doesn't rule out (exact), or none (``probes`` lists only).

Both take a scope, a condition on the documents' other columns, that holds before anything is ranked.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tendersieve.functions.scalars import MARKED, PLAIN
from tendersieve.sources.files import cut, scratch

c = F.col
WORD = re.compile("[a-z0-9]+")
_FOLD = str.maketrans(MARKED, PLAIN)
#: Most documents of a block, as a power of two, and its postings (but for the last document's).
BLOCK_BITS = 13
MOST_POSTINGS = 1 << 21
#: Blocks that are scored before bounds decide.
FIRST = 8
K1, B = 1.2, 0.75
RRF_K = 60
#: Rows of a packed block of vectors, and queries that meet it at once.
PACK = 1024
ASKING = 256
SALTS = 8
FIRST_LISTS = 2


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_FOLD).lower())


def _postings(most_docs: int):
    """Rows of ``_POSTINGS`` of documents that come in order of number; the empty term holds all of a block, with lengths as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, keys, lengths, held, size, kind = 0, [], array("i"), {}, 0, pa.int64()

        def rows() -> pa.RecordBatch:
            order = pc.sort_indices(pa.table({"key": pa.array(keys, kind), "place": np.arange(len(keys))}), sort_keys=[("key", "ascending"), ("place", "ascending")], null_placement="at_end")
            ranks = np.empty(len(keys), np.int32)
            ranks[order.to_numpy()] = np.arange(len(keys), dtype=np.int32)
            names = sorted(held)
            places, counts = [array("i", range(len(keys))), *(held[x][0] for x in names)], [lengths, *(held[x][1] for x in names)]
            columns = [
                pa.array(["", *names], pa.string()), pa.array([first] * len(places), pa.int64()), pa.array([len(x) for x in places], pa.int64()), pa.array([sum(x) for x in counts], pa.int64()),
                pa.array([x.tobytes() for x in places], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary()), pa.array([ranks.tobytes(), *[None] * len(names)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "total", "places", "counts", "ranks"])

        for batch in batches:
            kind = batch.schema.field("key").type
            for number, key, text in zip(batch.column("number").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if keys and (number != first + len(keys) or len(keys) >= most_docs or size >= MOST_POSTINGS):
                    yield rows()
                    keys, lengths, held, size = [], array("i"), {}, 0
                if not keys:
                    first = number
                found = words(text.as_py() or "")
                for term, n in Counter(found).items():
                    places, counts = held.setdefault(term, (array("i"), array("i")))
                    places.append(len(keys))
                    counts.append(n)
                    size += 1
                keys.append(key)
                lengths.append(len(found))
        if keys:
            yield rows()

    return run


_POSTINGS = "term string, block long, n long, total long, places binary, counts binary, ranks binary"


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, doc) of postings."""
    for batch in batches:
        for term, block, places in zip(*(batch.column(x).to_pylist() for x in ("term", "block", "places")), strict=True):
            docs = np.frombuffer(places, np.int32).astype(np.int64) + block
            yield pa.RecordBatch.from_arrays([pa.array([term] * len(docs), pa.string()), pa.array(np.full(len(docs), block)), pa.array(docs)], names=["term", "block", "doc"])


#: What comes of a block, in this order.
ALL, SCOPE, POSTINGS, QUERY = range(4)


def _ranked(mean: float, n: int, scoped: bool, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, doc, score): of each block the n best documents of each of its queries, those of less than ``sure`` left out.

        Terms whose greatest impacts together stay below ``sure`` name no candidates: only documents of the others are scored. Terms
        add up in one order whatever names the candidates, so documents of equal words have equal scores.
        """
        at, held, norm, ranks, mask, scratch = None, {}, None, None, None, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                if row["block"] != at:
                    at, held, mask = row["block"], {}, None
                if row["kind"] == ALL:
                    norm = K1 * (1 - B + B * np.frombuffer(row["counts"], np.int32) / mean)
                    ranks, scratch = np.frombuffer(row["ranks"], np.int32), np.zeros(len(norm))
                    mask = np.full(len(norm), not scoped)
                elif row["kind"] == SCOPE:
                    mask[row["inside"]] = True
                elif row["kind"] == POSTINGS:
                    places, counts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int32)
                    impact = counts * (K1 + 1) / (counts + norm[places])
                    held[row["term"]] = row["weight"], places, impact, float(impact.max())
                for asked in row["asking"] or ():
                    parts = [held[x] for x in asked["terms"] if x in held]
                    least = -1.0 if asked["sure"] is None else asked["sure"] - 1e-6
                    if not parts or every and len(parts) < len(asked["terms"]) or sum(x[0] * x[3] for x in parts) < least:
                        continue
                    if asked["only"] is not None:
                        those = np.array(asked["only"], np.int64) - at
                    elif every:
                        those = min((x[1] for x in parts), key=len)
                    else:
                        naming, below = [], 0.0
                        for x in sorted(parts, key=lambda x: x[0] * x[3]):
                            below += x[0] * x[3]
                            if below >= least:
                                naming.append(x[1])
                        if len(naming) > 1:
                            for x in naming:
                                scratch[x] = 1.0
                            those = np.flatnonzero(scratch)
                            scratch[those] = 0.0
                        else:
                            those = naming[0] if naming else np.empty(0, np.int64)
                    those = those[mask[those]]
                    score = np.zeros(len(those))
                    for w, places, impact, _ in parts:
                        scratch[places] = impact
                        got = scratch[those]
                        scratch[places] = 0.0
                        if every:
                            keep = got > 0
                            those, score, got = those[keep], score[keep], got[keep]
                        score += w * got
                    score = np.floor(score * 1e6 + 0.5) / 1e6
                    keep = np.flatnonzero(score >= least)
                    if len(keep) > n:
                        keep = keep[score[keep] >= np.partition(score[keep], len(keep) - n)[len(keep) - n]]
                    keep = keep[np.lexsort((ranks[those[keep]], -score[keep]))[:n]]
                    out[0].append(np.full(len(keep), asked["q"]))
                    out[1].append(those[keep].astype(np.int64) + at)
                    out[2].append(score[keep])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["q", "doc", "score"])

    return run


def _top(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each ``by`` with their rank; Spark keeps n a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(c("rank") <= n)


@dataclass
class TextIndex:
    """``postings`` as written by ``build``; ``docs``: (number, key, and the columns that scopes may use)."""

    postings: DataFrame
    docs: DataFrame
    n_docs: int
    mean_length: float

    @staticmethod
    def build(docs: DataFrame, key: str = "doc_id", path: str | None = None) -> TextIndex:
        """Index ``text`` of all rows under ``path`` (a new scratch folder by default); the key is kept as ``key``.

        A null text has no words; rows of the same key are documents of their own. An empty table gives an empty index.
        """
        spark = docs.sparkSession
        path = path or f"{scratch(spark)}/text-index-{uuid.uuid4().hex}"
        others = [x for x in docs.columns if x not in (key, "text")]
        docs.select(F.monotonically_increasing_id().alias("number"), c(key).alias("key"), "text", *others).write.parquet(f"{path}/numbered")
        # files are read in order of number, each block by one task; a block ends where numbers jump
        made = spark.read.parquet(f"{path}/numbered").select("number", "key", "text").mapInArrow(_postings(1 << BLOCK_BITS), _POSTINGS)
        made.write.parquet(f"{path}/postings")
        return TextIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        postings = spark.read.parquet(f"{path}/postings")
        all_ = postings.where("term = ''").agg(F.sum("n").alias("n"), F.sum("total").alias("words")).first()
        n = all_["n"] or 0
        return TextIndex(postings, spark.read.parquet(f"{path}/numbered").drop("text"), n, (all_["words"] or 0) / n if n else 0.0)

    def weights(self, asked: DataFrame) -> DataFrame:
        """(term, t, weight) of the asked terms with numbers of their own; those that no document holds drop out."""
        df = self.postings.select("term", "n").join(asked.where("term <> ''").select("term").distinct(), "term").groupBy("term").agg(F.sum("n").cast("double").alias("df"))
        weight = F.log(1 + (self.n_docs - c("df") + 0.5) / (c("df") + 0.5))
        return cut(df.select("term", F.monotonically_increasing_id().alias("t"), weight.alias("weight")), "weights")

    def _found(self, cells: DataFrame, weights: DataFrame, n: int, scope: Column | None, every: bool = False) -> DataFrame:
        """(q, doc, key, score): the n best of each block for its queries: cells of (block, asking: array of q, terms, sure, only)."""
        blocks = cells.select("block").distinct()
        all_ = self.postings.where("term = ''").join(blocks, "block")
        rows = cells.withColumn("kind", F.lit(QUERY)).unionByName(all_.select("block", "counts", "ranks", F.lit(ALL).alias("kind")), allowMissingColumns=True)
        rows = rows.unionByName(self.postings.select("term", "block", "places", "counts").join(weights, "term").drop("term").withColumnRenamed("t", "term").join(blocks, "block", "left_semi").withColumn("kind", F.lit(POSTINGS)), allowMissingColumns=True)
        if scope is not None:
            each = all_.select("block", F.explode(F.sequence("block", c("block") + c("n") - 1)).alias("number")).join(self.docs.where(scope).select("number"), "number")
            rows = rows.unionByName(each.groupBy("block").agg(F.collect_list(c("number") - c("block")).alias("inside"), F.lit(SCOPE).alias("kind")), allowMissingColumns=True)
        dealt = rows.repartition("block").sortWithinPartitions("block", "kind")
        found = dealt.mapInArrow(_ranked(self.mean_length or 1.0, n, scope is not None, every), "q long, doc long, score double")
        return found.join(self.docs.select(c("number").alias("doc"), "key"), "doc").select("q", "doc", "key", "score")

    def search(self, asked: DataFrame, n: int, scope: Column | None = None, every: bool = False, first: int = FIRST) -> DataFrame:
        """(qid, key, score, rank): the n documents of greatest BM25 for each query's distinct terms, ties by key.

        ``asked`` has (qid, term), terms as ``words`` makes them. ``every``: only documents with all terms of a query.
        Document frequencies are those of the whole index, whatever the scope. A query without a known term finds nothing.
        Queries of the same terms are searched once.
        """
        order = [F.desc("score"), c("key").asc_nulls_last(), F.asc("doc")]
        terms = cut(asked.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("asked")), "asked")
        sets = cut(terms.select("asked").distinct().withColumn("q", F.monotonically_increasing_id()), "sets")
        weights = self.weights(asked)
        several = math.ceil(sets.count() / ASKING) or 1
        known = sets.select("q", F.size("asked").alias("size"), F.explode("asked").alias("term")).join(weights, "term").groupBy("q", "size").agg(F.array_sort(F.collect_list(F.struct("term", "t"))).alias("x"))
        known = cut((known.where(F.size("x") == c("size")) if every else known).select("q", c("x.t").alias("terms")), "known")
        blocks = self.postings.where("term = ''").select("block")
        opened = cut(blocks.orderBy(F.xxhash64("block"), "block").limit(first), "opened")

        def found(some: DataFrame, asking: DataFrame) -> DataFrame:
            packs = asking.groupBy(F.pmod(F.xxhash64("q"), F.lit(several)).alias("pack")).agg(F.collect_list(F.struct("q", "terms", "sure", F.lit(None).cast("array<bigint>").alias("only"))).alias("asking"))
            return self._found(cut(packs, "packs").crossJoin(F.broadcast(some)).select("block", "asking"), weights, n, scope, every)

        best = cut(_top(found(opened, known.withColumn("sure", F.lit(None).cast("double"))), "q", order, n), "best")
        sure = best.where(c("rank") == n).select("q", c("score").alias("sure"))
        rest = found(blocks.join(opened, "block", "left_anti"), known.join(sure, "q", "left"))
        top = _top(best.drop("rank").unionByName(rest), "q", order, n)
        return top.join(terms.join(sets, "asked").select("qid", "q"), "q").select("qid", "key", "score", "rank")

    def web_search(self, texts: DataFrame, expressions: dict[int, str], n: int, scope: Column | None = None, key: str = "doc_id") -> DataFrame:
        """(qid, key, score, rank) of web-style expressions: words are all wanted, "phrases" word by word, ``or`` between
        alternatives, a minus in front of what must not stand there. ``texts`` (key, text) are those of the index.

        The score is the BM25 of all words wanted. An expression that only excludes finds nothing.
        """
        spark = self.postings.sparkSession
        parsed = {q: parse_expression(e) for q, e in expressions.items()}
        wanted = [(q, i, " ".join(x)) for q, (clauses, _) in parsed.items() for i, clause in enumerate(clauses) for x in clause]
        banned = [(q, " ".join(x)) for q, (_, none) in parsed.items() for x in none]
        asked = spark.createDataFrame(sorted({(q, w) for q, _, x in wanted for w in x.split()}), "qid int, term string")
        weights = self.weights(asked)
        of = {x for _, _, x in wanted} | {x for _, x in banned}
        terms = spark.createDataFrame([(x, w) for x in sorted(of) for w in sorted(set(x.split()))], "part string, term string")
        docs = self.postings.where(c("term").isin(sorted({w for x in of for w in x.split()}))).select("term", "block", "places").mapInArrow(_numbers, "term string, block long, doc long")
        each = docs.join(terms, "term").groupBy("part", "block", "doc").agg(F.count("*").alias("held"))
        sizes = terms.groupBy("part").agg(F.count("*").alias("size"))
        held = each.join(sizes, "part").where("held = size").select("part", "block", "doc")
        # a phrase is looked for in the texts that hold all its words
        folded = F.regexp_replace(F.lower(F.translate("text", MARKED, PLAIN)), "[^a-z0-9]+", " ")
        phrases = held.where(F.contains("part", F.lit(" "))).join(self.docs.select(c("number").alias("doc"), "key"), "doc").join(texts.select(c(key).alias("key"), "text"), "key")
        phrases = phrases.where(F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), "part", F.lit(" ")))).select("part", "block", "doc").distinct()
        held = cut(held.where(~F.contains("part", F.lit(" "))).unionByName(phrases), "held")
        clauses = spark.createDataFrame(wanted, "qid int, clause int, part string")
        need = spark.createDataFrame([(q, len(x)) for q, (x, _) in parsed.items()], "qid int, need int")
        fits = held.join(clauses, "part").select("qid", "clause", "block", "doc").distinct().groupBy("qid", "block", "doc").agg(F.count("*").alias("met")).join(need, "qid").where("met = need")
        fits = fits.join(held.join(spark.createDataFrame(banned, "qid int, part string"), "part").select("qid", "doc"), ["qid", "doc"], "left_anti")
        asking = asked.join(weights, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "t"))).alias("x"))
        cells = fits.groupBy("qid", "block").agg(F.collect_list("doc").alias("only")).join(asking, "qid")
        one = F.struct(c("qid").cast("long").alias("q"), c("x.t").alias("terms"), F.lit(None).cast("double").alias("sure"), "only")
        cells = cut(cells.select("block", F.array(one).alias("asking")), "cells")
        found = self._found(cells, weights, n, scope)
        return _top(found.withColumn("qid", c("q").cast("int")), "qid", [F.desc("score"), c("key").asc_nulls_last(), F.asc("doc")], n).select("qid", "key", "score", "rank")


def parse_expression(text: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(clauses of alternative word lists, excluded word lists): a list of several words is a phrase."""
    clauses: list[list[list[str]]] = []
    none: list[list[str]] = []
    joined = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if bare.lower() == "or" and not minus:
            joined = bool(clauses)
            continue
        found = words(quoted or bare)
        if not found:
            continue
        if minus:
            none.append(found)
        elif joined:
            clauses[-1].append(found)
        else:
            clauses.append([found])
        joined = False
    return clauses, none


# -- vectors ------------------------------------------------------------------------------------


def _unit(values: list) -> np.ndarray | None:
    """The vector of length one, or None for null, empty, zero and unsound ones."""
    v = np.array([np.nan if x is None else x for x in values or []], float)
    size = float(np.sqrt(v @ v)) if len(v) else 0.0
    return v / size if np.isfinite(size) and size > 0 else None


def _centroids(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Mean directions of a bounded sample, begun with rows far from each other."""
    at = [0][: len(sample)]
    far = np.full(len(sample), np.inf)
    while len(at) < min(lists, len(sample)):
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
        at.append(int(far.argmax()))
    centres = sample[at]
    for _ in range(rounds if len(sample) else 0):
        near = (sample @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            total = sample[near == k].sum(axis=0)
            size = np.sqrt(total @ total)
            if size > 0:
                centres[k] = total / size
    return centres


def _listed(centres: np.ndarray, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(v.as_py()) for v in batch.column("embedding")]
            at = [i for i, u in enumerate(units) if u is not None and len(centres) and len(u) == centres.shape[1]]
            m = np.array([units[i] for i in at]).reshape(len(at), centres.shape[1])
            cosine = m @ centres.T
            near = cosine.argmax(axis=1) if at else np.empty(0, np.int64)
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[np.arange(len(at)), near]))
            rest = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array(near.astype(np.int32)), pa.array(apart), pa.array([x.tobytes() for x in m], pa.binary()), *(rest.column(x) for x in ("key", *others))]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "apart", "unit", "key", *others])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most PACK rows of one list: ids, units, least and greatest distance to the centroid."""
    for batch in batches:
        lists = batch.column("list").to_numpy()
        cuts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(lists)], strict=True):
            for at in range(lo, hi, PACK):
                part = batch.slice(at, min(PACK, hi - at))
                apart = part.column("apart").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(lists[lo])], pa.int32()), pa.array([part.column("key").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([b"".join(part.column("unit").to_pylist())], pa.binary()), pa.array([apart.min()]), pa.array([apart.max()])],
                    names=["list", "ids", "flat", "nearest", "farthest"],
                )


def _aimed(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(qid, unit, list, way, place): each query's lists from the nearest on."""
        for batch in batches:
            for qid, v in zip(batch.column("qid").to_pylist(), batch.column("embedding"), strict=True):
                u = _unit(v.as_py())
                if u is None or len(u) != centres.shape[1]:
                    continue
                way = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ u)))
                order = np.argsort(way, kind="stable")
                k = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * k, pa.int64()), pa.array([u.tobytes()] * k, pa.binary()), pa.array(order.astype(np.int32)), pa.array(way[order]), pa.array(np.arange(k, dtype=np.int32))], names=["qid", "unit", "list", "way", "place"],
                )

    return run


def _matched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n best rows of a block for each query of a pack."""
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                m = np.frombuffer(row["flat"], float).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, m = ids[order], m[order]
                q = np.array([np.frombuffer(x["unit"], float) for x in row["asking"]])
                score = q @ m.T
                score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
                for one, asking in zip(score, row["asking"], strict=True):
                    reach = asking["reach"]
                    if reach is not None and (asking["way"] - row["farthest"] > reach or row["nearest"] - asking["way"] > reach):
                        continue
                    fits = np.flatnonzero(ids != asking["own"]) if asking["own"] is not None else np.arange(len(ids))
                    best = fits[np.argsort(-one[fits], kind="stable")[:n]]
                    yield pa.RecordBatch.from_arrays([pa.array([asking["qid"]] * len(best), pa.int64()), pa.array(ids[best]), pa.array(one[best])], names=["qid", "key", "cosine"])

    return run


@dataclass
class VectorLists:
    """``rows``: (list, apart, unit, key, scope columns), near rows of a list together."""

    rows: DataFrame
    centres: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, key: str = "vec_id", lists: int = 16, sample: int = 4096, rounds: int = 8, path: str | None = None) -> VectorLists:
        """Lists of all rows of ``embedding``; centroids come from at most ``sample`` rows of least hash.

        Null, empty, zero and unsound vectors, those of another length than the first of the sample, and null keys
        are in no list.
        """
        spark = vectors.sparkSession
        path = path or f"{scratch(spark)}/vector-lists-{uuid.uuid4().hex}"
        others = [x for x in vectors.columns if x not in (key, "embedding")]
        named = vectors.where(c(key).isNotNull()).select(c(key).cast("long").alias("key"), "embedding", *others)
        drawn = [u for r in named.orderBy(F.xxhash64("key"), "key").limit(sample).collect() if (u := _unit(r["embedding"])) is not None]
        drawn = np.array([u for u in drawn if len(u) == len(drawn[0])]).reshape(-1, len(drawn[0]) if drawn else 1)
        centres = _centroids(drawn, lists, rounds)
        kind = ", ".join(["list int", "apart double", "unit binary", "key long", *(f"`{x}` {vectors.schema[x].dataType.simpleString()}" for x in others)])
        listed = named.mapInArrow(_listed(centres, others), kind)
        listed.repartition("list", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("list", "apart").write.parquet(f"{path}/rows")
        spark.createDataFrame([(json.dumps(centres.tolist()),)], "centres string").write.parquet(f"{path}/centres")
        return VectorLists(spark.read.parquet(f"{path}/rows"), centres)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorLists:
        return VectorLists(spark.read.parquet(f"{path}/rows"), np.array(json.loads(spark.read.parquet(f"{path}/centres").first()[0])))

    def search(self, queries: DataFrame, n: int, scope: Column | None = None, probes: int | None = None) -> DataFrame:
        """(qid, key, cosine, rank): the n rows of greatest cosine to each query (qid, embedding, own), ties by key.

        ``own`` is a key to leave out, or null. With ``probes`` only so many lists are read and
        rows may be missed; without, all lists that can matter are.
        """
        aimed = cut(queries.select(c("qid").cast("long").alias("qid"), "embedding").mapInArrow(_aimed(self.centres), "qid long, unit binary, list int, way double, place int").join(queries.select(c("qid").cast("long").alias("qid"), c("own").cast("long").alias("own")), "qid"), "aimed")
        rows = self.rows if scope is None else self.rows.where(scope)
        blocks = rows.select("list", "apart", "unit", "key").mapInArrow(_packed, "list int, ids binary, flat binary, nearest double, farthest double")
        blocks = cut(blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")), "blocks")

        several = math.ceil(queries.count() / ASKING) or 1

        def matched(asking: DataFrame) -> DataFrame:
            # queries of a list go in packs, each to all of the list's salts
            packs = asking.groupBy("list", F.pmod(F.xxhash64("qid"), F.lit(several)).alias("pack")).agg(F.collect_list(F.struct("qid", "unit", "way", "own", "reach")).alias("asking"))
            packs = cut(packs.select("list", "asking", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")), "packs")
            pairs = blocks.join(packs, ["list", "salt"]).select("ids", "flat", "nearest", "farthest", "asking")
            return _top(pairs.mapInArrow(_matched(n), "qid long, key long, cosine double"), "qid", [F.desc("cosine"), F.asc("key")], n)

        first = FIRST_LISTS if probes is None else probes
        best = matched(aimed.where(c("place") < first).withColumn("reach", F.lit(None).cast("double")))
        if probes is not None:
            return best
        best = cut(best, "nearest")
        sure = best.where(c("rank") == n).select("qid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (c("cosine") - 2e-6))).alias("reach"))
        rest = aimed.where(c("place") >= first).join(sure, "qid", "left")
        both = best.drop("rank").unionByName(matched(rest).drop("rank"))
        return _top(both, "qid", [F.desc("cosine"), F.asc("key")], n)


def fusion_weights(alpha: float | None) -> tuple[float, float]:
    """(text, vectors): alpha is the share of vectors; without one, or at one half, both weigh 1."""
    if alpha is None:
        return 1.0, 1.0
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be from 0 to 1, not {alpha}")
    return 2.0 * (1.0 - alpha), 2.0 * alpha


def hybrid(by_text: DataFrame, by_chunk: DataFrame, n: int, alpha: float | None = None) -> DataFrame:
    """(qid, key, score, chunks, rank): reciprocal ranks of two lists, weighed and summed per document.

    ``by_text`` has (qid, key, rank), ``by_chunk`` (qid, key, chunk, rank), where a document may have several chunks; their
    ids come joined by commas, best first. With ``alpha`` what only a list of no weight holds is left out.
    """
    text, vector = fusion_weights(alpha)
    parts = by_text.select("qid", "key", (F.lit(text) / (RRF_K + c("rank"))).alias("s"), F.lit(None).cast("struct<rank:int,chunk:bigint>").alias("x"))
    parts = parts.unionByName(by_chunk.select("qid", "key", (F.lit(vector) / (RRF_K + c("rank"))).alias("s"), F.struct("rank", c("chunk").cast("long").alias("chunk")).alias("x")))
    chunks = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["chunk"].cast("string")), ",")
    whole = parts.groupBy("qid", "key").agg(F.round(F.sum("s"), 8).alias("score"), chunks.alias("chunks"))
    return _top(whole.where("score > 0"), "qid", [F.desc("score"), c("key").asc_nulls_last()], n)
