"""Text and vectors: chunks, term coverage, fusion of rankings, nearest vectors, language marks, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.functions.scalars import fold
from tendersieve.sources.files import cut

c = F.col

#: Frequent words of each language; fixed values.
MARKERS = {"en": ("the", "and", "with"), "de": ("der", "und", "mit"), "es": ("el", "los", "con"), "fr": ("le", "les", "avec")}


def term_coverage(docs: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Documents by the summed weight ln(1 + N / df) of the terms they hold.

    Each term is looked for as a word; what was found is written once, and weights, sums and N come from it.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    found = F.array_compact(F.array(*[F.when(F.contains(c("t"), fold(F.lit(f" {t} "))), F.lit(t)) for t in terms]))
    marked = cut(docs.select("doc_id", padded.alias("t")).select("doc_id", found.alias("found")), "marked")
    total = marked.agg(F.count("*").alias("n_docs"))
    each = marked.select("doc_id", F.explode("found").alias("term"))
    weight = each.groupBy("term").agg(F.count("*").alias("df")).crossJoin(total).select("term", F.log(1 + c("n_docs") / c("df")).alias("w"))
    scored = each.join(weight, "term").groupBy("doc_id").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("terms"))
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(n)


def chunks(docs: DataFrame, size: int, step: int) -> DataFrame:
    """(doc_id, chunk, start, body): pieces of ``size`` characters every ``step``, the last as long as what is left."""
    length = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step))
    rows = docs.where(length > 0).select("doc_id", "text", F.posexplode(F.filter(starts, lambda s: (s == 0) | (s + (size - step) < length))).alias("chunk", "start"))
    return rows.select("doc_id", "chunk", "start", F.substring("text", c("start") + 1, F.lit(size)).alias("body"))


def best_chunk(pieces: DataFrame, terms: list[str]) -> DataFrame:
    """Each document's chunk with most of the terms, the earliest of ties."""
    hits = sum((F.when(F.contains(F.lower("body"), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    best = F.max_by(F.struct("chunk", "hits"), F.struct("hits", -c("chunk"))).alias("x")
    return pieces.withColumn("hits", hits).where("hits > 0").groupBy("doc_id").agg(best).select("doc_id", "x.chunk", "x.hits")


def fused(rankings: list[tuple[float, DataFrame]], key: str, n: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank)."""
    parts = [df.select(key, (F.lit(w) / (F.lit(k) + c("rank"))).alias("s")) for w, df in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(key).agg(F.round(F.sum("s"), 8).alias("score"), F.count("*").alias("lists")).orderBy(F.desc("score"), F.asc(key)).limit(n)


def ranked(rows: DataFrame, order: list[Column], key: str, n: int) -> DataFrame:
    """The first n of a ranking with their rank; only n rows reach the window."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, "rank")


def _pack(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                rows = [np.array(v if v is not None else [], float) for v in part.column("embedding").to_pylist()]
                size = np.array([len(v) for v in rows], np.int64)
                flat = np.full((len(rows), max(1, size.max())), 0.0)
                for i, v in enumerate(rows):
                    flat[i, : len(v)] = v
                ids = part.column("vec_id").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, size, flat)], names=["ids", "sizes", "flat"])

    return run


def _best(n: int):
    def unpack(ids: bytes, sizes: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, k = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        m = np.frombuffer(flat, float).reshape(len(i), -1)
        norm = np.sqrt((m * m).sum(axis=1))
        return i, k, m, norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v, q = (unpack(*[batch.column(f"{side}{x}")[r].as_py() for x in ("ids", "sizes", "flat")]) for side in ("", "q_"))
                order = np.argsort(v[0], kind="stable")
                ids, sizes, m, norm = (x[order] for x in v)
                width = min(m.shape[1], q[2].shape[1])
                with np.errstate(all="ignore"):
                    score = q[2][:, :width] @ m[:, :width].T / (q[3][:, None] * norm)
                score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
                score[(q[1][:, None] != sizes) | ~np.isfinite(score)] = -np.inf
                other = q[0][:, None] != ids
                # ids rise, so that a stable sort sends ties to the least id; a row itself comes behind all
                first = np.argsort(np.where(other, -score, np.nan), axis=1, kind="stable")[:, :n]
                at = np.arange(len(q[0]))[:, None]
                keep = other[at, first]
                best = score[at, first][keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(q[0][:, None], first.shape)[keep]), pa.array(ids[first][keep]), pa.array(best, mask=np.isinf(best))], names=["query_id", "vec_id", "cosine"],
                )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, n: int, block: int = 1024) -> DataFrame:
    """The n other vectors of greatest cosine to each query vector (any number of rows); ties go to the least id.

    Both sides are packed into blocks of at most ``block`` rows; of every two blocks each query keeps its
    best n. Pairs without a cosine (null, zero, of different length) come last, with null.
    """
    spark = vectors.sparkSession
    sides = [cut(rows.where("vec_id is not null").select(c("vec_id").cast("long"), "embedding").mapInArrow(_pack(block), "ids binary, sizes binary, flat binary"), "vectors") for rows in (vectors, queries)]
    pairs = sides[0].repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).crossJoin(sides[1].select(*[c(x).alias(f"q_{x}") for x in ("ids", "sizes", "flat")]))
    scored = pairs.mapInArrow(_best(n), "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def language(text: Column) -> Column:
    """The language whose marker words stand most often; ties go to the first by name; und without any."""
    own = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    counts = [F.struct(F.negative(sum((F.regexp_count(own, F.lit(f" {w}(?= )")) for w in ws), F.lit(0))).alias("n"), F.lit(k).alias("k")) for k, ws in sorted(MARKERS.items())]
    best = F.array_min(F.array(*counts))
    return F.when(best["n"] == 0, "und").otherwise(best["k"])


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))
