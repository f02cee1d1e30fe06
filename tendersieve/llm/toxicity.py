"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

1. A bounded sample of labelled texts (``sample`` rows of least id hash) gives the terms: words, word
   beginnings, and beginnings of several different words, whose log-likelihood ratio ties them to label 1,
   the ``terms`` strongest of them. Copies would vote for all their words at once, so texts of the same
   least shingle count once.
2. One pass over all whole texts writes each text's terms and their counts. Document frequencies come from
   all of them; a weight is (1 + ln(count)) * idf, a vector is divided by its norm.
3. At most ``examples`` of the sample's vectors form an inverted index: a posting list a term, cut into
   blocks of neighbouring examples with the greatest weight of each. A query adds up these maxima, opens
   blocks by falling bound and stops when no bound reaches its k-th cosine, so that what it finds is exact.
4. The k nearest vote with their cosines as weights, against a prior of the base rate. An isotonic fit on the
   examples themselves (each without its own vote) turns votes into probabilities; a text
   without any term gets the smoothed rate of such texts in the sample.

The model's size is bounded by ``examples * terms`` postings whatever the tables' size, so it goes along
with the tasks. Labels, languages and sources are no inputs of a score.

Defined cases: a null text is empty; an empty text has no terms. A label that is null doesn't count; of several
labels of an id the greatest counts; a null id has no label but gets a score. Repeated rows are scored alike,
and ties between neighbours go to the least place in the index, which is in order of heaviest term,
then id. Words over ``LONGEST`` characters are known by their beginnings only. Without labels all
scores are 0.5, with labels of one kind near that kind. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import discard, free_name, materialize

WORD = re.compile(r"[^\W_]+")
GAP = re.compile(r"[\W_]")
#: Lengths of the beginnings that are terms besides the word; they end in a mark that no word has.
BEGINNINGS = (4, 5, 6)
MARK = "*"
#: Numbers of different words of one beginning that are a term of their own: a cosine forgets how often a lone term stands.
FAMILIES = (2, 3, 4, 6, 8, 12)
LONGEST = 40
BLOCK = 64
SHINGLE = 5
PIECE = 1 << 20
_KNOWN = 1 << 19


def word_counts(text: str) -> Counter[str]:
    """How often each word stands in a lower-cased text, read in pieces that end between words."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        stop = len(text)
        if at + PIECE < stop and (gap := GAP.search(text, at + PIECE)):
            stop = gap.start() + 1
        found.update(WORD.findall(text[at:stop].lower()))
        at = stop
    return found


def beginnings(word: str) -> list[str]:
    return [word[:n] + MARK for n in BEGINNINGS if len(word) > n]


def terms_of(words: Counter[str]) -> set[str]:
    """All terms of a text: its words, their beginnings, and those that begin at least so many different words."""
    families = Counter(b for w in words for b in beginnings(w))
    several = (f"{b}{n}" for b, size in families.items() if size >= FAMILIES[0] for n in FAMILIES if n <= size)
    return {w for w in words if len(w) <= LONGEST}.union(families, several)


def least_shingle(text: str) -> int:
    """The least hash of the text's five-word shingles: equal in near copies more often than not."""
    words = [xxhash.xxh64_intdigest(w.encode()) for w in WORD.findall(text.lower())]
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(str(words).encode()) >> 1
    h = np.array(words, np.uint64)
    mixed = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        mixed = (mixed ^ h[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return int(mixed.min()) >> 1


@dataclass
class Index:
    """Examples by falling place: vectors as postings a term, with the greatest weight of each block of places."""

    ids: np.ndarray
    labels: np.ndarray
    order: np.ndarray  # the row that each place was given as
    places: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray  # of a term's blocks
    blocks: np.ndarray
    maxima: np.ndarray
    block_at: np.ndarray  # first posting of a term's block, one more at the end

    @staticmethod
    def of(ids: list, labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), str(ids[i]).zfill(20), i))
        term = np.concatenate([np.empty(0, np.int64), *[vectors[i][0] for i in order]]).astype(np.int64)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.empty(0), *[vectors[i][1] for i in order]])
        by = np.lexsort((place, term))
        term, place, weight = term[by], place[by], weight[by]
        cell = term * (len(order) // BLOCK + 1) + place // BLOCK
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        return Index(
            np.array([ids[i] for i in order], object), np.array([labels[i] for i in order], np.int64), np.array(order, np.int64), place, weight,
            np.searchsorted(term[new], np.arange(n_terms + 1)), place[new] // BLOCK, np.maximum.reduceat(weight, new) if len(new) else weight, np.append(new, len(cell)),
        )

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples that share a term with the vector, nearest first; ``without`` leaves a place out."""
        bound = np.zeros(len(self.ids) // BLOCK + 1)
        spans = [(w, self.block_starts[t], self.block_starts[t + 1]) for t, w in zip(term, weight, strict=True)]
        for w, lo, hi in spans:
            bound[self.blocks[lo:hi]] += w * self.maxima[lo:hi]
        places, scores = np.empty(0, np.int64), np.empty(0)
        least = 0.0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or bound[block] * (1 + 1e-12) < least:
                break
            here = np.zeros(BLOCK)
            for w, lo, hi in spans:
                at = lo + np.searchsorted(self.blocks[lo:hi], block)
                if at < hi and self.blocks[at] == block:
                    posting = slice(self.block_at[at], self.block_at[at + 1])
                    here[self.places[posting] - block * BLOCK] += w * self.weights[posting]
            found = np.flatnonzero(here > 0)
            places, scores = np.append(places, found + block * BLOCK), np.append(scores, here[found])
            if without >= 0:
                scores, places = scores[places != without], places[places != without]
            first = np.lexsort((places, -scores))[:k]
            places, scores = places[first], scores[first]
            least = scores[-1] if len(scores) == k else 0.0
        return places, np.minimum(scores, 1.0)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the rising least-squares fit: (greatest x of each step, its value, smoothed by one half on either side)."""
    at, group = np.unique(x, return_inverse=True)
    steps: list[list[float]] = []  # sum, size, greatest x
    for top, total, size in zip(at, np.bincount(group, y), np.bincount(group), strict=True):
        steps.append([total, size, top])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            total, size, top = steps.pop()
            steps[-1] = [steps[-1][0] + total, steps[-1][1] + size, top]
    return np.array([s[2] for s in steps]), np.maximum.accumulate([(s[0] + 0.5) / (s[1] + 1) for s in steps])


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: Index
    k: int
    base: float
    without: float  # score of a text that has no term
    steps: np.ndarray
    values: np.ndarray

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        return w / math.sqrt(float(w @ w))

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1, neighbours weighted by cosine against one neighbour's worth of base rate at most."""
        prior = max(0.05, 1.0 - float(cosines.max(initial=0.0)))
        return (float(cosines @ self.index.labels[places]) + prior * self.base) / (float(cosines.sum()) + prior)

    def calibrated(self, vote: float) -> float:
        if not len(self.steps):
            return self.base
        return float(self.values[min(np.searchsorted(self.steps, vote - 1e-12), len(self.steps) - 1)])

    def score(self, term: np.ndarray, count: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        places, cosines = self.index.nearest(term, self.vector(term, count), self.k, without)
        return self.vote(places, cosines), places, cosines


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, texts of label 0, of label 1) of each batch's texts."""
    for batch in batches:
        sums: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            sums[label.as_py()].update(terms_of(word_counts(text.as_py())))
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[t] for t in names], pa.int64()) for s in sums]], names=["term", "clean", "toxic"])


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([least_shingle(t.as_py()) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "shingle"])


def _counted(terms: dict[str, int]):
    heads = {t[: t.index(MARK) + 1] for t in terms if MARK in t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}  # the wanted of a word's own term and beginnings
        for batch in batches:
            ids, counts = [], []
            for text in batch.column("text"):
                own: Counter[str] = Counter()
                families: Counter[str] = Counter()
                for word, n in word_counts(text.as_py() or "").items():
                    held = known.get(word)
                    if held is None:
                        held = tuple(b for b in beginnings(word) if b in heads) + ((word,) if word in terms else ())
                        if len(known) >= _KNOWN:
                            known.clear()
                        if len(word) <= LONGEST:
                            known[word] = held
                    for t in held:
                        own[t] += n
                        families[t] += 1
                for t, size in families.items():
                    if size >= FAMILIES[0] and t[-1] == MARK:
                        own.update({f"{t}{n}": 1 for n in FAMILIES if n <= size})
                found = sorted((terms[t], n) for t, n in own.items() if t in terms)
                ids.append([t for t, _ in found])
                counts.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "terms", "counts"])

    return run


def term_counts(docs: DataFrame, terms: dict[str, int], id_column: str = "doc_id") -> DataFrame:
    """(id, terms array<int>, counts array<long>) of every whole text."""
    kind = StructType([StructField("id", docs.schema[id_column].dataType), StructField("terms", ArrayType(IntegerType())), StructField("counts", ArrayType(LongType()))])
    return docs.select(F.col(id_column).alias("id"), "text").mapInArrow(_counted(terms), kind)


def labelled_sample(labels: DataFrame, sample: int, id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    """(id, label): at most ``sample`` labelled ids, those of least hash. A rate taken from their number bounds what is sorted."""
    each = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) >= 1).cast("int").alias("label"))
    hashed = each.withColumn("at", F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 1))
    n = hashed.count()
    rate = int(min(1.0, 1.5 * sample / max(n, 1)) * 2**31)
    return hashed.where(F.shiftrightunsigned("at", 32) < rate).orderBy("at", "id").limit(sample).select("id", "label")


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, terms: int = 1024, examples: int = 4096, k: int = 16, least_llr: float = 30.0, id_column: str = "doc_id") -> tuple[Model, DataFrame]:
    """(model, written term counts of all of ``docs``): ``score`` reads the latter."""
    ids = materialize(labelled_sample(labels, sample, id_column), "labelled")
    own = docs.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # a repeated id counts once; the sample's ids are at most ``sample`` rows
    texts = own.join(F.broadcast(ids), "id").mapInArrow(_least_shingles, StructType([*own.schema.fields, StructField("label", IntegerType()), StructField("shingle", LongType())]))
    texts = materialize(texts.groupBy("shingle").agg(F.min_by(F.struct("id", "text", "label"), F.struct("id", "text")).alias("x")).select("x.*"), "sampled")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    sums = texts.select("text", "label").mapInArrow(_partial_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    # a term of a toxic texts has a ratio of at most 2 a ln(all / toxic): fewer can't reach the least one
    fewest = least_llr / (2 * math.log((clean + toxic) / toxic)) if toxic and clean else 0
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    strong = sums.where(a >= fewest).where(a * clean > b * toxic)
    share = (a + b) / F.lit(float(max(1, clean + toxic)))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    llr = 2 * (part(a, toxic * share) + part(b, clean * share) + part(toxic - a, toxic * (1 - share)) + part(clean - b, clean * (1 - share)))
    chosen = [r["term"] for r in strong.select("term", F.round(llr, 6).alias("llr")).where(F.col("llr") >= least_llr).orderBy(F.desc("llr"), "term").limit(terms).collect()]
    place = {t: i for i, t in enumerate(chosen)}
    counted = materialize(term_counts(docs, place, id_column), "terms")
    n_docs = counted.count()
    df = np.zeros(len(place))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row a term
        df[r["t"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    kept = materialize(term_counts(texts.select(F.struct("id", "label").alias("x"), "text"), place, "x").select("id.*", "terms", "counts"), "examples")
    bare = {r["label"]: r["n"] for r in kept.where(F.size("terms") == 0).groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = kept.where(F.size("terms") > 0).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "terms", "counts").limit(examples).collect()
    base = (toxic + 0.5) / (clean + toxic + 1)
    empty = np.empty(0)
    model = Model(place, idf, Index.of([], [], [], len(place)), k, base, (bare.get(1, 0) + base) / (sum(bare.values()) + 1), empty, empty)
    vectors = [(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in rows]
    model.index = Index.of([r["id"] for r in rows], [r["label"] for r in rows], [(t, model.vector(t, n)) for t, n in vectors], len(place))
    if rows:
        at = np.argsort(model.index.order)
        votes = [model.score(t, n, at[i])[0] for i, (t, n) in enumerate(vectors)]
        model.steps, model.values = _isotonic(np.array(votes), np.array([r["label"] for r in rows], float))
    discard(ids, texts, kept)
    return model, counted


def _scored(model: Model, evidence: int, ids: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, list]] = {}
        for batch in batches:
            scores, found = [], []
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                if not len(terms):
                    scores.append(model.without)
                    found.append([])
                    continue
                t, n = terms.values.to_numpy().astype(np.int64), counts.values.to_numpy()
                key = (t.tobytes(), n.tobytes())
                if key not in known:
                    vote, places, cosines = model.score(t, n)
                    if len(known) >= 1 << 16:
                        known.clear()
                    known[key] = (model.calibrated(vote), [{"id": model.index.ids[p], "cosine": float(s), "label": int(model.index.labels[p])} for p, s in zip(places[:evidence], cosines[:evidence], strict=True)])
                score, near = known[key]
                scores.append(score)
                found.append(near)
            kind = pa.list_(pa.struct([("id", ids), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["id", "score", "evidence"])

    return run


def score(counted: DataFrame, model: Model, evidence: int = 5) -> DataFrame:
    """(id, score, evidence): a probability of label 1 for each row of ``term_counts``, with its nearest examples."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = counted.schema["id"].dataType
    near = ArrayType(StructType([StructField("id", kind), StructField("cosine", DoubleType()), StructField("label", IntegerType())]))
    return counted.mapInArrow(_scored(model, evidence, to_arrow_type(kind)), StructType([StructField("id", kind), StructField("score", DoubleType()), StructField("evidence", near)]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", **limits) -> DataFrame:
    """(id, score, predicted, evidence) of every row of ``docs``; ``limits`` are those of ``fit``.

    The id keeps its name.
    """
    model, counted = fit(docs, labels, id_column=id_column, **limits)
    found = score(counted, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return found.withColumnRenamed("id", free_name([c for c in found.columns if c != "id"], id_column))
