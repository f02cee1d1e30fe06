"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Equal texts become one class representative, so copies never multiply later work.
2. A text's five-word shingles, weighted 1 + ln(count), sign it: every shingle is a Poisson
   process whose arrivals (exponential gaps of mean 1/weight, drawn from the shingle's own
   hash) fall on random registers; a register keeps its earliest arrival. A register of two
   texts agrees with the probability Jaccard similarity of their weights. Drawing stops as
   soon as the next arrival is later than every register.
3. 32 bands of 4 registers: at a probability Jaccard similarity of 0.8 all bands miss with
   probability 5e-8, at 0.6 with 0.012. A text of a shared bucket is paired with the bucket's
   least text, never with all.
4. Pairs are verified on whole texts: the exact Jaccard similarity of their shingle sets. It is
   the probability Jaccard similarity where no shingle stands twice in a text; a text that says
   the same passage oftener than its copy has a lower one, which the spare of step 3 is for.
5. Verified links give components. Texts in buckets that still hold two components are looked
   at again, so that no link is lost to the choice of the least text. A shingle that stands in
   one of these texts only belongs to no overlap: with n shingles, u of them its own, a text
   shares at most n - u with any other, which bounds the similarity of a pair. Where the bound
   is too low for every partner, the text leaves. The others are paired with their bucket's
   most central text (least share of own shingles).
6. What is open then is completed by an exact join on differences (``_completion``): texts are
   written as what they have more and less than most texts of their cluster, which for edited
   copies is little and different, where the copies' shingles themselves are nearly all the same.

Defined cases: null is the empty text; a text of fewer than five words has one shingle, all
its words; texts without a word are similar only to each other; repeated rows and equal
texts share a class; a class whose ids are all null has the class id null; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, free_name, materialize, mix64, numbered, slices, text_key, word_ids
from .graph import connected_components

REGISTERS = 128
BAND = 4
SHINGLE = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count), sorted by text and hash, over all texts."""
    ids, counts, vocab = word_ids(texts)
    codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
    words = codes[ids] if len(ids) else np.empty(0, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    left = ends[doc] - np.arange(len(words))  # words from here to the text's end
    h = np.full(len(words), np.uint64(width))
    for j in range(width):
        there = left > j
        h[there] = mix64((h[there] ^ words[np.flatnonzero(there) + j]) * _GOLD + np.uint64(j + 1))
    keep = left >= np.minimum(width, counts[doc])
    keep[starts[counts > 0]] = True
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x registers, uint64) of weighted sets given as (doc, element, weight) triples.

    Exact for any round size: each element's arrivals come in order from its own hash, and it
    leaves once its next arrival is later than all registers of its text.
    """
    best = np.full(n_docs * registers, np.inf)
    sign = np.zeros(n_docs * registers, np.uint64)
    live = np.arange(len(doc))
    clock = np.zeros(len(doc))
    turn = np.zeros(len(doc), np.uint64)
    total = np.bincount(doc, minlength=n_docs)
    # texts of few elements draw several arrivals a round
    burst = np.clip(registers // np.maximum(total, 1), 1, 64)
    while len(live):
        rounds = int(burst[doc[live]].max())
        for step in range(rounds):
            now = live[burst[doc[live]] > step] if step else live
            if not len(now):
                break
            r = mix64(element[now] + (turn[now] + np.uint64(1)) * _GOLD)
            clock[now] -= np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[now]
            slot = doc[now] * registers + (mix64(r ^ _GOLD) % np.uint64(registers)).astype(np.int64)
            turn[now] += np.uint64(1)
            early = np.flatnonzero(clock[now] < best[slot])
            early = early[np.argsort(-clock[now[early]], kind="stable")]  # the earliest is written last
            best[slot[early]] = clock[now[early]]
            sign[slot[early]] = element[now[early]]
        latest = best.reshape(n_docs, registers).max(axis=1)
        live = live[clock[live] < latest[doc[live]]]
    return sign.reshape(n_docs, registers)


def bands(texts: list[bytes], width: int = SHINGLE, registers: int = REGISTERS, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (texts x registers // band, int64) and numbers of shingles."""
    doc, element, count = shingles(texts, width)
    sign = probminhash(doc, element, 1.0 + np.log(count), len(texts), registers)
    parts = sign.reshape(len(texts), registers // band, band)
    h = np.broadcast_to(np.arange(registers // band, dtype=np.uint64) + np.uint64(1), parts.shape[:2]) * _GOLD
    for j in range(band):
        h = mix64((h ^ parts[:, :, j]) * _GOLD + np.uint64(j))
    return h.view(np.int64), np.bincount(doc, minlength=len(texts))


def jaccard(a: list[bytes], b: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of texts a[i] and b[i]."""
    n = len(a)
    doc, h, _ = shingles(a + b, width)
    sizes = np.bincount(doc, minlength=2 * n)
    pair = doc % max(1, n)
    order = np.lexsort((h, pair))
    p, x = pair[order], h[order]
    same = (p[1:] == p[:-1]) & (x[1:] == x[:-1])
    both = np.bincount(p[1:][same], minlength=n)
    union = sizes[:n] + sizes[n:] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _sign(width: int, registers: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), 2 << 20):
                h, n = bands(part, width, registers, band)
                rows = batch.slice(first, len(part)).select(["uid", "k1", "k2"])
                flat = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * h.shape[1], pa.array(np.ascontiguousarray(h).ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int32()), flat], names=["uid", "k1", "k2", "n", "bands"])

    return run


def _verify(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.column("text_b").cast(pa.binary())
            for first, part in slices(batch.column("text_a"), 1 << 20):
                s = jaccard(part, [x.as_py() or b"" for x in other.slice(first, len(part))], width)
                rows = batch.slice(first, len(part)).select(["a", "b"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], names=["a", "b", "similarity"]).filter(pa.array(s >= least))

    return run


def _spell_out(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for first, part in slices(batch.column("text"), 1 << 20):
                doc, h, _ = shingles(part, width)
                yield pa.RecordBatch.from_arrays([pa.array(uid[first + doc]), pa.array(h.view(np.int64))], names=["uid", "h"])

    return run


def _sets(width: int):
    """Rows (uid, cluster, n, text) to (uid, cluster, n, hs: the shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text"), 1 << 20):
                doc, h, _ = shingles(part, width)
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))]).astype(np.int32)
                rows = batch.slice(first, len(part)).select(["uid", "cluster", "n"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(edges, pa.array(h.view(np.int64)))], names=["uid", "cluster", "n", "hs"])

    return run


def _far(similarity: float, n: Column) -> Column:
    """Sets of n and m elements reach the similarity if and only if they differ in at most _far(n) + _far(m) elements."""
    return F.lit((1 - similarity) / (1 + similarity) * (1 + 1e-9)) * n


class _Classes:
    """Verified links, and the label (least text) of each linked text's component."""

    def __init__(self, texts: DataFrame, width: int, similarity: float):
        self.texts, self.width, self.similarity = texts, width, similarity
        self.label: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) on whole texts and join the components of those that are links."""
        with_a = pairs.join(self.texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(self.texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
        links = materialize(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify(self.width, self.similarity), "a long, b long, similarity double"), "links")
        if self.label is None:
            self.label = materialize(connected_components(links), "labels")
            discard(links)
        elif not links.isEmpty():
            # components are linked, not texts: the graph shrinks from round to round
            edges = self.of(self.of(links.select("a", "b"), "a"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
            merged = materialize(connected_components(edges), "merged")
            known = self.label.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("label"))).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")))
            known = known.groupBy("node").agg(F.min("label").alias("label"))
            label = known.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
            self.label = materialize(label, "labels")

    def of(self, rows: DataFrame, node: str = "uid") -> DataFrame:
        """``rows`` with the label of ``node``, its own number if it has no link."""
        name = "label" if node == "uid" else f"label_{node}"
        return rows.join(self.label.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows (with labels) whose ``key`` is of more than one component."""
    keys = rows.groupBy(key).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(key)
    return rows.join(materialize(keys, "several"), key)


def _differences(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What sets (uid, cluster, n, hs) hold that their cluster's majority does not, and the other way round.

    Returns (uid, cluster, label, n, size: elements in which it differs) and (uid, e: the element; negative is
    told from positive by ``less``). Two sets of a cluster differ from each other in exactly the
    elements that one of these two lists has and the other has not.
    """
    spread = sets.select("cluster", F.explode("hs").alias("h"))
    members = sets.groupBy("cluster").agg(F.count("*").alias("m"))
    counts = spread.groupBy("cluster", "h").agg(F.count("*").alias("k"))
    major = counts.join(materialize(members, "sizes"), "cluster").where("2 * k > m").groupBy("cluster").agg(F.collect_list("h").alias("zs"))
    both = sets.join(materialize(major, "majority"), "cluster", "left").withColumn("zs", F.coalesce("zs", F.array().cast("array<long>")))
    both = both.select("uid", "cluster", "n", F.array_except("hs", "zs").alias("more"), F.array_except("zs", "hs").alias("less"))
    both = materialize(both, "differences")
    sizes = both.select("uid", "cluster", "n", (F.size("more") + F.size("less")).alias("size"))
    parts = [both.select("uid", "cluster", F.explode(side).alias("h"), F.lit(side == "less").alias("less")) for side in ("more", "less")]
    return sizes, parts[0].unionByName(parts[1])


def _completion(classes: _Classes, left: DataFrame, similarity: float) -> None:
    """Find what links are left between texts of one bucket and different components. ``left``: (band, uid, n, label).

    Texts that buckets connect form a cluster. Every text is written as its difference from the shingles that
    most texts of the cluster have; two texts are similar if and only if |D| + |E| - 2 * |D and E| is at most
    far(n) + far(m). So with gap = |D| - far(n), a pair of gaps that sum to 0 or less is similar: the text of
    the least gap links all these. Any other pair must share (gap + gap') / 2 elements of its differences, and
    elements that texts of a single component have are of no use for that. Texts that can't have so many leave;
    of the others, the rarest elements are matched (prefix filter): each so many that no pair can be missed.
    """
    stars = left.groupBy("band").agg(F.min("uid").alias("a"))
    stars = left.select("band", F.col("uid").alias("b")).join(materialize(stars, "stars"), "band").select("a", "b")
    cluster = materialize(connected_components(stars), "clusters")
    among = left.select("uid", "n").distinct().join(cluster.select(F.col("node").alias("uid"), F.col("label").alias("cluster")), "uid")
    sets = among.join(classes.texts, "uid").select("uid", "cluster", "n", "text").mapInArrow(_sets(classes.width), "uid long, cluster long, n int, hs array<long>")
    sets = materialize(sets, "sets")
    sizes, elements = _differences(sets)
    sizes = materialize(sizes.withColumn("gap", F.col("size") - _far(similarity, F.col("n"))), "gaps")
    pivot = sizes.groupBy("cluster").agg(F.min(F.struct("gap", "uid")).alias("p")).select("cluster", F.col("p.gap").alias("gap_b"), F.col("p.uid").alias("uid_b"))
    near = sizes.join(materialize(pivot, "pivots"), "cluster").where("uid <> uid_b and gap + gap_b <= 0")
    classes.add(near.select(F.least("uid", "uid_b").alias("a"), F.greatest("uid", "uid_b").alias("b")))
    able = sizes.select("uid", "cluster", "n", "gap")
    for _ in range(3):
        # elements that only texts of one component have are shared by no pair that matters
        named = materialize(classes.of(elements.join(able.select("uid", "n", "gap"), "uid")), "named")
        useful = named.groupBy("cluster", "h", "less").agg(F.count("*").alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").drop("x", "y")
        named = materialize(named.join(materialize(useful, "useful"), ["cluster", "h", "less"]), "named")
        d = named.groupBy("uid", "cluster", "n", "gap", "label").agg(F.count("*").alias("d"))
        d = materialize(d, "able")
        least = d.groupBy("cluster").agg(F.min("gap").alias("low"), F.max(2 * F.col("d") - F.col("gap")).alias("reach"))
        need = F.greatest(F.lit(1), F.ceil((F.col("gap") + F.col("low")) / 2)).cast("int")
        able = d.join(materialize(least, "least"), "cluster").withColumn("need", need).where("d >= need and gap <= reach")
        able = materialize(able.select("uid", "cluster", "label", "n", "gap", "d", "need"), "able")
    rare_first = Window.partitionBy("uid").orderBy("k", "h", "less")  # a window of one text's elements
    placed = named.select("uid", "h", "less", "k").join(able, "uid").withColumn("place", F.row_number().over(rare_first)).where("place <= d - need + 1")
    placed = materialize(placed.withColumn("rest", F.col("d") - F.col("place") + 1).drop("k", "d", "need", "place"), "placed")
    other = placed.select("cluster", "h", "less", *[F.col(c).alias(f"{c}_b") for c in ("uid", "label", "gap", "rest")])
    shared = (F.col("gap") + F.col("gap_b")) / 2
    pairs = placed.join(other, ["cluster", "h", "less"]).where((F.col("uid") < F.col("uid_b")) & (F.col("label") != F.col("label_b")) & (F.least("rest", "rest_b") >= shared))
    classes.add(materialize(pairs.select(F.col("uid").alias("a"), F.col("uid_b").alias("b")).distinct(), "last"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = SHINGLE, similarity: float = 0.8,
    registers: int = REGISTERS, band: int = BAND,
) -> DataFrame:
    """One row per input row: (uid, id, class_uid, class_id).

    uid is a number of the row; class_uid is the uid of the class's kept row and class_id its id, the least
    non-null id of the class.
    """
    return _classify(numbered(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "uid"), width, similarity, registers, band)


def _classify(rows: DataFrame, width: int, similarity: float, registers: int, band: int) -> DataFrame:
    """``near_duplicates`` of rows (uid, id, text)."""
    rows = rows.select("uid", "id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("uid", "id", "text", *text_key(F.col("text")))
    signed = materialize(rows.select("uid", "k1", "k2", "text").mapInArrow(_sign(width, registers, band), "uid long, k1 long, k2 long, n int, bands array<long>"), "signed")
    reps = signed.groupBy("k1", "k2").agg(F.min("uid").alias("rep"))
    one = signed.join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi")
    slots = materialize(one.select("uid", F.explode("bands").alias("band")), "slots")
    # what a join meets is written first: a join whose sides both are shuffled can split a hot key
    shared = materialize(slots.groupBy("band").agg(F.min("uid").alias("pivot"), F.max("uid").alias("last")).where("pivot < last"), "shared")
    buckets = materialize(slots.join(shared.select("band", "pivot"), "band"), "buckets")
    discard(slots)
    first = buckets.where("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
    texts = materialize(rows.select("uid", "text").join(buckets.select("uid").distinct(), "uid", "left_semi"), "texts")
    classes = _Classes(texts, width, similarity)
    classes.add(first)

    rest = materialize(_several(classes.of(buckets.select("band", "uid")), "band"), "open")
    words = texts.join(rest.select("uid").distinct(), "uid", "left_semi").mapInArrow(_spell_out(width), "uid long, h long")
    lone = words.groupBy("h").agg(F.count("*").alias("k"), F.min("uid").alias("uid")).where("k = 1").groupBy("uid").agg(F.count("*").alias("u"))
    bound = signed.select("uid", "n").join(rest.select("uid").distinct(), "uid", "left_semi").join(lone, "uid", "left")
    bound = bound.select("uid", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("common")).where(F.col("common") >= similarity * F.col("n"))
    rest = materialize(_several(rest.join(bound, "uid"), "band"), "bounded")

    # the most central text of each bucket: the least share of shingles of its own
    best = rest.groupBy("band").agg(F.min(F.struct(F.coalesce(1 - F.try_divide("common", "n"), F.lit(0.0)).alias("own"), "uid", "label", "n", "common")).alias("c"))
    best = best.select("band", *[F.col(f"c.{k}").alias(f"{k}_b") for k in ("uid", "label", "n", "common")])
    fewer = F.least("common", "common_b")
    may = fewer >= F.lit(similarity) * (F.col("n") + F.col("n_b") - fewer)
    central = rest.join(materialize(best, "central"), "band").where((F.col("label") != F.col("label_b")) & may)
    classes.add(central.select(F.least("uid", "uid_b").alias("a"), F.greatest("uid", "uid_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    left = materialize(_several(classes.of(rest.select("band", "uid", "n")), "band"), "left")
    if not left.isEmpty():
        _completion(classes, left, similarity)

    member = rows.select("uid", "id", "k1", "k2").join(materialize(reps, "reps"), ["k1", "k2"])
    member = classes.of(member.withColumnRenamed("uid", "row").withColumnRenamed("rep", "uid"))
    member = materialize(member.select(F.col("row").alias("uid"), "id", F.col("label").alias("class")), "members")
    kept = member.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("k"))
    kept = materialize(kept.select("class", F.col("k.uid").alias("class_uid"), F.col("k.id").alias("class_id")), "kept")
    return member.join(kept, "class").select("uid", "id", "class_uid", "class_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = SHINGLE, similarity: float = 0.8,
    registers: int = REGISTERS, band: int = BAND,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one of the least id (of equal ones, the first row)."""
    name = free_name(docs.columns, "uid")
    rows = numbered(docs, name)
    named = rows.select(F.col(name).alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = _classify(named, width, similarity, registers, band).where("uid = class_uid").select(F.col("uid").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
