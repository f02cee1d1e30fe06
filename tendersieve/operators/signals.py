"""Technology signals in tender documents: many terms at once by an automaton, counted with caps, judged and merged into labels."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersieve.operators.retrieval import words
from tendersieve.sources.files import cut

c = F.col

#: Weight of a mention by kind of document, and for all other kinds; the kinds of which one must mention a label. Fixed values.
KIND_WEIGHTS = {"technical": 1.0, "additional": 0.6, "legal": 0.3}
OTHER_WEIGHT = 0.3
LABELLING = ("technical", "additional")
#: Weighted mentions of a term that count at most, that a label needs, and at which its score is 1; firm terms a category needs. Fixed values.
TERM_CAP, LEAST_HITS, SATURATION, CATEGORY_TERMS = 3.0, 2.0, 6.0, 2
#: Characters of dictionary that one automaton takes; a larger dictionary goes in several passes.
AUTOMATON = 1 << 22


def _automaton(terms: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Of (label, term): spellings with and without a plural ending of the last word, each leading to its terms."""
    found: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
    for label, term in terms:
        own = words(term)
        if own:
            for ending in ("", "s", "es"):
                found[f" {' '.join(own)}{ending} "].append((label, " ".join(own), len(own)))
    out = ahocorasick.Automaton()
    for spelling, of in found.items():
        out.add_word(spelling, (len(spelling), of))
    if len(out):
        out.make_automaton()
    return out


def mentions(text: str, automaton: ahocorasick.Automaton) -> Counter[tuple[str, str]]:
    """How often each (label, term) is meant: of terms of one label that overlap, the first counts, the longest of those that begin together."""
    own = words(text)
    starts, at = {}, 0
    for i, w in enumerate(own):
        starts[at] = i
        at += len(w) + 1
    spans: dict[str, list[tuple[int, int, str]]] = defaultdict(list)
    for end, (size, of) in automaton.iter(f" {' '.join(own)} "):
        for label, term, n in of:
            spans[label].append((starts[end - size + 1], -n, term))
    out: Counter[tuple[str, str]] = Counter()
    for label, found in spans.items():
        free = 0
        for first, n, term in sorted(found):
            if first >= free:
                out[label, term] += 1
                free = first - n
    return out


def _counted(parts: list[list[tuple[str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [a for part in parts if len(a := _automaton(part))]
        for batch in batches:
            rows = []
            for tender, kind, text in zip(batch.column("tender").to_pylist(), batch.column("kind").to_pylist(), batch.column("text"), strict=True):
                for automaton in automata:
                    rows += [(tender, kind, label, term, n) for (label, term), n in mentions(text.as_py() or "", automaton).items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [batch.schema.field("tender").type, pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["tender", "kind", "label", "term", "n"])

    return run


def document_mentions(docs: DataFrame, dictionary: DataFrame, limit: int = AUTOMATON) -> DataFrame:
    """(tender, kind, label, term, n) of every whole text of ``docs`` (tender, kind, text) for the terms of ``dictionary`` (label, term).

    A dictionary of more than ``limit`` characters is split by label, each part read over the texts in a pass of its own:
    what an automaton takes along to the tasks is bounded. Null texts and terms have no words.
    """
    named = dictionary.where("label is not null and term is not null").select("label", "term").distinct()
    size = named.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    passes = -(-size // limit) or 1
    kind = f"tender {docs.schema['tender'].dataType.simpleString()}, kind string, label string, term string, n long"
    out = None
    for number in range(passes):
        part = named.where(F.pmod(F.xxhash64("label"), F.lit(passes)) == number)
        terms = [(r["label"], r["term"]) for r in part.orderBy("label", "term").toLocalIterator()]
        found = docs.select("tender", c("kind").cast("string").alias("kind"), "text").mapInArrow(_counted([terms]), kind)
        out = found if out is None else out.unionByName(found)
    return out


def score_documents(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tender, label, score, terms): labels that a tender's documents give enough evidence for.

    ``dictionary`` has (label, category boolean, term, ambiguous boolean). A mention weighs by its document's kind; a term
    counts up to a cap. No label without a mention outside the legal kinds, from ambiguous terms only, with less than the least
    weight, or, if it is a category, with fewer than two firm terms. ``terms`` come sorted and joined by ``|``. A null tender is one.
    """
    plain = F.array_join(F.regexp_extract_all(F.col("folded"), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    from tendersieve.functions.scalars import fold

    known = dictionary.withColumn("folded", fold(c("term"))).select("label", plain.alias("term"), "category", "ambiguous").groupBy("label", "term").agg(F.max("category").alias("category"), F.max("ambiguous").alias("ambiguous"))
    weight = F.coalesce(*[F.when(c("kind") == k, w) for k, w in KIND_WEIGHTS.items()], F.lit(OTHER_WEIGHT))
    counted = document_mentions(docs, dictionary).groupBy("tender", "label", "term", "kind").agg(F.sum("n").alias("n"))
    each = counted.groupBy("tender", "label", "term").agg(F.sum(c("n") * weight).alias("hits"), F.max(c("kind").isin(*LABELLING)).alias("outside"))
    each = each.join(known, ["label", "term"])
    firm = F.count_if(~F.coalesce("ambiguous", F.lit(False)))
    whole = each.groupBy("tender", "label").agg(
        F.round(F.sum(F.least("hits", F.lit(TERM_CAP))), 9).alias("hits"), F.max(F.coalesce("outside", F.lit(False))).alias("outside"), firm.alias("firm"),
        F.max(F.coalesce("category", F.lit(False))).alias("category"), F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"),
    )
    kept = whole.where(c("outside") & (c("firm") >= F.when(c("category"), CATEGORY_TERMS).otherwise(1)) & (c("hits") >= LEAST_HITS))
    return kept.select("tender", "label", F.round(F.least(F.lit(1.0), c("hits") / SATURATION), 4).alias("score"), "terms")


def merge_signals(existing: DataFrame, signals: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((tender, labels, score, main), (tender, label, score, predicted)): labels with what documents add; none is ever removed.

    ``existing`` has (tender, label, score, predicted); ``signals`` (tender, label, score), several of a label count by the
    greatest. A signal of at least ``least`` makes its label predicted and raises its score. ``labels`` are
    the predicted ones, best first, ties by name, joined by commas; ``main`` is the first. Tenders that neither table predicts
    anything for have null labels.
    """
    told = signals.where(c("score") >= least).groupBy("tender", "label").agg(F.max("score").alias("told"))
    old = existing.groupBy("tender", "label").agg(F.max("score").alias("old"), F.max(F.coalesce("predicted", F.lit(False))).alias("was"))
    both = old.alias("o").join(told.alias("t"), c("o.tender").eqNullSafe(c("t.tender")) & c("o.label").eqNullSafe(c("t.label")), "full")
    score = F.greatest(F.coalesce("old", F.lit(0.0)), F.coalesce("told", F.lit(0.0)))
    rows = both.select(F.coalesce("o.tender", "t.tender").alias("tender"), F.coalesce("o.label", "t.label").alias("label"), score.alias("score"), (F.coalesce("was", F.lit(False)) | c("told").isNotNull()).alias("predicted"))
    rows = cut(rows, "merged")
    order = F.array_sort(F.collect_list(F.when(c("predicted"), F.struct((-c("score")).alias("s"), "label"))))
    whole = rows.groupBy("tender").agg(order.alias("x"))
    labels = F.nullif(F.array_join(c("x.label"), ","), F.lit(""))
    return whole.select("tender", labels.alias("labels"), (-F.get("x", F.lit(0))["s"]).alias("score"), F.get("x", F.lit(0))["label"].alias("main")), rows
