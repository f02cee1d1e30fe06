"""Names to companies: an edit-similarity join by equal pieces, and the cascade of ways in which a name is known.

Names whose lengths can't reach the similarity never meet. A left name is cut into two pieces more than edits are allowed,
so a similar name holds two pieces unchanged, moved by no more than the edits before them: going from piece to piece, edits so far less
pieces so far fall by one at a piece unchanged only, and end at two below zero or less. Where they first come to one below, at the i-th piece,
exactly i edits are before it; where they first come to two below, at the j-th, exactly j - 1, and the rest behind. Where very many edits
are allowed, one piece is enough, of one more than those.

Names lie in blocks of a length and of bounded size. Each two blocks of fitting lengths are met in a task that reads both of them: pieces are
hashed and looked up there, and what meets is dropped by its letters, so neither keys nor pairs that only share pieces are dealt or written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tendersieve.functions import scalars as S
from tendersieve.sources.files import cut

c = F.col
#: Least similarities for which two names of any lengths above one must share a bigram.
FLOORS = {"blocks": 0.85, "edit": 0.75}


def _edits(kind: str, least: float) -> str:
    """SQL of the most edits between names of lengths l and m."""
    return f"cast(floor({1 - least!r} * {'(l + m)' if kind == 'blocks' else 'greatest(l, m)'} + 1e-9) as int)"


def _signed(names: DataFrame) -> DataFrame:
    """(name, l, letters) of distinct names of two letters or more; ``letters`` has bits of the classes of letters that stand once and twice in the name.

    A letter more or less changes one bit at most.
    """
    bits = F.expr("transform(sequence(1, length(name)), i -> shiftleft(1L, ascii(substring(name, i, 1)) & 31))")
    letters = F.aggregate(bits, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseOR(x).bitwiseOR(F.shiftleft(seen.bitwiseAND(x), 32)))
    return names.where("length(name) > 1").select("name").distinct().select("name", F.length("name").alias("l"), letters.alias("letters"))


def _sized(names: DataFrame, kind: str, least: float, indexed: bool) -> DataFrame:
    """``names`` with each length of a partner: x of the left, y of the right name, k the most edits between such."""
    low, high = (least / (2 - least), (2 - least) / least) if kind == "blocks" else (least, 1 / least)
    other = F.explode(F.expr(f"sequence(cast(ceil(l * {low!r} - 1e-9) as int), cast(floor(l * {high!r} + 1e-9) as int))"))
    sized = names.withColumn("m", other).where("m > 1").withColumn("k", F.expr(_edits(kind, least)))
    return sized.withColumnsRenamed({"l": "x", "m": "y"} if indexed else {"l": "y", "m": "x"}).where("abs(x - y) <= k")


#: Of the keys as rows, by which tests tell what meets.
PIECE = "struct(cast((cast({0} as long) * x) div (k + 2) as int) as s, cast((({0} + 1L) * x) div (k + 2) as int) as e)"
#: Numbers of two pieces and, of each, where it begins and ends in the left name.
TWO = f"explode(flatten(transform(sequence(0, k), i -> transform(sequence(i + 1, k + 1), j -> struct(i, j, {PIECE.format('i')} as p, {PIECE.format('j')} as q)))))"
KEY = "xxhash64(x, k, i, j, substring(name, p.s + 1 + {}, p.e - p.s), substring(name, q.s + 1 + {}, q.e - q.s)) AS key"


def _pieces(names: DataFrame, kind: str, least: float) -> DataFrame:
    """(name, letters, x, key): each two pieces of left names, once for each number of edits that a partner's length allows."""
    sized = _sized(names, kind, least, True).groupBy("name", "x", "letters", "k").agg(F.lit(1)).select("name", "x", "letters", "k")
    return sized.withColumn("two", F.expr(TWO)).select("name", "letters", "x", "k", "two.*").selectExpr("name", "letters", "x", KEY.format(0, 0))


def _places(names: DataFrame, kind: str, least: float) -> DataFrame:
    """(name, letters, y, key): what right names hold where two pieces of a left name may have come to stand."""
    each = _sized(names, kind, least, False).withColumn("two", F.expr(TWO)).select("name", "letters", "x", "y", "k", "two.*")
    behind = "(k - j + 1)"
    # the first piece goes as far as the edits before it, and the second as far from there as those between them; those behind take them to the end
    first = each.withColumn("low", F.expr(f"greatest(-i, y - x - {behind} - (j - 1 - i), -p.s)")).withColumn("high", F.expr(f"least(i, y - x + {behind} + (j - 1 - i), y - p.e)")).where("low <= high")
    first = first.withColumn("at", F.explode(F.expr("sequence(low, high)")))
    second = first.withColumn("low", F.expr(f"greatest(at - (j - 1 - i), y - x - {behind}, -q.s)")).withColumn("high", F.expr(f"least(at + (j - 1 - i), y - x + {behind}, y - q.e)")).where("low <= high")
    second = second.withColumn("to", F.explode(F.expr("sequence(low, high)")))
    if kind == "blocks":  # letters only go and come, and so many of them did
        second = second.where("(at - i) % 2 = 0 and (to - (j - 1)) % 2 = 0")
    return second.selectExpr("name", "letters", "y", KEY.format("at", "to"))


#: Characters of a block, pairs that are held at a time, most edits for which two pieces are looked up.
BLOCK, HELD, TWICE = 1 << 20, 1 << 22, 6
BASE = np.uint64(0x9E3779B97F4A7C15)


class _Block:
    """Names of one length as numbers, by column: their letters as in ``_signed`` and hashes of all that they begin with."""

    def __init__(self, names: list[str]):
        self.names, self.length = names, len(names[0])
        codes = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").reshape(len(names), -1).T.astype(np.uint64)
        self.letters = np.zeros(len(names), np.uint64)
        self.begin = np.zeros((self.length + 1, len(names)), np.uint64)
        self.power = np.ones(self.length + 1, np.uint64)
        for i, code in enumerate(codes):
            bit = np.uint64(1) << (code & np.uint64(31))
            self.letters |= bit | ((self.letters & bit) << np.uint64(32))
            self.begin[i + 1] = self.begin[i] * BASE + code + np.uint64(1)
            self.power[i + 1 : i + 2] = self.power[i : i + 1] * BASE
        self.sorted: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def key(self, p: tuple[int, int], q: tuple[int, int]) -> np.ndarray:
        part = lambda s, e: self.begin[e] - self.begin[s] * self.power[e - s]
        return part(*p) * self.power[q[1] - q[0]] + part(*q)

    def index(self, p: tuple[int, int], q: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if (p, q) not in self.sorted:
            key = self.key(p, q)
            order = np.argsort(key)
            self.sorted[p, q] = order, key[order]
        return self.sorted[p, q]


def _spots(x: int, y: int, k: int, kind: str, twice: bool) -> Iterator[tuple[tuple[int, int], tuple[int, int], int, int]]:
    """(first piece, second piece, how far each may have moved) of names of lengths x and y with k edits; of one piece only, the second is empty."""
    step = 2 if kind == "blocks" else 1  # letters only go and come, so the edits before a piece tell whether it moves by an odd number
    n = k + 1 + twice
    for i in range(k + 1):
        p = i * x // n, (i + 1) * x // n
        for j in range(i + 1, k + 2) if twice else (k + 1,):
            q = (j * x // n, (j + 1) * x // n) if twice else (0, 0)
            between, behind = (j - 1 - i, k - j + 1) if twice else (0, k - i)
            for at in range(-i, i + 1, step):
                if not max(y - x - behind - between, -p[0]) <= at <= min(y - x + behind + between, y - p[1]):
                    continue
                for to in range(at - between, at + between + 1, step) if twice else (0,):
                    if not twice or max(y - x - behind, -q[0]) <= to <= min(y - x + behind, y - q[1]):
                        yield p, q, at, to


def _near(a: _Block, b: _Block, k: int, kind: str, way: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b): all pairs within k edits and others of about the same letters; a pair may come again.

    ``way``: all pairs (0), one piece (1) or two (2); by default what takes least.
    """
    n, m = len(a.names), len(b.names)
    if way is None:
        looked = (k + 2) ** 4 // 24 + 1 if k <= TWICE else (k + 1) ** 2 // 2 + 1
        way = 0 if n * m <= looked * (64 + (n + m) // 2) else 2 if k <= TWICE else 1
    most = np.uint64(k)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = a.letters[i], b.letters[j]
        if kind == "blocks":
            return np.bitwise_count(x ^ y) <= most
        return (np.bitwise_count(x & ~y) <= most) & (np.bitwise_count(y & ~x) <= most)

    def told(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.unique(np.concatenate(held)), m)

    if way == 0:
        rows = max(1, HELD // m)
        for lo in range(0, n, rows):
            i, j = (x.ravel() for x in np.indices((min(rows, n - lo), m)))
            ok = alike(i + lo, j)
            yield i[ok] + lo, j[ok]
        return
    held: list[np.ndarray] = []
    size = 0
    for p, q, at, to in _spots(a.length, b.length, k, kind, way == 2):
        order, keys = a.index(p, q)
        own = b.key((p[0] + at, p[1] + at), (q[0] + to, q[1] + to))
        lo = np.searchsorted(keys, own)
        hit = np.flatnonzero(keys[np.minimum(lo, n - 1)] == own)
        lo = lo[hit]
        ends = np.cumsum(np.searchsorted(keys, own[hit], "right") - lo)
        first = 0
        while first < len(hit):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD, "right")))
            count = np.diff(ends[first:last], prepend=ends[first - 1] if first else 0)
            starts = np.cumsum(count) - count
            i = order[np.arange(int(count.sum())) + np.repeat(lo[first:last] - starts, count)]
            j = np.repeat(hit[first:last], count)
            ok = alike(i, j)
            held.append(i[ok] * m + j[ok])
            size += len(held[-1])
            if size > HELD:
                yield told(held)
                held, size = [], 0
            first = last
    if size:
        yield told(held)


def _most(kind: str, least: float, x: int, y: int) -> int:
    return math.floor((1 - least) * (x + y if kind == "blocks" else max(x, y)) + 1e-9)


def _meet(kind: str, least: float):
    """Of pairs of blocks (x, own_x, a, y, own_y, b): pairs of names that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[tuple, _Block] | None = None
        for batch in batches:
            for row, of_a in enumerate(zip(batch.column("x").to_pylist(), batch.column("own_x").to_pylist(), strict=True)):
                if left is None or left[0] != of_a:
                    left = of_a, _Block(batch.column("a")[row].as_py())
                own, others = left[1], _Block(batch.column("b")[row].as_py())
                names = pa.array(own.names), pa.array(others.names)
                for pairs in _near(own, others, _most(kind, least, own.length, others.length), kind):
                    for lo in range(0, len(pairs[0]), 1 << 16):
                        yield pa.RecordBatch.from_arrays([x.take(pa.array(i[lo : lo + (1 << 16)])) for x, i in zip(names, pairs, strict=True)], names=["a", "b"])

    return run


def _blocks(names: DataFrame) -> DataFrame:
    """(l, own, names): names of two letters or more in rows of a length and of bounded size; written."""
    long = names.where("length(name) > 1").withColumn("l", F.length("name"))
    sizes = cut(long.groupBy("l").agg(F.ceil(F.count("*") * c("l") / BLOCK).alias("n")), "sizes")  # a row a length
    files = max(1, min(FILES, sizes.agg(F.sum("n")).first()[0] or 0))
    dealt = long.join(F.broadcast(sizes), "l").select("l", F.pmod(F.xxhash64("name"), c("n")).alias("own"), "name")
    return cut(dealt.repartition(files, "l", "own").groupBy("l", "own").agg(F.collect_list("name").alias("names")), "blocks")


#: Blocks lie in so many files at most, of which a task meets a few with a few others.
FILES = 32


def _ratios(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ratios = [], []
            match = SequenceMatcher(None)
            for i, (a, b) in enumerate(sorted(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()), key=lambda x: x[1])):
                if i == 0 or b != match.b:
                    match.set_seq2(b)
                match.set_seq1(a)
                if match.real_quick_ratio() >= least and match.quick_ratio() >= least and (ratio := match.ratio()) >= least:
                    kept.append((a, b))
                    ratios.append(ratio)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.string()), pa.array(ratios, pa.float64())], names=["a", "b", "similarity"])

    return run


def similar_names(left: DataFrame, right: DataFrame, least: float, kind: str = "blocks") -> DataFrame:
    """(a, b, similarity): all pairs of a name of ``left`` and one of ``right`` (columns ``name``) that are at least so similar.

    ``blocks`` is twice the characters in matching blocks over both lengths (of a as first and b as second text),
    ``edit`` one less the edit distance over the greater length. Each pair of different texts comes once, however often they
    stand in the tables; null and empty names have no partner; names of one character only an equal one.
    """
    if least < FLOORS[kind]:
        raise ValueError(f"pairs below {FLOORS[kind]} need not share a bigram")
    left, right = (cut(x.select("name").where("name <> ''").distinct(), "names") for x in (left, right))
    x = _blocks(left).withColumnsRenamed({"l": "x", "own": "own_x", "names": "a"})
    y = _blocks(right).withColumnsRenamed({"l": "y", "own": "own_y", "names": "b"})
    fits = F.abs(c("x") - c("y")) <= F.expr(_edits(kind, least).replace("(l + m)", "(x + y)").replace("(l, m)", "(x, y)"))
    # blocks are read again for each pair of them, so what their pairs hold is not dealt over tasks
    met = x.hint("shuffle_replicate_nl").join(y, fits).mapInArrow(_meet(kind, least), "a string, b string")
    met = met.withColumn("l", F.length("a")).withColumn("m", F.length("b")).withColumn("k", F.expr(_edits(kind, least)))
    met = met.where("levenshtein(a, b, k) >= 0").select("a", "b").distinct()
    if kind == "blocks":
        found = met.mapInArrow(_ratios(least), "a string, b string, similarity double")
    else:
        found = met.withColumn("similarity", 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).where(c("similarity") >= least - 1e-12)
    single = [x.where("length(name) = 1") for x in (left, right)]
    return found.unionByName(single[0].join(single[1], "name").select(c("name").alias("a"), c("name").alias("b"), F.lit(1.0).alias("similarity")))


def _greedy(aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(alias, first, new): in order of ``first``, a name is new unless it is similar to an earlier new one.

    ``pairs`` (early, late). A name is settled as soon as all its earlier partners are, or one of them is new; rounds go
    on until all are.
    """
    known = cut(aliases.join(pairs.select(c("late").alias("alias")).distinct(), "alias", "left_anti").select("alias", F.lit(True).alias("new")), "known")
    while True:
        told = pairs.join(known.select(c("alias").alias("late")), "late", "left_anti").join(known.select(c("alias").alias("early"), "new"), "early", "left")
        each = told.groupBy("late").agg(F.max(F.coalesce("new", F.lit(False))).alias("some"), F.count_if(c("new").isNull()).alias("open"))
        step = cut(each.where("some or open = 0").select(c("late").alias("alias"), (~c("some")).alias("new")), "step")
        if step.isEmpty():
            return aliases.join(known, "alias")
        known = cut(known.unionByName(step), "known")


def resolve(rows: DataFrame, registry: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, alias, status, company_id, created_by, score) of award rows (id, name, tax) against (company_id, alias, tax).

    In this order: a tax id of the registry (``tax``); a name of the registry (``alias``, or ``review`` at 1.0 if both have a
    tax id and they differ); a similar name of the registry (``review``, never a link); else the row is new. New
    rows are settled among themselves: those with the tax id of an earlier new row share its outcome; of the rest, in
    order of id, the first of a name founds a company (``created``) unless a similar name has been founded (``review``);
    later rows of the name join it, or go to review where tax ids differ.
    ``company_id`` is the registry's company, or the candidate under review; ``created_by`` the row that founds the other kind.
    Malformed national tax ids count as none; rows without name and known tax id are ``skipped``. Of several companies
    with one tax id or name the least is meant; of several similar names the most similar, the last by text. Repeated
    ids are rows of their own and come in order of name.
    """
    # written between, as one expression of both is too long to be compiled
    own = cut(rows.select("id", S.company_name(F.coalesce("name", F.lit(""))).alias("alias"), S.tax_id(c("tax")).alias("tax"), F.monotonically_increasing_id().alias("row")), "rows")
    own = cut(own.withColumn("tax", F.when(S.tax_id_class(c("tax")) != "invalid", c("tax"))), "rows")
    place = F.struct("id", F.coalesce("alias", F.lit("")), "row")
    by_tax = registry.where("tax is not null").groupBy("tax").agg(F.min("company_id").alias("tax_company"))
    main = registry.where("alias is not null").groupBy("alias").agg(F.min("company_id").alias("alias_company"))
    canonical = registry.groupBy(c("company_id").alias("alias_company")).agg(F.min("tax").alias("canonical"))
    names = cut(main.join(canonical, "alias_company"), "names")
    known = cut(own.join(by_tax, "tax", "left").join(names, "alias", "left"), "known")
    conflict = c("tax").isNotNull() & c("canonical").isNotNull() & (c("tax") != c("canonical"))
    status = F.when(c("tax_company").isNotNull(), "tax").when(c("alias").isNull(), "skipped").when(c("alias_company").isNotNull(), F.when(conflict, "review").otherwise("alias"))
    first = known.select("*", status.alias("status")).withColumn("company_id", F.coalesce("tax_company", "alias_company")).withColumn("score", F.when(c("status") == "review", 1.0))
    none = F.lit(None).cast(own.schema["id"].dataType).alias("created_by")
    settled = first.where("status is not null").select("id", "alias", "status", "company_id", none, "score")

    left = first.where("status is null").select("id", "alias", "tax", "row")
    near = similar_names(names.select(c("alias").alias("name")), left.select(c("alias").alias("name")), least)
    best = near.groupBy("b").agg(F.max(F.struct("similarity", "a")).alias("x")).select(c("b").alias("alias"), c("x.a").alias("like"), c("x.similarity").alias("score"))
    best = cut(best.join(names.select(c("alias").alias("like"), c("alias_company").alias("company_id")), "like"), "best")
    fuzzy = left.join(best, "alias").select("id", "alias", F.lit("review").alias("status"), "company_id", none, "score")

    new = cut(left.join(best, "alias", "left_anti"), "new")
    holder = new.where("tax is not null").groupBy("tax").agg(F.min(place).alias("h")).select("tax", c("h.row").alias("holder"))
    held = cut(new.join(holder, "tax", "left").withColumn("holder", F.coalesce("holder", "row")), "held")
    heads = cut(held.where("holder = row"), "heads")
    aliases = cut(heads.groupBy("alias").agg(F.min(F.struct(place.alias("place"), "tax", "id")).alias("x")).select("alias", c("x.place").alias("first"), c("x.id").alias("founder"), c("x.tax").alias("founder_tax"), c("x.place.row").alias("founder_row")), "aliases")
    alone = aliases.select(c("alias").alias("name"))
    likes = similar_names(alone, alone, least).where("a <> b")
    order = aliases.select("alias", "first")
    pairs = likes.join(order.select(c("alias").alias("a"), c("first").alias("p")), "a").join(order.select(c("alias").alias("b"), c("first").alias("q")), "b").where("p < q")
    pairs = cut(pairs.select(c("a").alias("early"), c("b").alias("late"), "similarity"), "pairs")
    greedy = cut(_greedy(aliases, pairs), "greedy")
    founded = greedy.where("new").select("alias", "founder", "founder_tax", "founder_row")
    liked = pairs.join(founded.select(c("alias").alias("early"), "founder"), "early").groupBy("late").agg(F.max(F.struct("similarity", "early", "founder")).alias("x"))
    liked = liked.select(c("late").alias("alias"), c("x.founder").alias("like_founder"), c("x.similarity").alias("like_score"))
    told = heads.join(founded, "alias", "left").join(liked, "alias", "left")
    differs = c("tax").isNotNull() & c("founder_tax").isNotNull() & (c("tax") != c("founder_tax"))
    outcome = F.when(c("founder").isNull(), "review").when(c("founder_row") == c("row"), "created").when(differs, "review").otherwise("alias")
    told = cut(told.select("row", outcome.alias("status"), F.coalesce("founder", "like_founder").alias("created_by"), F.when(c("founder").isNull(), c("like_score")).when(outcome == "review", 1.0).alias("score")), "told")
    rest = held.join(told.withColumnRenamed("row", "holder"), "holder")
    shared = F.when((c("holder") != c("row")) & (c("status") != "review"), "tax").otherwise(c("status"))
    company = F.lit(None).cast(registry.schema["company_id"].dataType).alias("company_id")
    return settled.unionByName(fuzzy).unionByName(rest.select("id", "alias", shared.alias("status"), company, "created_by", "score"))
