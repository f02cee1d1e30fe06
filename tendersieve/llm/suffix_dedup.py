"""Suffix-array dedup: every byte under a string of ``threshold`` bytes that starts twice goes.

Distributed prefix doubling with Spark doing the sorting and the ranking:

* Ranks are fingerprints of a position's first bytes, so the rank of a position after an
  offset is known where the text is and a round moves only rank pairs and positions.
* First rank, ``gram`` bytes, at *anchors* only. An anchor is the least-ranked position among
  the ``window`` first positions of some string of ``threshold`` bytes (leftmost if tied);
  it depends on the string's bytes alone, so two equal strings have their anchors at the
  same place and no repeat can hide. Every string belongs to one anchor. Anchors of a unique
  rank leave, and with them all strings that belong to them.
* The strings of one anchor overlap; their union is the anchor's *reach*. Pairs (rank of the
  anchor, rank of the whole reach) go past the threshold at once: if a reach is there twice,
  all its strings are.
* Reaches that stay unique while their anchor is not are where matches begin or end. Their
  strings are sorted one by one by the pair (rank of the first half, rank at the offset of
  half the threshold); one copy of each settled reach of the same anchor takes part. Spark
  sorts these reaches by anchor rank. An anchor with more than ``group`` different reaches is
  not sorted in one task: its strings become rows of their own, counted with map-side sums.

Counts are hash aggregations with map-side sums, so a passage that stands in a third of all
documents is one row a task and not one task's rows.

What this keeps of prefix doubling and what not: ranks of rank pairs at an offset decide, and
what is unique leaves early; but ranks are 64-bit fingerprints that agree if and only if the
bytes do (up to collisions, about 1e-7 for 10**6 different strings), not places in a global
sort, positions enter thinned to anchors, and two offsets reach the threshold instead of a
row of doubled ones. Sorting a rank pair for each byte writes 16 bytes a byte and round.

Defined cases: null is the empty text; texts shorter than the threshold lose nothing; equal
texts (repeated rows too) repeat each other, so all their bytes go from the threshold on;
an empty table gives an empty result; columns of other names are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import discard, free_name, materialize, mix64, numbered, ranges, slices

THRESHOLD = 200
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def parts(threshold: int) -> tuple[int, int]:
    """(gram, window): gram + window - 1 = threshold."""
    window = max(1, threshold * 4 // 5)
    return threshold - window + 1, window


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Ranks:
    """Fingerprints of any substring of ``raw`` in constant time each."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(12, int(len(raw)).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n])


def first_least(values: np.ndarray, window: int) -> np.ndarray:
    """For each start s, the leftmost position of the least of values[s : s + window]."""
    n = len(values)
    starts = n - window + 1
    if starts <= 0:
        return np.empty(0, np.int64)
    rows = -(-n // window)
    grid = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, window)
    col = np.arange(window, dtype=np.int32)
    new = np.ones(grid.shape, bool)
    low = np.minimum.accumulate(grid, axis=1)
    new[:, 1:] = grid[:, 1:] < low[:, :-1]
    head = np.maximum.accumulate(np.where(new, col, 0), axis=1)
    back = grid[:, ::-1]
    low = np.minimum.accumulate(back, axis=1)
    new[:, 1:] = back[:, 1:] <= low[:, :-1]
    tail = (window - 1 - np.maximum.accumulate(np.where(new, col, 0), axis=1))[:, ::-1]
    base = (np.arange(rows, dtype=np.int64) * window)[:, None]
    s = np.arange(starts)
    left = (tail + base).ravel()[:starts]
    right = (head + base).ravel()[window - 1 : window - 1 + starts]
    right = np.where(right < s, left, right)
    return np.where(values[left] <= values[right], left, right)


def anchors(texts: list[bytes], threshold: int = THRESHOLD) -> dict[str, np.ndarray]:
    """One row an anchor: text, at (first string), n (strings), fp (its rank), c (rank of its reach)."""
    gram, window = parts(threshold)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    count = np.maximum(sizes - threshold + 1, 0)
    if not count.any():
        return {k: np.empty(0, np.int64) for k in ("text", "at", "n", "fp", "c")}
    ranks = Ranks(np.frombuffer(b"".join(texts), np.uint8))
    grams = ranks.all(gram)
    s = ranges(ends - sizes, count)
    anchor = first_least(grams, window)[s]
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(s)))
    text = np.repeat(np.arange(len(texts)), count)[first]
    at = s[first]
    whole = mix64(ranks.of(at, n + threshold - 1) + n.astype(np.uint64))
    return {"text": text, "at": at - (ends - sizes)[text], "n": n, "fp": grams[anchor[first]].view(np.int64), "c": whole.view(np.int64)}


def string_ranks(reaches: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reach, offset, rank, rank half the threshold on) of every string of every reach."""
    sizes = np.array([len(t) for t in reaches], np.int64)
    ends = np.cumsum(sizes)
    count = sizes - threshold + 1
    ranks = Ranks(np.frombuffer(b"".join(reaches), np.uint8))
    s = ranges(ends - sizes, count)
    reach = np.repeat(np.arange(len(reaches)), count)
    half = threshold // 2
    return reach, s - (ends - sizes)[reach], ranks.of(s, half), ranks.of(s + half, threshold - half)


def runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, length) of the maximal runs of consecutive positions, given sorted."""
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], at[first], np.diff(np.append(first, len(at)))


def _find(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for first, part in slices(batch.column("text"), 2 << 20):
                a = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[first + a["text"]]), pa.array(a["at"].astype(np.int32)), pa.array(a["n"].astype(np.int32)), pa.array(a["fp"]), pa.array(a["c"])],
                    names=["uid", "at", "n", "fp", "c"],
                )

    return run


def _cut(threshold: int):
    """Rows (uid, text, wanted: array of (at, n, fp)) to (fp, uid, at, reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            at, n, fp = (wanted.values.field(k).to_numpy() for k in ("at", "n", "fp"))
            edges = wanted.offsets.to_numpy()
            texts = batch.column("text").cast(pa.binary())
            step = max(1, len(texts) // 16)
            for i in range(0, len(texts), step):
                j = min(i + step, len(texts))
                lo, hi = edges[i], edges[j]
                row = np.repeat(np.arange(i, j), np.diff(edges[i : j + 1]))
                body = [texts[k].as_py() for k in range(i, j)]
                reach = [body[r - i][a : a + m + threshold - 1] for r, a, m in zip(row.tolist(), at[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)]
                uid = batch.column("uid").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi]), pa.array(uid), pa.array(at[lo:hi]), pa.array(reach, pa.binary())], names=["fp", "uid", "at", "reach"])

    return run


def _sort_strings(threshold: int, most: int = 2 << 20):
    """Reaches sorted by anchor rank to (uid, at, n): runs of strings that another reach has too."""

    def repeated(table: pa.Table) -> pa.RecordBatch:
        uid, at = table.column("uid").to_numpy(), table.column("at").to_numpy()
        reach, offset, r1, r2 = string_ranks(table.column("reach").to_pylist(), threshold)
        order = np.lexsort((r2, r1))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (r1[order[1:]] == r1[order[:-1]]) & (r2[order[1:]] == r2[order[:-1]])
        found = np.sort(order[same[1:] | same[:-1]])
        owner, first, n = runs(reach[found], offset[found])
        return pa.RecordBatch.from_arrays([pa.array(uid[owner]), pa.array((at[owner] + first).astype(np.int32)), pa.array(n.astype(np.int32))], names=["uid", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            # pieces of bounded size that end where an anchor ends
            sizes = np.cumsum(pc.binary_length(batch.column("reach")).to_numpy()).astype(np.int64)
            lo = 0
            for k in np.flatnonzero(fp[1:] != fp[:-1]) + 1 if batch.num_rows else []:
                if size + sizes[k - 1] - (sizes[lo - 1] if lo else 0) >= most:
                    held.append(batch.slice(lo, int(k) - lo))
                    yield repeated(pa.Table.from_batches(held))
                    held, size, lo = [], 0, int(k)
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
                size += sizes[-1] - (sizes[lo - 1] if lo else 0)
        if held:
            yield repeated(pa.Table.from_batches(held))

    return run


def _spell_out(threshold: int):
    """Reaches to one row a string: (r1, r2, uid, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                reach, offset, r1, r2 = string_ranks(part.column("reach").to_pylist(), threshold)
                uid, at = part.column("uid").to_numpy()[reach], part.column("at").to_numpy()[reach] + offset
                yield pa.RecordBatch.from_arrays([pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), pa.array(uid), pa.array(at.astype(np.int32))], names=["r1", "r2", "uid", "at"])

    return run


def repeated_strings(rows: DataFrame, threshold: int = THRESHOLD, group: int = 4096) -> DataFrame:
    """(uid, spans: array of (at, n)): strings at at .. at + n - 1 start elsewhere too. ``rows`` has uid and text."""
    found = materialize(rows.mapInArrow(_find(threshold), "uid long, at int, n int, fp long, c long"), "anchors")
    # what a join meets is written first: a join whose sides both are shuffled can split a hot key
    twice = materialize(found.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp"), "twice")
    alive = materialize(found.join(twice, "fp"), "alive")
    discard(found, twice)
    reaches = materialize(alive.groupBy("fp", "c").agg(F.count("*").alias("k"), F.min(F.struct("uid", "at", "n")).alias("one")), "reaches")
    settled = alive.join(reaches.where("k > 1").select("fp", "c"), ["fp", "c"]).select("uid", "at", "n")
    mixed = materialize(reaches.groupBy("fp").agg(F.count("*").alias("m"), F.min("k").alias("least")).where("m > 1 and least = 1").select("fp", "m"), "mixed")
    rest = reaches.join(mixed, "fp").select("one.*", "fp", "m")
    hot = rest.where(F.col("m") > group).select("fp").distinct()
    wanted = rest.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "n", "fp"))).alias("wanted"))
    cut = materialize(rows.join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(_cut(threshold), "fp long, uid long, at int, reach binary"), "cut")
    cool = cut.join(hot, "fp", "left_anti").repartition("fp").sortWithinPartitions("fp")
    edges = cool.mapInArrow(_sort_strings(threshold), "uid long, at int, n int")
    spelt = cut.join(hot, "fp", "left_semi").select("uid", "at", "reach").mapInArrow(_spell_out(threshold), "r1 long, r2 long, uid long, at int")
    where = F.struct("uid", "at")
    pairs = spelt.groupBy("r1", "r2").agg(F.min(where).alias("x"), F.max(where).alias("y")).where("x < y").select("r1", "r2")
    hot_edges = spelt.join(pairs, ["r1", "r2"], "left_semi").select("uid", "at", F.lit(1).alias("n"))
    spans = settled.unionByName(edges).unionByName(hot_edges)
    return spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(threshold: int, keep_text: bool, names: list[str], text: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            spans = batch.column(spans_col).to_pylist()
            kept, out = [], []
            for t, found in zip(texts, spans, strict=True):
                b = t.as_py() or b""
                left, done, n_spans, pieces = 0, 0, 0, []
                stop = None
                for x in found or ():
                    a, z = x["at"], x["at"] + x["n"] + threshold - 1
                    if stop is None or a > stop:
                        pieces.append(b[left if stop is None else stop : a])
                        n_spans += 1
                        done += z - a
                        stop = z
                    elif z > stop:
                        done += z - stop
                        stop = z
                pieces.append(b[stop or 0 :])
                rest = b"".join(pieces)
                kept.append(rest)
                out.append((len(b), done, n_spans, hashlib.sha256(rest).hexdigest()))
            columns = [batch.column(n) for n in names]
            if keep_text:
                # a cut may fall inside a character; such bytes are dropped from the text
                columns[names.index(text)] = pa.array([None if not t.is_valid else k.decode("utf-8", "ignore") for t, k in zip(texts, kept, strict=True)], pa.string())
            result = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *result], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", *, threshold: int = THRESHOLD, group: int = 4096, keep_text: bool = True) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``, and the columns of ``RESULT``.

    n_spans counts maximal removed runs; kept_sha256 is the digest of the bytes that stay. With
    ``keep_text`` false the text column is left out. Columns named like a result are replaced.
    """
    results = [c.split()[0] for c in RESULT.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in results]
    number, found = free_name(rest, "uid"), free_name(rest, "spans")
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in rest]), number)
    spans = repeated_strings(rows.select(F.col(number).alias("uid"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), threshold, group)
    names = [c for c in rest if keep_text or c != text]
    joined = rows.join(spans.select(F.col("uid").alias(number), F.col("spans").alias(found)), number, "left").drop(number)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields), RESULT])
    return joined.mapInArrow(_remove(threshold, keep_text, names, text, found), schema)
