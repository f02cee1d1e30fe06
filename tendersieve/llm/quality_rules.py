"""Quality rules with suffix-array repetition.

Every text is judged alone, so the work is one pass without a shuffle. The words of a
slice of texts become integers that carry their text, one suffix array by prefix doubling
sorts all their suffixes (matches cannot leave a text), and the common prefixes of
neighbours give, for each position, the longest substring starting there that starts
somewhere else in the text too: the boundaries of the longest-common-prefix intervals.
The union of these spans is the covered part.

Defined cases: a null or empty text has no words, fails the base rules and covers
nothing; texts of any length are taken whole; repeated rows are judged alike; extra
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ranges, slices, word_ids

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, covered_fraction double, base_failed boolean, kept boolean"
)
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\f"
_LUT = np.zeros(256, bool)
_LUT[list(SYMBOLS)] = True
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True


def suffix_repeats(tokens: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring starting there that also starts elsewhere.

    Prefix doubling: suffixes sorted by their first 1, 2, 4, ... tokens until all ranks differ;
    the common prefix of sorted neighbours is then read off the kept ranks, longest power first.
    """
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    order = np.argsort(rank)
    while step < n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(pair[order][1:] != pair[order][:-1])))
        rank = new
        step *= 2
        if rank[order[-1]] == n:
            break
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        alive = np.flatnonzero((a < n) & (b < n))
        same = alive[levels[k][a[alive]] == levels[k][b[alive]]]
        # a rank at level k speaks of 2**k tokens; shorter suffixes never share one with others
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = lcp
    np.maximum.at(longest, order[1:], lcp)
    return longest


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(np.concatenate(([0], total[ends])))


def judge(texts: list[bytes], min_repeat_words: int) -> dict[str, np.ndarray]:
    ids, counts, vocab = word_ids(texts)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    byte_ends = np.cumsum([len(t) for t in texts])
    chars = ((raw & 0xC0) != 0x80) & ~_WHITE[raw]
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(WHITE)]
        dup_lines[i] = len(lines) - len(set(lines))
    longest = suffix_repeats(doc * max(1, len(vocab)) + ids)

    def covered(length: np.ndarray, keep: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(keep)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length[at], -1)
        return np.cumsum(edge[:-1]) > 0

    spans = _per_text(covered(longest, longest >= min_repeat_words), ends)
    triples = _per_text(covered(np.full(len(ids), 3), longest >= 3), ends)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_words": counts, "word_chars": _per_text(chars, byte_ends), "n_symbols": _per_text(_LUT[raw], byte_ends),
        "n_dup_lines": dup_lines, "n_repeat_words": triples, "n_covered_words": spans, "longest_repeat": most,
        "covered_fraction": spans / np.maximum(counts, 1),
    }


def quality_rules(
    docs: DataFrame, text: str = "text", *, min_words: int = 50, max_repeat_percent: int = 50, min_repeat_words: int = 10,
    max_covered_fraction: float = 0.5, max_longest_repeat: int = 400,
) -> DataFrame:
    """All columns of ``docs`` and the counts and verdicts of ``SCHEMA``.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in
    3-word windows found twice or more. The method's verdict also rejects a text whose repeats of
    ``min_repeat_words`` words or more cover more than ``max_covered_fraction`` of it, or whose longest
    repeat exceeds ``max_longest_repeat`` words. Columns of ``docs`` named like a result, in upper or lower case, are replaced.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = source.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for first, part in slices(texts):
                out = judge(part, min_repeat_words)
                n = out["n_words"]
                failed = (n < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * n)
                bad = (out["covered_fraction"] > max_covered_fraction) | (out["longest_repeat"] > max_longest_repeat)
                out |= {"base_failed": failed, "kept": ~(failed | bad)}
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(out[c]) for c in names)], names=[*rest, *names])

    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), SCHEMA])
    return source.mapInArrow(run, full)
