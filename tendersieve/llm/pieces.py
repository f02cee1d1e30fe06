"""SentencePiece encoding and decoding: best path over a vocabulary's scores, split by chunk.

A text is encoded as the sequence of pieces with the greatest sum of scores (unigram
decoding; of equal paths the one whose last piece is longer, at every node). A text longer
than ``chunk`` characters is cut into chunks that different tasks encode:

1. Each chunk yields a matrix in (max, plus): from entry state i (the piece before ends i
   characters into the chunk) to exit state j (the last piece ends j characters behind it).
2. Matrices of a text are combined associatively, blocks of chunks first, then the blocks:
   that gives the scores of the states at every chunk's start.
3. With them each chunk, alone, traces back from every exit state to its entry state. These
   maps compose the same way, from the text's end, which fixes every chunk's one exit state.
4. Each chunk, alone, writes its pieces. The result doesn't depend on ``chunk``.

A space becomes the mark U+2581 and one is put in front; no piece has a mark behind another
character, so paths meet wherever a mark follows one, and words between such places are
encoded once and looked up after that. Characters outside the vocabulary, and the mark
itself where a text holds it, become byte pieces, so decoding gives the very text back.

Defined cases: null and empty texts have no ids; texts of any length are taken whole; repeated
rows are encoded alike; an empty table gives an empty result; extra columns are passed through,
those named like a result replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import free_name, materialize, numbered, ranges, slices

MARK = "▁"
#: Stands for a mark in the text itself; it cannot occur in valid UTF-8.
OWN_MARK = "\udc81"
CHUNK = 65536
BLOCK = 64
UNKNOWN_PENALTY = 10.0
#: So many words are remembered at most; then all are forgotten.
WORDS = 200_000
BITS, PLACES = 20, 3
NONE = -np.inf


class Pieces:
    """A vocabulary: scores and ids of its pieces, best paths over them, and the way back."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.table = {p.id_to_piece(i): (float(p.get_score(i)), i) for i in plain}
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(s for s, _ in self.table.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.table))
        assert not any(MARK in x.lstrip(MARK) or "\n" in x for x in self.table), "a piece goes on behind a word's start"
        self.spelling = [b""] * n
        for x, (_, i) in self.table.items():
            self.spelling[i] = x.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.spelling[i] = bytes([b])
        self.spelling_size = np.array([len(x) for x in self.spelling])
        self.spelling_start = np.cumsum(self.spelling_size) - self.spelling_size
        self.spelling_bytes = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.keys: np.ndarray | None = None
        self._forget()

    def mark(self, text: str) -> str:
        return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""

    def edges(self, text: str, s: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, id) of the pieces that start at s; id -1: the character's bytes."""
        get = self.table.get
        single = False
        for e in range(s + 1, min(s + self.longest, len(text)) + 1):
            if found := get(text[s:e]):
                single = single or e == s + 1
                yield e, *found
        if not single:
            yield s + 1, self.unknown, -1

    def spell(self, text: str, s: int, e: int, i: int) -> list[int]:
        if i >= 0:
            return [i]
        return [self.byte_ids[b] for b in text[s:e].replace(OWN_MARK, MARK).encode()]

    def lattice(self, text: str, stop: int, entry: list[float]) -> tuple[list[float], list[tuple[int, int] | None]]:
        """Best scores of the nodes of ``text`` and, for each, (start, id) of its last piece; None: an entry.

        Pieces start before ``stop``; node i < len(entry) is entered from before with entry[i].
        """
        best = [*entry, *[NONE] * (len(text) + 1 - len(entry))]
        back: list[tuple[int, int] | None] = [None] * len(best)
        for s in range(min(stop, len(text))):
            if (b := best[s]) > NONE:
                for e, score, i in self.edges(text, s):
                    if b + score > best[e]:
                        best[e], back[e] = b + score, (s, i)
        return best, back

    def trace(self, text: str, back: list[tuple[int, int] | None], node: int) -> tuple[int, list[int]]:
        """The entry node and the ids of the best path to ``node``."""
        parts = []
        while step := back[node]:
            parts.append(self.spell(text, step[0], node, step[1]))
            node = step[0]
        return node, [i for p in reversed(parts) for i in p]

    # -- words, encoded once -------------------------------------------------------------------

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.word_score = np.empty(0)
        self.word_start = np.empty(0, np.int64)
        self.word_size = np.empty(0, np.int64)
        self.word_ids = np.empty(0, np.int32)

    def _hash(self, seed: int) -> bool:
        """Buckets (``PLACES`` each) of the hashes of all beginnings of pieces; false if a bucket would need more.

        Slot 0 stands for no beginning of any piece; a beginning that isn't a piece scores minus infinity.
        """
        self.factor = np.uint64(seed)
        names = sorted({x[:k] for x in self.table for k in range(1, len(x) + 1)})
        h = np.zeros(len(names), np.uint64)
        for k in range(self.longest):
            there = np.array([len(x) > k for x in names])
            h[there] = self._step(h[there], np.array([ord(x[k]) for x in names if len(x) > k], np.uint64))
        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        if place.max() >= PLACES:
            return False
        self.keys = np.zeros((PLACES, 1 << BITS), np.uint64)
        self.slots = np.zeros((PLACES, 1 << BITS), np.int32)
        self.keys[place, at[order]], self.slots[place, at[order]] = h[order], order + 1
        found = [self.table.get(x, (NONE, -1)) for x in names]
        self.piece_score = np.array([NONE, *(v[0] for v in found)])
        self.piece_id = np.array([-1, *(v[1] for v in found)], np.int32)
        return True

    def _step(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ (c + np.uint64(1))) * self.factor
        return h ^ (h >> np.uint64(32))

    def _paths_of(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of words of one length, side by side: (scores, ids of all, number of ids of each)."""
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64)
        best = np.full((size + 1, n), NONE)
        best[0] = 0.0
        start = np.zeros((size + 1, n), np.int32)
        piece = np.zeros((size + 1, n), np.int32)
        for s in range(size):
            live = np.flatnonzero(best[s] > NONE)  # words with a path to s and a piece that may go on
            h = np.zeros(len(live), np.uint64)
            for e in range(s + 1, min(size, s + self.longest) + 1):
                h = self._step(h, chars[live, e - 1])
                at = (h >> np.uint64(64 - BITS)).astype(np.int64)
                slot = np.zeros(len(at), np.int32)
                for keys, slots in zip(self.keys, self.slots, strict=True):
                    here = np.flatnonzero(keys[at] == h)
                    slot[here] = slots[at[here]]
                score = self.piece_score[slot] + best[s][live]
                if e == s + 1:
                    score[score == NONE] = best[s][live[score == NONE]] + self.unknown
                better = np.flatnonzero(score > best[e][live])
                to = live[better]
                best[e][to], start[e][to], piece[e][to] = score[better], s, self.piece_id[slot[better]]
                on = np.flatnonzero(slot)
                if not len(on):
                    break
                live, h = live[on], h[on]
        node = np.full(n, size)
        lane = np.arange(n)
        owners, nodes, ids = [], [], []
        while len(lane):
            owners.append(lane)
            nodes.append(node)
            ids.append(piece[node, lane])
            node = start[node, lane]
            lane, node = lane[node > 0], node[node > 0]
        owner, node, found = (np.concatenate(x) for x in (owners, nodes, ids))
        order = np.lexsort((node, owner))
        node, found, owner = node[order], found[order], owner[order]
        odd = np.flatnonzero(found < 0)
        spelt = [self.spell(words[i], k - 1, k, -1) for i, k in zip(owner[odd].tolist(), node[odd].tolist(), strict=True)]
        width = np.ones(len(found), np.int64)
        width[odd] = [len(x) for x in spelt]
        ids = np.repeat(found, width)
        ids[ids < 0] = [i for x in spelt for i in x]
        return best[size], ids, np.bincount(np.repeat(owner, width), minlength=n)

    def learn(self, words: list[bytes]) -> None:
        """Best paths of ``words``, put behind those at hand in this order."""
        if not words:
            return
        seed = 0x9E3779B97F4A7C15
        while self.keys is None and not self._hash(seed):
            seed += 2
        spelt = b"\0".join(words).decode("utf-8", "surrogatepass").replace(" ", MARK).split("\0")
        if len(spelt) != len(words):  # a word holds the separator
            spelt = [w.decode("utf-8", "surrogatepass").replace(" ", MARK) for w in words]
        width = np.fromiter(map(len, spelt), np.int64, len(spelt))
        width[width > 48] = 0
        order = np.argsort(width, kind="stable")
        score, count, flats = np.empty(len(words)), np.empty(len(words), np.int64), []
        edges = np.flatnonzero(np.diff(width[order], prepend=-1)).tolist() + [len(words)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            size = int(width[order[lo]])
            for at in range(lo, hi, 8192):
                part = order[at : min(at + 8192, hi)]
                own = [spelt[i] for i in part.tolist()]
                if size:
                    score[part], ids, count[part] = self._paths_of(own, size)
                else:
                    one = [self.lattice(w, len(w), [0.0]) for w in own]
                    found = [self.trace(w, back, len(w))[1] for w, (_, back) in zip(own, one, strict=True)]
                    score[part], count[part] = [x[0][-1] for x in one], [len(x) for x in found]
                    ids = np.array([i for x in found for i in x], np.int32)
                flats.append(ids.astype(np.int32))
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        self.word_start = np.concatenate((self.word_start, start + len(self.word_ids)))
        self.word_score, self.word_size = np.concatenate((self.word_score, score)), np.concatenate((self.word_size, count))
        self.word_ids = np.concatenate((self.word_ids, *flats))

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all words of ``texts`` among those at hand, number of words of each text).

        ``texts`` have spaces for marks. A word is a run of marks and what follows, or a line end; no piece
        goes over its ends (none holds a line end). Words that come once here are at hand until the next call
        only; the others are remembered.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        mark, line = raw == 32, raw == 10
        begin = line.copy()
        begin[1:] |= (mark[1:] & ~mark[:-1]) | line[:-1]
        ends = np.cumsum(sizes)
        begin[(ends - sizes)[sizes > 0]] = True
        count = np.concatenate(([0], np.cumsum(begin)))
        edges = np.append(np.flatnonzero(begin), len(raw)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        codes, own = words.indices.to_numpy(), words.dictionary.to_pylist()
        often = np.bincount(codes, minlength=len(own)) > 1
        n, flat = len(self.known), int(self.word_size[: len(self.known)].sum())
        self.word_score, self.word_start, self.word_size, self.word_ids = self.word_score[:n], self.word_start[:n], self.word_size[:n], self.word_ids[:flat]
        get = self.known.get
        at = np.array([get(w, -1) for w in own], np.int64)
        new = np.flatnonzero((at < 0) & often)
        if n + len(new) > WORDS:
            self._forget()
            n, at = 0, np.full(len(own), -1)
            new = np.flatnonzero(often)
        self.learn(keep := [own[i] for i in new.tolist()])
        at[new] = np.arange(n, n + len(new))
        self.known.update(zip(keep, range(n, n + len(new)), strict=True))
        once = np.flatnonzero(at < 0)
        at[once] = np.arange(len(self.word_score), len(self.word_score) + len(once))
        self.learn([own[i] for i in once.tolist()])
        return at[codes], count[ends] - count[ends - sizes]

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); texts in UTF-8."""
        own, stand_in = MARK.encode(), OWN_MARK.encode("utf-8", "surrogatepass")
        at, count = self.look_up([b" " + t.replace(own, stand_in) if t else b"" for t in texts])
        size = self.word_size[at]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.word_ids[ranges(self.word_start[at], size)], np.diff(total[np.concatenate(([0], np.cumsum(count)))])

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text.encode()])[0].tolist()

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of the texts of ``sizes`` ids each, without the mark put in front."""
        width = self.spelling_size[ids]
        raw = self.spelling_bytes[ranges(self.spelling_start[ids], width)].tobytes()
        edges = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [raw[a + 1 : z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")

    # -- a chunk of a marked text: its n characters and up to longest - 1 behind them ----------

    @staticmethod
    def _spaced(body: str) -> bytes:
        return body.replace(MARK, " ").encode("utf-8", "surrogatepass")

    def cuts(self, body: str, n: int, before: str) -> tuple[int, int]:
        """The first and last place in 0 .. n where all paths meet; (-1, -1) if there is none."""
        at = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", body[: n + 1])]
        if body[:1] == MARK and before != MARK:
            at.insert(0, 0)
        return (at[0], at[-1]) if at else (-1, -1)

    def matrix(self, body: str, n: int, before: str) -> np.ndarray:
        """Scores from each entry state to each exit state."""
        k = self.longest
        out = np.full((k, k), NONE)
        first, last = self.cuts(body, n, before)

        def exits(text: str, stop: int, entry: list[float]) -> list[float]:
            best = self.lattice(text, stop, entry)[0][stop : stop + k]
            return best + [NONE] * (k - len(best))

        if first < 0:
            for i in range(min(k, len(body) + 1)):
                out[i] = exits(body, n, [*[NONE] * i, 0.0])
            return out
        at = self.look_up([self._spaced(body[first:last])])[0]
        middle = float(self.word_score[at].sum())
        tail = exits(body[last:], n - last, [0.0])
        for i in range(min(k, first + 1)):
            head = self.lattice(body[:first], first, [*[NONE] * i, 0.0])[0][first]
            out[i] = head + middle + np.array(tail)
        return out

    def entries(self, body: str, n: int, before: str, entry: list[float]) -> list[int]:
        """For each exit state the entry state of its best path (0 where there is none)."""
        first, _ = self.cuts(body, n, before)
        ends = min(self.longest, len(body) - n + 1)
        if first < 0:
            best, back = self.lattice(body, n, entry[: len(body) + 1])
            found = [self.trace(body, back, n + j)[0] if best[n + j] > NONE else 0 for j in range(ends)]
        else:
            head = body[:first]
            found = [self.trace(head, self.lattice(head, first, entry[: first + 1])[1], first)[0]] * ends
        return found + [0] * (self.longest - ends)

    def path(self, body: str, n: int, before: str, entry: list[float], exit_: int) -> tuple[int, list[int]]:
        """The entry state and the ids of the best path to an exit state; (0, []) if no path leads there."""
        first, last = self.cuts(body, n, before)
        if first < 0:
            best, back = self.lattice(body, n, entry[: len(body) + 1])
            return self.trace(body, back, n + exit_) if best[n + exit_] > NONE else (0, [])
        tail = body[last:]
        ids = self.trace(tail, self.lattice(tail, n - last, [0.0])[1], n - last + exit_)[1]
        at = self.look_up([self._spaced(body[first:last])])[0]
        middle = self.word_ids[ranges(self.word_start[at], self.word_size[at])].tolist()
        head = body[:first]
        state, ahead = self.trace(head, self.lattice(head, first, entry[: first + 1])[1], first)
        return state, ahead + middle + ids


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in (max, plus); a may be a vector."""
    return (a[..., :, None] + b).max(axis=-2)


def _lists(parts: list[list[int]]) -> pa.Array:
    return _ragged(np.fromiter((i for p in parts for i in p), np.int32), np.array([len(p) for p in parts]))


def _ragged(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat))


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for first, part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(first, len(part)), _ragged(*p.encode_many(part))], names=["uid", "ids"])

    return run


def _chunks(path: str, chunk: int):
    """(uid, c, n, before, body) of every chunk; each has at least ``chunk`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                t = p.mark(text.as_py())
                count = max(1, len(t) // chunk)
                for lo in range(0, count, 64):
                    rows = []
                    for c in range(lo, min(lo + 64, count)):
                        a, z = c * chunk, (c + 1) * chunk if c + 1 < count else len(t)
                        rows.append((uid, c, z - a, t[a - 1 : a] if a else "", t[a : z + p.longest - 1]))
                    columns = [list(x) for x in zip(*rows, strict=True)]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                    columns[3], columns[4] = ([x.encode("utf-8", "surrogatepass") for x in columns[k]] for k in (3, 4))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["uid", "c", "n", "before", "body"])

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for r in batch.to_pylist():
        r["body"], r["before"] = (r[k].decode("utf-8", "surrogatepass") for k in ("body", "before"))
        yield r


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            m = [p.matrix(r["body"], r["n"], r["before"]).ravel().tolist() for r in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("c"), pa.array(m, pa.list_(pa.float64()))], names=["uid", "c", "m"])

    return run


def _maps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            out = [p.entries(r["body"], r["n"], r["before"], r["v"]) for r in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("c"), pa.array(out, pa.list_(pa.int32()))], names=["uid", "c", "f"])

    return run


def _paths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            ids = [p.path(r["body"], r["n"], r["before"], r["v"], r["exit"])[1] for r in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("c"), _lists(ids)], names=["uid", "c", "ids"])

    return run


def _block_product(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c")
    k = int(len(pdf.m.iloc[0]) ** 0.5)
    total = np.array(pdf.m.iloc[0]).reshape(k, k)
    for m in pdf.m.iloc[1:]:
        total = combine(total, np.array(m).reshape(k, k))
    return pd.DataFrame({"uid": [pdf.uid.iloc[0]], "c": [pdf.block.iloc[0]], "m": [total.ravel().tolist()]})


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scores of the states at the start of each matrix; the first row has those at the start of all in ``v``."""
    pdf = pdf.sort_values("c")
    k = int(len(pdf.m.iloc[0]) ** 0.5)
    first = pdf.v.iloc[0] if "v" in pdf else None
    v = np.array(first if first is not None else [0.0] + [NONE] * (k - 1))
    out = []
    for m in pdf.m:
        out.append(v.tolist())
        v = combine(v, np.array(m).reshape(k, k))
    return pd.DataFrame({"uid": pdf.uid, "c": pdf.c, "v": out})


def _block_map(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c", ascending=False)
    f = np.array(pdf.f.iloc[0])
    for g in pdf.f.iloc[1:]:
        f = np.array(g)[f]
    return pd.DataFrame({"uid": [pdf.uid.iloc[0]], "c": [pdf.block.iloc[0]], "f": [f.tolist()]})


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """The exit state of each map, from the last to the first."""
    pdf = pdf.sort_values("c", ascending=False)
    state = int(pdf["exit"].iloc[0]) if "exit" in pdf else 0
    out = []
    for f in pdf.f:
        out.append(state)
        state = int(f[state])
    return pd.DataFrame({"uid": pdf.uid, "c": pdf.c, "exit": out})


def encode(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(uid, ids: array of int) of every row (uid long, text string)."""
    rows = rows.select("uid", F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text")
    short = rows.where(size <= chunk).mapInArrow(_whole(path), "uid long, ids array<int>")
    return short.unionByName(encode_chunks(rows.where(size > chunk), path, chunk))


def encode_chunks(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``encode`` for texts longer than ``chunk``: no task holds more of a text's lattice than a chunk."""
    body = "uid long, c int, n int, before binary, body binary"
    chunks = materialize(rows.mapInArrow(_chunks(path, chunk), body).repartition("uid", "c"), "chunks")
    block = F.floor(F.col("c") / BLOCK).cast("int").alias("block")
    m = materialize(chunks.mapInArrow(_matrices(path), "uid long, c int, m array<double>").select("*", block), "matrices")
    blocks = m.groupBy("uid", "block").applyInPandas(_block_product, "uid long, c int, m array<double>")
    at = blocks.groupBy("uid").applyInPandas(_starts, "uid long, c int, v array<double>").withColumnRenamed("c", "block")
    starts = m.join(at, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_starts, "uid long, c int, v array<double>")
    starts = materialize(starts, "starts")
    known = chunks.join(starts, ["uid", "c"])
    f = materialize(known.mapInArrow(_maps(path), "uid long, c int, f array<int>").select("*", block), "maps")
    blocks = f.groupBy("uid", "block").applyInPandas(_block_map, "uid long, c int, f array<int>")
    ends = blocks.groupBy("uid").applyInPandas(_exits, "uid long, c int, exit int").withColumnRenamed("c", "block")
    exits = f.join(ends, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_exits, "uid long, c int, exit int")
    ids = known.join(exits, ["uid", "c"]).mapInArrow(_paths(path), "uid long, c int, ids array<int>")
    parts = F.sort_array(F.collect_list(F.struct("c", "ids")))
    return ids.groupBy("uid").agg(F.flatten(parts["ids"]).alias("ids"))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, spelt from the array ``ids``; null stays null."""
    rest = [c for c in rows.columns if c != text]
    rows = rows.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                spelt = p.decode_many(pc.list_flatten(part.column(ids)).to_numpy(), pc.fill_null(pc.list_value_length(part.column(ids)), 0).to_numpy())
                out = [x.decode("utf-8", "replace") if ok else None for x, ok in zip(spelt, part.column(ids).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*rest, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{text}` string"])
    return rows.mapInArrow(run, schema)


RESULT = "ids array<int>, n_pieces int, ids_crc32 long, decoded_ok boolean"


def encode_documents(docs: DataFrame, path: str, text: str = "text", *, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the columns of ``RESULT``: the ids, their number, the crc32 of the ids as little-endian
    unsigned 32-bit integers, and whether decoding them gives the text back.
    Columns of ``docs`` named like a result, in upper or lower case, are replaced.
    """
    names = ["ids", "n_pieces", "ids_crc32", "decoded_ok"]
    rest = [c for c in docs.columns if c.lower() not in names]
    number = free_name(rest, "uid")
    table = numbered(docs.select(*[F.col(f"`{c}`") for c in rest]), number)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def rows(p: Pieces, part: pa.RecordBatch, texts: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes).tolist()
        raw = flat.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * (z - n) : 4 * z]) for z, n in zip(ends, sizes.tolist(), strict=True)]
        ok = [x == t for x, t in zip(p.decode_many(flat, sizes), texts, strict=True)]
        found = [_ragged(flat.astype(np.int32), sizes), pa.array(sizes, pa.int32()), pa.array(crc, pa.int64()), pa.array(ok)]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), *found], names=[*rest, *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for first, part in slices(batch.column(text)):
                yield rows(p, batch.slice(first, len(part)), part, *p.encode_many(part))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for batch in batches:
            for first, part in slices(batch.column(text)):
                own = batch.slice(first, len(part))
                flat, sizes = pc.list_flatten(own.column("ids")).to_numpy(), pc.list_value_length(own.column("ids")).to_numpy()
                yield rows(p, own, part, flat, sizes)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.drop(number).schema.fields), RESULT])
    short = table.where(F.char_length(body) <= chunk).drop(number).mapInArrow(whole, schema)
    giant = table.where(F.char_length(body) > chunk)
    coded = encode_chunks(giant.select(F.col(number).alias("uid"), F.col(f"`{text}`").alias("text")), path, chunk)
    return short.unionByName(giant.join(coded.select(F.col("uid").alias(number), "ids"), number).drop(number).mapInArrow(joined, schema))
