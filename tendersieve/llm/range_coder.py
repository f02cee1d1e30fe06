"""An adaptive context-mixing range coder for blocks of token ids, many blocks side by side in numpy.

Each block has models of its own. For an id three orders say what they expect:

* order 2 and order 1 name the id that followed the two ids, or the one id, before, with a
  confidence that grows with each hit;
* order 0 has the ids of the block so far with their counts, and a share for ids not seen yet,
  which are written out in 16 bits.

The three are mixed into one line of ``TOTAL`` units: the shares of order 2 and 1 follow how
often predictions of that confidence were right in the block, the rest is order 0's. One
range-coding step narrows the range to an id's part. An id that order 2 or 1 foretold doesn't
count in order 0. Counts take effect every ``PERIOD`` ids, so that sums are renewed for
all blocks at once. All arithmetic is in whole numbers, so reading repeats it exactly.
"""

from __future__ import annotations

import numpy as np

PERIOD = 32
TOTAL = 28
LIMIT = 16384
_SLOTS = 512
_NONE = 1 << 17
_ID, _LEVEL, _CAP = (1 << 18) - 1, 1 << 18, 7 << 18
#: Shares of 1 << 15: the most a prediction can get, and what one of each confidence gets at a weight of 1 << 14.
_MOST = 30500
_SHARE = np.array((1500, 6000, 12000, 18000, 22000, 25000, 27500, 29000), np.int32)
_ROW = 32
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_W = np.uint64(16)


def _part(rest: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The share (of 1 << 15) of at most 1 << TOTAL units."""
    return (rest >> 13) * share >> 2


class _Models:
    """What the three orders expect, for the first k of ``lanes`` blocks."""

    def __init__(self, lanes: int):
        self.slot = np.arange(lanes, dtype=np.int32) * _SLOTS
        self.tables = [np.full(lanes * _SLOTS, _NONE, np.int32) for _ in range(2)]
        self.weight = [np.full(lanes, 1 << 14, np.int32) for _ in range(2)]
        self.fresh = np.full(lanes, _MOST, np.int32)
        self.width = 2 * _ROW
        self.ids = np.zeros((lanes, self.width), np.int32)
        self.counts = np.zeros((lanes, self.width), np.int32)
        self.seen = np.zeros(lanes, np.int64)
        self.wait = np.full((lanes, PERIOD), -1, np.int32)
        self.waiting = np.zeros(lanes, np.int64)
        self._sum(lanes)

    def _sum(self, k: int) -> None:
        """Sums of the counts of all ids before each: what order 0 codes with until the next period."""
        self.sums = np.zeros((k, self.width), np.int32)
        np.cumsum(self.counts[:k, :-1], axis=1, out=self.sums[:, 1:])
        self.coarse = np.ascontiguousarray(self.sums[:, ::_ROW])
        self.total = self.sums[:, -1].copy()
        self.parts = np.maximum(self.total, 1).astype(np.float64)
        self.row = np.arange(k, dtype=np.int32) * self.width
        self.empty = np.flatnonzero(self.total == 0)

    def renew(self, k: int) -> None:
        """Take in the ids that were written out in the last period."""
        row, col = np.nonzero(np.arange(PERIOD) < self.waiting[:k, None])
        if (room := int((self.seen[:k] + self.waiting[:k]).max(initial=0)) + 2) > self.width:
            more = -(-(room + self.width // 2) // _ROW) * _ROW - self.width
            self.ids, self.counts = (np.pad(x, ((0, 0), (0, more))) for x in (self.ids, self.counts))
            self.width += more
        self.ids[row, self.seen[row] + col] = self.wait[row, col]
        self.counts[row, self.seen[row] + col] = 1
        self.seen[:k] += self.waiting[:k]
        self.waiting[:k] = 0
        self.wait[:k] = -1
        self._sum(k)

    def shares(self, k: int, before: np.ndarray, earlier: np.ndarray) -> None:
        """Look up both contexts; lay out the line: order 2, order 1, new ids, order 0."""
        one = before * np.int32(-1640531535)
        two = one + earlier * np.int32(-2048144777)
        self.at = [self.slot[:k] + (h >> 16 & _SLOTS - 1) for h in (one, two)]
        self.entry = [t.take(a) for t, a in zip(self.tables, self.at, strict=True)]
        self.named = [e & _ID for e in self.entry]
        self.share = [_SHARE.take(e >> 18) * w[:k] >> 14 for e, w in zip(self.entry, self.weight, strict=True)]
        one, two = self.named
        self.m2 = self.share[1] << TOTAL - 15
        np.copyto(self.m2, 0, where=two == _NONE)
        rest = (1 << TOTAL) - self.m2
        self.m1 = _part(rest, self.share[0])
        np.copyto(self.m1, 0, where=(one == _NONE) | (one == two))
        rest -= self.m1
        self.new = _part(rest, self.fresh[:k])
        if len(empty := self.empty[: np.searchsorted(self.empty, k)]):
            self.new[empty] = rest[empty]
        self.most = self.m2 + self.m1
        self.base = self.most + self.new
        self.unit = ((rest - self.new) / self.parts[:k]).astype(np.int32)

    def learn(self, k: int, ids: np.ndarray, used: np.ndarray, raw: np.ndarray) -> None:
        """``used``: where order 0 coded an id, among all blocks' counts; ``raw``: the blocks whose id was written out."""
        for table, at, entry, named, weight, share in zip(self.tables, self.at, self.entry, self.named, self.weight, self.share, strict=True):
            hit = named == ids
            weaker = entry - _LEVEL
            np.copyto(weaker, ids, where=weaker < 0)
            np.copyto(weaker, np.minimum(entry + _LEVEL, named | _CAP), where=hit)
            table[at] = weaker
            w = weight[:k]
            w += ((hit.astype(np.int32) << 15) - share) >> 7
            np.clip(w, 512, 17000, out=w)
        self.counts.ravel()[used] += 1
        fresh = self.fresh[:k]
        fresh -= fresh >> 5  # stays above 0
        if len(raw):
            fresh[raw] += _MOST >> 5
            x = ids[raw]
            first = raw[~(self.wait[raw] == x[:, None]).any(axis=1)]
            self.wait[first, self.waiting[first]] = ids[first]
            self.waiting[first] += 1


class _Range:
    """The ranges of all blocks: carryless, 64 bits, moved on by 16 bits at a time."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.span = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)

    def narrow(self, k: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Narrow the first k ranges to parts of TOTAL bits; returns those that may be moved on."""
        span = self.span[:k]
        span >>= np.uint64(TOTAL)
        self.low[:k] += start.astype(np.uint64) * span
        span *= size.astype(np.uint64)
        return np.flatnonzero(span < _TOP)

    def write(self, lane: np.ndarray, ids: np.ndarray) -> None:
        """Narrow ranges to 16 bits written out."""
        self.span[lane] >>= _W
        self.low[lane] += ids.astype(np.uint64) * self.span[lane]

    def settled(self, lane: np.ndarray) -> np.ndarray:
        """Those blocks whose leading 16 bits are settled, after cutting ranges that grew too small to wait."""
        low, span = self.low[lane], self.span[lane]
        done = (low ^ (low + span)) < _TOP
        small = np.flatnonzero(~done & (span < _BOT))
        if len(small):
            self.span[lane[small]] = (~low[small] + np.uint64(1)) & (_BOT - np.uint64(1))
            done[small] = True
        return lane[done]

    def move(self, lane: np.ndarray) -> None:
        self.low[lane] <<= _W
        self.span[lane] <<= _W


def _by_size(sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """Blocks from long to short, so that those still being coded are the first k; and their sizes."""
    if max(sizes, default=0) > LIMIT:
        raise ValueError(f"a block has more than {LIMIT} ids")
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    return order, np.array([sizes[i] for i in order], np.int64)


def _places(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a block its rank in order of first appearance, and whether a period began in between."""
    _, first, inverse = np.unique(block, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse], first[inverse] // PERIOD < np.arange(len(block)) // PERIOD


def _line(models: _Models, order0: np.ndarray, two: np.ndarray, one: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each block's id on the line; ``order0``: its place in all blocks' counts, used where no other order coded it."""
    below = models.sums.ravel().take(order0)
    size = (models.sums.ravel().take(order0 + 1) - below) * models.unit
    start = below * models.unit + models.base
    for where, at, wide in ((raw, models.most, models.new), (one, models.m2, models.m1), (two, np.int32(0), models.m2)):
        np.copyto(start, at, where=where)
        np.copyto(size, wide, where=where)
    return start, size


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of at most LIMIT ids, each below 65536."""
    order, size = _by_size([len(b) for b in blocks])
    longest = int(size.max(initial=0))
    ids, place = np.zeros((longest, len(blocks)), np.int32), np.zeros((longest, len(blocks)), np.int16)
    known = np.zeros((longest, len(blocks)), bool)
    for r, i in enumerate(order):
        if len(blocks[i]):
            ids[: size[r], r] = blocks[i]
            place[: size[r], r], known[: size[r], r] = _places(blocks[i])
    models, ranges = _Models(len(blocks)), _Range(len(blocks))
    out = np.zeros((len(blocks), longest + 64), np.uint16)
    fill = np.zeros(len(blocks), np.int64)

    def emit(lane: np.ndarray) -> None:
        while len(lane := ranges.settled(lane)):
            out[lane, fill[lane]] = ranges.low[lane] >> np.uint64(48)
            fill[lane] += 1
            ranges.move(lane)

    none = np.zeros(len(blocks), np.int32)
    for t in range(longest):
        k = int(np.searchsorted(-size, -t, "left"))  # blocks longer than t
        if t % PERIOD == 0:
            models.renew(k)
            if int(fill.max()) + 4 * PERIOD + 8 > out.shape[1]:
                out = np.pad(out, ((0, 0), (0, out.shape[1] // 2 + 4 * PERIOD)))
        x = ids[t, :k]
        models.shares(k, ids[t - 1, :k] if t else none[:k], ids[t - 2, :k] if t > 1 else none[:k])
        two = models.named[1] == x
        one = models.named[0] == x
        one &= ~two
        rest = ~(two | one)
        zero = rest & known[t, :k]
        raw = rest & ~zero
        at = models.row[:k] + place[t, :k] * zero
        emit(ranges.narrow(k, *_line(models, at, two, one, raw)))
        if len(written := np.flatnonzero(raw)):
            ranges.write(written, x[written])
            emit(written)
        models.learn(k, x, at[zero], written)
    for _ in range(4):
        out[np.arange(len(blocks)), fill] = ranges.low >> np.uint64(48)
        fill += 1
        ranges.low <<= _W
    result: list[bytes] = [b""] * len(blocks)
    for r, i in enumerate(order):
        result[i] = out[r, : fill[r]].astype("<u2").tobytes()
    return result


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks of the given sizes."""
    order, size = _by_size(sizes)
    longest = int(size.max(initial=0))
    ids = np.zeros((longest, len(sizes)), np.int32)
    words = np.zeros((len(sizes), max((len(p) // 2 for p in payloads), default=0) + 4), np.uint16)
    for r, i in enumerate(order):
        words[r, : len(payloads[i]) // 2] = np.frombuffer(payloads[i], "<u2")
    models, ranges = _Models(len(sizes)), _Range(len(sizes))
    code = np.zeros(len(sizes), np.uint64)
    for w in range(4):
        code = code << _W | words[:, w]
    fill = np.full(len(sizes), 4)
    end = words.shape[1] - 1

    def take(lane: np.ndarray) -> None:
        while len(lane := ranges.settled(lane)):
            code[lane] = code[lane] << _W | words[lane, np.minimum(fill[lane], end)]
            fill[lane] += 1
            ranges.move(lane)

    none = np.zeros(len(sizes), np.int32)
    for t in range(longest):
        k = int(np.searchsorted(-size, -t, "left"))
        if t % PERIOD == 0:
            models.renew(k)
        models.shares(k, ids[t - 1, :k] if t else none[:k], ids[t - 2, :k] if t > 1 else none[:k])
        v = ((code[:k] - ranges.low[:k]) // (ranges.span[:k] >> np.uint64(TOTAL))).astype(np.int32)
        two, one, zero = v < models.m2, v < models.most, v >= models.base
        raw = ~(one | zero)
        one &= ~two
        target = np.clip((v - models.base) / np.maximum(models.unit, 1), 0, models.total[:k] - 1).astype(np.int32)[:, None]
        part = (models.coarse[:k] <= target).sum(axis=1, dtype=np.int32) - np.int32(1)
        np.maximum(part, 0, out=part)
        rows = models.sums.reshape(-1, _ROW).take((models.row[:k] // _ROW) + part, axis=0)
        at = models.row[:k] + part * _ROW + np.maximum((rows <= target).sum(axis=1, dtype=np.int32) - np.int32(1), 0)
        x = ids[t, :k]
        models.ids.ravel().take(at, out=x)
        np.copyto(x, models.named[0], where=one)
        np.copyto(x, models.named[1], where=two)
        take(ranges.narrow(k, *_line(models, at, two, one, raw)))
        if len(written := np.flatnonzero(raw)):
            x[written] = np.minimum((code[written] - ranges.low[written]) // (ranges.span[written] >> _W), np.uint64(65535))
            ranges.write(written, x[written])
            take(written)
        models.learn(k, x, at[zero], written)
    result: list[np.ndarray] = [np.empty(0, np.int64)] * len(sizes)
    for r, i in enumerate(order):
        result[i] = ids[: size[r], r]
    return result
