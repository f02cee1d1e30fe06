"""Repair of conversation structure at least cost, by layers of reachable grammar states.

A good conversation's role initials spell ``(s?(ua)+)?``. Edits in order of rows: Keep (0), Rerole to user or
assistant (1), Delete (2; the only edit of blank rows and of repetitions), Insert an empty user or assistant turn
before a row or at the end (5). A row that stays though its text breaks off adds 5.

1. Rows get their place in the conversation by running sums over ranges, so one long conversation lies on many tasks,
   and one character each: its role's class and what is wrong with it.
2. ``CHUNK`` places of a conversation make one string. Layer k holds, for each place, the bit set of grammar
   states from which the end is reached at a cost of at most k: it follows from the layers k, k-1, k-2,
   k-5 and k-6 by table look-ups, for all strings of a batch at once. The first layer that accepts gives the
   cost. Each layer is kept, and a walk through the bits from the start, trying Delete, Insert, Keep and
   Rerole in this order, spells the least audit: from a state each letter leads to one state only.
3. A conversation of several chunks has a matrix of costs between states for each, multiplied (min, +) from its
   end, ``FAN`` at a time and in as many levels as it takes. That gives each chunk the costs behind
   it, hence its walks from all states and, composed in order, the state it is entered in.
4. Rows and edits meet by row number; the digest of a conversation, which no two tasks could share, is fed
   row by row from sorted partitions and holds one row at a time.

Defined cases: null ids are one conversation; null turns come first; rows of one turn are in order of role, then of
their text's MD5 digest. A null role or text is one space, a role other than s, u, a only fits after
Rerole. Repeated rows are repetitions, as are rows equal but for their turn. A conversation
without rows is no conversation; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, materialize, numbered
from .prefix import running_sum

CHUNK = 256
FAN = 256
#: Bytes of layers that one batch may hold.
LAYERS = 48 << 20
FOREVER = 1 << 40
#: A row's code: its role's class, 4 if it must go, 8 if it breaks off. PAD stands behind shorter strings of a batch.
CLASSES, MUST_GO, BROKEN, PAD = "sua", 4, 8, 16
#: State after a role's class: 0 at the start, 1 after s, 2 after u, 3 after a.
AFTER = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
#: State after the only turn of user or assistant that fits.
TURN = (2, 2, 3, 2)
#: Cost from a state to the conversation's end, by inserts.
AT_END = [0, 10, 5, 0]
SPACE = " \t\n\x0b\x0c\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states before by code and states after) of Keep without and with a broken text, and states before by Rerole or Insert."""
    keep, broken, turn = np.zeros((PAD + 1, 16), np.uint8), np.zeros((PAD + 1, 16), np.uint8), np.zeros(16, np.uint8)
    for states in range(16):
        turn[states] = sum(1 << p for p in range(4) if states >> TURN[p] & 1)
        keep[PAD, states] = states
        for k in range(3):
            before = sum(1 << p for p in range(4) if k in AFTER[p] and states >> AFTER[p][k] & 1)
            keep[k, states] = broken[k | BROKEN, states] = before
    return keep, broken, turn


KEEP, KEEP_BROKEN, BEFORE_TURN = _tables()


def layers(codes: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Bit sets (layer, string, place) of the states from which the end is reached at a cost of at most the layer.

    ``codes`` (strings x places), ``ends`` (strings x 4) the costs behind the last place, ``wanted`` the bits that
    must be in the first place's set for the layers to end; at most as many layers as deleting all and two inserts cost.
    """
    b, n = codes.shape
    pad = codes == PAD
    turnable = np.where((codes & MUST_GO) | (codes & BROKEN) | pad, 0, 255).astype(np.uint8)
    late = np.where((codes & BROKEN) > 0, 255, 0).astype(np.uint8)
    edit = np.where(pad, 0, 255).astype(np.uint8)
    found: list[np.ndarray] = []
    for k in range(2 * n + 12 + int(np.where(ends < FOREVER, ends, 0).max(initial=0))):
        now = np.zeros((b, n + 1), np.uint8)
        now[:, n] = ((ends <= k) << np.arange(4)).sum(axis=1)
        if k:
            now |= found[k - 1]
            now[:, :n] |= BEFORE_TURN[found[k - 1][:, 1:]] & turnable
        if k > 1:
            now[:, :n] |= found[k - 2][:, 1:] & edit
        if k > 4:
            now[:, :n] |= BEFORE_TURN[found[k - 5][:, :n]] & edit
            now[:, :n] |= KEEP_BROKEN[codes, found[k - 5][:, 1:]]
        if k > 5:
            now[:, :n] |= BEFORE_TURN[found[k - 6][:, 1:]] & late
        for i in range(n - 1, -1, -1):
            now[:, i] |= KEEP[codes[:, i], now[:, i + 1]]
        found.append(now)
        if not (wanted & ~now[:, 0]).any():
            break
    return np.stack(found)


def walk(own: list[list[int]], codes: list[int], state: int) -> tuple[list[tuple[int, str, int]], int, int]:
    """Least audit from ``state``: (places inserted before, edit, state after) of each row, the last state and the cost spent."""
    k = total = next(k for k, sets in enumerate(own) if sets[0] >> state & 1)
    edits: list[tuple[int, str, int]] = []
    i = inserted = 0
    while i < len(codes):
        code = codes[i]
        extra = 5 if code & BROKEN else 0
        if k > 1 and own[k - 2][i + 1] >> state & 1:
            k, edit = k - 2, "D"
        elif k > 4 and own[k - 5][i] >> TURN[state] & 1:
            state, k, inserted = TURN[state], k - 5, inserted + 1
            continue
        else:
            after = AFTER[state].get(code & 3, -1)
            if after >= 0 and k >= extra and own[k - extra][i + 1] >> after & 1:
                k, state, edit = k - extra, after, "K"
            else:
                k, state, edit = k - extra - 1, TURN[state], "R"
        edits.append((inserted, edit, state))
        i, inserted = i + 1, 0
    return edits, state, total - k


def _each(strings: list[str], ends: list[list[int]], wanted: list[int]) -> Iterator[tuple[int, list[int], list[list[int]]]]:
    """(number, codes, layers) of each string; strings of like length share their layers' steps."""
    codes = [np.frombuffer(s.encode(), np.uint8) - ord("a") for s in strings]
    by: dict[int, list[int]] = {}
    for j, own in enumerate(codes):
        by.setdefault(1 << max(0, len(own) - 1).bit_length(), []).append(j)
    for n, members in by.items():
        most = max(1, LAYERS // (n * (2 * n + 24)))
        for lo in range(0, len(members), most):
            part = members[lo : lo + most]
            filled = np.full((len(part), n), PAD, np.uint8)
            for row, j in enumerate(part):
                filled[row, : len(codes[j])] = codes[j]
            sets = layers(filled, np.array([ends[j] for j in part]), np.array([wanted[j] for j in part], np.uint8))
            for row, j in enumerate(part):
                yield j, codes[j].tolist(), sets[:, row, : len(codes[j]) + 1].tolist()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, costs): the cost through the chunk from each state to each."""
    for batch in batches:
        strings = batch.column("codes").to_pylist()
        costs = [[FOREVER] * 16 for _ in strings]
        for q in range(4):
            end = [FOREVER if p != q else 0 for p in range(4)]
            for j, _, own in _each(strings, [end] * len(strings), [15] * len(strings)):
                for p in range(4):
                    costs[j][4 * p + q] = next((k for k, sets in enumerate(own) if sets[0] >> p & 1), FOREVER)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(costs, pa.list_(pa.int64()))], names=["key", "block", "value"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, states): the state that each chunk is left in, for each it may be entered in."""
    for batch in batches:
        states = [[0] * 4 for _ in range(batch.num_rows)]
        lows = [min(x) for x in batch.column("ends").to_pylist()]
        ends = [[min(FOREVER, v - low) for v in x] for x, low in zip(batch.column("ends").to_pylist(), lows, strict=True)]
        for j, codes, own in _each(batch.column("codes").to_pylist(), ends, [15] * batch.num_rows):
            for p in range(4):
                # a state that no path leads on from is entered by none either
                states[j][p] = walk(own, codes, p)[1] if own[-1][0] >> p & 1 else 0
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(states, pa.list_(pa.int64()))], names=["key", "block", "value"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: its audit, cost, illegal neighbours and its rows' edits."""
    for batch in batches:
        audits, costs, illegal, rows = ([None] * batch.num_rows for _ in range(4))
        entered, last = batch.column("entered").to_pylist(), batch.column("last").to_pylist()
        uids = batch.column("uids").to_pylist()
        ends = batch.column("ends").to_pylist()
        lows = [0 if final else min(x) for x, final in zip(ends, last, strict=True)]
        ends = [[min(FOREVER, v - low) for v in x] for x, low in zip(ends, lows, strict=True)]
        for j, codes, own in _each(batch.column("codes").to_pylist(), ends, [1 << p for p in entered]):
            edits, state, cost = walk(own, codes, entered[j])
            before, out = entered[j], []
            for uid, (inserted, edit, after) in zip(uids[j], edits, strict=True):
                turns = []
                for _ in range(inserted):
                    before = TURN[before]
                    turns.append("user" if before == 2 else "assistant")
                out.append({"uid": uid, "inserted": turns, "edit": edit, "role": "" if edit != "R" else "user" if after == 2 else "assistant"})
                before = after
            turns = []
            while last[j] and AT_END[state]:
                state, cost = TURN[state], cost + 5
                turns.append("user" if state == 2 else "assistant")
            if turns:
                out.append({"uid": None, "inserted": turns, "edit": "", "role": ""})
            audits[j] = "".join("I" * len(x["inserted"]) + x["edit"] for x in out)
            costs[j], rows[j] = cost, out
            roles = [c & 3 for c in codes]
            illegal[j] = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(roles, roles[1:]))
        kind = pa.list_(pa.struct([("uid", pa.int64()), ("inserted", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("block"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(rows, kind)],
            names=["key", "block", "audit", "cost", "illegal", "edits"],
        )


_EDITS = "key string, block long, audit string, cost long, illegal long, edits array<struct<uid:long,inserted:array<string>,edit:string,role:string>>"

Value = list[int]


def _times(a: Value, b: Value) -> Value:
    return [min(FOREVER, *(a[4 * p + r] + b[4 * r + q] for r in range(4))) for p in range(4) for q in range(4)]


def _scan(blocks: DataFrame, join: Callable[[Value, Value], Value], step: Callable[[Value, Value], Value], start: Value, backwards: bool) -> DataFrame:
    """(key, block, state): what ``step`` makes of ``start`` over all earlier blocks (key, block, value), or later ones.

    ``join`` of two neighbours' values stands for both. ``FAN`` blocks meet in one row, in as many levels as the longest key needs.
    """
    group = F.floor(F.col("block") / FAN).cast("long")
    parts = materialize(blocks.groupBy("key", group.alias("above")).agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts")), "scan")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("parts").to_pylist():
                value = row[0]["value"]
                for x in row[1:]:
                    value = join(value, x["value"])
                out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("above"), pa.array(out, pa.list_(pa.int64()))], names=["key", "block", "value"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, states = [], [], []
            for key, row, state in zip(*(batch.column(c).to_pylist() for c in ("key", "parts", "state")), strict=True):
                for x in reversed(row) if backwards else row:
                    keys.append(key)
                    at.append(x["block"])
                    states.append(state)
                    state = step(x["value"], state)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int64()), pa.array(states, pa.list_(pa.int64()))], names=["key", "block", "state"])

    if parts.where("above > 0").isEmpty():
        begun = parts.withColumn("state", F.array(*[F.lit(v).cast("long") for v in start]))
    else:
        up = _scan(parts.mapInArrow(joined, "key string, block long, value array<long>"), join, step, start, backwards)
        begun = parts.join(up.withColumnRenamed("block", "above"), ["key", "above"])
    return begun.mapInArrow(spread, "key string, block long, state array<long>")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of rows sorted by key and place: each key's pieces joined by newlines, fed one by one."""
    key, digest = None, None
    for batch in batches:
        for own, piece in zip(batch.column("key"), batch.column("piece"), strict=True):
            own = own.as_py()
            if digest is not None and own == key:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "digest"])
                key, digest = own, hashlib.sha256()
            digest.update(piece.as_py().encode())
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "digest"])


def conversation_key(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))


@dataclass
class Repair:
    """``report``: a row a conversation (key, conv_id, counts, cost, audit, repaired_sha256); ``rows``: the repaired
    conversations' rows (key, place, added, role, text), where added numbers the turns inserted before a place."""

    report: DataFrame
    rows: DataFrame


def repair(turns: DataFrame) -> Repair:
    """Repairs (conv_id, turn, role, text)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    body = F.rtrim(text, F.lit(SPACE))
    rows = turns.select(
        conversation_key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").isNotNull().cast("int").alias("timed"), "turn", role.alias("role"), text.alias("text"),
        F.md5(text).alias("digest"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    rows = numbered(rows, "uid")
    slim = running_sum(rows.select("uid", "key", "conv_id", "timed", "turn", "role", "digest", "blank", "open"), ["key"], ["timed", "turn", "role", "digest", "uid"], F.lit(1), "place")
    slim = materialize(slim, "places")
    again = slim.groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialize(again, "again")
    told = slim.join(again, ["key", "role", "digest"], "left")
    repeated = F.coalesce(F.col("place") > F.col("first"), F.lit(False)) & ~F.col("blank")
    told = told.withColumn("repeated", repeated).withColumn("broken", F.col("open") & ~F.col("blank") & ~F.col("repeated"))
    initial = F.left("role", F.lit(1))
    kind = F.coalesce(*[F.when(initial == x, i) for i, x in enumerate(CLASSES)], F.lit(3))
    code = kind + F.when(F.col("blank") | F.col("repeated"), MUST_GO).otherwise(0) + F.when(F.col("broken"), BROKEN).otherwise(0)
    block = F.floor((F.col("place") - 1) / CHUNK).cast("long")
    told = told.withColumn("code", F.char(F.lit(ord("a")) + code)).withColumn("block", block)
    packed = told.groupBy("key", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", "code", "uid"))).alias("x"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "repeated", "broken")],
    )
    packed = packed.select("key", "block", F.array_join("x.code", "").alias("codes"), F.col("x.uid").alias("uids"), "blank", "repeated", "broken")
    packed = materialize(packed, "chunks")
    several = materialize(packed.groupBy("key").agg(F.max("block").alias("final")).where("final > 0"), "several")
    long_ = packed.join(several, "key")
    end = F.array(*[F.lit(v).cast("long") for v in AT_END])
    whole = packed.join(several, "key", "left_anti").select("key", "block", "codes", "uids", end.alias("ends"), F.lit(0).alias("entered"), F.lit(True).alias("last"))
    if not several.isEmpty():
        costs = long_.select("key", "block", "codes").mapInArrow(_matrices, "key string, block long, value array<long>")
        ends = _scan(costs, _times, lambda m, v: [min(FOREVER, *(m[4 * p + q] + v[q] for q in range(4))) for p in range(4)], AT_END, True)
        ended = materialize(long_.join(ends.withColumnRenamed("state", "ends"), ["key", "block"]).select("key", "block", "codes", "uids", "ends", (F.col("block") == F.col("final")).alias("last")), "ends")
        left = ended.select("key", "block", "codes", "ends").mapInArrow(_exits, "key string, block long, value array<long>")
        entered = _scan(left, lambda f, g: [g[x] for x in f], lambda f, s: [f[s[0]]], [0], False)
        parts = ended.join(entered.select("key", "block", F.col("state")[0].cast("int").alias("entered")), ["key", "block"])
        whole = whole.unionByName(parts)
    edits = materialize(whole.mapInArrow(_edits, _EDITS), "edits")
    each = edits.select("key", "block", F.posexplode("edits").alias("at", "e")).select("key", (F.col("block") * CHUNK + F.col("at") + 1).alias("place"), "e.*")
    # only what stays is looked up
    stays = each.where((F.col("edit") != "D") | (F.size("inserted") > 0)).join(rows.select("uid", F.col("role").alias("own"), "text"), "uid", "left")
    there = F.col("edit").isin("K", "R")
    own = F.struct(F.when(F.col("edit") == "R", F.col("role")).otherwise(F.col("own")).alias("role"), F.col("text").alias("text"))
    lines = F.concat(F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))), F.when(there, F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    repaired = stays.select("key", "place", lines.alias("lines"))
    pieces = repaired.select("key", "place", F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("piece"))
    digests = pieces.repartition("key").sortWithinPartitions("key", "place").select("key", "piece").mapInArrow(_hashed, "key string, digest string")
    own_rows = repaired.select("key", "place", F.posexplode("lines").alias("added", "line")).select("key", "place", "added", "line.role", "line.text")

    span = slim.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    faults = packed.groupBy("key").agg(F.sum("blank").alias("blank"), F.sum("repeated").alias("duplicate"), F.sum("broken").alias("truncated"))
    spelled = edits.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    # neighbours on either side of a cut between chunks
    tail = long_.select("key", (F.col("block") + 1).alias("block"), F.right("codes", F.lit(1)).alias("a"))
    cuts = tail.join(long_.select("key", "block", F.left("codes", F.lit(1)).alias("b")), ["key", "block"])
    pair = [(F.ascii(x) - ord("a")).bitwiseAND(3) for x in ("a", "b")]
    wrong = ~F.concat(*[p.cast("string") for p in pair]).isin("01", "12", "21")
    cuts = cuts.groupBy("key").agg(F.sum(wrong.cast("long")).alias("cut"))
    report = span.join(faults, "key").join(spelled, "key").join(cuts, "key", "left").join(digests, "key", "left")
    report = report.select(
        "key", "conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("cut", F.lit(0))).alias("illegal"), "cost", "audit",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    discard(again)
    return Repair(report, own_rows)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the remainder of crc32 of ``conv_id:turn`` by 20: 0 drops a row,
    1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 sets its role to user.
    Nulls are one space."""
    space = F.lit(" ")
    mark = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    hurt = turns.withColumn("mark", mark).where("mark <> 0").select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("mark") == 3, 2).otherwise(1).alias("times"),
    )
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
