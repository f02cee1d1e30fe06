import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tendersieve.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, Key string"
TURNS = {"u": "user", "a": "assistant"}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def brute(rows):
    """Report of one conversation's (turn, role, text) rows by plain recursion over audits."""
    rows = order([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(C.SPACE)
        faults.append("blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for x in "ua":
                if (state, x) in after:
                    c, a, t = best(i, x, inserted + 1)
                    found.append((c + 5, "I" + a, (TURNS[x] + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if faults[i] in ("", "cut"):
                extra = 5 if faults[i] else 0
                if (state, role[:1]) in after:
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                for x in "ua":
                    if (state, x) in after:
                        c, a, t = best(i + 1, x, 0)
                        found.append((c + extra + 1, "R" + a, (f"{TURNS[x]}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    return gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(rnd, n):
    rows = []
    for t in range(n):
        role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None] if rnd.random() < 0.3 else [("user", "assistant")[t % 2]])
        text = rnd.choice(["Yes.", "No!", "Why?", "cut off", " \t", "", None, f"number {rnd.randrange(99)}.", f"open {t}", "end. \n"])
        rows.append((None if rnd.random() < 0.05 else t + rnd.choice([0, 0, 0, 2]), role, text))
    return rows


def reports(spark, conversations):
    rows = [(c, *r, "x") for c, own in conversations.items() for r in own]
    random.Random(1).shuffle(rows)
    found = C.repair(spark.createDataFrame(rows, SCHEMA))
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in found.report.collect()}, found


@pytest.mark.parametrize("chunk, fan", [(256, 256), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, chunk, fan):
    """Small chunks and fans take every conversation through matrices in several levels."""
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "FAN", fan)
    rnd = random.Random(7)
    data = {c: conversation(rnd, rnd.choice([1, 2, 3, 5, 8, 13, 21])) for c in range(60)}
    data[None] = conversation(rnd, 6)
    data[99] = [(None, None, None)] * 3
    got, found = reports(spark, data)
    assert got == {c: brute(rows) for c, rows in data.items()}
    lines = {}
    for r in found.rows.orderBy("key", "place", "added").collect():
        lines.setdefault(r["key"], []).append(f"{r['role']}:{r['text']}")
    for c in data:
        text = "\n".join(lines.get("" if c is None else f"={c}", []))
        assert hashlib.sha256(text.encode()).hexdigest() == got[c][-1]


def test_one_conversation_of_many_turns_and_a_long_text(spark):
    rows = [(t, ("user", "assistant")[t % 2], "x" * 200_000 + "." if t == 3 else f"turn {t}.") for t in range(1000)]
    rows[500] = (500, "assistant", "turn 500.")
    got, _ = reports(spark, {5: rows})
    assert got[5][:6] == (0, 0, 0, 0, 2, 1) and got[5][6] == "K" * 500 + "R" + "K" * 499


def test_empty_table(spark):
    found = C.repair(spark.createDataFrame([], SCHEMA))
    assert found.report.count() == found.rows.count() == 0


def test_damage_by_its_rule(spark):
    rows = [(c, t, "assistant", "A b. C! d?") for c in range(8) for t in range(12)] + [(None, None, None, None), (3, None, None, "x."), (None, 4, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        new = (c, t, "user" if mark == 4 else role, "" if mark == 1 else "".join(x for x in text if x not in ".!?") if mark == 2 else text)
        want += [new] * {0: 0, 3: 2}.get(mark, 1)
    got = [tuple(r) for r in C.damage(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_copies_of_one_turn_in_a_third_of_all_rows(spark):
    rows = [(t, "user", "Same." if t % 3 else f"turn {t}.") for t in range(300)]
    got, _ = reports(spark, {1: rows, 2: [(0, "user", "Hello."), (1, "assistant", "Hello.")]})
    assert got[1][2] == 199 and got[2][5] == 0
