"""The whole pipeline on a small table, against the chained brute-force versions of its stages."""

import hashlib
import random
from collections import Counter

import corpus_pipeline

from .test_near_dedup import classes
from .test_quality_rules import longest_repeat_at
from .test_mixing import water

UNIT = 1 << 24


def made():
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(900)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = draw(60)
    texts = []
    for _ in range(24):
        t = draw(rng.randint(55, 120))
        texts.append(t)
        if rng.random() < 0.4:
            copy = list(t)
            copy[rng.randrange(len(copy))] = "edited"
            texts += [copy, t]
        if rng.random() < 0.3:
            texts.append(draw(40) + passage + draw(30))
    texts += [draw(10), draw(30) * 3, ["same"] * 80, []]
    rows = [(i * 3 % 997, " ".join(t), "en", rng.choice(["web", "books", None]), len(" ".join(t))) for i, t in enumerate(texts)]
    return [*rows, (998, None, "en", "web", 0)]


def kept(text):
    w = (text or "").split()
    n = len(w)
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    twice = {p for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    if n < 50 or 100 * len(twice) > 50 * n:
        return False
    repeats = longest_repeat_at(w)
    covered = {p for i, k in enumerate(repeats) if k >= 10 for p in range(i, i + k)}
    return len(covered) <= 0.5 * n and max(repeats) <= 400


def without_repeats(rows, threshold=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + threshold] for t in raw for i in range(len(t) - threshold + 1))
    out = []
    for t in raw:
        gone = {p for i in range(len(t) - threshold + 1) if seen[t[i : i + threshold]] > 1 for p in range(i, i + threshold)}
        out.append(bytes(b for p, b in enumerate(t) if p not in gone).decode("utf-8", "ignore"))
    return out


def times(rows):
    """Copies of each (id, text, source): systematic sampling in order of size and id."""
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    goal = water(total, {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}, 1.5 * sum(total.values()), 2.0)
    out = {}
    for s in sources:
        rate = round(goal[s] / total[s] * UNIT) if total[s] else 0
        shift = int(hashlib.md5(f"7:{s or ''}".encode()).hexdigest()[:6], 16)
        for k, i in enumerate(sorted((i for i, _, x in rows if x == s), key=lambda i: (size[i], i)), 1):
            out[i] = (k * rate + shift) // UNIT - ((k - 1) * rate + shift) // UNIT
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = [r for r in rows if kept(r[1])]
    named = classes([(r[0], r[1]) for r in good])
    one = sorted((r for r, (i, least) in zip(good, named, strict=True) if i == least), key=lambda r: r[0])
    one = [r for k, r in enumerate(one) if not k or one[k - 1][0] != r[0]]
    assert len(rows) > len(good) > len(one)
    texts = without_repeats([(r[0], r[1]) for r in one])
    cut = [(r[0], t, r[3]) for r, t in zip(one, texts, strict=True)]
    assert any(t != r[1] for r, t in zip(one, texts, strict=True))
    want = Counter({i: n for i, n in times(cut).items() if n})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r.decoded_ok and r.n_pieces == len(r.ids) for r in got)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
