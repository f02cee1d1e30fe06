import random
import re

import numpy as np

from tendersieve.llm.quality_rules import quality_rules, suffix_repeats


def longest_repeat_at(t):
    out = []
    for p in range(len(t)):
        best = 0
        for q in range(len(t)):
            n = 0
            while q != p and max(p, q) + n < len(t) and t[p + n] == t[q + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_suffix_repeats():
    rng = random.Random(4)
    for _ in range(150):
        t = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        assert suffix_repeats(np.array(t, np.int64)).tolist() == longest_repeat_at(t)


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "é#*", "a b c a b c a", "x\x0by\x85z q"]
    for _ in range(40):
        texts.append("".join(rng.choice(["aé", "b", "c#", "dd|", "\n", " ", " e ", "\t", " long<word> "]) + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 200))))
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    out = quality_rules(docs)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        far = longest_repeat_at(w)
        covered = {p + k for p, n in enumerate(far) if n >= 10 for k in range(n)}
        assert (r.n_covered_words, r.longest_repeat) == (len(covered), max(far, default=0))
        assert r.kept == (not r.base_failed and len(covered) <= 0.5 * len(w) and max(far, default=0) <= 400)
    assert quality_rules(docs.limit(0)).count() == 0
