import random
import re
import textwrap

from tendersieve.llm.license_scan import PHRASES, TEMPLATES, license_scan


def scan(text, phrases, templates, threshold):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    w = find(lower)
    places, base = [], set()
    for p, label in phrases:
        q = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
        places += at
        base |= {label} if at else set()
    more, score = set(), float(bool(places))
    for label, t in templates:
        own = set(t.split())
        lines = lower.split("\n")
        for i in range(len(lines)):
            share = len(own & set(find(" ".join(lines[i : i + 4])))) / len(own)
            if share >= threshold - 1e-12:
                more.add(label)
                score = max(score, share)
    out = len(w), len(places), min(places, default=None), max(places, default=None)
    return *out, ",".join(sorted(base)), ",".join(sorted(base | more)), score


def test_against_brute_force(spark):
    rng = random.Random(9)
    phrases = (*PHRASES, ("a b a", "aba"))
    templates = (*TEMPLATES, ("short", "a b c"), ("long", "a b c d e f g h i j"))
    bits = [t for _, t in templates] + [p for p, _ in phrases] + ["a", "b", "a b a b a", "c", "d e", "f g h", "é", "Zürich", "\n", "MIT License", "the", "license"]
    texts = [None, "", "...", "mit", "MIT-License mit license", "x\nmit\nlicense", "Licensed under the Apache License, Version 2.0."]
    for _ in range(200):
        parts = [rng.choice(bits) for _ in range(rng.randint(0, 14))]
        words = [x for p in parts for x in p.split(" ") if rng.random() < 0.93]
        texts.append("".join(x + rng.choice([" ", " ", ", ", "-", "\n"]) for x in words))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = license_scan(docs, phrases=phrases, templates=templates)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == scan(t, phrases, templates, 0.8), t
    assert license_scan(docs.limit(0)).count() == 0


def test_wrapped_licenses_are_found(spark):
    """Each template wrapped at 72 columns, behind comment marks, among other lines."""
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        lines = textwrap.wrap(text, 72)
        rows.append((i, label, "\n".join(["# made by hand", *(f"# {x}" for x in lines), "x = 1"])))
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    assert all(r.want in r.labels.split(",") for r in license_scan(docs).collect())
