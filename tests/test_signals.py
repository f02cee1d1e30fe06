import random
import re
from collections import Counter

import pytest

from tendersieve.operators import signals as G
from tendersieve.operators.retrieval import words

TERMS = [("CLOUD", True, "cloud", True), ("CLOUD", True, "cloud server", False), ("CLOUD", True, "backup", False), ("CLOUD", True, "data centre", False), ("MAKER", False, "Acme", False), ("MAKER", False, "acme one", False), ("SHARED", False, "cloud server", False), ("LAW", False, "firma", True)]
DICTIONARY = "label string, category boolean, term string, ambiguous boolean"


def plain(docs, terms):
    """The rules row by row, mentions by one expression a label."""
    hits, outside = {}, set()
    for tender, kind, text in docs:
        padded = "  " + "  ".join(words(text or "")) + "  "
        for label in {t[0] for t in terms}:
            own = sorted({" ".join(words(t[2])) for t in terms if t[0] == label}, key=lambda w: (-w.count(" "), w))
            pattern = "|".join(w.replace(" ", "  ") for w in own)
            for term in re.findall(f" ({pattern})(?:es|s)? ", padded):
                key = (tender, label)
                hits.setdefault(key, Counter())[term.replace("  ", " ")] += G.KIND_WEIGHTS.get(kind, G.OTHER_WEIGHT)
                if kind in G.LABELLING:
                    outside.add(key)
    out = {}
    for key, own in hits.items():
        known = {" ".join(words(t[2])): t for t in terms if t[0] == key[1]}
        firm = sum(not known[t][3] for t in own)
        total = round(sum(min(v, 3.0) for v in own.values()), 9)
        if key in outside and firm >= (2 if any(k[1] for k in known.values()) else 1) and total >= 2:
            out[key] = (round(min(1.0, total / 6), 4), "|".join(sorted(own)))
    return out


@pytest.mark.parametrize("limit", [G.AUTOMATON, 20])
def test_scores_equal_the_plain_rules(spark, monkeypatch, limit):
    rnd = random.Random(3)
    parts = ["cloud server", "Cloud", "clouds", "backups", "data centres", "ACME one", "acme", "Ácme", "firma", "firmas", "serving", "cloudy", "x", "-", "cloud servers backup"]
    docs = [(rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice(["technical", "legal", "additional", None, "odd"]), " ".join(rnd.choices(parts, k=rnd.randrange(9)))) for _ in range(80)]
    docs += [(9, "technical", None), (9, None, "")]
    df = spark.createDataFrame(docs, "tender long, kind string, text string")
    dictionary = spark.createDataFrame([*TERMS, (None, True, "x", False), ("CLOUD", True, None, False), ("CLOUD", True, "--", False)], DICTIONARY)
    want = plain(docs, TERMS)
    assert len(want) > 5
    found = G.document_mentions(df, dictionary, limit)
    whole = Counter()
    for r in found.collect():
        whole[r["tender"], r["label"], r["term"]] += r["n"]
    assert whole == sum((Counter({(t, label, term): n for (label, term), n in G.mentions(x or "", G._automaton([(a, b) for a, _, b, _ in TERMS])).items()}) for t, _, x in docs), Counter())
    assert {(r["tender"], r["label"]): (r["score"], r["terms"]) for r in G.score_documents(df, dictionary).collect()} == want


def test_empty_dictionary_and_texts(spark):
    docs = spark.createDataFrame([(1, "technical", "cloud")], "tender long, kind string, text string")
    dictionary = spark.createDataFrame(TERMS, DICTIONARY)
    assert G.score_documents(docs, dictionary.limit(0)).count() == G.score_documents(docs.limit(0), dictionary).count() == 0


def test_labels_are_never_removed(spark):
    rnd = random.Random(1)
    old = [(t, label, rnd.choice([None, 0.0, 0.2, 0.7]), rnd.choice([True, False, None])) for t in range(12) for label in "abc" if rnd.random() < 0.7]
    new = [(t, label, rnd.choice([0.1, 0.5, 0.9])) for t in range(6, 16) for label in "bcd" if rnd.random() < 0.7]
    new += new[:5]
    tables = spark.createDataFrame(old, "tender long, label string, score double, predicted boolean"), spark.createDataFrame(new, "tender long, label string, score double")
    merged, rows = G.merge_signals(*tables)
    told = {}
    for t, label, s in new:
        if s >= 0.5:
            told[t, label] = max(told.get((t, label), 0.0), s)
    score = {(t, label): s or 0.0 for t, label, s, _ in old}
    predicted = {(t, label) for t, label, _, p in old if p} | set(told)
    for key, s in told.items():
        score[key] = max(score.get(key, 0.0), s)
    assert {(r["tender"], r["label"]): (r["score"], r["predicted"]) for r in rows.collect()} == {k: (s, k in predicted) for k, s in score.items()}
    for r in merged.collect():
        own = sorted((-score[k], k[1]) for k in predicted if k[0] == r["tender"])
        assert tuple(r)[1:] == ((",".join(x for _, x in own), -own[0][0], own[0][1]) if own else (None, None, None))
