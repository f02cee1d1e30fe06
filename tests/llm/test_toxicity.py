import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tendersieve.llm import toxicity as T
from tendersieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_index_equals_brute_force():
    rnd = random.Random(5)
    vectors = []
    for _ in range(700):
        terms = sorted(rnd.sample(range(40), rnd.choice([1, 1, 2, 5, 12])))
        w = np.array([rnd.choice([1.0, 2.0, 3.5]) for _ in terms])
        vectors.append((np.array(terms), w / math.sqrt(w @ w)))
    index = T.Index.of(list(range(700)), [i % 2 for i in range(700)], vectors, 40)
    dense = np.zeros((700, 40))
    for place, row in enumerate(index.order):
        dense[place, vectors[row][0]] = vectors[row][1]
    for term, weight in vectors[:120]:
        q = np.zeros(40)
        q[term] = weight
        cosine = dense @ q
        want = sorted(range(700), key=lambda p: (-round(cosine[p], 9), p))[:9]
        places, found = index.nearest(term, weight, 9)
        assert np.allclose(found, cosine[want][: len(found)])
        assert all(cosine[p] <= found[-1] + 1e-9 for p in set(range(700)) - set(places.tolist()))
        assert sorted(found, reverse=True) == list(found)


def test_an_index_without_examples():
    places, cosines = T.Index.of([], [], [], 3).nearest(np.array([1]), np.array([1.0]), 4)
    assert len(places) == len(cosines) == 0


def test_words_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(f"Wort{i % 37}" for i in range(5000)) + " ende"
    whole = Counter(T.WORD.findall(text.lower()))
    monkeypatch.setattr(T, "PIECE", 64)
    assert T.word_counts(text) == whole
    assert T.word_counts("x" * 1000) == {"x" * 1000: 1}


def test_terms_counted_as_by_the_plain_rule(spark):
    texts = ["loserA loserB loserC trash trash", "", None, "y" * 60 + " losers", "trash-can, TRASH!"]
    vocabulary = sorted({"lose*", "loser*", "lose*2", "loser*3", "trash", "tras*", "yyyy*", "loser*8"})
    place = {t: i for i, t in enumerate(vocabulary)}
    got = T.term_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), place).collect()
    for r in got:
        words = T.word_counts(texts[r["id"]] or "")
        want = {place[t] for t in T.terms_of(words) if t in place}
        assert set(r["terms"]) == want
    assert {vocabulary[t]: n for t, n in zip(got[0]["terms"], got[0]["counts"])} == {"lose*": 3, "loser*": 3, "lose*2": 1, "loser*3": 1, "trash": 2, "tras*": 2}


def test_isotonic_is_the_least_squares_fit():
    x = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    steps, values = T._isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]))
    assert list(steps) == [0.1, 0.3, 0.5] and np.allclose(values, [0.25, 1.5 / 4, 2.5 / 3])


def small(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice("abcdefgh") + rnd.choice("klmnop") * 3 + str(rnd.randrange(400)) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[3:3] = rnd.sample(["vilest", "rotten", "wretch"], 2)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, Score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_leaves_clean_texts_alone(spark):
    docs, labels = small(spark)
    more = spark.createDataFrame([(1000, "a rotten wretch", None), (1001, "nothing here", None), (1002, None, ""), (None, "vilest rotten", ""), (1003, "", ""), (1003, "", "")], docs.schema)
    got = {(r["doc_id"], i): r for i, r in enumerate(T.toxicity(docs.unionByName(more), labels).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in got.items()}
    assert len(got) == 306
    assert by[1000]["predicted"] == 1 and by[None]["predicted"] == 1
    assert by[1001]["predicted"] == by[1002]["predicted"] == by[1003]["predicted"] == 0
    assert by[1002]["score"] == by[1003]["score"] and all(0 <= r["score"] <= 1 for r in by.values())
    assert all(by[i]["predicted"] == (i % 5 == 0) for i in range(300))
    assert [e["label"] for e in by[1000]["evidence"]] == [1] * 5


def test_empty_tables_null_labels_and_one_kind(spark):
    docs, labels = small(spark, 40)
    assert T.toxicity(docs.limit(0), labels).count() == 0
    none = T.toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert T.toxicity(docs, labels.withColumn("toxic", F.lit(0))).agg(F.max("score")).first()[0] < 0.1


def test_same_scores_for_any_partitioning(spark):
    docs, labels = small(spark, 120)
    a = sorted(tuple(r) for r in T.toxicity(docs, labels, sample=60, examples=30).select("doc_id", "score").collect())
    assert a == sorted(tuple(r) for r in T.toxicity(docs.repartition(7), labels.repartition(3), sample=60, examples=30).select("doc_id", "score").collect())


def test_held_out_accuracy(spark):
    got = QUERIES["op11_toxicity"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in held)
    assert hit / sum(r["toxic"] for r in held) >= 0.8 and hit / sum(r["predicted"] for r in held) >= 0.97
    # calibration: the mean score of ten groups is near the share of label 1
    held.sort(key=lambda r: r["score"])
    parts = np.array_split(np.arange(len(held)), 10)
    assert sum(abs(np.mean([held[i]["score"] - held[i]["toxic"] for i in p])) for p in parts) / 10 < 0.03
