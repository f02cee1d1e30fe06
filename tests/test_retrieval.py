import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendersieve.operators import retrieval as R
from tendersieve.search_queries import PROBES

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string"


def made(n=150, seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rnd.choice([1, 5, 30, 90]))), rnd.choice(["en", "de", None])) for i in range(n)]
    return [*rows, (n, None, "en"), (n + 1, "", "de"), (n + 2, "Ñandú w1! w1-w2", "en"), (3, "w1 w2 nandu", "de")]


def brute(rows, asked, n, fits=lambda r: True, every=False):
    texts = [R.words(r[1] or "") for r in rows]
    mean = sum(map(len, texts)) / len(texts)
    df = Counter(w for t in texts for w in set(t))
    out = []
    for qid, terms in asked.items():
        scores = []
        for r, t in zip(rows, texts):
            own = Counter(t)
            held = [w for w in set(terms) if own[w]]
            if not held or not fits(r) or every and len(held) < len(set(terms)):
                continue
            s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in held)
            scores.append((-round(s, 6), r[0]))
        out += [(qid, k, -s) for k, (s, _) in enumerate(sorted(scores)[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("first", [1, 8])
def test_bm25_equals_brute_force_through_bounds(spark, monkeypatch, every, first):
    monkeypatch.setattr(R, "BLOCK_BITS", 2)
    rows = made()
    asked = {1: ["w1", "w2"], 2: ["w5", "w40", "w5"], 3: ["nonesuch"], 4: ["nandu", "w1"], 5: ["w0", "w1", "w2", "w3"]}
    index = R.TextIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid int, term string")
    got = index.search(terms, 6, every=every, first=first).collect()
    assert sorted((r["qid"], r["rank"], r["score"]) for r in got) == brute(rows, asked, 6, every=every)
    scoped = index.search(terms, 6, F.col("lang") == "en", every, first).collect()
    assert sorted((r["qid"], r["rank"], r["score"]) for r in scoped) == brute(rows, asked, 6, lambda r: r[2] == "en", every)


def test_a_block_holds_many_documents_and_equal_queries_are_searched_once(spark):
    rows = made(120)
    index = R.TextIndex.build(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    # one row a term: bounds and queries no longer meet each 64 documents
    assert index.postings.where("term = 'w1'").count() == index.postings.select("block").distinct().count() == 1
    asked = {q: ["w1", "w7", "w30"] if q % 2 else ["w2"] for q in range(300)}
    got = index.search(spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid int, term string"), 5).collect()
    assert sorted((r["qid"], r["rank"], r["score"]) for r in got) == brute(rows, asked, 5)


def test_an_index_is_opened_again_and_may_be_empty(spark, tmp_path):
    docs = spark.createDataFrame(made(20), SCHEMA)
    terms = spark.createDataFrame([(1, "w1")], "qid int, term string")
    a = R.TextIndex.build(docs, path=f"{tmp_path}/a").search(terms, 5).collect()
    assert a == R.TextIndex.open(spark, f"{tmp_path}/a").search(terms, 5).collect() and len(a) == 5
    assert R.TextIndex.build(docs.limit(0)).search(terms, 5).count() == 0


def test_expressions(spark):
    assert R.parse_expression('"two words" or One -not -"this one" OR') == ([[["two", "words"], ["one"]]], [["not"], ["this", "one"]])
    assert R.parse_expression("") == ([], []) and R.parse_expression("OR a") == ([[["a"]]], [])
    rows = [(1, "red green blue", ""), (2, "green red", ""), (3, "red, GREEN!", ""), (4, "blue", ""), (5, None, ""), (6, "green red green", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Rank string")
    got = R.TextIndex.build(docs).web_search(docs, {1: '"red green"', 2: "red -blue", 3: "blue OR nothing", 4: "-red", 5: '"red green" -"green blue"'}, 9).collect()
    found = {}
    for r in got:
        found.setdefault(r["qid"], set()).add(r["key"])
    assert found == {1: {1, 3, 6}, 2: {2, 3, 6}, 3: {1, 4}, 5: {3, 6}}


def nearest(rows, queries, n, fits=lambda r: True):
    out = []
    for qid, v, own in queries:
        scores = [(-float(np.sign(s := float(R._unit(v) @ R._unit(r[1]))) * np.floor(abs(s) * 1e6 + 0.5) / 1e6), r[0]) for r in rows if R._unit(r[1]) is not None and r[0] != own and fits(r)]
        out += [(qid, k, key, -s) for k, (s, key) in enumerate(sorted(scores)[:n], 1)]
    return sorted(out)


def test_vector_lists_are_exact(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rnd.normal(size=8) * 0.3).tolist(), "ab"[i % 2]) for i in range(300)]
    rows += [(900, None, "a"), (901, [0.0] * 8, "a"), (902, [float("nan")] * 8, "b"), (903, [None] * 8, "b"), (904, rows[7][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side string")
    lists = R.VectorLists.build(df, lists=6)
    queries = [(i, rows[i][1], rows[i][0]) for i in range(0, 300, 20)] + [(7, rows[7][1], None)]
    asked = spark.createDataFrame(queries, "qid long, embedding array<double>, own long")
    assert sorted((r["qid"], r["rank"], r["key"], r["cosine"]) for r in lists.search(asked, 7).collect()) == nearest(rows, queries, 7)
    assert sorted((r["qid"], r["rank"], r["key"], r["cosine"]) for r in lists.search(asked, 7, F.col("side") == "a").collect()) == nearest(rows, queries, 7, lambda r: r[2] == "a")
    assert lists.search(asked.limit(0), 7).count() == 0
    assert R.VectorLists.build(df.limit(0)).search(asked, 7).count() == 0


def test_probes_find_nine_of_ten(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("vec_id").alias("own"))
    lists = R.VectorLists.build(vectors)
    exact = {(r["qid"], r["key"]) for r in lists.search(asked, 10).collect()}
    some = {(r["qid"], r["key"]) for r in lists.search(asked, 10, probes=PROBES).collect()}
    assert len(exact) == 1000 and len(exact & some) / len(exact) >= 0.9


def test_fusion(spark):
    assert R.fusion_weights(None) == R.fusion_weights(0.5) == (1.0, 1.0) and R.fusion_weights(1) == (0.0, 2.0)
    with pytest.raises(ValueError, match="alpha"):
        R.fusion_weights(1.5)
    text = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, key long, rank int")
    chunk = spark.createDataFrame([(1, 12, 7, 1), (1, 10, 5, 2), (1, 12, 3, 3)], "qid int, key long, chunk long, rank int")
    both = [tuple(r) for r in R.hybrid(text, chunk, 9).orderBy("rank").collect()]
    assert both == [(1, 10, round(1 / 61 + 1 / 62, 8), "5", 1), (1, 12, round(1 / 61 + 1 / 63, 8), "7,3", 2), (1, 11, round(1 / 62, 8), "", 3)]
    assert [r["key"] for r in R.hybrid(text, chunk, 9, alpha=0.0).orderBy("rank").collect()] == [10, 11]
