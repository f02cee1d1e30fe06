import random

import numpy as np

from tendersieve.llm.near_dedup import keep_one, near_duplicates, probminhash, shingles


def classes(rows):
    """Brute force: components of the pairs of similarity 0.8 or more, each named by its least id."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if all_ == 0 or both / all_ >= 0.8:
                name = [name[j] if x == name[i] else x for x in name]
    least = {}
    for k, (i, _) in zip(name, rows, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [(i, least.get(k)) for k, (i, _) in zip(name, rows, strict=True)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " \n "), (None, "lone words"), (903, "one two"), (904, "one two"), (None, None)]
    for d in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 150))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows) + 1000 * d, " ".join(copy)))
    return rows


def test_classes(spark):
    for seed in (2,):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, uid int")
        got = [(r.id, r.class_id) for r in near_duplicates(docs).collect()]
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(got, key=key) == sorted(classes(rows), key=key)
        kept = keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({c for _, c in got if c is not None}) + len({c for i, c in got if c is None})


def test_groups_at_the_threshold(spark):
    """Edited copies of one text, many of them just beyond reach of each other, in edits shared and not; two groups in one cluster."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    shared = [(rng.randrange(60), f"s{i}") for i in range(6)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            at, word = rng.choice(shared)
            copy[at] = word
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"e{rng.randrange(400)}"
        if i % 3 == 0:
            copy = copy[: rng.randint(35, 60)] + [f"t{rng.randrange(3)}_{j}" for j in range(rng.randint(0, 12))]
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows)
    assert len({c for _, c in want}) > 20
    assert sorted((r.id, r.class_id) for r in near_duplicates(docs, registers=256, band=2).collect()) == sorted(want)


def test_recall_of_near_copies(spark):
    """Copies of similarity 0.8 or more, some with repeated passages: at least 0.99 share the class of their original."""
    rng = random.Random(8)
    rows, planted = [], []
    for d in range(120):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        if d % 3 == 0:
            base += base[:30]
        copy = list(base)
        for _ in range(len(base) // 50):
            copy[rng.randrange(len(copy))] = "edit"
        if d % 5 == 0:
            copy += base[:20]
        shingled = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy)]
        rows += [(2 * d, " ".join(base)), (2 * d + 1, " ".join(copy))]
        if len(shingled[0] & shingled[1]) >= 0.8 * len(shingled[0] | shingled[1]):
            planted.append(d)
    got = {r.id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) > 80
    assert sum(got[2 * d] == got[2 * d + 1] for d in planted) >= 0.99 * len(planted)


def test_clashing_columns_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, 1, 2, "x"), (2, long + " more", 3, 4, "y"), (3, None, None, None, None)], "doc_id long, text string, uid int, UID_ int, `class` string")
    assert [tuple(r)[0] for r in keep_one(docs).orderBy("doc_id").collect()] == [1, 3]
    assert keep_one(docs).columns == docs.columns


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and keep_one(docs).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    elements = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 200), rng.uniform(0.5, 4, 200)
    b[:100] = a[:100]
    doc = np.repeat([0, 1], 200)
    s = probminhash(doc, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, registers=4096)
    truth = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(200))
    assert abs((s[0] == s[1]).mean() - truth) < 0.03


def test_shingles_of_short_texts():
    doc, h, count = shingles([b"", b"a b", b"a b c d e a b c d e a b c d e", b"a b"])
    assert doc.tolist().count(0) == 0 and h[doc == 1] == h[doc == 3]
    assert count[doc == 2].sum() == 11 and (doc == 2).sum() == 5
