import hashlib
import random

import numpy as np

from tendersieve.llm.suffix_dedup import first_least, suffix_dedup


def brute(texts, threshold):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - threshold + 1):
            s = t[i : i + threshold]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - threshold + 1):
            if seen[t[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases(rng, n, most):
    common = "".join(rng.choice("abcdé ") for _ in range(90))
    texts = [None, "", "short", "x" * 150, "ab" * 70, common, common]
    for _ in range(n):
        t = "".join(rng.choice("abc é") for _ in range(rng.randint(0, most)))
        if rng.random() < 0.5:
            a = rng.randint(0, 50)
            t = t[: most // 2] + common[a : a + rng.randint(10, 80)] + t[most // 2 :]
        if rng.random() < 0.3 and texts[-1]:
            t = texts[-1][: rng.randint(1, most)] + t
        texts.append(t)
    return texts


def test_first_least():
    rng = np.random.default_rng(1)
    for _ in range(100):
        v = rng.integers(0, 4, rng.integers(1, 60)).astype(np.uint64)
        w = int(rng.integers(1, 12))
        assert list(first_least(v, w)) == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


def test_against_brute_force(spark):
    for seed, threshold, group in ((1, 20, 4096), (2, 20, 2), (3, 33, 4096)):
        texts = cases(random.Random(seed), 120, 160)
        docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int")
        got = suffix_dedup(docs, threshold=threshold, group=group, keep_text=False)
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        rows = {r[0]: tuple(r)[1:] for r in got.collect()}
        assert [rows[i] for i in range(len(texts))] == brute(texts, threshold)


def test_empty_and_ids_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(empty).count() == 0
    docs = spark.createDataFrame([(None, "q" * 300), (None, "q" * 300), (1, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed, r.text) for r in suffix_dedup(docs).collect() if r.text is not None) == [(300, 300, ""), (300, 300, "")]
