import random

import public_tokenizers
import pytest

from tendersieve.llm.pieces import decode, encode, encode_documents, load

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(p, text):
    """Score of the best of all segmentations, by recursion."""
    best = {len(text): 0.0}
    for s in range(len(text) - 1, -1, -1):
        ways = [p.table[text[s:e]][0] + best[e] for e in range(s + 1, min(len(text), s + p.longest) + 1) if text[s:e] in p.table]
        if text[s] not in p.table:
            ways.append(p.unknown + best[s + 1])
        best[s] = max(ways)
    return best[0]


def text(rng, n):
    return "".join(rng.choice(["the", "ing", " ", "  ", "é", "x", "ab", "▁", "漢", "\n", "other", ",", "😀"]) for _ in range(n))


def test_best_score_and_round_trip():
    p, rng = load(PATH), random.Random(2)
    for _ in range(80):
        t = text(rng, rng.randint(0, 60))
        ids = p.encode(t)
        assert p.decode(ids) == t
        m = p.mark(t)
        if m and "▁" not in t:
            units = p.lattice(m, len(m), [0.0])
            assert units[0][-1] == brute(p, m)
            assert p.trace(m, units[1], len(m))[1] == ids


@pytest.mark.parametrize("chunk", [20, 33])
def test_chunks_give_the_same_ids(spark, chunk):
    p, rng = load(PATH), random.Random(chunk)
    texts = [text(rng, rng.randint(0, 400)) for _ in range(12)] + [text(rng, 300).replace(" ", "") for _ in range(4)] + ["漢" * 5000, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    got = {r.uid: r.ids for r in encode(rows, PATH, chunk).collect()}
    assert got == {i: p.encode(t or "") for i, t in enumerate(texts)}


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, 5), (1, "a b", 6), (2, "", 7)], "doc_id long, text string, ids int")
    out = encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_pieces", "ids_crc32", "decoded_ok"]
    assert all(r.decoded_ok and r.n_pieces == len(r.ids) for r in out.collect())
    back = decode(out, PATH).collect()
    assert sorted(r.decoded for r in back) == ["", "", "a b", "a b"]
    assert encode_documents(docs.limit(0), PATH).count() == 0
