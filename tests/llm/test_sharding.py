import random
import zlib

from tendersieve.llm.sharding import shard


def test_laws(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["copy" * 10] * 40 + [None, "", None]
    rows = [(rng.choice([i, i, None]), t, rng.choice(["en", "fr", None]), rng.choice(["a", "source-long-name", ""]), 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, size int")
    out = shard(docs, shards=16).collect()
    assert sorted((r.id is None, r.id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in docs.collect())
    total = [0] * 16
    slots = [[] for _ in range(16)]
    where = {}
    for r in out:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values()), "equal texts stay together"
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(total) / 16
    assert max(total) - min(total) < 0.1 * mean + 40 * 41, total  # a group of copies is not split
    assert sum(r.size for r in out) == sum(len((t or "").encode()) + 1 for t in texts + [r[1] for r in rows[:2]])
    assert {r.text_crc32 for r in out} == {zlib.crc32((t or "").encode()) for t in texts}


def test_target_bytes_and_few_rows(spark):
    docs = spark.createDataFrame([(i, "x" * 99) for i in range(64)], "doc_id long, text string")
    one = shard(docs, shards=4).collect()
    assert len({r.shard for r in one}) == 1  # one text, one group
    docs = spark.createDataFrame([(i, f"{i:099}") for i in range(64)], "doc_id long, text string")
    out = shard(docs, shards=None, target_bytes=1000).collect()
    total = {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) <= 1000 and len(total) == 8
    assert shard(docs.limit(0)).count() == 0
    assert [(r.id, r.shard, r.slot, r.size) for r in shard(docs.limit(1)).collect()] == [(0, 0, 0, 100)]


def test_group_of_a_third_of_all_bytes_and_least_id(spark):
    rows = [(i, "c" * 99) for i in range(200)] + [(i, f"{i:099}") for i in range(200, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"shards": 16}, {"shards": None, "target_bytes": 3000}):
        total, copies = {}, set()
        for r in shard(docs, **how).collect():
            total[r.shard] = total.get(r.shard, 0) + r.size
            copies |= {r.shard} if r.id < 200 else set()
        (heavy,) = copies
        assert sum(total.values()) == 60000
        rest = [w for k, w in total.items() if k != heavy]
        if "target_bytes" in how:
            assert max(rest) <= 3000 and total[heavy] <= 20000 + 3000
        else:
            assert set(total) == set(range(16)) and total[heavy] == 20000 and max(rest) - min(rest) <= 200
