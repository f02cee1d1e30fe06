import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tendersieve.llm import common, token_files
from tendersieve.llm.range_coder import decode_blocks, encode_blocks
from tendersieve.llm.token_files import BLOCK, digests, read_parts, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip_and_predictable_ids_cost_less():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 5, 300, 17)] + [np.array([7, 8, 9] * 200), np.zeros(0, np.int64), np.full(3000, 65535)]
    coded = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[3]) > 550 and len(coded[5]) < 250 and len(coded[7]) < 400
    assert encode_blocks([]) == []
    with pytest.raises(ValueError, match="16384"):
        encode_blocks([np.zeros(20_000, np.int64)])


def test_any_mix_of_blocks_round_trips():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        blocks = []
        for _ in range(40):
            n = int(rng.integers(0, 1500))
            kind = rng.integers(0, 5)
            x = rng.integers(0, [3, 50, 600, 65536, 65536][kind], n)
            if kind == 4 and n > 10:
                x = np.tile(x[:7], n // 7 + 1)[:n]
                x[rng.integers(0, n, 5)] = 65535
            blocks.append(x)
        coded = encode_blocks(blocks)
        assert all((a == b).all() for a, b in zip(blocks, decode_blocks(coded, [len(b) for b in blocks]), strict=True))


def test_costs_less_than_deflate(spark):
    """Ids of the table's texts, in blocks of the default size, against zlib over the very same blocks."""
    t = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    ids = np.concatenate([t.encode(x, add_special_tokens=False).ids + [2] for x in texts])
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    mine, deflated = sum(map(len, encode_blocks(blocks))), sum(len(zlib.compress(b.astype("<u2").tobytes())) for b in blocks)
    assert mine < 0.9 * deflated


def test_files(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    texts = ["Hello  world\n\n it's", "", None, "x " * 900, "é漢 <|endoftext|> z", "\t 12 \x85y", "same", "same"]
    rows = [(90 - 10 * i if i != 6 else None, x, "extra") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = str(tmp_path / "f")
    write_tokens(docs, folder, PATH, block=64, lanes=3)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(read_parts(spark, folder, lanes=2)).collect()}
    start = 0
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), x
        start += len(ids)
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.withColumn("crc32", blocks.crc32 + 1).write.parquet(f"{folder}2/blocks")
    spark.read.parquet(f"{folder}/index").write.parquet(f"{folder}2/index")
    with pytest.raises(Exception, match="damaged"):
        read_parts(spark, f"{folder}2").collect()


def test_no_documents(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert digests(read_parts(spark, str(tmp_path / "e"))).count() == 0


def test_documents_of_several_parts_are_all_read(spark, tmp_path):
    t = Tokenizer.from_file(PATH)
    texts = [f"{i} words " * (1 + i % 40) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    folder = str(tmp_path / "f")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tokens(docs, folder, PATH, block=64, lanes=3)
        got = sorted(map(tuple, digests(read_parts(spark, folder)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{folder}/blocks").select("part").distinct().count() >= 3
    start, want = 0, []
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_digests_write_no_ids_and_old_ids_are_removed(spark, tmp_path, monkeypatch):
    """What is written beside the files are numbers of a part, however long the documents are."""
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(scratch))
    rnd = np.random.default_rng(3)
    texts = ["".join(chr(97 + x) for x in rnd.integers(0, 26, 60_000)), "short"]
    write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "f"), PATH)
    assert not list(scratch.glob("ids-*"))
    got = {r.id: (r.n_tokens, r.ids_crc32) for r in digests(read_parts(spark, str(tmp_path / "f"))).collect()}
    t = Tokenizer.from_file(PATH)
    want = {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    assert len(want[0]) > 2 * BLOCK
    assert sum(p.stat().st_size for p in scratch.rglob("*.parquet")) < 10_000


def test_payloads_are_read_where_they_lie(spark, tmp_path):
    """The index has a row a part and goes to the blocks, not they to it, whatever is thought small."""
    folder = str(tmp_path / "f")
    docs = spark.createDataFrame([(i, f"{i} words " * (1 + i % 30)) for i in range(200)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_tokens(docs, folder, PATH, block=64, lanes=3)
        plan = read_parts(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    blocks, index = spark.read.parquet(f"{folder}/blocks").collect(), {r.part: r.start for r in spark.read.parquet(f"{folder}/index").collect()}
    assert len(index) == len({b.part for b in blocks}) < len(blocks)
    start = 0
    for b in sorted(blocks, key=lambda b: (b.part, b.seq)):
        assert index[b.part] + b.before == start
        start += b.n


def test_texts_cut_at_spaces_have_the_ids_of_the_whole(monkeypatch):
    rnd = random.Random(1)
    parts = ["a", "b ", " ", "  ", "\n", "\t", "'s", "1", "é", "-", "\x85", "​", "\x1f", " x", "<|", "foo", "　", "<|endoftext|>"]
    texts = ["", " ", "a ", "a\n \nb", "a\n ", "don't 's 'll", *("".join(rnd.choices(parts, k=rnd.randrange(1, 30))) for _ in range(3000))]
    whole = Tokenizer.from_file(PATH)
    for most in (5, 1_000_000):
        monkeypatch.setattr(token_files, "WORDS", most)
        coder = token_files._Coder(PATH)
        got = [x for i in range(0, len(texts), 100) for x in coder.encode(texts[i : i + 100])]
        assert got == [np.array(whole.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
