"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

Documents are encoded, dealt by range of their id and coded in that order. A block holds at most
``BLOCK`` ids of consecutive documents (longer documents go on in further blocks), is
coded with models of its own and has a crc32 of its ids, so any block can be read, checked
or lost alone. ``range_coder`` has the models and the coding; the blocks of a task are coded
side by side, up to ``LANES`` at a time, which bounds memory. Ids have 16 bits: a vocabulary
of more than 65,536 ids is refused.

Files: ``blocks`` (Parquet; part, seq, n, before, docs, payload, crc32; before counts the part's ids before the
block, docs has the documents' ids, numbers of ids here and before, and whether they go on) in document order, and
``index`` (Parquet; part, start), the number of ids before each part: a row a part, so blocks are read where they lie.

Defined cases: null is the empty text (only the end id); null document ids come last; rows of
equal id stay in the order they are read; an empty table gives empty files; a block whose crc32
doesn't match raises an error; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, materialize, slices
from .prefix import running_sum
from .range_coder import decode_blocks, encode_blocks

BLOCK = 2048
LANES = 4096
END = 2

#: Splits a text as the vocabulary's byte-level pre-tokenizer does; a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space amid other white space: the only kind that the pre-tokenizer may not begin a word at.
LONE = regex.compile(r"\s (?:\s|\Z)")
WORDS = 1_000_000


class _Coder:
    """The tokenizers library behind a memory of what stands between spaces, which it encodes alone anyway.

    Words that are not known yet are encoded as one text, and cut again by the bytes that each id stands for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token files hold ids of 16 bits; the vocabulary has more")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]  # a character of the vocabulary is a byte
        self.known: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _behind_spaces(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it; no word is empty or begins with white space."""
        spaced = [f" {w}" for w in words]
        whole = "".join(spaced)
        ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u2")
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(x.encode()) for x in spaced])
        at = np.searchsorted(ends, wanted)
        if any(x in whole for x in self.special) or at[-1] != len(ids) - 1 or (ends[at] != wanted).any():
            return self._alone(spaced)
        raw, cuts = ids.tobytes(), [0, *(2 * (at + 1)).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, words: list[str]) -> None:
        known = self.known
        new = list({w: None for w in words if w not in known})
        if len(known) + len(new) > WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        plain = [w for w in new if w and not w[0].isspace()]
        other = [w for w in new if not w or w[0].isspace()]
        if plain:
            known.update(zip(plain, self._behind_spaces(plain), strict=True))
        if other:
            known.update(zip(other, self._alone([f" {w}" for w in other]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers."""
        cut: list[list[str] | None] = [None if LONE.search(x) or any(s in x for s in self.special) else x.split(" ") for x in texts]
        self._learn([w for words in cut if words for w in words[1:]])
        known = self.known
        firsts = iter(self._alone([x if words is None else words[0] for x, words in zip(texts, cut, strict=True)]))
        return [first if not words else first + b"".join([known[w] for w in words[1:]]) for first, words in zip(firsts, cut, strict=True)]


@lru_cache(2)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stop = _coder(path), end.to_bytes(2, "little")
        for batch in batches:
            for first, part in slices(batch.column("text"), 1 << 20):
                ids = [x + stop for x in coder.encode([x.decode() for x in part])]
                rows = batch.slice(first, len(part)).select(["uid", "id"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.binary())], names=["uid", "id", "ids"])

    return run


BLOCKS = "part int, seq int, n int, before long, docs array<struct<id:long,n:int,at:long,more:boolean>>, payload binary, crc32 long"


def _code(block: int, lanes: int):
    """Rows (id, ids) in document order to blocks; ``more``: the document goes on in the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[dict] = []
        held: list[np.ndarray] = []
        full: list[tuple[list[dict], np.ndarray]] = []

        def close() -> None:
            nonlocal docs, held
            if docs:
                full.append((docs, np.concatenate(held)))
            docs, held = [], []

        def write() -> pa.RecordBatch:
            nonlocal seq, before, full
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for _, x in full]
            payloads = encode_blocks([x for _, x in full])
            ends = before + np.cumsum([len(x) for _, x in full])
            rows = [{"part": part, "seq": seq + i, "n": len(x), "before": int(ends[i]) - len(x), "docs": d, "payload": p, "crc32": c} for i, ((d, x), p, c) in enumerate(zip(full, payloads, crc, strict=True))]
            seq, before, full = seq + len(full), int(ends[-1]), []
            kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("before", pa.int64()), ("docs", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32()), ("at", pa.int64()), ("more", pa.bool_())]))), ("payload", pa.binary()), ("crc32", pa.int64())])
            return pa.RecordBatch.from_pylist(rows, kinds)

        room = block
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_py(), "<u2")
                if len(ids) > room and docs:
                    close()
                    room = block
                for a in range(0, len(ids), block):
                    piece = ids[a : a + block]
                    docs.append({"id": i, "n": len(piece), "at": a, "more": a + block < len(ids)})
                    held.append(piece)
                    room -= len(piece)
                    if a + block < len(ids):
                        close()
                        room = block
                if len(full) >= lanes:
                    yield write()
        close()
        if full:
            yield write()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, block: int = BLOCK, lanes: int = LANES) -> None:
    """Encode all texts, each with the id ``end`` behind it, and write the files to ``folder``."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    coded = materialize(rows.mapInArrow(_tokenize(tokenizer, end), "uid long, id long, ids binary"), "ids")
    keys = [F.col("id").asc_nulls_last(), F.col("uid")]
    dealt = coded.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "ids")
    dealt.mapInArrow(_code(block, lanes), BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    discard(coded)
    sizes = docs.sparkSession.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    ends = running_sum(sizes, [], ["part"], F.col("n"), "end")
    ends.select("part", (F.col("end") - F.col("n")).alias("start")).write.parquet(f"{folder}/index")


def _read(lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, lanes):
                part = batch.slice(lo, lanes)
                blocks = decode_blocks(part.column("payload").to_pylist(), part.column("n").to_pylist())
                out: list[tuple] = []
                for ids, crc, start, docs in zip(blocks, part.column("crc32").to_pylist(), part.column("start").to_pylist(), part.column("docs").to_pylist(), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"the block at {start} is damaged")
                    at = 0
                    for d in docs:
                        out.append((d["id"], start + at - d["at"], d["at"], d["n"], d["more"], raw[4 * at : 4 * (at + d["n"])]))
                        at += d["n"]
                columns = zip(*out, strict=True) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "at", "n", "more", "ids"])

    return run


def read_parts(spark: SparkSession, folder: str, lanes: int = LANES) -> DataFrame:
    """(id, start, at, n, more, ids): the documents' parts, ids as little-endian unsigned 32-bit integers.

    start counts the ids before the document, at those of the document before the part; ``more`` says that
    the document goes on in the next block.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    index = spark.read.schema("part int, start long").parquet(f"{folder}/index")
    placed = blocks.join(F.broadcast(index), "part").select("n", "docs", "payload", "crc32", (F.col("start") + F.col("before")).alias("start"))
    return placed.mapInArrow(_read(lanes), "id long, start long, at long, n int, more boolean, ids binary")


def _joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of bytes of which each part's (number of bytes, crc32) is known: as zeros behind them change the crc32 of those before."""
    crc = 0
    for size, own in parts:
        zeros = bytes(size)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
    return crc


def _crc():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [_joined([(4 * p["n"], p["crc"]) for p in x]) for x in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "start", "n_tokens"]).columns, pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def digests(parts: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document; ids of several parts need not come together, as their crc32 join."""
    parts = materialize(parts.select("id", "start", "at", "n", "more", F.crc32("ids").alias("crc")), "parts")
    alone = (F.col("at") == 0) & ~F.col("more")
    one = parts.where(alone).select("id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    several = parts.where(~alone).groupBy("start").agg(F.first("id").alias("id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    return one.unionByName(several.select("id", "start", "n_tokens", "pieces").mapInArrow(_crc(), "id long, start long, n_tokens long, ids_crc32 long"))
