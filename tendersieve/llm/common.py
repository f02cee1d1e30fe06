"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Seeds of the second half of a 128-bit text key.
_SECOND = 0x5EED


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is named, a temporary folder serves a local session; on a cluster that is an error, as a
    folder of our own choice would lie on one machine's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="tendersieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    The files outlive lost executors, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores behind it until it differs from all taken names, upper and lower case alike."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row, written once: numbers given anew in each job could differ between jobs."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: equal texts, and only they, share both."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(_SECOND), t).alias("k2")]


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive runs of about ``most`` bytes; null is empty.

    Bounds what numpy holds at a time whatever the Arrow batch size; a longer text stands alone.
    """
    out: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts):
        b = t.as_py() or b""
        if out and size + len(b) > most:
            yield first, out
            out, first, size = [], i, 0
        out.append(b)
        size += len(b)
    if out:
        yield first, out


def word_ids(texts: list[bytes], vocab: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as small integers.

    Returns (ids of all words in order, number of words per text, word -> id).
    ``bytes.split`` cuts at exactly the six ASCII white-space characters.
    """
    vocab = {} if vocab is None else vocab
    ids: list[int] = []
    counts = np.empty(len(texts), np.int64)
    get = vocab.setdefault
    for i, t in enumerate(texts):
        words = t.split()
        counts[i] = len(words)
        ids.extend([get(w, len(vocab)) for w in words])
    return np.array(ids, np.int64), counts, vocab


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each s, n."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)
