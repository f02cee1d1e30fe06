"""Columns of clashing names, and one very long text, through every operator."""

import public_tokenizers
import pytest

from tendersieve.llm.audio import align
from tendersieve.llm.license_scan import license_scan
from tendersieve.llm.mixing import copies, mix
from tendersieve.llm.near_dedup import keep_one
from tendersieve.llm.pieces import encode_documents
from tendersieve.llm.quality_rules import quality_rules
from tendersieve.llm.sharding import shard
from tendersieve.llm.suffix_dedup import suffix_dedup
from tendersieve.llm.token_files import digests, read_parts, write_tokens
from tendersieve.llm.url_filter import filter_urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ("__uid", "uid", "spans", "__spans", "__blocks", "found", "__found", "Kept", "Labels", "N_BYTES", "IDS", "Rule", "s_uid")
#: The columns of CLASHES that a result takes the place of.
REPLACED = {"quality_rules": {"Kept"}, "license_scan": {"Labels"}, "suffix_dedup": {"N_BYTES"}, "encode_documents": {"IDS"}, "filter_urls": {"Rule"}, "mix": set(), "keep_one": set()}


def clashing(spark, text="text"):
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = [(1, "some words of a text", "a", *CLASHES), (2, long, "b", *CLASHES), (3, None, None, *[None] * len(CLASHES))]
    return spark.createDataFrame(rows, f"doc_id long, {text} string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))


@pytest.mark.parametrize("name", sorted(REPLACED))
def test_clashing_names(spark, name):
    docs = clashing(spark, "url" if name == "filter_urls" else "text")
    out = {
        "quality_rules": lambda: quality_rules(docs), "license_scan": lambda: license_scan(docs), "suffix_dedup": lambda: suffix_dedup(docs),
        "encode_documents": lambda: encode_documents(docs, PIECES), "filter_urls": lambda: filter_urls(docs, [("block", "com", "/")]), "mix": lambda: mix(docs), "keep_one": lambda: keep_one(docs),
    }[name]()
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3} and (name == "mix" or len(rows) == 3)
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)
    for c in set(CLASHES) - REPLACED[name]:
        assert {r[c] for r in rows if r.doc_id < 3} <= {c}, c


def test_a_very_long_text(spark, tmp_path):
    docs = clashing(spark).select("doc_id", "text", "source")
    assert {r.id: r.size for r in copies(docs).collect()} == {1: 5, 2: 120_000, 3: 0}
    assert shard(docs, shards=2).count() == 3
    assert align(docs.selectExpr("doc_id", "encode(text, 'utf-8') as audio"), sample="u1").count() == 3
    write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.id: r.n_tokens for r in digests(read_parts(spark, str(tmp_path / "t"))).collect()}
    assert got[3] == 1 and got[2] > 120_000
