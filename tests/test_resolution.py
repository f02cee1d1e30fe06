import math
import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from tendersieve.entity_queries import award_parties, party_names
from tendersieve.functions import scalars as S
from tendersieve.operators import resolution as R

SF = "/root/testdata/sf0.001"


def typo(rnd, name):
    at = rnd.randrange(len(name))
    return rnd.choice([name[:at] + name[at + 1 :], name[:at] + rnd.choice("abcxyz") + name[at:], name[:at] + rnd.choice("abc") + name[at + 1 :]])


def made(n=120, seed=2):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 20, 40]))) for _ in range(n)]
    return [*base, *[typo(rnd, rnd.choice(base)) for _ in range(n)], "", None, "a", "aaaaaaaa", "aaaaaaaaa", "aaaaaaa"]


@pytest.mark.parametrize("kind, least", [("blocks", 0.85), ("blocks", 0.92), ("edit", 0.75), ("edit", 0.9)])
def test_similar_names_equal_all_pairs(spark, kind, least):
    left, right = made(), made(seed=3)[:60] + made()[100:]

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    measure = edit if kind == "edit" else lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(a, b): round(x, 9) for a in set(left) - {None, ""} for b in set(right) - {None, ""} if (x := measure(a, b)) >= least - 1e-12}
    frames = [spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right)]
    got = R.similar_names(*frames, least, kind).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): round(r["similarity"], 9) for r in got} == want


@pytest.mark.parametrize("kind", ["blocks", "edit"])
def test_any_two_lengths_share_a_bigram(kind):
    least = R.FLOORS[kind]
    for m in range(2, 300):
        for n in range(m, 300):
            k = math.floor((1 - least) * (m + n if kind == "blocks" else n) + 1e-9)
            if n - m <= k and n > 1:
                assert n - 1 - 2 * k >= 1


def test_too_low_a_similarity(spark):
    with pytest.raises(ValueError, match="bigram"):
        R.similar_names(*[spark.createDataFrame([], "name string")] * 2, 0.5)


def plain(rows, registry, least=0.92):
    """The cascade row by row."""
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    tax_of, alias_of, canonical = {}, {}, {}
    for company, alias, tax in sorted(registry, key=lambda r: r[0]):
        if tax is not None:
            tax_of.setdefault(tax, company)
            canonical[company] = min(canonical.get(company, tax), tax)
        if alias is not None:
            alias_of.setdefault(alias, company)
    out, new = {}, []
    for id_, alias, tax in rows:
        if tax in tax_of:
            out[id_] = ("tax", tax_of[tax], None, None)
        elif alias is None:
            out[id_] = ("skipped", None, None, None)
        elif alias in alias_of:
            other = canonical.get(alias_of[alias])
            bad = tax is not None and other is not None and tax != other
            out[id_] = ("review", alias_of[alias], None, 1.0) if bad else ("alias", alias_of[alias], None, None)
        elif like := get_close_matches(alias, sorted(alias_of), n=1, cutoff=least):
            out[id_] = ("review", alias_of[like[0]], None, ratio(like[0], alias))
        else:
            new.append((id_, alias, tax))
    founded, holders = {}, {}
    for id_, alias, tax in sorted(new):
        if tax is not None and tax in holders:
            status, _, by, score = out[holders[tax]]
            out[id_] = ("review" if status == "review" else "tax", None, by, score)
            continue
        if tax is not None:
            holders[tax] = id_
        if alias in founded:
            by, other = founded[alias]
            bad = tax is not None and other is not None and tax != other
            out[id_] = ("review", None, by, 1.0) if bad else ("alias", None, by, None)
        elif like := get_close_matches(alias, sorted(founded), n=1, cutoff=least):
            out[id_] = ("review", None, founded[like[0]][0], ratio(like[0], alias))
        else:
            founded[alias] = (id_, tax)
            out[id_] = ("created", None, id_, None)
    return {k: (s, a, b, None if x is None else round(x, 9)) for k, (s, a, b, x) in out.items()}


def run(spark, rows, registry):
    return {r["id"]: (r["status"], r["company_id"], r["created_by"], None if r["score"] is None else round(r["score"], 9)) for r in R.resolve(rows, registry).collect()}


def test_cascade_equals_row_by_row(spark):
    rnd = random.Random(9)
    base = [f"{rnd.choice(['OBRAS', 'AGUAS', 'LUZ'])} {''.join(rnd.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ', k=14))}" for _ in range(40)]
    registry = [(i, name, rnd.choice([None, f"FR{i}"])) for i, name in enumerate(base[:15])] + [(2, base[30], None), (40, base[3], "FR40"), (41, None, "FR41")]
    rows = []
    for i in range(160):
        name = rnd.choice(base)
        rows.append((i, typo(rnd, name).upper() if rnd.random() < 0.4 else name, rnd.choice([None, None, f"FR{rnd.randrange(60)}"])))
    rows += [(900, None, None), (901, "", "FR41"), (902, " S.L.", None)]
    df = spark.createDataFrame(rows, "id long, name string, tax string")
    names = {r["id"]: r["alias"] for r in df.select("id", S.company_name(F.coalesce("name", F.lit(""))).alias("alias")).collect()}
    want = plain([(i, names[i], t) for i, _, t in rows], registry)
    assert run(spark, df, spark.createDataFrame(registry, "company_id long, alias string, tax string")) == want
    assert {"tax", "skipped", "alias", "review", "created"} == {x[0] for x in want.values()}


def test_documents_as_parties(spark):
    rows, registry = award_parties(spark, SF)
    shaped = rows.select("id", S.company_name(F.coalesce("name", F.lit(""))).alias("alias"), F.when(S.tax_id_class(F.col("tax")) != "invalid", S.tax_id(F.col("tax"))).alias("tax"))
    want = plain([tuple(r) for r in shaped.collect()], [tuple(r) for r in registry.collect()])
    assert run(spark, rows, registry) == want


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "ALFA BETA", None), (2, "ALFA BETA", "FR1")], "id long, name string, tax string")
    registry = spark.createDataFrame([], "company_id long, alias string, tax string")
    assert R.resolve(rows.limit(0), registry).count() == 0
    assert run(spark, rows, registry) == {1: ("created", None, 1, None), 2: ("alias", None, 1, None)}


def test_names_of_common_words_meet_by_pieces_not_by_pairs(spark):
    """Names of the same few bigrams in other orders share no piece in its place, so hardly any of their pairs are met."""
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice(["THE", "AND", "OF ", "DE ", "LA "]) for _ in range(6)) for _ in range(400)})
    side = R._signed(spark.createDataFrame([(x,) for x in names], "name string"))
    met = R._pieces(side, "blocks", 0.92).withColumnRenamed("name", "a").join(R._places(side, "blocks", 0.92).withColumnRenamed("name", "b"), "key").select("a", "b").distinct()
    n = len(names)
    assert n <= met.count() < n * n / 4
    near = {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert near <= {tuple(r) for r in met.collect()}


def test_first_words_as_of_the_whole_text(spark, tmp_path):
    texts = [None, "", " .", "a", "Ñandú--x2 été four five", "ß1ſ2", "İstanbul Kelvin x y", "one\n\ntwo" + " " * 3000 + "three", "-" * 5000 + "z", "w" * 5000, "日本 one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    every = F.slice(F.regexp_extract_all(S.fold(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 3)
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.upper(F.array_join(every, " "))).collect()
    assert sorted(map(tuple, party_names(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("kind, least", [("edit", 0.75), ("blocks", 0.85)])
def test_each_way_of_two_blocks_finds_all_similar_pairs(kind, least, monkeypatch):
    """All pairs, one equal piece or two, whatever is held at a time."""
    monkeypatch.setattr(R, "HELD", 7)
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abñ") for _ in range(rnd.choice([2, 3, 5, 8, 12, 20, 36]))) for _ in range(60)]
    left, right = sorted(set(base)), sorted({typo(rnd, typo(rnd, x)) for x in base for _ in range(2)} | set(base[:20]))
    blocks = [{n: R._Block([x for x in side if len(x) == n]) for n in {len(x) for x in side} if n > 1} for side in (left, right)]
    similar = 0
    for a in blocks[0].values():
        for b in blocks[1].values():
            k = R._most(kind, least, a.length, b.length)
            if abs(a.length - b.length) > k:
                continue
            near = lambda x, y: _edit(x, y) <= k if kind == "edit" else SequenceMatcher(None, x, y).ratio() >= least - 1e-12  # noqa: B023, E731
            want = {(i, j) for i, x in enumerate(a.names) for j, y in enumerate(b.names) if near(x, y)}
            similar += len(want)
            for way in (0, 1, 2):
                assert want <= {(int(i), int(j)) for pairs in R._near(a, b, k, kind, way) for i, j in zip(*pairs, strict=True)}
    assert similar > 60


def test_what_pairs_of_names_hold_is_not_dealt(spark):
    """Only almost similar pairs are shuffled: the plan has one exchange, above the edit distance."""
    names = spark.createDataFrame([(x,) for x in made()], "name string")
    plan = R.similar_names(names, names, 0.8, "edit")._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("CartesianProduct") :].split("\nUnion")[0]
    assert "Exchange" not in join[: join.index("FileScan")] and "levenshtein" in plan[: plan.index("CartesianProduct")]


def test_names_that_share_their_first_half(spark):
    """All pairs hold two equal pieces; those of few edits are told, and no others."""
    rnd = random.Random(5)
    names = sorted({"common begin " + "".join(rnd.choice("ab") for _ in range(11)) for _ in range(300)})
    side = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r["a"], r["b"]) for r in R.similar_names(side, side, 0.9, "edit").collect()}
    assert got == {(a, b) for a in names for b in names if _edit(a, b) <= 2}
