import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendersieve.functions import scalars as S
from tendersieve.operators import evaluation, graph, relational, text, trends
from tendersieve.queries import QUERIES
from tendersieve.plans.scope import TenderFilter
from tendersieve.sources import files
from tendersieve.streaming import events as stream


def test_scalars(spark):
    rows = spark.createDataFrame([("Ácme  S.L.U.", "1.234,56 €", "31/12/2020", " b-12.3 "), ("", "n/d", "31/02/2026", ""), (None, None, None, None)], "name string, money string, day string, tax string")
    got = [tuple(r) for r in rows.select(S.company_name(F.col("name")), S.money(F.col("money")), S.iso_date(F.col("day")), S.tax_id(F.col("tax"))).collect()]
    assert got == [("ACME", 1234.56, "2020-12-31", "B123"), (None, None, "31/02/2026", None), (None,) * 4]


def test_empty_filter_is_no_filter(spark):
    rows = spark.range(3)
    assert TenderFilter().is_empty() and TenderFilter().apply(rows) is rows


def test_components_and_no_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 10), (10, 7), (5, 5), (None, 4)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7), (9, 7), (10, 7)}
    assert graph.components(edges.limit(0)).count() == 0


def test_keyset_pages_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(20)], "id long, v double")
    seen, after = [], None
    while True:
        page = relational.keyset_page(rows, "v", "id", after, 6).collect()
        if not page:
            break
        seen += [r.id for r in page]
        after = (page[-1].v, page[-1].id)
    assert sorted(seen) == list(range(20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v double, y int, k string, published timestamp")
    assert evaluation.average_precision(evaluation.thresholds(none, F.col("v"), F.col("y"))).first()[0] is None
    assert evaluation.anomalies(none, "k", "v", 2.0, 5).count() == 0
    assert trends.seasonality(none).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id>1</id><updated>2024-01-02T00:00:00Z</updated></entry><entry><id>2</id><updated>2024-01-01T00:00:00Z</updated></entry></feed>")
    feed = files.read_feed(spark, str(tmp_path / "f.xml"), "id long, updated string")
    fresh, cursor = files.newer_than(feed, "updated", "2024-01-01")
    assert [r.id for r in fresh.collect()] == [1] and str(cursor.first()[0]).startswith("2024-01-02")
    assert files.write_with_manifest({"t": spark.range(5)}, str(tmp_path / "out")) == {"t": 5}
    assert '"t": 5' in spark.read.text(str(tmp_path / "out/_manifest")).first()[0]
    files.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).count() == 3
    listing = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ("broken",), (None,)], "body string")
    assert [r.a for r in files.read_json_listing(listing, "body", "a: int").where("a IS NOT NULL").collect()] == [1, 2]
    with pytest.raises(ValueError):
        files.guarded_sql(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        files.guarded_sql(spark, "SELECT 1; DROP TABLE x")
    assert files.guarded_sql(spark, "SELECT * FROM range(5)", rows=3).collect()[0].truncated


def test_stream_gives_what_batch_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.tumbling(live, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, stream.tumbling(events, "1 day").collect()))
    q = stream.streaming_changes(live, "user_id", "event_type").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.changes(events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "before", "after")
    assert sorted(map(tuple, spark.table("changes").collect())) == sorted(map(tuple, batch.collect()))


def brute_nearest(rows, queries, n):
    out = []
    for q, x in queries:
        found = []
        for v, y in rows:
            ok = x and y and len(x) == len(y) and any(x) and any(y)
            if v != q:
                found.append((-round(float(np.dot(x, y)) / (np.linalg.norm(x) * np.linalg.norm(y)), 6) if ok else np.inf, v))
        out += [(q, v, None if s == np.inf else -s, k + 1) for k, (s, v) in enumerate(sorted(found)[:n])]
    return sorted(out)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(30)] + [(200, None), (220, [0.0] * 5), (240, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block, n in ((7, 10), (1024, 3), (1024, 100)):
        got = text.nearest(vectors, vectors.where("vec_id % 20 = 0"), n, block).select("query_id", "vec_id", "cosine", "rank").collect()
        want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], n)
        assert [(r[0], r[1], r[3]) for r in sorted(map(tuple, got), key=lambda r: (r[0], r[3]))] == [(r[0], r[1], r[3]) for r in sorted(want, key=lambda r: (r[0], r[3]))]
        assert {(r[0], r[1]): r[2] for r in got} == pytest.approx({(r[0], r[1]): r[2] for r in want})


def test_cosine_topk_takes_every_twentieth_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["cosine_topk"](spark, sf).select("query_id", "vec_id", "cosine", "rank").collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert {(r[0], r[3]): r[2] for r in got} == pytest.approx({(r[0], r[3]): r[2] for r in want}, abs=2e-6)


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_identity_tokens_against_union_find(spark):
    rows = [(i, f"n{i * 37 % 41}" if i % 3 else None, "" if i % 7 == 0 else f"t{i * 11 % 59}") for i in range(120)]
    got = graph.components(graph.token_edges(spark.createDataFrame(rows, "id long, name string, tax string"), "id", ["name", "tax"])).collect()
    shared = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and ((x[1] and x[1] == y[1]) or (x[2] and x[2] == y[2]))]
    assert len(got) == len(rows) and {r.node: r.component for r in got} == union_find(range(120), shared)


def test_every_customer_has_a_component(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/customer.parquet").collect()
    shared = [(x.c_custkey, y.c_custkey) for x in rows for y in rows if x.c_custkey < y.c_custkey and (x.c_name == y.c_name or x.c_acctbal == y.c_acctbal)]
    got = {r.node: r.component for r in QUERIES["identity_components"](spark, sf).collect()}
    assert got == union_find([r.c_custkey for r in rows], shared)


def test_guarded_sql_refuses_all_but_queries(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("guarded_numbers")
    spark.range(2).write.parquet(str(tmp_path / "p"))
    good = [
        "SELECT id, ';' AS mark FROM guarded_numbers WHERE id IN (SELECT max(id) FROM guarded_numbers)",
        "WITH x AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM guarded_numbers) SELECT * FROM x UNION ALL SELECT 7, 8 ORDER BY 1;",
        "SELECT id % 2 AS k, count(*) FILTER (WHERE id > 0) AS n FROM guarded_numbers a JOIN (VALUES (1), (2)) v(x) ON x = id GROUP BY 1 HAVING count(*) > 0",
        "SELECT id, w FROM guarded_numbers LATERAL VIEW explode(split('a b', ' ')) t AS w", "SELECT * FROM (SELECT id, id % 2 AS k FROM guarded_numbers) PIVOT (count(*) FOR k IN (0, 1))",
    ]
    for sql in good:
        assert files.guarded_sql(spark, sql).columns[-1] == "truncated"
    assert files.guarded_sql(spark, good[0]).first().mark == ";"
    assert [r.truncated for r in files.guarded_sql(spark, "SELECT id FROM guarded_numbers", rows=2).collect()] == [True, True]
    bad = [
        "WITH x AS (SELECT 7 AS a) INSERT INTO guarded_numbers SELECT a FROM x", "SELECT TRANSFORM(id) USING 'cat' FROM guarded_numbers", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT (SELECT java_method('java.lang.System', 'exit', 1))", f"SELECT * FROM parquet.`{tmp_path / 'p'}`", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x", "DROP VIEW guarded_numbers",
        "SET a = 1", "SELECT 1; SELECT 2", "SELECT * FROM python_worker_logs()", "EXPLAIN SELECT 1", "SELECT a FROM guarded_numbers LATERAL VIEW json_tuple('{}', 'a') t AS a",
        "SELECT * FROM (SELECT id, id % 2 AS k FROM guarded_numbers) PIVOT (max(reflect('a', 'b')) FOR k IN (0))", "SELECT w FROM guarded_numbers LATERAL VIEW explode(array(reflect('a', 'b'))) t AS w", "SELECT 1 WHERE exists(SELECT * FROM csv.`/etc/passwd`)", "",
    ]
    for sql in bad:
        with pytest.raises(ValueError):
            files.guarded_sql(spark, sql)
    with pytest.raises(TimeoutError):
        files.guarded_sql(spark, "SELECT sum(a.id * b.id % 7) FROM range(10000000) a CROSS JOIN range(10000000) b", seconds=2.0)
    assert files.guarded_sql(spark, "SELECT id FROM guarded_numbers ORDER BY id DESC", rows=2).collect() == [(2, True), (1, True)]


ENTRY_XML = """<feed><entry><id>e1</id><title>Old</title><updated>2024-01-01T00:00:00Z</updated><ContractFolderStatus><ContractFolderID>F/1</ContractFolderID></ContractFolderStatus></entry>
<entry><id>e1</id><title>Works</title><updated>2024-02-01T00:00:00Z</updated><ContractFolderStatus><ContractFolderID>F/1</ContractFolderID><ContractFolderStatusCode>RES</ContractFolderStatusCode>
<LocatedContractingParty><Party><PartyName><Name>Town</Name></PartyName></Party></LocatedContractingParty>
<ProcurementProject><Name>w</Name><TypeCode>3</TypeCode><BudgetAmount><TaxExclusiveAmount>1000.5</TaxExclusiveAmount></BudgetAmount><RequiredCommodityClassification><ItemClassificationCode>45000000</ItemClassificationCode></RequiredCommodityClassification></ProcurementProject>
<ProcurementProjectLot><ID>1</ID><ProcurementProject><Name>north</Name><BudgetAmount><TaxExclusiveAmount>600</TaxExclusiveAmount></BudgetAmount></ProcurementProject></ProcurementProjectLot>
<ProcurementProjectLot><ID>2</ID></ProcurementProjectLot>
<TenderResult><ResultCode>8</ResultCode><ReceivedTenderQuantity>3</ReceivedTenderQuantity><WinningParty><PartyIdentification><ID>B1</ID></PartyIdentification><PartyName><Name>Acme SL</Name></PartyName></WinningParty>
<AwardedTenderedProject><ProcurementProjectLotID>1</ProcurementProjectLotID><LegalMonetaryTotal><TaxExclusiveAmount>550</TaxExclusiveAmount></LegalMonetaryTotal></AwardedTenderedProject></TenderResult>
</ContractFolderStatus></entry><entry><title>nothing</title></entry></feed>"""


def test_nested_entries_and_archives(spark, tmp_path):
    (tmp_path / "f.xml").write_text(ENTRY_XML)
    tenders, lots, won = files.parse_entries(files.read_feed(spark, str(tmp_path / "f.xml"), files.ENTRY))
    t = tenders.collect()
    assert [(r.id, r.folder, r.title, r.status, r.body, r.type, r.budget, r.codes) for r in t] == [("e1", "F/1", "Works", "RES", "Town", "3", 1000.5, ["45000000"])]
    assert sorted((r.lot, r.name, r.budget) for r in lots.collect()) == [("1", "north", 600.0), ("2", None, None)]
    assert [(r.lot, r.bids, r.tax_id, r.company, r.awarded) for r in won.collect()] == [("1", 3, "B1", "Acme SL", 550.0)]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("a.atom", ENTRY_XML)
        z.writestr("readme.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = {(r.path.rsplit("/", 1)[1], r.name, r.body == ENTRY_XML) for r in files.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {("m.zip", "a.atom", True), ("broken.zip", None, False)}


def test_csv_begins_with_a_mark(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("á", 1)], "name string, n int").coalesce(1), str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname;n")


def test_holt_winters_and_communities_against_plain_python(spark):
    edges = [(1, 2, 5.0), (2, 3, 5.0), (1, 3, 5.0), (4, 5, 5.0), (5, 6, 5.0), (4, 6, 5.0), (3, 4, 0.5)]
    got = {r[0]: r[1] for r in graph.communities(spark.createDataFrame(edges, "a long, b long, w double"), 10).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and got[1] != got[4]


def test_scalars_of_dates(spark):
    rows = spark.createDataFrame([("2024-07-01T21:59:00+00:00",), ("2024-07-01",), ("2024-07-01T23:30:00+00:00",), ("no date at all",), (None,)], "t string")
    assert [r[0] for r in rows.select(S.local_deadline_hour(F.col("t"))).collect()] == ["23:59", None, None, None, None]
    days = {str(r[0]) for r in spark.range(1).select(F.explode(F.array(*[S.easter(F.lit(y)) for y in (1961, 2024, 2025, 2038)]))).collect()}
    assert days == {"1961-04-02", "2024-03-31", "2025-04-20", "2038-04-25"}


def test_keyset_pages_descending_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 3)) for i in range(20)], "id long, v double")
    seen, after = [], None
    while page := relational.keyset_page(rows, "v", "id", after, 6, descending=True).collect():
        seen += [r.id for r in page]
        after = (page[-1].v, page[-1].id)
    assert len(seen) == 20 and sorted(seen) == list(range(20))


def test_components_of_a_long_cycle_in_any_order(spark):
    """Paths of hundreds of nodes whose labels rise and fall; rounds must not follow their length."""
    edges = [(i, i * 7919 % 1009 + 1) for i in range(1, 1010)] + [(5000 + i, 5001 + i) for i in range(300)]
    top: dict[int, int] = {}

    def root(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    out = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in out} == {(n, root(n)) for n in top}
