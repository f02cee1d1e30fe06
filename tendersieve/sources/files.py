"""Reading feeds and writing results: XML, JSON, HTML tables in; CSV, Parquet with a manifest out; guarded SQL."""

from __future__ import annotations

import io
import json
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

c = F.col


def scratch(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one serves a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="tendersieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives lost executors."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_feed(spark: SparkSession, path: str, schema: str, row_tag: str = "entry") -> DataFrame:
    """Entries of XML feeds, one row each."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def read_json_listing(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON arrays in a text column; malformed texts give none."""
    return rows.select("*", F.explode(F.from_json(c(column), f"array<struct<{schema}>>")).alias("item")).select("*", "item.*").drop("item", column)


def newer_than(entries: DataFrame, updated: str, cursor: str | None) -> tuple[DataFrame, DataFrame]:
    """(entries strictly after the cursor, the next cursor as one row)."""
    instant = F.try_to_timestamp(c(updated))
    fresh = entries if cursor is None else entries.where(instant > F.lit(cursor).cast("timestamp"))
    return fresh, fresh.agg(F.coalesce(F.max(instant), F.lit(cursor).cast("timestamp")).alias("cursor"))


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV with a header; each file begins with a byte order mark, by which spreadsheets know UTF-8."""
    first, *rest = df.columns
    marked = df.select(c(f"`{first}`").alias("\ufeff" + first), *[c(f"`{x}`") for x in rest])
    marked.write.option("sep", separator).option("header", True).option("encoding", "UTF-8").csv(path)


#: Ids of entries and what a nested entry holds, as a schema for ``read_feed``; element names are fixed values.
ENTRY = (
    "id string, title string, updated string, ContractFolderStatus struct<ContractFolderID:string, ContractFolderStatusCode:string, "
    "LocatedContractingParty:struct<Party:struct<PartyName:struct<Name:string>>>, "
    "ProcurementProject:struct<Name:string, TypeCode:string, BudgetAmount:struct<TaxExclusiveAmount:double>, RequiredCommodityClassification:array<struct<ItemClassificationCode:string>>>, "
    "ProcurementProjectLot:array<struct<ID:string, ProcurementProject:struct<Name:string, BudgetAmount:struct<TaxExclusiveAmount:double>>>>, "
    "TenderResult:array<struct<ResultCode:string, AwardDate:string, ReceivedTenderQuantity:int, WinningParty:struct<PartyIdentification:struct<ID:string>, PartyName:struct<Name:string>>, "
    "AwardedTenderedProject:struct<ProcurementProjectLotID:string, LegalMonetaryTotal:struct<TaxExclusiveAmount:double>>>>>"
)


def parse_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tenders, lots, awards) of entries read by ``read_feed`` with the schema ``ENTRY``; of rows of one id the latest counts.

    Missing parts give nulls, or no lots and awards; entries without an id or folder are left out.
    """
    f = "ContractFolderStatus"
    known = entries.where(c("id").isNotNull() & c(f"{f}.ContractFolderID").isNotNull())
    last = known.groupBy("id").agg(F.max_by(F.struct("*"), F.coalesce(F.try_to_timestamp("updated"), F.lit("1900-01-01").cast("timestamp"))).alias("e")).select("e.*")
    tenders = last.select(
        "id", c(f"{f}.ContractFolderID").alias("folder"), "title", F.try_to_timestamp("updated").alias("updated"), c(f"{f}.ContractFolderStatusCode").alias("status"),
        c(f"{f}.LocatedContractingParty.Party.PartyName.Name").alias("body"), c(f"{f}.ProcurementProject.TypeCode").alias("type"), c(f"{f}.ProcurementProject.BudgetAmount.TaxExclusiveAmount").alias("budget"),
        F.coalesce(c(f"{f}.ProcurementProject.RequiredCommodityClassification.ItemClassificationCode"), F.array().cast("array<string>")).alias("codes"),
    )
    lots = last.select("id", F.explode(f"{f}.ProcurementProjectLot").alias("l")).select("id", c("l.ID").alias("lot"), c("l.ProcurementProject.Name").alias("name"), c("l.ProcurementProject.BudgetAmount.TaxExclusiveAmount").alias("budget"))
    won = last.select("id", F.explode(f"{f}.TenderResult").alias("r")).select(
        "id", c("r.AwardedTenderedProject.ProcurementProjectLotID").alias("lot"), c("r.ResultCode").alias("result"), c("r.AwardDate").alias("awarded_on"), c("r.ReceivedTenderQuantity").alias("bids"),
        c("r.WinningParty.PartyIdentification.ID").alias("tax_id"), c("r.WinningParty.PartyName.Name").alias("company"), c("r.AwardedTenderedProject.LegalMonetaryTotal.TaxExclusiveAmount").alias("awarded"),
    )
    return tenders, lots, won


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                whole = zipfile.ZipFile(io.BytesIO(raw.as_py()))
            except zipfile.BadZipFile:
                yield pa.RecordBatch.from_pydict({"path": [path], "name": [None], "body": pa.array([None], pa.string())})
                continue
            for name in whole.namelist():
                if name.lower().endswith((".xml", ".atom")):
                    yield pa.RecordBatch.from_pydict({"path": [path], "name": [name], "body": pa.array([whole.read(name).decode("utf-8", "replace")], pa.string())})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, body): the XML files of ZIP archives, one row each; an archive that can't be read gives one row without name and body."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(_unzip, "path string, name string, body string")


#: What a statement may consist of: nodes of a parsed query, and functions.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedHaving "
    "UnresolvedInlineTable LocalRelation OneRowRelation Union Except Intersect WithWindowDefinition Pivot".split()
)
FUNCTIONS = frozenset(
    "count sum avg mean min max median mode stddev stddev_pop stddev_samp variance var_pop var_samp percentile percentile_approx approx_count_distinct count_if any every bool_and bool_or first last first_value "
    "last_value min_by max_by collect_list collect_set array_agg corr row_number rank dense_rank lag lead ntile percent_rank cume_dist abs round floor ceil ceiling sqrt exp ln log log2 log10 pow power sign mod greatest "
    "least coalesce nullif ifnull nvl if isnull isnotnull upper lower trim ltrim rtrim btrim length char_length substr substring left right concat concat_ws replace translate regexp_replace regexp_extract "
    "regexp_extract_all regexp_count regexp_like rlike like split contains startswith endswith instr locate position lpad rpad initcap repeat reverse year quarter month day dayofmonth dayofweek weekofyear hour minute "
    "second date trunc date_trunc date_add date_sub datediff date_diff months_between add_months last_day to_date to_timestamp date_format unix_timestamp current_date now try_to_date try_to_timestamp "
    "try_divide try_cast cast array size cardinality element_at array_contains array_distinct array_sort sort_array array_join exists transform filter aggregate map struct named_struct md5 sha2 xxhash64 "
    "crc32 hash get_json_object from_json to_json string int bigint double float boolean decimal timestamp grouping grouping_id not and or in between extract date_part".split()
)


ROWS_OF = frozenset(("range", "explode", "posexplode", "inline"))


def _nodes(node: JavaObject) -> Iterator[JavaObject]:
    yield node
    for below in (node.children(), node.innerChildren()):
        for i in range(below.size()):
            yield from _nodes(below.apply(i))


def _refused(spark: SparkSession, sql: str) -> str | None:
    """What in a statement is no plain query over tables by name; the statement is parsed, not run."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedTableValuedFunction":
            if (name := node.name().mkString(".").lower()) not in ROWS_OF:
                return f"function {name}"
        elif kind == "Generate" and node.generator().getClass().getSimpleName() == "UnresolvedGenerator":
            if (name := node.generator().name().unquotedString().lower()) not in ROWS_OF:
                return f"function {name}"
        elif kind not in QUERY_NODES:
            return kind
        if kind == "UnresolvedRelation" and node.multipartIdentifier().size() != 1:
            return f"table {node.multipartIdentifier().mkString('.')}"
        expressions = node.expressions()
        for i in range(expressions.size()):
            for e in _nodes(expressions.apply(i)):
                if e.getClass().getSimpleName() == "UnresolvedFunction":
                    name = e.nameParts().mkString(".").lower()
                    if name not in FUNCTIONS:
                        return f"function {name}"
    return None


def write_with_manifest(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each table as zstd Parquet and, last, a manifest with their row counts (one small JSON row)."""
    counts: dict[str, int] = {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        counts[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}").count()
    spark.createDataFrame([(json.dumps({"engine": "spark", "row_counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/_manifest")
    return counts


def guarded_sql(spark: SparkSession, sql: str, rows: int = 500, cell: int = 1000, seconds: float = 30.0) -> DataFrame:
    """A read-only query, at most ``rows`` rows, whether there are more, texts cut to ``cell`` characters.

    The statement is parsed first: one that holds anything but query nodes, functions of the list ``FUNCTIONS``
    and tables by their plain name (so no commands, inserts, scripts, reflection, or paths as tables) is refused.
    It runs once, at most ``seconds`` long, else its jobs are cancelled and ``TimeoutError`` is raised; its
    first rows are written, so that they and the mark tell of the same run.
    """
    try:
        refused = _refused(spark, sql)
    except ParseException as e:
        raise ValueError(f"not one statement: {e.getCondition()}") from e
    if refused:
        raise ValueError(f"only a SELECT over tables is allowed, not {refused}")
    found = spark.sql(sql).limit(rows + 1)
    short = [F.substring(f"`{f.name}`", 1, cell).alias(f.name) if f.dataType.simpleString() == "string" else c(f"`{f.name}`") for f in found.schema.fields]
    context, group, late = spark.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        told = cut(found.select(*short), "guarded")
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    return told.limit(rows).withColumn("truncated", F.lit(told.count() > rows))


def describe(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """One row a table: its number of rows (from footers) and of columns."""
    parts = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    rows = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")) for n, df in zip(names, parts, strict=True)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
