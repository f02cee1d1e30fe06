"""Registered queries of trained models: classifier with calibration and threshold, discount quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersieve.operators.allotment import draw, split
from tendersieve.operators.classifier import grid_counts, later_share, train, tune_threshold
from tendersieve.operators.evaluation import calibration_error
from tendersieve.operators.quantiles import coverage, fit_tree, paired_error
from tendersieve.plans.domain import awards, table, tenders
from tendersieve.registry import query
from tendersieve.sources.files import cut

c = F.col


@query("threshold_grid", "SELECT CAST(floor(l_quantity / 51 / 0.005 + 1e-9) AS INT) AS step, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS positives, count(*) AS n FROM lineitem GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select((c("l_quantity") / 51).alias("p"), (c("l_returnflag") == "R").cast("int").alias("y"))
    return grid_counts(rows, "p", "y")


@query("tuned_classifier")
def _(s: SparkSession, d: str) -> DataFrame:
    """Quality of documents: trained on the earlier ids, judged on the later ones that it never saw; one row of figures."""
    rows = table(s, d, "labels").where("quality is not null").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", "text", c("quality").alias("label"), F.floor(c("doc_id") / 10).alias("day"))
    early, late = later_share(rows, "day", "doc_id", 0.3)
    model = train(early, "day", "doc_id", share=0.3, size=1 << 12)
    scored = cut(model.score(late).select("label", "probability"), "scored")
    best = tune_threshold(scored, "probability", "label", cost_fn=4.0)
    figures = [F.lit(float(best[k]) if best else None).cast("double").alias(k) for k in ("threshold", "fbeta", "precision", "recall", "p5", "p95")]
    return calibration_error(scored, c("probability"), c("label")).select("ece", "n", *[F.lit(v).alias(k) for k, v in model.metadata.items() if k != "n"], *figures)


# -- discounts ------------------------------------------------------------------------------------

FEATURES = ["bids", "budget", "cpv", "brand"]
CUT = "1998-01-01"


def discounts(s: SparkSession, d: str) -> DataFrame:
    rows = awards(s, d, "budget", "awarded", "bids", "awarded_on", "cpv", "brand")
    return rows.where("budget > 0").select(*FEATURES, "awarded_on", F.round(1 - c("awarded") / c("budget"), 6).alias("discount"))


@query("discount_baseline_coverage", f"""WITH d AS (SELECT awarded_on, round(1 - awarded / budget, 6) AS y FROM @a WHERE budget > 0),
  q AS (SELECT quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90 FROM d WHERE awarded_on < '{CUT}'),
  x AS (SELECT count(*) AS n, avg((y >= p10 AND y <= p90)::INT) AS x, avg(abs(y - p50)) AS mae, avg(y - p50) AS bias FROM d, q WHERE awarded_on >= '{CUT}')
  SELECT n, round(x, 4) AS coverage, round(mae, 4) AS mae, round(bias, 4) AS bias, CASE WHEN n < 30 THEN 'no data' WHEN x < 0.5 THEN 'broken' WHEN x < 0.65 THEN 'warn' ELSE 'ok' END AS status FROM x""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = discounts(s, d)
    before = rows.where(c("awarded_on") < CUT).agg(F.percentile("discount", [0.1, 0.5, 0.9]).alias("q"))
    band = before.select(*[c("q")[i].alias(x) for i, x in enumerate(("p10", "p50", "p90"))])  # one row
    return coverage(rows.where(c("awarded_on") >= CUT).crossJoin(band), "discount")


@query("discount_tree_backtest")
def _(s: SparkSession, d: str) -> DataFrame:
    """A tree of the earlier awards' discounts against the later ones', and against the earlier median alone."""
    rows = discounts(s, d)
    early, late = rows.where(c("awarded_on") < CUT), rows.where(c("awarded_on") >= CUT)
    tree = fit_tree(early, "discount", FEATURES)
    middle = early.agg(F.percentile_approx("discount", 0.5, 10_000).alias("m")).first()["m"]
    told = tree.predict(late).withColumn("median", F.lit(middle))
    return coverage(told, "discount").crossJoin(paired_error(told, "discount", "median", "p50").drop("n")).withColumn("leaves", F.lit(len(tree.leaves)))  # one row each


# -- samples --------------------------------------------------------------------------------------


@query("stratified_draw")
def _(s: SparkSession, d: str) -> DataFrame:
    """300 tenders over strata of kind and status (a sampling operator)."""
    return draw(tenders(s, d, "id", "kind", "status"), F.concat_ws("/", "kind", "status"), "id", 300)


@query("stable_split", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'holdout' WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS INT) % 2 = 0 THEN 'tune' ELSE 'holdout' END AS half, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    half = split(c("doc_id"), F.when(c("doc_id") % 10 == 0, "holdout"))
    return table(s, d, "documents").groupBy(half.alias("half"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
