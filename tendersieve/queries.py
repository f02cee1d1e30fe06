"""The registered queries of the analyses, each with DuckDB SQL of the same result where SQL has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tendersieve.functions import scalars as S
from tendersieve import entity_queries as entity_queries, model_queries as model_queries, more_queries as more_queries, search_queries as search_queries, signal_queries as signal_queries, snapshot_queries as snapshot_queries
from tendersieve.operators import bodies, evaluation, graph, labels, market, overview, relational, text, trends
from tendersieve.operators.louvain import louvain
from tendersieve.plans.domain import awards, places, table, tenders
from tendersieve.plans.scope import TenderFilter
from tendersieve.registry import ORACLE_SQL as ORACLE_SQL, QUERIES as QUERIES, query
from tendersieve.sources import files
from tendersieve.streaming import events as stream

c = F.col
NOW = "1998-06-01"


# -- overview ----------------------------------------------------------------------------------

SCOPE = TenderFilter(since="1995-01-01", until="1997-12-31", statuses=("O", "F"), least=1000.0)


@query("overview_kpis", "SELECT count(*) AS n, round(sum(amount), 2) AS amount, round(avg(amount), 2) AS mean_amount, count(DISTINCT body_id) AS bodies FROM @t "
       "WHERE published >= '1995-01-01' AND published < '1998-01-01' AND status IN ('O', 'F') AND amount >= 1000")
def _(s, d):
    return overview.kpis(SCOPE.apply(tenders(s, d, "amount", "body_id", "published", "status")))


@query("scope_all_fields", "SELECT id, region, kind FROM @t WHERE region IN ('ASIA', 'EUROPE') AND status = 'O' AND (kind IS NULL OR kind NOT IN ('5-LOW')) "
       "AND list_has_any(tags, ['BUILDING', 'URGENT']) AND amount <= 200000 AND contains(lower(body), 'customer') AND starts_with(CAST(id AS VARCHAR), '1')")
def _(s, d):
    f = TenderFilter(regions=("ASIA", "EUROPE"), statuses=("O",), not_kinds=("5-LOW",), tags=("BUILDING", "URGENT"), most=200000.0, text="CÚSTOMER", prefixes=("1",))
    return f.apply(tenders(s, d)).select("id", "region", "kind")


@query("status_funnel", "SELECT count(*) FILTER (status = 'O') AS open, count(*) FILTER (status IN ('F', 'P')) AS done, count(*) AS total FROM @t")
def _(s, d):
    return overview.funnel(tenders(s, d, "status"), {"open": ("O",), "done": ("F", "P")})


@query("monthly_volume", "SELECT strftime(date_trunc('month', published), '%Y-%m-%d') AS bucket, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1")
def _(s, d):
    return trends.series(tenders(s, d, "published", "amount"), "month")


@query("top_bodies", "SELECT body, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1 ORDER BY n DESC, body LIMIT 10")
def _(s, d):
    return overview.top_groups(tenders(s, d, "body", "amount"), "body", 10)


@query("recent_vs_previous_window", f"""SELECT count(*) FILTER (r) AS recent, count(*) FILTER (p) AS previous, coalesce(round(sum(amount) FILTER (r), 2), 0.0::DOUBLE) AS recent_amount,
  round(CASE WHEN count(*) FILTER (p) = 0 THEN 0.0::DOUBLE ELSE (count(*) FILTER (r) - count(*) FILTER (p)) / count(*) FILTER (p) * 100 END, 2) AS change_pct
  FROM (SELECT amount, published >= DATE '{NOW}' - 30 AS r, published >= DATE '{NOW}' - 60 AND published < DATE '{NOW}' - 30 AS p FROM @t)""")
def _(s, d):
    return overview.recent_and_previous(tenders(s, d), NOW, 30)


@query("concentration_topn", """WITH g AS (SELECT body, round(sum(amount), 2) AS amount FROM @t GROUP BY 1 HAVING sum(amount) IS NOT NULL),
  p AS (SELECT round(sum(amount), 2) AS top_amount FROM (SELECT amount FROM g ORDER BY amount DESC, body LIMIT 10))
  SELECT top_amount, total_amount, round(top_amount / total_amount, 6) AS top_share FROM p, (SELECT round(sum(amount), 2) AS total_amount FROM g)""")
def _(s, d):
    return overview.concentration(tenders(s, d), "body", 10)


@query("region_counts", "SELECT region, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1")
def _(s, d):
    return overview.by_group(tenders(s, d), "region")


@query("type_status_flow", "SELECT kind, status, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1, 2")
def _(s, d):
    return overview.by_group(tenders(s, d), "kind", "status")


@query("province_counts", "SELECT region, province, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1, 2")
def _(s, d):
    return overview.by_group(tenders(s, d), "region", "province")


@query("cancel_rate", f"SELECT count(*) FILTER (status = 'P') AS cancelled, count(*) AS total, round(count(*) FILTER (status = 'P') / count(*), 6) AS rate FROM @t WHERE published >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY")
def _(s, d):
    return overview.cancel_rate(tenders(s, d), "P", "1997-06-01")


@query("p75_hot_today", f"""WITH p AS (SELECT round(quantile_cont(amount, 0.75), 4) AS p75 FROM @t)
  SELECT p75, count(*) FILTER (status = 'O' AND amount >= p75) AS hot, count(*) FILTER (published >= DATE '{NOW}' - 1) AS new, count(*) FILTER (status = 'O') AS open FROM t, p GROUP BY p75""")
def _(s, d):
    return overview.today(tenders(s, d, "amount", "status", "published"), NOW, "O")


@query("award_indicators", """WITH g AS (SELECT company_id, sum(awarded) AS s FROM @a GROUP BY 1), h AS (SELECT round(sum(power(s / w * 100, 2)), 4) AS hhi, count(*) AS companies FROM (SELECT s, sum(s) OVER () AS w FROM g))
  SELECT hhi, companies, round(count(*) FILTER (bids = 1) / count(bids) * 100, 4) AS single_bid_pct, count(bids) AS with_bids, count(*) AS awards FROM a, h GROUP BY hhi, companies""")
def _(s, d):
    return overview.award_indicators(awards(s, d, "company_id", "awarded", "bids"))


@query("period_compare", """WITH k AS (SELECT p, count(*)::DOUBLE AS n, round(sum(amount), 2) AS amount, round(avg(amount), 2) AS mean_amount, count(DISTINCT body_id)::DOUBLE AS bodies
  FROM (SELECT *, year(published) AS p FROM @t WHERE year(published) IN (1995, 1996)) GROUP BY p), u AS (UNPIVOT k ON n, amount, mean_amount, bodies INTO NAME kpi VALUE v)
  SELECT x.kpi, x.v AS before, y.v AS after, round((y.v - x.v) / abs(x.v) * 100, 2) AS change_pct FROM u x JOIN u y USING (kpi) WHERE x.p = 1995 AND y.p = 1996""")
def _(s, d):
    return overview.compare_periods(tenders(s, d), ("1995-01-01", "1996-01-01"), ("1996-01-01", "1997-01-01"))


@query("systematic_sample", """WITH x AS (SELECT id, row_number() OVER (ORDER BY published DESC NULLS LAST, id DESC) AS rn, ceil(count(*) OVER () / 100) AS stride FROM @t) SELECT id, rn FROM x WHERE (rn - 1) % stride = 0""")
def _(s, d):
    return overview.systematic_sample(tenders(s, d), 100)


@query("top_with_awards", """WITH p AS (SELECT id, amount FROM @t WHERE amount IS NOT NULL ORDER BY amount DESC, id LIMIT 20),
  g AS (SELECT tender_id, min(struct_pack(lot := lot, company := company)).company AS winner, round(sum(awarded), 4) AS awarded, count(*) AS awards FROM @a GROUP BY 1)
  SELECT id, amount, winner, awarded, coalesce(awards, 0) AS awards FROM p LEFT JOIN g ON id = tender_id""")
def _(s, d):
    return overview.top_with_awards(tenders(s, d), awards(s, d), 20)


@query("completeness", """SELECT x.k AS "column", x.f AS filled, x.n FROM (SELECT unnest([struct_pack(k := 'lang', f := count(*) FILTER (trim(lang) <> ''), n := count(*)),
  struct_pack(k := 'source', f := count(*) FILTER (trim(source) <> ''), n := count(*)), struct_pack(k := 'text', f := count(*) FILTER (trim(text, ' ') <> ''), n := count(*))]) AS x FROM documents)""")
def _(s, d):
    return overview.completeness(table(s, d, "documents"), ["lang", "source", "text"])


@query("completeness_by_month", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(props) FILTER (props <> '') AS with_props FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), overview.count_if(c("props") != "").alias("with_props"))


@query("codelist_frequencies", "SELECT CASE WHEN ltrim(split_part(kind, '-', 1), '0') = '' THEN '0' ELSE ltrim(split_part(kind, '-', 1), '0') END AS code, count(*) AS n FROM @t GROUP BY 1")
def _(s, d):
    return tenders(s, d).groupBy(S.code_key(F.split("kind", "-")[0]).alias("code")).agg(F.count("*").alias("n"))


# -- trends ------------------------------------------------------------------------------------


@query("trends_daily", "SELECT strftime(published, '%Y-%m-%d') AS bucket, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1")
def _(s, d):
    return trends.series(tenders(s, d, "published", "amount"), "day")


@query("trends_weekly", "SELECT strftime(date_trunc('week', published), '%Y-%m-%d') AS bucket, count(*) AS n, round(sum(amount), 2) AS amount FROM @t GROUP BY 1")
def _(s, d):
    return trends.series(tenders(s, d, "published", "amount"), "week")


@query("heatmap_month_status", "SELECT strftime(published, '%Y-%m') AS month, status, count(*) AS n FROM @t GROUP BY 1, 2")
def _(s, d):
    return trends.heatmap(tenders(s, d), "status")


@query("yoy", f"""WITH x AS (SELECT amount, published >= DATE '{NOW}' - 365 AND published < TIMESTAMP '{NOW}' AS a, published >= DATE '{NOW}' - 730 AND published < DATE '{NOW}' - 365 AS b FROM @t),
  y AS (SELECT count(*) FILTER (a) AS n, count(*) FILTER (b) AS n_before, round(sum(amount) FILTER (a), 2) AS amount, round(sum(amount) FILTER (b), 2) AS amount_before FROM x)
  SELECT *, CASE WHEN n_before > 0 THEN round((n - n_before) / n_before * 100, 4) END AS change_pct FROM y""")
def _(s, d):
    return trends.year_over_year(tenders(s, d, "published", "amount"), NOW)


EDGES = [0.0, 1e3, 1e4, 5e4, 1e5, 2e5, 3e5, 5e5]


@query("amount_histogram", "SELECT low, count(amount) AS n FROM (SELECT unnest([0.0, 1e3, 1e4, 5e4, 1e5, 2e5, 3e5, 5e5]::DOUBLE[]) AS low, unnest([1e3, 1e4, 5e4, 1e5, 2e5, 3e5, 5e5, 1e300]::DOUBLE[]) AS high) LEFT JOIN @t ON amount >= low AND amount < high GROUP BY low")
def _(s, d):
    return trends.histogram(tenders(s, d), EDGES)


@query("waterfall", "WITH m AS (SELECT strftime(date_trunc('month', published), '%Y-%m-%d') AS bucket, count(*) AS n FROM @t GROUP BY 1) SELECT bucket, n, n - lag(n, 1, 0) OVER (ORDER BY bucket) AS delta, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS total FROM m")
def _(s, d):
    return trends.waterfall(trends.series(tenders(s, d, "published", "amount"), "month"))


@query("peak_month", "SELECT strftime(date_trunc('month', published), '%Y-%m-%d') AS bucket, count(*) AS n FROM @t GROUP BY 1 ORDER BY n DESC, bucket LIMIT 1")
def _(s, d):
    return trends.peak(trends.series(tenders(s, d, "published", "amount"), "month"))


@query("deadline_calendar", "SELECT strftime(published + INTERVAL 45 DAY, '%Y-%m-%d') AS due, count(*) AS n FROM @t WHERE CAST(published AS DATE) + 45 >= DATE '1996-01-01' AND CAST(published AS DATE) + 45 < DATE '1996-07-01' GROUP BY 1")
def _(s, d):
    return trends.due_calendar(tenders(s, d), "1996-01-01", "1996-07-01", 45)


@query("deadline_kpis", """SELECT count(*) FILTER (due = DATE '1997-03-10') AS today, count(*) FILTER (due > DATE '1997-03-10' AND due < DATE '1997-03-18') AS week,
  count(*) FILTER (due > DATE '1997-03-10' AND due < DATE '1997-04-01') AS month FROM (SELECT CAST(published AS DATE) + 45 AS due FROM @t)""")
def _(s, d):
    return trends.due_kpis(tenders(s, d), "1997-03-10", 45)


@query("cpv_ranking", "SELECT cpv, round(sum(awarded), 4) AS amount, count(*) AS n, strftime(min(awarded_on), '%Y-%m') AS first_month, strftime(max(awarded_on), '%Y-%m') AS last_month FROM @a GROUP BY 1 ORDER BY amount DESC, cpv LIMIT 15")
def _(s, d):
    month = lambda x: F.date_format(x, "yyyy-MM")
    rows = awards(s, d).groupBy("cpv").agg(overview.cents(c("awarded")).alias("amount"), F.count("*").alias("n"), month(F.min("awarded_on")).alias("first_month"), month(F.max("awarded_on")).alias("last_month"))
    return rows.orderBy(F.desc("amount"), F.asc("cpv")).limit(15)


@query("cpv_series", """WITH p AS (SELECT cpv FROM @a GROUP BY 1 ORDER BY round(sum(awarded), 4) DESC, cpv LIMIT 5) SELECT cpv, strftime(awarded_on, '%Y-%m') AS month, count(*) AS n, round(sum(awarded), 4) AS amount FROM a WHERE cpv IN (FROM p) GROUP BY 1, 2""")
def _(s, d):
    return trends.ranked_series(awards(s, d), "cpv", 5)


@query("seasonality", """WITH m AS (SELECT date_trunc('month', published)::DATE AS m, count(*) AS n FROM @t GROUP BY 1), sp AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH))::DATE AS m FROM m)
  SELECT CAST(month(sp.m) AS INT) AS month, round(sum(coalesce(n, 0)) / count(*), 6) AS mean_n, count(*) AS seen FROM sp LEFT JOIN m USING (m) GROUP BY 1""")
def _(s, d):
    return trends.seasonality(tenders(s, d))


@query("holt_winters")
def _(s, d):
    monthly = tenders(s, d).groupBy("region", F.date_format(F.date_trunc("month", "published"), "yyyy-MM-dd").alias("bucket")).agg(F.count("*").alias("n"))
    return trends.forecast(monthly, "region", 6)


# -- labels ------------------------------------------------------------------------------------


@query("tag_entries", "SELECT tag, count(*) AS n, round(sum(amount), 2) AS amount, count(*) FILTER (status = 'F') AS done FROM (SELECT unnest(list_distinct(tags)) AS tag, amount, status FROM @t) GROUP BY 1")
def _(s, d):
    return labels.entries(tenders(s, d), "F")


TAGS = "x AS (SELECT *, unnest(list_distinct(tags)) AS tag FROM @t)"


@query("tag_cross_region", f"""WITH {TAGS}, p AS (SELECT tag FROM x GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 4), r AS (SELECT region FROM t WHERE region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 3)
  SELECT tag, region, count(*) AS n FROM x WHERE tag IN (FROM p) AND region IN (FROM r) GROUP BY 1, 2""")
def _(s, d):
    return labels.crossed(tenders(s, d), "region", 3, 4)


@query("tag_evolution_with_others", f"""WITH {TAGS}, p AS (SELECT tag FROM x GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 3)
  SELECT strftime(published, '%Y-%m') AS month, CASE WHEN tag IN (FROM p) THEN tag ELSE '__OTHERS__' END AS tag, count(*) AS n, round(sum(amount), 2) AS amount FROM x GROUP BY 1, 2""")
def _(s, d):
    return labels.evolution(tenders(s, d), 3)


@query("tag_overlap_topn", "SELECT id, amount FROM @t WHERE list_has_any(tags, ['MACHINERY', 'LOW']) ORDER BY amount DESC NULLS LAST, id LIMIT 50")
def _(s, d):
    return labels.overlapping(tenders(s, d), ["MACHINERY", "LOW"], 50)


@query("tag_families", """SELECT x.f AS family, x.n AS n, x.amount AS amount, any_family FROM (SELECT unnest([struct_pack(f := 'build', n := count(*) FILTER (list_has_any(tags, ['BUILDING', 'MACHINERY'])), amount := round(sum(amount) FILTER (list_has_any(tags, ['BUILDING', 'MACHINERY'])), 2)),
  struct_pack(f := 'fast', n := count(*) FILTER (list_has_any(tags, ['URGENT', 'HIGH'])), amount := round(sum(amount) FILTER (list_has_any(tags, ['URGENT', 'HIGH'])), 2))]) AS x, count(*) FILTER (list_has_any(tags, ['BUILDING', 'MACHINERY', 'URGENT', 'HIGH'])) AS any_family FROM @t)""")
def _(s, d):
    return labels.families(tenders(s, d), {"build": ["BUILDING", "MACHINERY"], "fast": ["URGENT", "HIGH"]})


# -- bodies ------------------------------------------------------------------------------------


@query("body_totals", "SELECT count(*) AS n, count(DISTINCT body) AS bodies, round(sum(amount), 2) AS amount FROM @t")
def _(s, d):
    return bodies.totals(tenders(s, d))


@query("body_ranking_modal_kind", """WITH p AS (SELECT body, kind, count(*) AS k, sum(amount) AS m FROM @t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY kind IS NULL, k DESC, kind) AS rn FROM p)
  SELECT body, CAST(sum(k) AS BIGINT) AS n, round(sum(m), 2) AS amount, max(kind) FILTER (rn = 1) AS modal_kind FROM r GROUP BY 1 ORDER BY n DESC, body LIMIT 20""")
def _(s, d):
    return bodies.ranking(tenders(s, d, "body", "kind", "amount"), 20)


@query("body_treemap", """WITH p AS (SELECT body, kind, count(*) AS k, round(sum(amount), 2) AS amount FROM @t GROUP BY 1, 2), b AS (SELECT body FROM p GROUP BY 1 ORDER BY sum(k) DESC, body LIMIT 10) SELECT body, kind, amount FROM p WHERE body IN (FROM b) AND amount > 0""")
def _(s, d):
    return bodies.treemap(tenders(s, d), 10)


LEAD = """b AS (SELECT tender_id, max(struct_pack(w := awarded, d := awarded_on)).d AS d FROM @a GROUP BY 1), y AS (SELECT region, id, published, floor((epoch(d) - epoch(published)) / 86400) AS days FROM @t JOIN b ON id = tender_id),
  l AS (SELECT region, count(*) AS n, quantile_cont(days, 0.25) AS p25, quantile_cont(days, 0.5) AS p50, quantile_cont(days, 0.75) AS p75 FROM y WHERE days >= 0 GROUP BY 1)"""


@query("lead_time_median", f"WITH {LEAD} SELECT * FROM l")
def _(s, d):
    return bodies.lead_times(tenders(s, d, "id", "published", "region"), awards(s, d, "tender_id", "awarded_on", "awarded"), "region")


@query("expected_award", f"""WITH {LEAD} SELECT t.id, strftime(published::DATE + CAST(round(p50) AS INT), '%Y-%m-%d') AS expected, strftime(published::DATE + CAST(round(p25) AS INT), '%Y-%m-%d') AS earliest,
  strftime(published::DATE + CAST(round(p75) AS INT), '%Y-%m-%d') AS latest FROM t LEFT JOIN l USING (region)""")
def _(s, d):
    rows = tenders(s, d)
    return bodies.expected_award(rows, bodies.lead_times(rows, awards(s, d), "region"), "region")


@query("failure_rates_grouping_sets", """SELECT body, kind, CAST(grouping(kind) AS INT) AS all_kinds, count(*) AS n, count(*) FILTER (status = 'P') AS failed, round(count(*) FILTER (status = 'P') / count(*), 6) AS rate FROM @t GROUP BY GROUPING SETS ((body, kind), (body)) HAVING grouping(kind) = 1 OR kind IS NOT NULL""")
def _(s, d):
    return bodies.failure_rates(tenders(s, d, "body", "kind", "status"), "P")


@query("bodies_by_source", "SELECT body, count(*) FILTER (kind = '1-URGENT') AS n0, count(*) FILTER (kind = '5-LOW') AS n1 FROM @t GROUP BY 1")
def _(s, d):
    return bodies.by_source(tenders(s, d), "body", ["1-URGENT", "5-LOW"])


@query("first_time_in_region", """WITH x AS (SELECT company_id, region, awarded_on FROM @a JOIN @t ON tender_id = id), y AS (SELECT company_id, region, min(awarded_on) AS f, count(*) AS n FROM x GROUP BY 1, 2)
  SELECT company_id, region, strftime(f, '%Y-%m-%d') AS first_on, n FROM y WHERE f >= TIMESTAMP '1992-06-01'""")
def _(s, d):
    return bodies.first_in_region(awards(s, d).join(tenders(s, d).select("id", "region"), c("tender_id") == c("id")), "1992-06-01")


# -- market ------------------------------------------------------------------------------------

PAIR = "budget > 0 AND awarded > 0 AND awarded <= 1.5 * budget"
DISC = "(budget - awarded) / budget"


@query("discount_by_dimension", f"""SELECT brand, count(*) AS contracts, round(avg({DISC} * 100), 4) AS mean, round(min({DISC} * 100), 4) AS least, round(max({DISC} * 100), 4) AS most, round(sum(awarded), 4) AS amount, round(avg(bids), 4) AS bids FROM @a WHERE {PAIR} GROUP BY 1 HAVING count(*) >= 3""")
def _(s, d):
    return market.discounts(awards(s, d, "brand", "budget", "awarded", "bids"), "brand", 3)


@query("discount_bias", f"""WITH p AS (SELECT tender_id, sum(budget) AS budget, sum(awarded) AS awarded FROM @a WHERE {PAIR} GROUP BY 1) SELECT (SELECT round(avg({DISC} * 100), 4) FROM a WHERE {PAIR}) AS per_award, round(avg({DISC} * 100), 4) AS per_tender FROM p""")
def _(s, d):
    return market.discount_bias(awards(s, d))


@query("market_share", """WITH g AS (SELECT company, round(sum(awarded), 4) AS amount, count(*) AS contracts, round(avg(bids), 4) AS bids FROM @a WHERE starts_with(cpv, 'PROMO') GROUP BY 1) SELECT *, round(amount / sum(amount) OVER () * 100, 4) AS share FROM g ORDER BY amount DESC, company LIMIT 25""")
def _(s, d):
    return market.market_share(awards(s, d, "cpv", "company", "awarded", "bids"), c("cpv").startswith("PROMO"), 25)


@query("hhi_by_segment", """WITH o AS (SELECT cpv, company_id, sum(awarded) AS s, count(*) AS k FROM @a GROUP BY 1, 2) SELECT cpv, CAST(sum(k) AS BIGINT) AS contracts, count(*) AS companies, round(sum(s * s) / (sum(s) * sum(s)) * 10000, 4) AS hhi FROM o GROUP BY 1 HAVING sum(k) >= 5""")
def _(s, d):
    return market.hhi(awards(s, d, "cpv", "company_id", "awarded"), "cpv", 5)


@query("competition_bands", """WITH p AS (SELECT tender_id, cpv, max(bids) AS b FROM @a GROUP BY 1, 2) SELECT cpv, count(*) AS tenders, round(avg(b), 4) AS bids, count(*) FILTER (b < 2) AS band_0, count(*) FILTER (b >= 2 AND b < 5) AS band_1, count(*) FILTER (b >= 5) AS band_2 FROM p GROUP BY 1 HAVING count(*) >= 3""")
def _(s, d):
    return market.competition(awards(s, d), "cpv", 3)


@query("rivals_median_discount", f"""WITH g AS (SELECT company_id, count(*) AS contracts, round(quantile_cont(CASE WHEN {PAIR} THEN {DISC} END, 0.5), 6) AS median_discount, max(struct_pack(d := awarded_on, k := tender_id, n := company)).n AS name FROM @a WHERE brand = 'Brand#11' GROUP BY 1)
  SELECT (SELECT count(*) FROM a WHERE brand = 'Brand#11') AS segment_awards, *, company_id = 7 AS is_own FROM g ORDER BY contracts DESC, company_id LIMIT 20""")
def _(s, d):
    return market.rivals(awards(s, d), c("brand") == "Brand#11", 7, 20)


@query("head_to_head", f"""WITH m AS (SELECT tender_id, avg({DISC}) AS own FROM @a WHERE company_id = 7 GROUP BY 1), o AS (SELECT tender_id, company_id, avg({DISC}) AS theirs FROM a WHERE company_id <> 7 GROUP BY 1, 2)
  SELECT company_id, count(*) AS tenders, round(avg(own), 6) AS own_discount, round(avg(theirs), 6) AS their_discount FROM o JOIN m USING (tender_id) GROUP BY 1""")
def _(s, d):
    return market.head_to_head(awards(s, d), 7)


RENEW = f"r AS (SELECT *, CAST(awarded_on::DATE + INTERVAL 24 MONTH AS DATE) AS ends FROM @a), q AS (SELECT *, CAST(ends - DATE '{NOW}' AS INT) AS days FROM r WHERE ends >= DATE '{NOW}' AND ends < DATE '{NOW}' + INTERVAL 6 MONTH)"


@query("renewals_score_topn", f"WITH {RENEW} SELECT tender_id, lot, part_id, strftime(ends, '%Y-%m-%d') AS ends, days, round(awarded * greatest(0.0, least(1.0, 1 - days / 180)), 2) AS score FROM q ORDER BY score DESC, tender_id, lot, part_id LIMIT 100")
def _(s, d):
    return market.renewals(awards(s, d), NOW, 6, 24, 100)


@query("renewals_by_company", f"WITH {RENEW} SELECT company, count(*) AS n, round(sum(awarded), 4) AS amount, strftime(min(ends), '%Y-%m-%d') AS nearest FROM q GROUP BY 1 ORDER BY amount DESC, company LIMIT 100")
def _(s, d):
    return market.renewals_by_company(awards(s, d), NOW, 6, 24, 100)


@query("company_profile_breakdown", "WITH g AS (SELECT brand, count(*) AS n, round(sum(awarded), 4) AS amount FROM @a WHERE company_id = 7 AND trim(brand) <> '' GROUP BY 1) SELECT *, round(amount / sum(amount) OVER () * 100, 1) AS share FROM g ORDER BY amount DESC, n DESC, brand LIMIT 10")
def _(s, d):
    return market.breakdown(awards(s, d).where("company_id = 7"), "brand", 10)


PAIRS = "m AS (SELECT tender_id, company_id, sum(awarded) AS w FROM @a GROUP BY 1, 2)"


@query("pairs_co_award", f"WITH {PAIRS} SELECT x.company_id AS a, y.company_id AS b, count(*) AS n, round(sum(x.w + y.w), 4) AS amount FROM m x JOIN m y USING (tender_id) WHERE x.company_id < y.company_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    return market.partner_pairs(awards(s, d, "tender_id", "company_id", "awarded"), 2)


@query("joint_venture_candidates", "WITH g AS (SELECT tender_id, awarded_on, awarded, count(*) AS k, count(DISTINCT company_id) AS d FROM @a GROUP BY 1, 2, 3) SELECT count(*) FILTER (d > 1) AS candidates, CAST(coalesce(sum(k) FILTER (d > 1), 0) AS BIGINT) AS rows, CAST(sum(k) AS BIGINT) AS all_rows FROM g")
def _(s, d):
    return market.same_day_winners(awards(s, d))


WEIGHTS = {"amount": 20.0, "competition": 15.0, "time": 10.0}
SCORE = f"""sb AS (SELECT segment, round(avg(bids), 4) AS bids FROM @a JOIN @t ON tender_id = id GROUP BY 1), o AS (SELECT *, CAST(CAST(published AS DATE) + 60 - DATE '{NOW}' AS INT) AS days FROM t WHERE status = 'O'),
  pp AS (SELECT quantile_cont(amount, 0.1) AS lo, quantile_cont(amount, 0.9) AS hi FROM o),
  sc AS (SELECT id, round((20 * coalesce(greatest(0, least(1, (amount - lo) / (hi - lo))), 0.5) + 15 * coalesce(1 - greatest(0, least(1, (bids - 1) / 49)), 0.5)
    + 10 * CASE WHEN days < 0 THEN 0 WHEN days < 7 THEN 0.5 WHEN days < 91 THEN 1 WHEN days < 181 THEN 0.7 ELSE 0.3 END::DOUBLE) / 45 * 100, 4) AS score FROM o LEFT JOIN sb USING (segment), pp)"""


@query("opportunity_score", f"WITH {SCORE} SELECT id, score, CASE WHEN score < 40 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'high' END AS band FROM sc")
def _(s, d):
    rows = tenders(s, d, "id", "segment", "status", "amount", "published")
    bids = awards(s, d, "tender_id", "bids").join(rows.select("id", "segment"), c("tender_id") == c("id")).groupBy("segment").agg(F.round(F.avg("bids"), 4).alias("bids"))
    return market.opportunity_scores(rows, bids, NOW, WEIGHTS, "O")


@query("score_bands", f"WITH {SCORE} SELECT CASE WHEN score < 40 THEN 'low' WHEN score < 70 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM sc GROUP BY 1")
def _(s, d):
    return QUERIES["opportunity_score"](s, d).groupBy("band").agg(F.count("*").alias("n"))


@query("price_cohort", f"""WITH x AS (SELECT {DISC} AS d, brand, cpv FROM @a WHERE {PAIR}), k AS (SELECT 0 AS level, 'brand and cpv' AS cohort, d FROM x WHERE brand = 'Brand#11' AND starts_with(cpv, 'PROMO') UNION ALL SELECT 1, 'cpv', d FROM x WHERE starts_with(cpv, 'PROMO') UNION ALL SELECT 2, 'all', d FROM x)
  SELECT cohort, count(*) AS n, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75 FROM k GROUP BY level, cohort HAVING count(*) >= 500 ORDER BY level LIMIT 1""")
def _(s, d):
    promo = c("cpv").startswith("PROMO")
    return market.price_cohort(awards(s, d), [("brand and cpv", (c("brand") == "Brand#11") & promo), ("cpv", promo), ("all", F.lit(True))], 500)


# -- joins, sets, windows, pages ---------------------------------------------------------------


@query("semi_min_bids", "SELECT id, status FROM @t WHERE EXISTS (SELECT 1 FROM @a WHERE tender_id = id AND bids >= 49)")
def _(s, d):
    return relational.with_child_at_least(tenders(s, d), awards(s, d), "id", "tender_id", c("bids") >= 49).select("id", "status")


@query("anti_without_awards", "SELECT id, status FROM @t WHERE NOT EXISTS (SELECT 1 FROM @a WHERE tender_id = id)")
def _(s, d):
    return relational.without_child(tenders(s, d), awards(s, d), "id", "tender_id").select("id", "status")


@query("full_outer_sources", """WITH x AS (SELECT body_id, count(*) AS urgent FROM @t WHERE kind = '1-URGENT' GROUP BY 1), y AS (SELECT body_id, count(*) AS low FROM t WHERE kind = '5-LOW' GROUP BY 1)
  SELECT body_id, urgent, low, CAST((urgent IS NOT NULL)::INT + (low IS NOT NULL)::INT AS INT) AS sources FROM x FULL JOIN y USING (body_id)""")
def _(s, d):
    rows = tenders(s, d).groupBy("body_id", "kind").agg(F.count("*").alias("n"))
    return relational.merged_sources({"urgent": rows.where("kind = '1-URGENT'"), "low": rows.where("kind = '5-LOW'")}, "body_id", "n")


@query("lateral_latest", "SELECT tender_id, lot, company FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY awarded_on DESC, lot DESC, part_id DESC) AS rn FROM @a) WHERE rn = 1")
def _(s, d):
    return relational.latest_child(awards(s, d, "tender_id", "awarded_on", "lot", "part_id", "company"), "tender_id", ["awarded_on", "lot", "part_id"], ["lot", "company"])


@query("predecessor_asof", "SELECT id, body_id, kind, lag(id) OVER w AS previous, lag(published) OVER w AS previous_at FROM @t WINDOW w AS (PARTITION BY body_id, kind ORDER BY published, id)")
def _(s, d):
    return relational.predecessors(tenders(s, d), ["body_id", "kind"], "published", "id")


@query("prefix_rule_match", "SELECT cpv, CASE WHEN starts_with(cpv, 'PROMO BRUSHED') THEN 'brushed' WHEN starts_with(cpv, 'ECONOMY') THEN 'economy' WHEN starts_with(cpv, 'PROMO') THEN 'promo' END AS rule, count(*) AS n FROM @a GROUP BY 1, 2")
def _(s, d):
    rows = relational.longest_prefix_rule(awards(s, d), [("PROMO", "promo"), ("PROMO BRUSHED", "brushed"), ("ECONOMY", "economy")], "cpv")
    return rows.groupBy("cpv", "rule").agg(F.count("*").alias("n"))


@query("stratified_sample_md5", "SELECT id, region FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id) AS rn FROM @t) WHERE rn <= 20")
def _(s, d):
    return relational.stratified_sample(tenders(s, d), "region", "id", 20, ":7").select("id", "region")


@query("keyset_page", "SELECT id, amount FROM @t WHERE amount > 100000 OR (amount = 100000 AND id > 5) OR amount IS NULL ORDER BY amount NULLS LAST, id LIMIT 50")
def _(s, d):
    return relational.keyset_page(tenders(s, d), "amount", "id", (100000.0, 5), 50).select("id", "amount")


@query("offset_page", "SELECT id, amount FROM @t ORDER BY published DESC, id LIMIT 25 OFFSET 100")
def _(s, d):
    return relational.offset_page(tenders(s, d), [F.desc("published"), F.asc("id")], 100, 25).select("id", "amount")


@query("except_parity", """WITH x AS (SELECT body_id FROM @t WHERE status = 'O' GROUP BY 1), y AS (SELECT body_id FROM t WHERE status = 'F' GROUP BY 1)
  SELECT body_id, 'left' AS side FROM (FROM x EXCEPT FROM y) UNION ALL SELECT body_id, 'right' FROM (FROM y EXCEPT FROM x)""")
def _(s, d):
    rows = tenders(s, d)
    return relational.parity(rows.where("status = 'O'").select("body_id").distinct(), rows.where("status = 'F'").select("body_id").distinct())


@query("distinct_on_canonical", "SELECT id, body_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY body_id, kind ORDER BY status DESC, published, id) AS rn FROM @t) WHERE rn = 1")
def _(s, d):
    return relational.canonical(tenders(s, d, "id", "body_id", "kind", "status", "published"), ["body_id", "kind"], [F.desc("status"), F.asc("published"), F.asc("id")]).select("id", "body_id", "kind")


@query("first_value_current_version", "SELECT id, body_id, first_value(kind) OVER (PARTITION BY body_id ORDER BY published DESC, id DESC) AS current FROM @t")
def _(s, d):
    return relational.current_version(tenders(s, d, "id", "body_id", "published", "kind"), ["body_id"], [F.desc("published"), F.desc("id")], "kind").select("id", "body_id", "current")


@query("exact_then_like", "SELECT c_custkey, c_name, 1 AS exact FROM customer WHERE c_custkey = 12 UNION ALL SELECT c_custkey, c_name, 0 FROM (SELECT * FROM customer WHERE contains(lower(c_name), '12') AND c_custkey <> 12 ORDER BY c_custkey LIMIT 19)")
def _(s, d):
    return relational.exact_then_like(table(s, d, "customer"), "c_custkey", "c_name", "12", 20)


@query("total_beside_rows", "SELECT id, amount, (SELECT count(*) FROM @t) AS total FROM t ORDER BY amount DESC, id LIMIT 15")
def _(s, d):
    return relational.total_beside(tenders(s, d).select("id", "amount"), [F.desc("amount"), F.asc("id")], 15)


@query("duplicate_detection", """WITH x AS (SELECT id, min(id) OVER (PARTITION BY body_id, kind, status) AS a1, min(id) OVER (PARTITION BY body_id, kind) AS a2 FROM @t)
  SELECT id, CASE WHEN a1 < id THEN a1 ELSE a2 END AS canonical, CASE WHEN a1 < id THEN 'confirmed' ELSE 'pending' END AS status, CASE WHEN a1 < id THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM x WHERE a1 < id OR a2 < id""")
def _(s, d):
    return relational.duplicates(tenders(s, d, "id", "body_id", "kind", "status"), ["body_id", "kind", "status"], ["body_id", "kind"], "id")


# -- scalars -----------------------------------------------------------------------------------


@query("normalize_company", "SELECT s_suppkey, nullif(trim(regexp_replace(regexp_replace(upper(s_name), '[.;:\"'']', '', 'g'), '[^A-Z0-9 ]+', ' ', 'g')), '') AS name FROM supplier")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", S.company_name(c("s_name")).alias("name"))


@query("variation_by_year", """WITH y AS (SELECT year(published) AS y, region, count(*) AS n FROM @t GROUP BY 1, 2), z AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY region ORDER BY y) AS p FROM y)
  SELECT CAST(y AS INT) AS year, region, n, CASE WHEN n = 0 AND p = 0 THEN 0.0::DOUBLE WHEN p <> 0 THEN round((n - p) / p * 100, 1) END AS change FROM z""")
def _(s, d):
    yearly = tenders(s, d).groupBy(F.year("published").alias("year"), "region").agg(F.count("*").alias("n"))
    before = F.lag("n", 1, 0).over(Window.partitionBy("region").orderBy("year"))
    return yearly.withColumn("p", before).select("year", "region", "n", S.variation(c("n"), c("p")).alias("change"))


@query("event_props_json", "SELECT event_type, k AS key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS n_values FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) GROUP BY ALL")
def _(s, d):
    """Keys of the JSON in ``props`` with their numbers of values; malformed JSON has none."""
    keys = F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")
    return table(s, d, "events").select("event_type", keys).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_values"))


# -- text and vectors --------------------------------------------------------------------------

TERMS = ["license", "water", "energy", "nonesuch"]


@query("term_coverage_rank", """WITH m AS (SELECT doc_id, list_intersect(list_distinct(regexp_extract_all(lower(translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), '[a-z0-9]+')), ['license', 'water', 'energy', 'nonesuch']) AS f FROM documents),
  e AS (SELECT doc_id, unnest(f) AS term FROM m), w AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS w FROM e GROUP BY 1)
  SELECT doc_id, round(sum(w), 6) AS score, count(*) AS terms FROM e JOIN w USING (term) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""")
def _(s, d):
    return text.term_coverage(table(s, d, "documents"), TERMS, 50)


CHUNKS = """k AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 800)) AS start FROM documents WHERE length(text) > 0),
  ch AS (SELECT doc_id, CAST(start / 800 AS INT) AS chunk, CAST(start AS INT) AS start, substr(text, CAST(start + 1 AS BIGINT), 1000) AS body FROM k WHERE start = 0 OR start + 200 < length(text))"""


@query("chunks", f"WITH {CHUNKS} SELECT doc_id, chunk, start, md5(body) AS digest FROM ch")
def _(s, d):
    return text.chunks(table(s, d, "documents"), 1000, 800).select("doc_id", "chunk", "start", F.md5("body").alias("digest"))


@query("best_chunk", f"""WITH {CHUNKS}, h AS (SELECT doc_id, chunk, CAST(contains(lower(body), 'license') AS INT) + CAST(contains(lower(body), 'the') AS INT) AS hits FROM ch)
  SELECT doc_id, chunk, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk) AS rn FROM h WHERE hits > 0) WHERE rn = 1""")
def _(s, d):
    return text.best_chunk(text.chunks(table(s, d, "documents"), 1000, 800), ["license", "the"])


@query("rrf_fusion", """WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 100), y AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents ORDER BY rank LIMIT 100)
  SELECT doc_id, round(sum(s), 8) AS score, count(*) AS lists FROM (SELECT doc_id, 1.2::DOUBLE / (60 + rank) AS s FROM x UNION ALL SELECT doc_id, 0.8::DOUBLE / (60 + rank) FROM y) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40""")
def _(s, d):
    docs = table(s, d, "documents")
    long_, late = text.ranked(docs, [F.desc("n_chars"), F.asc("doc_id")], "doc_id", 100), text.ranked(docs, [F.desc("doc_id")], "doc_id", 100)
    return text.fused([(1.2, long_), (0.8, late)], "doc_id", 40)


@query("cosine_topk", """WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
  y AS (SELECT query_id, vec_id, sign(s) * floor(abs(s) * 1e6 + 0.5) / 1e6 AS cosine FROM x) SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM y QUALIFY rank <= 10""")
def _(s, d):
    vectors = table(s, d, "embeddings")
    return text.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10)


@query("language_id", """WITH p AS (SELECT lang, ' ' || replace(lower(coalesce(text, '')), ' ', '  ') || ' ' AS t FROM documents),
  m(k, w) AS (VALUES ('en', 'the'), ('en', 'and'), ('en', 'with'), ('de', 'der'), ('de', 'und'), ('de', 'mit'), ('es', 'el'), ('es', 'los'), ('es', 'con'), ('fr', 'le'), ('fr', 'les'), ('fr', 'avec')),
  n AS (SELECT row_number() OVER () AS i, lang, t FROM p), h AS (SELECT i, any_value(lang) AS lang, k, sum((length(t) - length(replace(t, ' ' || w || ' ', ''))) // (length(w) + 2)) AS hits FROM n, m GROUP BY i, k),
  b AS (SELECT lang, CASE WHEN hits = 0 THEN 'und' ELSE k END AS language, row_number() OVER (PARTITION BY i ORDER BY hits DESC, k) AS r FROM h) SELECT language, lang, count(*) AS n FROM b WHERE r = 1 GROUP BY ALL""")
def _(s, d):
    return table(s, d, "documents").groupBy(text.language(F.coalesce("text", F.lit(""))).alias("language"), "lang").agg(F.count("*").alias("n"))


@query("html_extract", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) AS links FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", text.html_title(c("html")).alias("title"), F.size(text.html_links(c("html"))).cast("long").alias("links"))


# -- graph and evaluation ----------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> DataFrame:
    return market.partner_pairs(awards(s, d, "tender_id", "company_id", "awarded"), 3)


@query("connected_components", """WITH RECURSIVE e AS MATERIALIZED (SELECT c_custkey AS a, (c_custkey * 7919) % 1009 + 1 AS b FROM customer), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, component) USING KEY (node) AS (SELECT a, a FROM u GROUP BY 1 UNION SELECT u.a, min(r.component) FROM r JOIN u ON u.b = r.node JOIN recurring.r AS old ON old.node = u.a WHERE r.component < old.component GROUP BY u.a) SELECT node, component FROM r""")
def _(s, d):
    return graph.components(table(s, d, "customer").select(c("c_custkey").alias("a"), (c("c_custkey") * 7919 % 1009 + 1).alias("b")))


@query("identity_components")
def _(s, d):
    return graph.components(graph.token_edges(table(s, d, "customer"), "c_custkey", ["c_name", "c_acctbal"]))


@query("communities")
def _(s, d):
    """By modularity; the label rounds of ``graph.communities`` are a cheaper way without a guarantee."""
    return louvain(_edges(s, d).select("a", "b", c("amount").alias("w")))[0]


@query("partner_degrees", f"WITH {PAIRS}, g AS (SELECT x.company_id AS a, y.company_id AS b FROM m x JOIN m y USING (tender_id) WHERE x.company_id < y.company_id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, count(*) AS degree FROM (SELECT a FROM g UNION ALL SELECT b FROM g) GROUP BY 1 ORDER BY degree DESC, a LIMIT 30")
def _(s, d):
    return graph.degrees(_edges(s, d), 30)


@query("identity_tokens", "SELECT token, count(*) AS n FROM (SELECT 'c_nationkey:' || c_nationkey AS token FROM customer UNION ALL SELECT 'c_mktsegment:' || c_mktsegment FROM customer WHERE trim(c_mktsegment) <> '') WHERE token IS NOT NULL GROUP BY 1")
def _(s, d):
    return graph.tokens(table(s, d, "customer"), "c_custkey", ["c_nationkey", "c_mktsegment"]).groupBy("token").agg(F.count("*").alias("n"))


@query("modal_attribute", "SELECT company_id, brand AS modal FROM (SELECT company_id, brand, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, brand) AS rn FROM @a WHERE brand IS NOT NULL GROUP BY 1, 2) WHERE rn = 1")
def _(s, d):
    return graph.modal(awards(s, d), "company_id", "brand")


CUTS = [50000.0, 100000.0, 150000.0, 200000.0, 250000.0]


@query("psi", """WITH x AS (SELECT (amount > 50000)::INT + (amount > 100000)::INT + (amount > 150000)::INT + (amount > 200000)::INT + (amount > 250000)::INT AS bin, year(published) = 1995 AS ref FROM @t WHERE year(published) IN (1995, 1996)),
  r AS (SELECT bin, count(*) AS k FROM x WHERE ref GROUP BY 1), q AS (SELECT bin, count(*) AS k FROM x WHERE NOT ref GROUP BY 1), n AS (SELECT (SELECT sum(k) FROM r) AS nr, (SELECT sum(k) FROM q) AS nq),
  b AS (SELECT coalesce(r.k / nr, 1 / greatest(nr, nq)) AS r, coalesce(q.k / nq, 1 / greatest(nr, nq)) AS s FROM r FULL JOIN q USING (bin), n) SELECT round(sum((s - r) * ln(s / r)), 6) AS psi, count(*) AS bins FROM b""")
def _(s, d):
    rows = tenders(s, d)
    return evaluation.psi(rows.where(F.year("published") == 1995), rows.where(F.year("published") == 1996), "amount", CUTS)


def _truth() -> Column:
    return (c("l_returnflag") == "R").cast("int")


@query("ece", "WITH b AS (SELECT least(floor(l_discount * 8 * 10), 9) AS bin, l_discount * 8 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM g")
def _(s, d):
    return evaluation.calibration_error(table(s, d, "lineitem"), c("l_discount") * 8, _truth())


POINTS = """g AS (SELECT l_quantity AS score, CAST(sum((l_returnflag = 'R')::INT) AS BIGINT) AS k, count(*) AS m FROM lineitem GROUP BY 1),
  pt AS (SELECT score, k, sum(k) OVER (ORDER BY score DESC) AS tp, sum(m) OVER (ORDER BY score DESC) AS n, sum(k) OVER () AS positives FROM g)"""


def _points(s: SparkSession, d: str) -> DataFrame:
    return evaluation.thresholds(table(s, d, "lineitem"), c("l_quantity"), _truth())


@query("average_precision", f"WITH {POINTS} SELECT round(sum(k / positives * tp / n), 6) AS average_precision FROM pt")
def _(s, d):
    return evaluation.average_precision(_points(s, d))


@query("best_f_beta", f"WITH {POINTS} SELECT score AS threshold, round(5 * tp / (n + 4 * positives), 6) AS f FROM pt ORDER BY f DESC, threshold DESC LIMIT 1")
def _(s, d):
    return evaluation.best_f_beta(_points(s, d), 2.0)


@query("threshold_bands", f"WITH {POINTS} SELECT min(score) FILTER (tp >= 0.33 * n) AS sure_from, max(score) FILTER (tp >= 0.9 * positives) AS none_below FROM pt")
def _(s, d):
    return evaluation.bands(_points(s, d), 0.33, 0.1)


@query("anomaly_sigma", "WITH g AS (SELECT body_id, avg(amount) AS m, stddev_pop(amount) AS s, count(amount) AS k FROM @t GROUP BY 1) SELECT id, body_id, amount FROM t JOIN g USING (body_id) WHERE k >= 5 AND s > 0 AND amount > m + 2 * s")
def _(s, d):
    return evaluation.anomalies(tenders(s, d, "id", "body_id", "amount"), "body_id", "amount", 2.0, 5)


@query("publication_spike", "SELECT count(*) FILTER (d = DATE '1996-03-15') AS today, round(count(*) FILTER (d < DATE '1996-03-15' AND d >= DATE '1996-03-15' - 30) / 30, 6) AS mean, count(*) FILTER (d = DATE '1996-03-15') > 1.5 * count(*) FILTER (d < DATE '1996-03-15' AND d >= DATE '1996-03-15' - 30) / 30 AS is_spike FROM (SELECT published::DATE AS d FROM @t)")
def _(s, d):
    return evaluation.spike(tenders(s, d), "published", "1996-03-15", 1.5)


@query("label_agreement", """WITH x AS (SELECT l_linestatus AS label, l_returnflag = 'R' AS y, l_discount > 0.05 AS p FROM lineitem), g AS (SELECT label, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM x GROUP BY GROUPING SETS ((label), ()))
  SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""")
def _(s, d):
    rows = table(s, d, "lineitem").select(c("l_linestatus").alias("label"), (c("l_returnflag") == "R").alias("y"), (c("l_discount") > 0.05).alias("p"))
    return evaluation.agreement(rows, "label", c("y"), c("p"))


# -- events ------------------------------------------------------------------------------------


@query("events_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return stream.tumbling(table(s, d, "events"), "1 day")


@query("events_sliding", "WITH x AS (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, start + INTERVAL 3 DAY AS \"end\", count(*) AS n FROM x GROUP BY 1")
def _(s, d):
    return stream.sliding(table(s, d, "events"), "3 days", "1 day")


@query("events_session", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, g""")
def _(s, d):
    return stream.sessions(table(s, d, "events"), "6 hours")


@query("dedup_events", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return stream.once(table(s, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("digest_daily", "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1, 2")
def _(s, d):
    return stream.digest(table(s, d, "events"), "1 day")


@query("cdc_events", """WITH x AS (SELECT user_id, ts, event_id, event_type AS before, lead(event_type) OVER w AS after, lead(event_id) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, ts, event_id, before, after FROM x WHERE nx IS NOT NULL AND before IS DISTINCT FROM after""")
def _(s, d):
    return stream.changes(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("standing_rules", "SELECT event_id, ts, 'large' AS rule FROM events WHERE value > 90 UNION ALL SELECT event_id, ts, 'early' FROM events WHERE event_id < 500")
def _(s, d):
    return stream.matches(table(s, d, "events"), {"large": "value > 90", "early": "event_id < 500"})


@query("late_events", "SELECT event_id FROM events, (SELECT max(ts) AS m FROM events) WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY")
def _(s, d):
    return stream.late(table(s, d, "events"), "2024-01-20", "1 day")[1].select("event_id")


@query("retry_backoff", "SELECT event_id FROM (SELECT event_id, ts, user_id % 6 AS r FROM events) WHERE epoch(TIMESTAMP '2024-01-15') >= epoch(ts) + least(3600.0 * power(2, r), 40000.0)")
def _(s, d):
    rows = table(s, d, "events").select("event_id", c("ts").alias("last_attempt"), (c("user_id") % 6).alias("retries"))
    return stream.retry_due(rows, "2024-01-15", 3600, 40000).select("event_id")


@query("timeline", "SELECT published AS at, 'tender' AS kind, id AS key FROM @t UNION ALL SELECT awarded_on, 'award', tender_id FROM @a")
def _(s, d):
    return stream.union_timeline({"tender": tenders(s, d).select(c("published").alias("at"), c("id").alias("key")), "award": awards(s, d).select(c("awarded_on").alias("at"), c("tender_id").alias("key"))})


# -- catalogue ---------------------------------------------------------------------------------


@query("describe_tables", "SELECT 'orders' AS name, count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'region', count(*), 2 FROM region")
def _(s, d):
    return files.describe(s, d, ["orders", "region"])


@query("guarded_sql", "SELECT r_name, r_regionkey, false AS truncated FROM region")
def _(s, d):
    table(s, d, "region").createOrReplaceTempView("region")
    return files.guarded_sql(s, "SELECT r_name, r_regionkey FROM region")


@query("places", "SELECT n_nationkey, n_name AS province, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return places(s, d)
