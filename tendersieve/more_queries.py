"""More registered queries: names and ids, dates and deadlines, prices, histories, own work, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersieve.functions import scalars as S
from tendersieve.operators import procurement as P, relational
from tendersieve.plans.domain import awards, table, tenders
from tendersieve.plans.scope import TenderFilter
from tendersieve.registry import query

c = F.col

# -- names and ids -----------------------------------------------------------------------------

ENDINGS = (" S.L.", ", S.A.U.", " SLNE", " Sociedad Limitada Unipersonal", " S. Coop.", " GmbH", " (Ibéria) S.L., S.A.", "", " & Compañía, S.A.", " N.V.", "-Ag.", " UTE")


def _name_sql(x: str) -> str:
    """DuckDB's normal form of the name ``x``."""
    form = S.LEGAL_FORM.replace("'", "''")
    out = f"trim(upper(translate({x}, '{S.MARKED}', '{S.PLAIN}')))"
    for _ in range(S.FORMS):
        out = f"trim(regexp_replace({out}, '{form}', ''), ' ,.-')"
    out = rf"trim(regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    for _ in range(S.FORMS):
        out = f"trim(regexp_replace({out}, '{form}', ''))"
    return f"nullif({out}, '')"


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("company_names", f"SELECT s_suppkey, {_name_sql(f's_name || {_texts(ENDINGS)}[s_suppkey % {len(ENDINGS)} + 1]')} AS name FROM supplier")
def _(s, d):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (c("s_suppkey") % len(ENDINGS) + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", S.company_name(F.concat("s_name", ending)).alias("name"))


VENTURES = ("UTE {a} SL - {b} S.A.", "U.T.E. {a}, {b} y {a} (Lote 3)", "{a} / {b} UTE", "UTECO {a} SL", "ute: {a} AND Ñandú; {b}", "UTE", "{a} - {b}")


@query("joint_venture_names", rf"""WITH n AS (SELECT s_suppkey, replace(replace({_texts(VENTURES)}[s_suppkey % {len(VENTURES)} + 1], '{{a}}', s_name), '{{b}}', 'Obras ' || s_nationkey) AS name FROM supplier),
  b AS (SELECT s_suppkey, CASE WHEN regexp_matches(trim(name), '{S.VENTURE_HEAD}') THEN regexp_replace(trim(name), '{S.VENTURE_HEAD}', '') WHEN regexp_matches(trim(name), '{S.VENTURE_TAIL}') THEN regexp_replace(trim(name), '{S.VENTURE_TAIL}', '') END AS body FROM n),
  m AS (SELECT s_suppkey, i, {_name_sql("trim(x, ' ,.-')")} AS member FROM (SELECT s_suppkey, unnest(string_split_regex(x, '{S.BETWEEN_MEMBERS}')) AS x, generate_subscripts(string_split_regex(x, '{S.BETWEEN_MEMBERS}'), 1) AS i FROM (SELECT s_suppkey, trim(regexp_replace(trim(body), '\s*\([^)]*\)\s*$', ''), ' ,.-') AS x FROM b WHERE body IS NOT NULL)))
  SELECT s_suppkey, member, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS INT) AS place FROM (SELECT s_suppkey, member, min(i) AS i FROM m WHERE member IS NOT NULL GROUP BY 1, 2)""")
def _(s, d):
    form = F.element_at(F.array(*[F.lit(v) for v in VENTURES]), (c("s_suppkey") % len(VENTURES) + 1).cast("int"))
    name = F.replace(F.replace(form, F.lit("{a}"), c("s_name")), F.lit("{b}"), F.concat(F.lit("Obras "), c("s_nationkey").cast("string")))
    return table(s, d, "supplier").select("s_suppkey", F.posexplode(S.joint_venture_members(name)).alias("place", "member"))


#: A tax id made from a key: persons and residents with right and wrong letters, companies, foreign ids, none.
_MADE = """CASE o_custkey % 7 WHEN 0 THEN lpad(CAST(o_custkey AS {t}), 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_custkey % 23 + 1 AS INT), 1) WHEN 1 THEN lpad(CAST(o_custkey AS {t}), 8, '0') || '-a'
  WHEN 2 THEN 'x' || lpad(CAST(o_custkey AS {t}), 7, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(o_custkey % 23 + 1 AS INT), 1) WHEN 3 THEN 'B-' || lpad(CAST(o_custkey * 7919 % 10000000 AS {t}), 7, '0') || CAST(o_orderkey % 10 AS {t})
  WHEN 4 THEN 'Q' || lpad(CAST(o_custkey * 7919 % 10000000 AS {t}), 7, '0') || substr('JABCDEFGHI', CAST(o_orderkey % 10 + 1 AS INT), 1) WHEN 5 THEN 'FR 12.345' || CAST(o_custkey AS {t}) END"""


@query("tax_id_classes", rf"""WITH m AS (SELECT o_orderkey, nullif(upper(regexp_replace({_MADE.format(t='VARCHAR')}, '[\s\-.]', '', 'g')), '') AS s FROM orders),
  k AS (SELECT *, CASE WHEN regexp_matches(s, '^[A-Z][0-9]{{7}}.$') THEN list_transform(range(2, 9), lambda i: CAST(substr(s, i, 1) AS INT)) END AS g FROM m),
  q AS (SELECT *, (10 - (g[2] + g[4] + g[6] + list_sum(list_transform([g[1], g[3], g[5], g[7]], lambda x: x * 2 // 10 + x * 2 % 10))) % 10) % 10 AS k FROM k),
  r AS (SELECT *, CAST(CAST(k AS INT) AS VARCHAR) AS digit, substr('JABCDEFGHI', CAST(k AS INT) + 1, 1) AS letter, substr(s, 9, 1) AS z FROM q)
  SELECT kind, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, CASE WHEN s IS NULL THEN 'invalid'
    WHEN regexp_matches(s, '^[0-9]{{8}}[A-Z]$') THEN CASE WHEN substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(substr(s, 1, 8) AS INT) % 23 + 1, 1) = z THEN 'dni' ELSE 'invalid' END
    WHEN regexp_matches(s, '^[XYZ][0-9]{{7}}[A-Z]$') THEN CASE WHEN substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(translate(substr(s, 1, 1), 'XYZ', '012') || substr(s, 2, 7) AS INT) % 23 + 1, 1) = z THEN 'nie' ELSE 'invalid' END
    WHEN regexp_matches(s, '^[ABCDEFGHJNPQRSUVW][0-9]{{7}}[0-9A-J]$') THEN CASE WHEN (contains('KPQSNW', s[1]) AND z = letter) OR (contains('ABEH', s[1]) AND z = digit) OR (NOT contains('KPQSNWABEH', s[1]) AND z IN (digit, letter)) THEN 'cif' ELSE 'invalid' END
    ELSE 'foreign' END AS kind FROM r) GROUP BY kind""")
def _(s, d):
    made = table(s, d, "orders").select("o_orderkey", F.expr(_MADE.format(t="STRING")).alias("id"))
    return made.groupBy(S.tax_id_class(c("id")).alias("kind")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("listing_scope", "SELECT id, amount, published FROM (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate AS published, date_diff('day', DATE '1996-03-01', CAST(o_orderdate + INTERVAL 40 DAY AS DATE)) AS days, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS canonical, c_mktsegment, o_orderpriority AS code FROM orders JOIN customer ON o_custkey = c_custkey) WHERE days BETWEEN 0 AND 30 AND canonical = id AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND (starts_with(code, '1') OR starts_with(code, '2-H'))")
def _(s, d):
    rows = tenders(s, d)
    first = rows.groupBy("body_id", "kind").agg(F.min("id").alias("canonical"))
    rows = rows.join(first, ["body_id", "kind"]).withColumns({"deadline": F.date_add(c("published").cast("date"), 40), "code": c("kind"), "body_type": c("segment")})
    return TenderFilter(days_left=(0, 30), today="1996-03-01", unique=True, body_types=("BUILDING", "MACHINERY"), codes=("1", "2-H")).apply(rows).select("id", "amount", "published")


@query("keyset_page_descending", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders WHERE v < 100000 OR (v = 100000 AND id < 500) OR v IS NULL ORDER BY v DESC NULLS LAST, id DESC LIMIT 40")
def _(s, d):
    rows = table(s, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("v"))
    return relational.keyset_page(rows, "v", "id", (100000.0, 500), 40, descending=True)


@query("keyset_null_tail", "SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'P' AND o_orderkey < 4000 ORDER BY id DESC LIMIT 40")
def _(s, d):
    rows = table(s, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("amount"), F.when(c("o_orderstatus") != "P", c("o_totalprice")).alias("v"))
    return relational.keyset_page(rows, "v", "id", (None, 4000), 40, descending=True).select("id", "amount")


# -- dates and deadlines -----------------------------------------------------------------------


@query("deadline_hours", """WITH x AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M:%S') || '+05:00' WHEN 2 THEN 'noon' END AS t FROM events),
  y AS (SELECT event_id, day, CASE WHEN event_id % 4 = 0 THEN timezone('UTC', timezone('Europe/Madrid', CAST(day || ' ' || t AS TIMESTAMP))) WHEN event_id % 4 = 1 THEN CAST(day || ' ' || substr(t, 1, 8) AS TIMESTAMP) - INTERVAL 5 HOUR END AS u FROM x),
  z AS (SELECT event_id, coalesce(strftime(u, '%Y-%m-%dT%H:%M:%S+00:00'), day) AS deadline, timezone('Europe/Madrid', timezone('UTC', u)) AS l FROM y)
  SELECT event_id, deadline, CASE WHEN strftime(l, '%Y-%m-%d') = substr(deadline, 1, 10) THEN strftime(l, '%H:%M') END AS hour FROM z""")
def _(s, d):
    time = F.date_format("ts", "HH:mm:ss")
    given = F.when(c("event_id") % 4 == 0, time).when(c("event_id") % 4 == 1, F.concat(time, F.lit("+05:00"))).when(c("event_id") % 4 == 2, "noon")
    rows = table(s, d, "events").select("event_id", S.utc_deadline(F.date_format("ts", "yyyy-MM-dd"), given).alias("deadline"))
    return rows.withColumn("hour", S.local_deadline_hour(c("deadline")))


_CALENDAR = """y AS (SELECT unnest(range(1990, 2004)) AS y), e AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), f AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM e),
  g AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM f), i AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS q FROM g), o AS (SELECT make_date(y, q // 31, q % 31 + 1) - 2 AS friday FROM i),
  k AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
  w AS (SELECT day, isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '01-06', '05-01', '08-15', '10-12', '11-01', '12-06', '12-08', '12-25') AND day NOT IN (SELECT friday FROM o) AS b FROM k),
  n AS (SELECT day, b, sum(b::INT) OVER (ORDER BY day) AS nth FROM w)"""


@query("appeal_deadlines", f"""WITH {_CALENDAR} SELECT o_orderkey AS id, z.day AS due FROM orders JOIN n x ON x.day = CAST(o_orderdate AS DATE) JOIN n z ON z.b AND z.nth = x.nth + 15
  WHERE o_totalprice > CASE o_orderpriority[1] WHEN '1' THEN 100000 WHEN '2' THEN 100000 WHEN '3' THEN 3000000 END AND o_custkey % 10 <> 0 AND o_orderkey % 7 <> 0""")
def _(s, d):
    rows = table(s, d, "orders").select(
        c("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("type"), c("o_totalprice").alias("value"), c("o_orderdate").alias("published"),
        F.when(c("o_custkey") % 10 == 0, "es220").otherwise("ES300").alias("nuts"), F.when(c("o_orderkey") % 7 == 0, "DOC_PIN, DOC_CN").otherwise("DOC_CN").alias("notices"),
    )
    return P.appeal_deadlines(rows).select("id", "due")


@query("durations_in_months", "SELECT p_partkey, round(p_size * CASE p_partkey % 6 WHEN 0 THEN 12.0 WHEN 1 THEN 1.0 WHEN 2 THEN 7 / 30.4375 WHEN 3 THEN 1 / 30.4375 WHEN 4 THEN 1 / 730.0 END, 6) AS months FROM part")
def _(s, d):
    units = F.element_at(F.array(*[F.lit(u) for u in ("ANN", "meses", " wek ", "Días", "HUR", "score")]), (c("p_partkey") % 6 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", F.round(S.months(c("p_size"), units), 6).alias("months"))


@query("money_texts", "SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2")
def _(s, d):
    grouped = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    written = F.when(c("o_orderkey") % 3 == 0, F.concat(grouped, F.lit(" €"))).when(c("o_orderkey") % 3 == 1, F.format_string("%.2f", "o_totalprice")).otherwise("n/d")
    return table(s, d, "orders").select("o_orderkey", S.money(written).alias("amount"))


@query("day_texts", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '31/02/1996' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week FROM orders")
def _(s, d):
    written = F.when(c("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(c("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).when(c("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise("31/02/1996")
    return table(s, d, "orders").select("o_orderkey", S.iso_date(written).alias("day"), S.iso_week(c("o_orderdate")).alias("week"))


@query("open_by_status", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 7 IN (0, 1, 6)) AS open FROM orders GROUP BY 1")
def _(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in ("PUB", "EV", "RES", "ADJ", "AGR", "EJEC", None)]), (c("o_orderkey") % 7 + 1).cast("int"))
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(S.is_open(status)).alias("open"))


# -- prices ------------------------------------------------------------------------------------


@query("price_points", """WITH b AS (SELECT l_orderkey AS tender_id, l_linenumber AS lot, l_discount AS cut, ['proportional', 'inverse_price', 'steps', 'reckless_mark', 'other'][l_linenumber % 5 + 1] AS formula, max(l_discount) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)
  SELECT tender_id, lot, formula, cut, round(CASE WHEN formula IN ('proportional', 'reckless_mark') THEN CASE WHEN best <= 0 THEN 40.0::DOUBLE ELSE 40.0 * least(cut / best, 1.0) END WHEN formula = 'inverse_price' THEN CASE WHEN cut >= best THEN 40.0 ELSE 40.0 * (1 - best) / (1 - cut) END
    WHEN formula = 'steps' THEN CASE WHEN cut >= 0.08 THEN 40.0 WHEN cut >= 0.04 THEN 15.0 WHEN cut >= 0.02 THEN 5.0 ELSE 0.0 END END, 2) AS points, cut > 0.09 AS reckless FROM b""")
def _(s, d):
    formula = F.element_at(F.array(*[F.lit(x) for x in ("proportional", "inverse_price", "steps", "reckless_mark", "other")]), c("l_linenumber") % 5 + 1)
    bids = table(s, d, "lineitem").select(c("l_orderkey").alias("tender_id"), c("l_linenumber").alias("lot"), c("l_discount").alias("cut"), formula.alias("formula"))
    return P.price_points(bids, 40.0, [(0.02, 5.0), (0.04, 15.0), (0.08, 60.0)], 0.09)


@query("reckless_cuts", "SELECT tender_id, lot, round((1 - awarded / budget) * 100, 4) AS cut_percent FROM @a WHERE budget > 0 AND awarded > 0 AND round((1 - awarded / budget) * 100, 4) >= 9.5")
def _(s, d):
    return P.reckless_cuts(awards(s, d), 9.5)


_COHORT = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS body, p_brand AS code, CAST(floor(log2(l_extendedprice)) AS BIGINT) AS size, CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 END AS competition, l_shipdate >= TIMESTAMP '1998-06-01' AS target FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("cohort_levels", f"""WITH h AS ({_COHORT}), k AS (
  SELECT *, [CASE WHEN competition IS NOT NULL THEN 'a' || concat_ws('|', body, code, size, competition) END, 'b' || concat_ws('|', body, code, size), CASE WHEN competition IS NOT NULL THEN 'c' || concat_ws('|', code, size, competition) END, 'd' || concat_ws('|', code, size), 'e' || code, 'f' || size, 'g'] AS ks FROM h),
  u AS (SELECT id, target, unnest(ks) AS k, unnest(range(1, 8)) AS level FROM k), n AS (SELECT k, count(*) AS n FROM u WHERE NOT target AND k IS NOT NULL GROUP BY 1),
  f AS (SELECT id, level, n FROM u JOIN n USING (k) WHERE target) SELECT id, CAST(level AS INT) AS level, n FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n < 20, level, n) = 1""")
def _(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), c("l_partkey") == c("p_partkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_suppkey").alias("body"), c("p_brand").alias("code"), F.floor(F.log2("l_extendedprice")).alias("size"),
        F.when(c("l_quantity") < 10, 1).when(c("l_quantity") < 30, 2).alias("competition"), (c("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")).alias("target"),
    )
    return P.cohort_levels(rows.where("target"), rows.where("not target"), 20)


@query("modification_costs", """WITH m AS (SELECT l_orderkey AS tender_id, l_suppkey % 3 AS lot, l_suppkey % 5 AS contract, l_linenumber // 2 AS number, l_shipdate AS day, l_extendedprice AS amount FROM lineitem), w AS (SELECT tender_id, lot, max(amount) AS awarded FROM m GROUP BY 1, 2),
  g AS (SELECT tender_id, lot, arg_max(amount, row(day, amount)) AS final FROM m GROUP BY 1, 2 HAVING count(DISTINCT contract) = 1 AND count(*) = count(DISTINCT number))
  SELECT tender_id, lot, awarded, final, round((final / awarded - 1) * 100, 1) AS variation FROM g JOIN w USING (tender_id, lot)""")
def _(s, d):
    rows = table(s, d, "lineitem").select(c("l_orderkey").alias("tender_id"), (c("l_suppkey") % 3).alias("lot"), (c("l_suppkey") % 5).alias("contract"), F.expr("l_linenumber div 2").alias("number"), c("l_shipdate").alias("at"), c("l_extendedprice").alias("amount"))
    return P.modification_costs(rows, rows.groupBy("tender_id", "lot").agg(F.max("amount").alias("awarded")))


# -- histories, own work, upkeep ---------------------------------------------------------------


@query("contract_events", """WITH v AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS version, CASE l_returnflag WHEN 'A' THEN 'ADJ' WHEN 'R' THEN 'ANUL' ELSE 'PUB' END AS status, floor(l_quantity / 10) * 1000 AS amount, CAST(l_shipdate AS DATE) AS until FROM lineitem),
  p AS (SELECT b.*, a.status AS s0, a.amount AS a0, a.until AS u0 FROM v a JOIN v b ON a.id = b.id AND b.version = a.version + 1),
  e AS (SELECT id, version, 'status' AS field, CASE status WHEN 'ADJ' THEN 'award' WHEN 'ANUL' THEN 'cancellation' ELSE 'status_change' END AS event, NULL::DOUBLE AS delta FROM p WHERE status <> s0 UNION ALL SELECT id, version, 'amount', 'modification', round(amount - a0, 2) FROM p WHERE amount <> a0
    UNION ALL SELECT id, version, 'until', CASE WHEN until > u0 THEN 'extension' ELSE 'modification' END, NULL FROM p WHERE until <> u0) SELECT *, md5(id || '|' || version || '|' || field) AS key FROM e""")
def _(s, d):
    nth = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)").cast("long")
    rows = table(s, d, "lineitem").select(
        c("l_orderkey").alias("id"), nth.alias("version"), F.when(c("l_returnflag") == "A", "ADJ").when(c("l_returnflag") == "R", "ANUL").otherwise("PUB").alias("status"),
        (F.floor(c("l_quantity") / 10) * 1000).cast("double").alias("amount"), c("l_shipdate").cast("date").alias("until"),
    )
    return P.contract_events(rows)


@query("own_funnel", """WITH f AS (SELECT l_orderkey, min(l_shipdate) AS decided FROM lineitem GROUP BY 1), p AS (SELECT c_nationkey AS org, o_orderstatus AS s, o_totalprice AS amount, date_diff('day', CAST(o_orderdate AS DATE), CAST(decided AS DATE)) * 24 AS hours FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON o_orderkey = l_orderkey)
  SELECT org, count(*) AS n, count(*) FILTER (s IN ('F', 'P')) AS submitted, count(*) FILTER (s = 'F') AS won, count(*) FILTER (s = 'P') AS lost, round(coalesce(sum(amount) FILTER (s = 'F'), 0), 2) AS amount, median(hours) AS median_hours, round(count(*) FILTER (s = 'F') / nullif(count(*) FILTER (s IN ('F', 'P')), 0), 6) AS win_rate FROM p GROUP BY 1""")
def _(s, d):
    decided = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("at"))
    rows = table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(decided, c("o_orderkey") == c("l_orderkey"), "left").select(
        c("c_nationkey").alias("org"), F.when(c("o_orderstatus").isin("F", "P"), 1).alias("submitted"), F.when(c("o_orderstatus") == "F", "won").when(c("o_orderstatus") == "P", "lost").alias("outcome"),
        c("o_totalprice").alias("amount"), (F.datediff("at", "o_orderdate") * 24).alias("hours"),
    )
    return P.own_funnel(rows)


@query("team_workload", """WITH p AS (SELECT nullif(o_custkey % 20, 0) AS responsible, o_orderkey % 5 = 0 AS submitted, CAST(o_orderdate AS DATE) + 30 AS deadline, o_orderkey % 3 = 0 AS idle FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1998-01-01'), f AS (
  SELECT responsible, 1 AS open, submitted::INT AS submitted, (NOT submitted AND deadline < DATE '1998-06-01')::INT AS overdue, (NOT submitted AND deadline >= DATE '1998-06-01' AND deadline <= DATE '1998-06-15')::INT AS due_soon, (NOT submitted AND idle)::INT AS no_action FROM p UNION ALL SELECT unnest(range(15, 31)), 0, 0, 0, 0, 0)
  SELECT responsible, CAST(sum(open) AS BIGINT) AS open, CAST(sum(submitted) AS BIGINT) AS submitted, CAST(sum(overdue) AS BIGINT) AS overdue, CAST(sum(due_soon) AS BIGINT) AS due_soon, CAST(sum(no_action) AS BIGINT) AS no_action FROM f GROUP BY 1""")
def _(s, d):
    rows = table(s, d, "orders").where("o_orderstatus = 'O' AND o_orderdate >= '1998-01-01'").select(
        F.nullif(c("o_custkey") % 20, F.lit(0)).alias("responsible"), F.when(c("o_orderkey") % 5 == 0, "submitted").otherwise("open").alias("status"), F.date_add(c("o_orderdate").cast("date"), 30).alias("deadline"),
        F.when(c("o_orderkey") % 3 == 0, " ").otherwise("call").alias("next_action"),
    )
    return P.workload(rows, s.range(15, 31).withColumnRenamed("id", "responsible"), "1998-06-01", 14)


@query("source_freshness", "SELECT event_type AS source, count(*) AS n, max(ts) AS last, round(epoch(TIMESTAMP '2024-02-01' - max(date_trunc('second', ts))) / 3600, 2) AS lag_hours, lag_hours > CASE event_type WHEN 'click' THEN 1 ELSE 48 END AS stale FROM events GROUP BY 1")
def _(s, d):
    return P.freshness(table(s, d, "events").select(c("event_type").alias("source"), c("ts").alias("at")), "2024-02-01", {"click": 1.0}, 48.0)


@query("retention_due", "SELECT 'orders' AS name, count(*) FILTER (o_orderdate < DATE '1998-06-01' - 365) AS due FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (l_shipdate < DATE '1998-06-01' - 730) FROM lineitem")
def _(s, d):
    return P.retention({"orders": (table(s, d, "orders"), "o_orderdate", 365), "lineitem": (table(s, d, "lineitem"), "l_shipdate", 730)}, "1998-06-01")


@query("retained_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= DATE '1998-06-01' - 365")
def _(s, d):
    return P.retained(table(s, d, "orders"), "o_orderdate", 365, "1998-06-01").select("o_orderkey")


# -- search and evaluation ---------------------------------------------------------------------


@query("emerging_terms", r"""WITH t AS (SELECT doc_id, substr(text, 1, 120) AS head, unnest(list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü0-9/\-]{3,}'))) AS term FROM documents)
  SELECT term, count(*) AS n, arg_min(head, doc_id) AS example FROM t WHERE term NOT IN ('the', 'and', 'der', 'und') AND NOT contains('license', term) AND NOT contains('information', term) GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, term LIMIT 20""")
def _(s, d):
    return P.emerging_terms(table(s, d, "documents"), ["license", "information"], ["the", "and", "der", "und"], 3, 20)


@query("search_boolean", """WITH p AS (SELECT doc_id, ' ' || regexp_replace(lower(translate(coalesce(text, ''), 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents),
  k AS (SELECT doc_id, t, (length(t) - length(replace(t, ' the ', ''))) / 5 + (length(t) - length(replace(t, ' of ', ''))) / 4 + (length(t) - length(replace(t, ' license ', ''))) / 9 AS n, length(t) - length(replace(t, ' ', '')) AS z FROM p)
  SELECT doc_id, round(n / (1 + ln(1.0 + z)), 6) AS score FROM k WHERE contains(t, ' the ') AND (contains(t, ' of ') OR contains(t, ' license ')) AND NOT contains(t, ' warranty ') ORDER BY score DESC, doc_id LIMIT 50""")
def _(s, d):
    return P.search(table(s, d, "documents"), ["the"], ["of", "license"], ["warranty"], 50)


@query("affinity", "SELECT p_partkey, greatest(least(((p_type LIKE '%PROMO%')::INT + (p_type LIKE '%TIN')::INT + (p_type LIKE '%BRASS')::INT) / 3, 1.0::DOUBLE), CASE WHEN p_brand = 'Brand#12' THEN 1.0::DOUBLE WHEN substr(p_brand, 1, 4) = 'Bran' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END) AS affinity FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.greatest(S.keyword_affinity(c("p_type"), ("promo", "tin", "brass")), S.code_similarity(c("p_brand"), ("Brand#12",))).alias("affinity"))


@query("bootstrap_average_precision", """WITH d AS (SELECT r, l_quantity AS score, (l_returnflag = 'R')::INT AS y, CAST('0x' || substr(md5('5:' || r || ':' || (l_orderkey * 10 + l_linenumber)), 1, 6) AS BIGINT) / 16777216 AS u FROM lineitem, (SELECT unnest(range(1, 21)) AS r)),
  k AS (SELECT r, score, y, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 WHEN u < 0.999406 THEN 5 WHEN u < 0.999917 THEN 6 WHEN u < 0.999990 THEN 7 WHEN u < 0.999999 THEN 8 ELSE 9 END AS k FROM d), g AS (SELECT r, score, sum(k * y) AS h, sum(k) AS n FROM k WHERE k > 0 GROUP BY 1, 2),
  w AS (SELECT r, h, sum(h) OVER (PARTITION BY r ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY r ORDER BY score DESC) AS seen, sum(h) OVER (PARTITION BY r) AS p FROM g), a AS (SELECT r, sum(h / p * tp / seen) AS ap FROM w GROUP BY 1)
  SELECT round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.975), 6) AS high, count(*) AS resamples FROM a""")
def _(s, d):
    rows = table(s, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_quantity").alias("score"), (c("l_returnflag") == "R").cast("int").alias("truth"))
    return P.bootstrap_precision(rows, 20, 5)
