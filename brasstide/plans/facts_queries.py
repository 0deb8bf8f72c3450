"""Annual facts, lookups, ratios and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import facts
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import Ctes, r
from brasstide.sources import maintenance
from brasstide.sources.derived import BARS, ENTRIES, bars, entries, table, written

QUERIES, SQL = {}, {}
C = Ctes()
C.raw("bars", BARS)
C.raw("entries", ENTRIES)


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


C.add("year_ends", "SELECT cik, end_day, min(fy) AS fiscal_year FROM entries WHERE form = '10-K' AND val IS NOT NULL "
      "AND end_day - start_day BETWEEN 350 AND 380 GROUP BY cik, end_day")
C.add("annual", """
  SELECT e.cik, taxonomy, concept, unit, fiscal_year, start_day AS period_start, end_day AS period_end, val AS value,
    accn AS accession, form, filed FROM entries e JOIN year_ends USING (cik, end_day)
  QUALIFY row_number() OVER (PARTITION BY e.cik, taxonomy, concept, unit, fiscal_year ORDER BY filed DESC, accn DESC) = 1""")
C.add("named", """
  SELECT concat('S', cik) AS ticker, *, CASE concept WHEN 'Revenues' THEN 'revenue' WHEN 'GrossProfit' THEN 'gross_profit'
    WHEN 'NetIncomeLoss' THEN 'net_income' END AS fact FROM annual""")
C.add("by_year", """
  SELECT ticker, fiscal_year, max(value) FILTER (fact = 'revenue') AS revenue, max(value) FILTER (fact = 'gross_profit') AS gross_profit,
    max(value) FILTER (fact = 'net_income') AS net_income FROM named GROUP BY ticker, fiscal_year""")


def _facts(spark, sf):
    return written(spark, sf, "annual_facts", lambda: facts.annual_facts(entries(spark, sf)))


def _named(spark, sf):
    return facts.named_facts(_facts(spark, sf).withColumn("ticker", F.concat(F.lit("S"), F.col("cik"))))


@query("company_json_entries", """
  SELECT cik, taxonomy, concept, unit, start_day, end_day, round(val, 4) AS val, fy, fp, form, filed, accn FROM entries""")
def _json(spark, sf):
    # The documents as the source serves them, built from the entries and flattened again.
    e = F.struct(F.col("start_day").cast("string").alias("start"), F.col("end_day").cast("string").alias("end"),
                 "val", "accn", "fy", "fp", "form", F.col("filed").cast("string").alias("filed"))
    units = entries(spark, sf).groupBy("cik", "taxonomy", "concept", "unit").agg(F.collect_list(e).alias("e"))
    concepts = units.groupBy("cik", "taxonomy", "concept").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units")).alias("b"))
    taxonomies = concepts.groupBy("cik", "taxonomy").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "b"))).alias("c"))
    docs = taxonomies.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "c"))).alias("facts"))
    raw = docs.select(F.to_json(F.struct("cik", "facts")).alias("json"))
    return rounded(facts.company_entries(raw), {"val": 4})


@query("fiscal_year_ends", "SELECT cik, end_day, fiscal_year FROM year_ends")
def _ends(spark, sf):
    return facts.fiscal_year_ends(entries(spark, sf))


@query("annual_facts", f"""
  SELECT cik, concept, unit, fiscal_year, period_start, period_end, {r('value', 4, 'value')}, accession, filed FROM annual""")
def _annual(spark, sf):
    f = _facts(spark, sf).select("cik", "concept", "unit", "fiscal_year", "period_start", "period_end", "value",
                                 "accession", "filed")
    return rounded(f, {"value": 4})


@query("facts_as_of", f"""
  WITH e AS (SELECT * FROM entries WHERE filed <= DATE '1997-12-31'),
  y AS (SELECT cik, end_day, min(fy) AS fiscal_year FROM e GROUP BY cik, end_day)
  SELECT e.cik, concept, fiscal_year, {r('val', 4, 'value')}, accn AS accession FROM e JOIN y USING (cik, end_day)
  QUALIFY row_number() OVER (PARTITION BY e.cik, concept, fiscal_year ORDER BY filed DESC, accn DESC) = 1""")
def _as_of(spark, sf):
    f = facts.annual_facts(entries(spark, sf), "1997-12-31")
    return rounded(f.select("cik", "concept", "fiscal_year", "value", "accession"), {"value": 4})


@query("pinned_facts", f"""
  WITH p AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, make_date(CAST(1996 + s_nationkey % 4 AS INT), 6, 30) AS pin FROM supplier),
  e AS (SELECT e.* FROM entries e JOIN p USING (cik) WHERE filed <= pin),
  y AS (SELECT cik, end_day, min(fy) AS fiscal_year FROM e GROUP BY cik, end_day)
  SELECT e.cik, concept, fiscal_year, {r('val', 4, 'value')} FROM e JOIN y USING (cik, end_day)
  QUALIFY row_number() OVER (PARTITION BY e.cik, concept, fiscal_year ORDER BY filed DESC, accn DESC) = 1""")
def _pinned(spark, sf):
    pins = table(spark, sf, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
        F.make_date(1996 + F.col("s_nationkey") % 4, F.lit(6), F.lit(30)).alias("pin"))
    e = entries(spark, sf).join(pins, "cik").filter(F.col("filed") <= F.col("pin")).drop("pin")
    return rounded(facts.annual_facts(e).select("cik", "concept", "fiscal_year", "value"), {"value": 4})


@query("upsert_facts", f"""
  SELECT cik, concept, fiscal_year, {r('CASE WHEN fiscal_year = 1997 THEN value * 2 ELSE value END', 4, 'value')} FROM annual""")
def _upsert(spark, sf):
    f = _facts(spark, sf)
    new = f.filter("fiscal_year = 1997").withColumn("value", F.col("value") * 2)
    return rounded(facts.upsert_facts(f, new).select("cik", "concept", "fiscal_year", "value"), {"value": 4})


@query("replace_company_facts", "SELECT cik, concept, fiscal_year FROM annual WHERE NOT (cik < '0000000051' AND fiscal_year < 1998)")
def _replace(spark, sf):
    f = _facts(spark, sf)
    new = f.filter("cik < '0000000051' AND fiscal_year >= 1998")
    return maintenance.replace_partition(f, new, "cik").select("cik", "concept", "fiscal_year")


@query("named_facts", f"SELECT ticker, fiscal_year, fact, {r('value', 4, 'value')}, concept FROM named")
def _names(spark, sf):
    return rounded(_named(spark, sf).select("ticker", "fiscal_year", "fact", "value", "concept"), {"value": 4})


_ASK = """(SELECT l_orderkey * 10 + l_linenumber AS request_id, concat('s', lpad(CAST(l_suppkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS VARCHAR), 10, '0'), ' ') AS ticker,
    CASE l_linenumber WHEN 1 THEN 'Net Sales' WHEN 2 THEN 'gross-profit' WHEN 3 THEN 'capex' WHEN 4 THEN 'dividends' ELSE 'earnings' END AS fact,
    CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 6 THEN 2090 ELSE year(l_shipdate) END AS fiscal_year FROM lineitem)"""


@query("fact_lookup", f"""
  WITH q AS (SELECT request_id, upper(trim(ticker)) AS ticker, fact AS asked, CASE fact WHEN 'Net Sales' THEN 'revenue'
      WHEN 'gross-profit' THEN 'gross_profit' WHEN 'capex' THEN 'capital_expenditures' WHEN 'earnings' THEN 'net_income' END AS fact,
      fiscal_year AS fy FROM {_ASK}),
  y AS (SELECT ticker, fact, max(fiscal_year) AS latest FROM named GROUP BY ticker, fact)
  SELECT request_id, q.ticker, asked, q.fact, coalesce(fy, latest) AS fiscal_year,
    CASE WHEN q.fact IS NULL THEN 'bad_input' WHEN n.value IS NOT NULL THEN 'ok'
      WHEN q.ticker NOT IN (SELECT ticker FROM named) THEN 'not_ingested' WHEN latest IS NULL THEN 'never_reported'
      ELSE 'not_that_year' END AS status, {r('n.value', 4, 'value')}, n.accession
  FROM q LEFT JOIN y ON y.ticker = q.ticker AND y.fact = q.fact
  LEFT JOIN named n ON n.ticker = q.ticker AND n.fact = q.fact AND n.fiscal_year = coalesce(fy, latest)""")
def _lookup(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    shift = F.when(n == 7, 1000000).otherwise(0)
    q = li.select(
        (F.col("l_orderkey") * 10 + n).alias("request_id"),
        F.concat(F.lit("s"), F.lpad((F.col("l_suppkey") + shift).cast("string"), 10, "0"), F.lit(" ")).alias("ticker"),
        F.when(n == 1, "Net Sales").when(n == 2, "gross-profit").when(n == 3, "capex").when(n == 4, "dividends")
        .otherwise("earnings").alias("fact"),
        F.when(n == 5, F.lit(None)).when(n == 6, 2090).otherwise(F.year("l_shipdate")).cast("int").alias("fiscal_year"))
    out = facts.lookup(q, _named(spark, sf)).select("request_id", "ticker", "asked", "fact", "fiscal_year", "status",
                                                    "value", "accession")
    return rounded(out, {"value": 4})


@query("fact_citations", """
  SELECT ticker, fact, fiscal_year, concat('us-gaap:', concept) AS concept, accession,
    concat('https://www.sec.gov/Archives/edgar/data/', CAST(cik AS BIGINT), '/', replace(accession, '-', ''), '/') AS source_url
  FROM named WHERE fact = 'revenue'""")
def _citations(spark, sf):
    n = _named(spark, sf)
    q = n.filter("fact = 'revenue'").select(F.xxhash64("ticker", "fiscal_year").alias("request_id"), "ticker", "fact",
                                            F.col("fiscal_year").cast("int").alias("fiscal_year"))
    return facts.lookup(q, n).select("ticker", "fact", "fiscal_year", "concept", "accession", "source_url")


@query("money_format", """
  SELECT o_orderkey, CASE WHEN v >= 1e9 THEN concat('$', format('{:,.3f}', v / 1e9), ' billion')
      WHEN v >= 1e6 THEN concat('$', format('{:,.1f}', v / 1e6), ' million') ELSE concat('$', format('{:,.0f}', v)) END AS formatted
  FROM (SELECT o_orderkey, floor(o_totalprice) * power(10, o_custkey % 5) + 0.3 AS v FROM orders)""")
def _money(spark, sf):
    v = F.floor("o_totalprice") * F.pow(F.lit(10.0), F.col("o_custkey") % 5) + 0.3
    return table(spark, sf, "orders").select("o_orderkey", facts.formatted(v, F.lit("USD")).alias("formatted"))


@query("ratios_by_year", f"""
  SELECT ticker, fiscal_year, 'gross_margin' AS ratio, {r('gross_profit / revenue', 6, 'value')} FROM by_year
    WHERE gross_profit IS NOT NULL AND revenue IS NOT NULL
  UNION ALL SELECT ticker, fiscal_year, 'net_margin', {r('net_income / revenue', 6, 'value')} FROM by_year
    WHERE net_income IS NOT NULL AND revenue IS NOT NULL""")
def _ratios(spark, sf):
    out = facts.ratios_by_year(_named(spark, sf)).select("ticker", "fiscal_year", "ratio", "value")
    return rounded(out, {"value": 6})


@query("statement_ratios", f"""
  WITH q AS (SELECT concat('S', lpad(CAST(l_suppkey AS VARCHAR), 10, '0')) AS ticker, date_trunc('quarter', l_shipdate) AS qs,
      sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS rev, sum(CAST(round(l_tax * 100) AS BIGINT)) / 100.0 - 1 AS eq,
      sum(CAST(l_quantity AS BIGINT)) AS debt, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'N') / 100.0 AS net
    FROM lineitem GROUP BY 1, 2),
  p AS (SELECT ticker, 'quarterly' AS period_type, qs, rev, net, eq, debt FROM q UNION ALL
    SELECT ticker, 'ttm', qs, sum(rev) OVER w, sum(net) OVER w, eq, debt FROM q
    WINDOW w AS (PARTITION BY ticker ORDER BY qs ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
    QUALIFY count(*) OVER w = 4)
  SELECT ticker, period_type, CAST(qs AS DATE) AS period_end, x.ratio, round(x.v, 6) + 0.0 AS value,
    CASE WHEN x.gone <> '' THEN 'missing' WHEN x.den = 0 THEN 'zero' ELSE 'ok' END AS status,
    CASE WHEN x.iseq AND x.den < 0 THEN 'negative equity' END AS caveat
  FROM (SELECT ticker, period_type, qs, unnest([
      struct_pack(ratio := 'net_margin', v := net / nullif(rev, 0), den := rev, iseq := false, gone := CASE WHEN net IS NULL THEN 'n' ELSE '' END),
      struct_pack(ratio := 'return_on_equity', v := net / nullif(eq, 0), den := eq, iseq := true, gone := CASE WHEN net IS NULL THEN 'n' ELSE '' END),
      struct_pack(ratio := 'debt_to_equity', v := debt / nullif(eq, 0), den := eq, iseq := true, gone := '')]) AS x FROM p)""")
def _statement(spark, sf):
    li = table(spark, sf, "lineitem")

    def cents(x):
        return F.sum(F.round(F.col(x) * 100).cast("bigint")) / 100.0

    q = li.groupBy(F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("ticker"),
                   F.date_trunc("quarter", "l_shipdate").cast("date").alias("period_end")).agg(
        cents("l_extendedprice").alias("rev"), (cents("l_tax") - 1).alias("eq"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("debt"),
        (F.sum(F.when(F.col("l_returnflag") == "N", F.round(F.col("l_extendedprice") * 100).cast("bigint"))) / 100.0)
        .alias("net"))
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for label, c in (
        ("Operating Revenue", "rev"), ("Total Equity Gross Minority Interest", "eq"), ("Total Debt", "debt"),
        ("Net Income Common Stockholders", "net"))])
    lines = q.select("ticker", F.lit("quarterly").alias("period_type"), "period_end", F.explode(rows).alias("l")).select(
        "ticker", "period_type", "period_end", "l.*")
    out = facts.statement_ratios(lines).filter(F.col("ratio").isin("net_margin", "return_on_equity", "debt_to_equity"))
    return rounded(out.select("ticker", "period_type", "period_end", "ratio", "value", "status", "caveat"), {"value": 6})


@query("company_snapshot", f"""
  WITH g AS (SELECT *, lag(revenue) OVER w AS pr, lag(net_income) OVER w AS pn, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS k
    FROM by_year WHERE revenue IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))
  SELECT ticker, fiscal_year, {r('gross_profit / revenue', 6, 'gross_margin')}, {r('net_income / revenue', 6, 'net_margin')},
    {r('CASE WHEN pr > 0 THEN revenue / pr - 1 END', 6, 'revenue_growth')},
    {r('CASE WHEN pn > 0 THEN net_income / pn - 1 END', 6, 'net_income_growth')} FROM g WHERE k <= 3""")
def _snapshot(spark, sf):
    out = facts.snapshot(_named(spark, sf)).select("ticker", "fiscal_year", "gross_margin", "net_margin",
                                                   "revenue_growth", "net_income_growth")
    return rounded(out, {c: 6 for c in ("gross_margin", "net_margin", "revenue_growth", "net_income_growth")})


@query("latest_common_year", """
  SELECT ticker, max(fiscal_year) AS fiscal_year FROM (SELECT ticker, fiscal_year FROM named
    WHERE fact IN ('revenue', 'net_income') GROUP BY ticker, fiscal_year HAVING count(DISTINCT fact) = 2) GROUP BY ticker""")
def _latest(spark, sf):
    return facts.latest_years(_named(spark, sf), ["revenue", "net_income"])


@query("fiscal_year_end", "SELECT ticker, fiscal_year, min(period_end) AS fiscal_year_end FROM named GROUP BY ticker, fiscal_year")
def _year_end(spark, sf):
    return facts.fiscal_year_end(_named(spark, sf))


@query("fact_arithmetic", f"""
  WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, ['plus', '-', 'times', 'over', 'growth', 'share of', 'modulo'][l_linenumber] AS op0,
      concat('S', lpad(CAST(l_suppkey AS VARCHAR), 10, '0')) AS ticker, year(l_shipdate) AS y, CAST(l_quantity AS INT) AS n FROM lineitem),
  v AS (SELECT q.*, a.value AS x, CASE WHEN y = 1995 THEN 0 ELSE n * 1000000.0 END AS z FROM q LEFT JOIN named a
    ON a.ticker = q.ticker AND a.fact = 'revenue' AND a.fiscal_year = y)
  SELECT request_id, CASE op0 WHEN 'plus' THEN 'add' WHEN '-' THEN 'subtract' WHEN 'times' THEN 'multiply' WHEN 'over' THEN 'divide'
      WHEN 'growth' THEN 'percent_change' WHEN 'share of' THEN 'percent_of' ELSE op0 END AS operation,
    CASE WHEN op0 = 'modulo' THEN 'unsupported' WHEN x IS NULL THEN 'bad_input' WHEN op0 IN ('over', 'share of') AND z = 0 THEN 'zero' ELSE 'ok' END AS status,
    {r("CASE op0 WHEN 'plus' THEN x + z WHEN '-' THEN x - z WHEN 'times' THEN x * z / 1000000 WHEN 'over' THEN x / nullif(z, 0) WHEN 'growth' THEN (z - x) / abs(x) * 100 WHEN 'share of' THEN x / nullif(z, 0) * 100 END", 6, 'value')}
  FROM v""")
def _arith(spark, sf):
    n = F.col("l_linenumber")
    ops = F.array(*map(F.lit, ["plus", "-", "times", "over", "growth", "share of", "modulo"]))
    y = F.year("l_shipdate")
    q = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("request_id"), F.element_at(ops, n).alias("operation"),
        F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"), F.lit(":Total Revenue:FY"),
                 y.cast("string")).alias("a"),
        F.when(y == 1995, "0").otherwise(F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"),
                                                  F.lit(" million"))).alias("b"))
    out = facts.arithmetic(q, _named(spark, sf)).select(
        "request_id", "operation", "status", F.when(F.col("operation") == "multiply", F.col("value") / 1000000)
        .otherwise(F.col("value")).alias("value"))
    return rounded(out, {"value": 6})


@query("price_earnings_as_of", f"""
  WITH q AS (SELECT ticker, fiscal_year, make_date(CAST(fiscal_year AS INT), 12, 31) AS on_day, value / 1000000 AS eps FROM named WHERE fact = 'net_income')
  SELECT q.ticker, q.fiscal_year, max(day) AS price_day, max_by(close, day) AS close, {r('max_by(close, day) / any_value(eps)', 5, 'pe')}
  FROM q JOIN bars b ON b.ticker = q.ticker AND b.day <= q.on_day GROUP BY q.ticker, q.fiscal_year""")
def _pe(spark, sf):
    eps = _named(spark, sf).filter("fact = 'net_income'").withColumn("value", F.col("value") / 1000000)
    q = eps.select("ticker", "fiscal_year", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("on_day"))
    out = facts.price_earnings(eps, bars(spark, sf), q).select("ticker", "fiscal_year", "price_day", "close", "pe")
    return rounded(out, {"pe": 5})


@query("same_fiscal_end", """
  WITH a AS (SELECT DISTINCT ticker, period_end AS end_a FROM named),
  b AS (SELECT DISTINCT ticker, CAST(period_end + CAST(CAST(substr(ticker, 11, 1) AS INT) * 2 - 6 AS INT) AS DATE) AS end_b FROM named)
  SELECT a.ticker, end_a, end_b FROM a JOIN b ON a.ticker = b.ticker AND abs(end_a - end_b) <= 7""")
def _near(spark, sf):
    ends = _named(spark, sf).select("ticker", F.col("period_end").alias("end_a")).distinct()
    shift = F.substring("ticker", 11, 1).cast("int") * 2 - 6
    b = ends.select("ticker", F.date_add("end_a", shift).alias("end_b"))
    return facts.same_fiscal_end(ends, b)
