"""Annual facts from company filings, and figures, ratios and arithmetic over them.

Requests are tables too: a lookup answers any number of (ticker, fact, year) rows in one join,
with a status column where nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.sources.maintenance import latest_per_key

# Forms, fact names with their concepts in order of preference, aliases, ratios.
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
YEAR_DAYS = (350, 380)
PLAIN_UNITS = ["USD", "shares", "USD/shares"]
CONCEPTS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "gross_profit": ["GrossProfit"],
    "research_and_development": ["ResearchAndDevelopmentExpense"],
    "selling_general_and_administrative": ["SellingGeneralAndAdministrativeExpense"],
    "operating_expenses": ["OperatingExpenses"],
    "operating_income": ["OperatingIncomeLoss"],
    "pretax_income": [
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"],
    "income_tax_expense": ["IncomeTaxExpenseBenefit"],
    "net_income": ["NetIncomeLoss"],
    "eps_basic": ["EarningsPerShareBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "shares_basic": ["WeightedAverageNumberOfSharesOutstandingBasic"],
    "shares_diluted": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capital_expenditures": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "shareholders_equity": ["StockholdersEquity"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue"],
    "long_term_debt": ["LongTermDebt"],
}
ALIASES = {
    "revenues": "revenue", "total_revenue": "revenue", "net_sales": "revenue", "sales": "revenue",
    "cost_of_sales": "cost_of_revenue", "cogs": "cost_of_revenue", "rnd": "research_and_development",
    "r&d": "research_and_development", "research_and_development_expense": "research_and_development",
    "sga": "selling_general_and_administrative", "sg&a": "selling_general_and_administrative",
    "operating_profit": "operating_income", "income_before_tax": "pretax_income",
    "income_before_income_taxes": "pretax_income", "pre_tax_income": "pretax_income",
    "tax_expense": "income_tax_expense", "income_taxes": "income_tax_expense",
    "provision_for_income_taxes": "income_tax_expense", "net_profit": "net_income",
    "earnings": "net_income", "basic_eps": "eps_basic", "diluted_eps": "eps_diluted",
    "eps": "eps_diluted", "basic_shares": "shares_basic", "diluted_shares": "shares_diluted",
    "weighted_average_shares_basic": "shares_basic", "weighted_average_shares_diluted": "shares_diluted",
    "capex": "capital_expenditures", "cash_from_operations": "operating_cash_flow",
    "assets": "total_assets", "liabilities": "total_liabilities", "equity": "shareholders_equity",
    "stockholders_equity": "shareholders_equity", "cash": "cash_and_equivalents",
    "debt": "long_term_debt",
}
RATIOS = {"gross_margin": ("gross_profit", "revenue"), "operating_margin": ("operating_income", "revenue"),
          "net_margin": ("net_income", "revenue"),
          "return_on_equity": ("net_income", "shareholders_equity"),
          "current_ratio": ("current_assets", "current_liabilities"),
          "debt_to_equity": ("total_debt", "equity")}
PERCENT_RATIOS = ["gross_margin", "operating_margin", "net_margin", "return_on_equity"]
LINE_ALIASES = {
    "revenue": ["Total Revenue", "Operating Revenue", "Revenue"],
    "gross_profit": ["Gross Profit"],
    "operating_income": ["Operating Income", "Total Operating Income As Reported"],
    "net_income": ["Net Income", "Net Income Common Stockholders",
                   "Net Income From Continuing Operation Net Minority Interest"],
    "total_debt": ["Total Debt"],
    "equity": ["Stockholders Equity", "Total Equity Gross Minority Interest"],
    "current_assets": ["Current Assets", "Total Current Assets"],
    "current_liabilities": ["Current Liabilities", "Total Current Liabilities"],
}
STATEMENT_RATIOS = {**RATIOS, "return_on_equity": ("net_income", "equity")}

_ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
COMPANY_SCHEMA = f"struct<cik:string,facts:map<string,map<string,struct<units:map<string,array<{_ENTRY}>>>>>>"


def company_entries(raw: DataFrame, column: str = "json") -> DataFrame:
    """Company-facts documents flattened to one row per reported entry."""
    df = raw.select(F.from_json(column, COMPANY_SCHEMA).alias("d"))
    df = df.select(F.lpad("d.cik", 10, "0").alias("cik"), F.explode("d.facts").alias("taxonomy", "_c"))
    df = df.select("cik", "taxonomy", F.explode("_c").alias("concept", "_b"))
    df = df.select("cik", "taxonomy", "concept", F.explode("_b.units").alias("unit", "_e"))
    df = df.select("cik", "taxonomy", "concept", "unit", F.explode("_e").alias("e"))
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date")
    return df.select("cik", "taxonomy", "concept", "unit", day("e.start").alias("start_day"),
                     day("e.end").alias("end_day"), "e.val", "e.fy", "e.fp", "e.form",
                     day("e.filed").alias("filed"), "e.accn")


def annual_entries(entries: DataFrame, filed_through=None) -> DataFrame:
    """Entries of annual reports with a value, filed by the given day."""
    df = entries.filter(F.col("form").isin(ANNUAL_FORMS) & F.col("val").isNotNull())
    if filed_through is None:
        return df
    through = filed_through if isinstance(filed_through, Column) else F.lit(filed_through).cast("date")
    return df.filter(F.col("filed") <= through)


def _full_year() -> Column:
    return F.datediff("end_day", "start_day").between(*YEAR_DAYS)


def fiscal_year_ends(entries: DataFrame, filed_through=None) -> DataFrame:
    """Period end -> the company's label for that year: the smallest `fy` that printed it."""
    df = annual_entries(entries, filed_through).filter(_full_year() & F.col("fy").isNotNull())
    return df.groupBy("cik", "end_day").agg(F.min("fy").alias("fiscal_year"))


def annual_facts(entries: DataFrame, filed_through=None) -> DataFrame:
    """One row per company, concept, unit and fiscal year: the most recently filed figure."""
    df = annual_entries(entries, filed_through).filter(
        F.col("end_day").isNotNull() & F.col("filed").isNotNull()
        & (F.col("start_day").isNull() | _full_year()))
    df = df.join(fiscal_year_ends(entries, filed_through), ["cik", "end_day"])
    best = latest_per_key(df, ["cik", "taxonomy", "concept", "unit", "fiscal_year"],
                          [F.col("filed").desc(), F.coalesce("accn", F.lit("")).desc()])
    return best.select("cik", "taxonomy", "concept", "unit", "fiscal_year", F.lit("FY").alias("fiscal_period"),
                       F.col("start_day").alias("period_start"), F.col("end_day").alias("period_end"),
                       F.col("val").alias("value"), F.col("accn").alias("accession"), "form", "filed")


def upsert_facts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming figures replace stored ones on the table's key."""
    keys = ["cik", "taxonomy", "concept", "unit", "fiscal_year", "fiscal_period"]
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def _pairs(mapping: dict[str, list[str]]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("fact"), F.lit(i).alias("_rank"), F.lit(c).alias("concept"))
                     for f, cs in mapping.items() for i, c in enumerate(cs)])


def named_facts(facts: DataFrame) -> DataFrame:
    """One row per (ticker, year, fact name): the first concept reported, plain units first.

    The name is looked up on the row itself (a constant map), not joined.
    """
    ranked = F.filter(_pairs(CONCEPTS), lambda p: p["concept"] == F.col("concept"))
    df = facts.filter("fiscal_period = 'FY'").withColumn("_p", F.explode(ranked))
    df = df.withColumns({"fact": F.col("_p.fact"), "_rank": F.col("_p._rank")}).drop("_p")
    return latest_per_key(df, ["ticker", "fiscal_year", "fact"],
                          [F.col("_rank"), ~F.col("unit").isin(PLAIN_UNITS), F.col("unit")]).drop("_rank")


def fact_name(raw: Column) -> Column:
    """What a person writes -> the fact's name, or null."""
    name = F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")
    known = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k, v)])
    name = F.coalesce(F.try_element_at(known, name), name)
    return F.when(name.isin(list(CONCEPTS)), name)


def formatted(value: Column, unit: Column) -> Column:
    """A figure as a person reads it."""
    def fixed(x, d):
        return F.format_number(x, d)

    size = F.abs(value)
    money = (F.when(size >= 1e9, F.concat(F.lit("$"), fixed(value / 1e9, 3), F.lit(" billion")))
             .when(size >= 1e6, F.concat(F.lit("$"), fixed(value / 1e6, 1), F.lit(" million")))
             .otherwise(F.concat(F.lit("$"), fixed(value, 0))))
    share = F.concat(F.lit("$"), F.when(size >= 0.1, fixed(value, 2)).otherwise(fixed(value, 3)),
                     F.lit(" per share"))
    return (F.when(unit == "USD/shares", share)
            .when(unit == "shares", F.concat(fixed(value, 0), F.lit(" shares")))
            .when(unit == "USD", money)
            .otherwise(F.concat(value.cast("string"), F.lit(" "), unit)))


def latest_years(named: DataFrame, facts: list[str]) -> DataFrame:
    """Per ticker, the most recent year in which every one of `facts` was reported."""
    years = named.filter(F.col("fact").isin(facts)).groupBy("ticker", "fiscal_year").agg(
        F.count_distinct("fact").alias("_k")).filter(F.col("_k") == len(facts))
    return years.groupBy("ticker").agg(F.max("fiscal_year").alias("fiscal_year"))


def lookup(requests: DataFrame, named: DataFrame) -> DataFrame:
    """Answer (request_id, ticker, fact, fiscal_year) rows; year null means the latest.

    status: ok, bad_input, not_ingested, never_reported, not_that_year (with the last 12 years).
    """
    r = requests.withColumns({"ticker": F.upper(F.trim("ticker")), "asked": F.col("fact"),
                              "fact": fact_name(F.col("fact"))})
    by_fact = named.groupBy("ticker", "fact").agg(
        F.max("fiscal_year").alias("_latest"),
        F.slice(F.reverse(F.array_sort(F.collect_set("fiscal_year"))), 1, 12).alias("_years"))
    known = named.select("ticker").distinct().withColumn("_known", F.lit(True))
    r = r.join(by_fact, ["ticker", "fact"], "left").join(known, "ticker", "left")
    r = r.withColumns({"basis": F.when(F.col("fiscal_year").isNull(), "latest reported"),
                       "fiscal_year": F.coalesce("fiscal_year", "_latest")})
    cols = ["value", "unit", "period_start", "period_end", "taxonomy", "concept", "accession", "form",
            "filed", "cik"]
    out = r.join(named.select("ticker", "fact", "fiscal_year", *cols), ["ticker", "fact", "fiscal_year"], "left")
    bad = F.col("fact").isNull() | ~F.coalesce(F.col("fiscal_year").between(1990, 2100), F.lit(True))
    status = (F.when(bad, "bad_input").when(F.col("value").isNotNull(), "ok")
              .when(F.col("_known").isNull(), "not_ingested")
              .when(F.col("_years").isNull(), "never_reported").otherwise("not_that_year"))
    return out.select(
        "request_id", "ticker", "asked", "fact", "fiscal_year", "basis", status.alias("status"), "value",
        "unit", formatted(F.col("value"), F.col("unit")).alias("formatted"), "period_start", "period_end",
        F.concat_ws(":", "taxonomy", "concept").alias("concept"), "accession", "form", "filed",
        F.when(F.col("cik").isNotNull(), F.concat(
            F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"),
            F.lit("/"), F.regexp_replace("accession", "-", ""), F.lit("/"))).alias("source_url"),
        F.when(status == "not_that_year", F.array_join(F.reverse(F.col("_years")), ", ")).alias("available_years"))


def fiscal_year_end(named: DataFrame) -> DataFrame:
    return named.groupBy("ticker", "fiscal_year").agg(F.min("period_end").alias("fiscal_year_end"))


def wide_facts(named: DataFrame, facts: list[str]) -> DataFrame:
    """One row per (ticker, year), one column per fact."""
    return named.filter(F.col("fact").isin(facts)).groupBy("ticker", "fiscal_year").agg(*[
        F.max(F.when(F.col("fact") == f, F.col("value"))).alias(f) for f in facts])


def ratios_by_year(named: DataFrame, names=("gross_margin", "operating_margin", "net_margin",
                                            "return_on_equity", "current_ratio")) -> DataFrame:
    """Every ratio for every year both of its facts exist; a zero denominator has no ratio."""
    parts = sorted({x for n in names for x in RATIOS[n]})
    rows = F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(RATIOS[n][0]).alias("numerator"),
                              F.col(RATIOS[n][1]).alias("denominator")) for n in names])
    df = wide_facts(named, parts).select("ticker", "fiscal_year", F.explode(rows).alias("_r")).select(
        "ticker", "fiscal_year", "_r.*").filter("numerator is not null and denominator is not null")
    value = F.try_divide("numerator", "denominator")
    percent = F.col("ratio").isin(PERCENT_RATIOS)
    return df.withColumns({
        "value": F.round(value, 6),
        "formatted": F.when(percent, F.concat(F.format_number(value * 100, 2), F.lit("%")))
        .otherwise(F.concat(F.format_number(value, 2), F.lit("x"))),
        "status": F.when(F.col("denominator") == 0, "no_data").otherwise("ok")})


def statement_ratios(lines: DataFrame) -> DataFrame:
    """Ratios of each period from statement lines (ticker, period_type, period_end, label, value).

    A line goes by the first of its labels that is present. Period type ttm sums the flows of the
    last four quarters against the latest quarter's balances.
    """
    ranked = F.filter(_pairs(LINE_ALIASES), lambda p: p["concept"] == F.col("label"))
    df = lines.filter(F.col("value").isNotNull()).withColumn("_p", F.explode(ranked))
    df = df.withColumns({"line": F.col("_p.fact"), "_rank": F.col("_p._rank")})
    keys = ["ticker", "period_type", "period_end"]
    wide = df.groupBy(*keys).agg(*[
        F.min_by("value", F.when(F.col("line") == x, F.col("_rank"))).alias(x) for x in LINE_ALIASES])
    flows = ["revenue", "gross_profit", "operating_income", "net_income"]
    w = Window.partitionBy("ticker").orderBy("period_end").rowsBetween(-3, 0)
    q = wide.filter("period_type = 'quarterly'")
    ttm = q.withColumn("_n", F.count(F.lit(1)).over(w)).withColumns({
        f: F.when(F.col("_n") == 4, F.sum(f).over(w)) for f in flows}).withColumn(
        "period_type", F.lit("ttm")).filter("_n = 4").drop("_n")
    rows = F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(a).alias("numerator"), F.col(b).alias("denominator"),
                              F.lit(b == "equity").alias("_eq"),
                              F.concat_ws(" and ", F.when(F.col(a).isNull(), a), F.when(F.col(b).isNull(), b))
                              .alias("missing")) for n, (a, b) in STATEMENT_RATIOS.items()])
    out = wide.unionByName(ttm).select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    return out.withColumns({
        "value": F.round(F.try_divide("numerator", "denominator"), 6),
        "status": F.when(F.col("missing") != "", "missing").when(F.col("denominator") == 0, "zero").otherwise("ok"),
        "caveat": F.when(F.col("_eq") & (F.col("denominator") < 0), "negative equity")}).drop("_eq")


def snapshot(named: DataFrame, years: int = 3) -> DataFrame:
    """The last fiscal years of five facts with margins and growth on the year before."""
    facts = ["revenue", "gross_profit", "operating_income", "net_income", "eps_diluted"]
    df = wide_facts(named, facts).filter("revenue is not null")
    w = Window.partitionBy("ticker").orderBy("fiscal_year")

    def share(x):
        return F.round(F.when(F.col("revenue") != 0, F.col(x) / F.col("revenue")), 6)

    def growth(x):
        before = F.lag(x).over(w)
        return F.round(F.when(before > 0, F.col(x) / before - 1), 6)

    df = df.withColumns({
        "gross_margin": share("gross_profit"), "operating_margin": share("operating_income"),
        "net_margin": share("net_income"), "revenue_growth": growth("revenue"),
        "net_income_growth": growth("net_income"),
        "_k": F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("fiscal_year").desc()))})
    return df.filter(F.col("_k") <= years).drop("_k")


# Patterns of operands, operation aliases and scale words.
_REFERENCE = r"^\s*([A-Za-z][A-Za-z0-9.\-]*)\s*[:/]\s*([A-Za-z_&][\w &\-]*?)\s*[:/]\s*(?:[Ff][Yy])?\s*(\d{4})\s*$"
_NUMBER = r"^\s*\(?\s*([-+]?)\s*\$?\s*([\d,]*\.?\d+(?:[eE][-+]?\d+)?)\s*(%|[A-Za-z]+)?\s*\)?\s*$"
OPERATIONS = ["add", "subtract", "multiply", "divide", "percent_change", "percent_of"]
OPERATION_ALIASES = {
    "+": "add", "plus": "add", "sum": "add", "addition": "add", "-": "subtract", "minus": "subtract",
    "difference": "subtract", "subtraction": "subtract", "*": "multiply", "x": "multiply", "times": "multiply",
    "product": "multiply", "multiplication": "multiply", "/": "divide", "ratio": "divide", "division": "divide",
    "over": "divide", "growth": "percent_change", "percentage_change": "percent_change",
    "pct_change": "percent_change", "growth_rate": "percent_change", "percentage_of": "percent_of",
    "share": "percent_of", "share_of": "percent_of", "pct_of": "percent_of", "margin": "percent_of"}
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mm": 1e6, "billion": 1e9, "bn": 1e9,
          "b": 1e9, "trillion": 1e12, "tn": 1e12, "t": 1e12}


def stated_number(raw: Column) -> Column:
    """The number a text states, or null: signs, commas, dollars, scale words; % is dropped."""
    digits = F.regexp_replace(F.regexp_extract(raw, _NUMBER, 2), ",", "")
    unit = F.lower(F.regexp_extract(raw, _NUMBER, 3))
    scale = F.when(unit.isin("", "%"), 1.0)
    for word, value in SCALES.items():
        scale = scale.when(unit == word, value)
    sign = F.when(F.regexp_extract(raw, _NUMBER, 1) == "-", -1.0).otherwise(1.0)
    return F.when(raw.rlike(_NUMBER), digits.try_cast("double") * scale * sign)


def plain_number(x: Column) -> Column:
    """A number without float noise: whole ones grouped, others to at most six places."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    text = F.regexp_replace(F.format_number(x, 6), r"\.?0+$", "")
    return F.when(whole, F.format_number(x, 0)).otherwise(text)


def arithmetic(requests: DataFrame, named: DataFrame) -> DataFrame:
    """One step of arithmetic per row of (request_id, operation, a, b).

    An operand is a number or a reference TICKER:fact:year, looked up in the facts.
    """
    op = F.regexp_replace(F.lower(F.trim("operation")), " ", "_")
    known = F.create_map(*[F.lit(x) for k, v in OPERATION_ALIASES.items() for x in (k, v)])
    df = requests.withColumn("operation", F.coalesce(F.try_element_at(known, op), op))
    n = named.select(F.col("ticker").alias("_t"), F.col("fact").alias("_f"), F.col("fiscal_year").alias("_y"),
                     F.col("value").alias("_v"))
    for side in ("a", "b"):
        ref = F.col(side).rlike(_REFERENCE)
        part = lambda i: F.regexp_extract(F.col(side), _REFERENCE, i)       # noqa: E731, B023
        df = df.withColumns({
            "_t": F.when(ref, F.upper(part(1))), "_f": F.when(ref, fact_name(part(2))),
            "_y": F.when(ref, part(3).try_cast("int"))})
        df = df.join(n, ["_t", "_f", "_y"], "left").withColumn(
            f"{side}_value", F.when(ref, F.col("_v")).otherwise(stated_number(F.col(side)))).drop("_t", "_f", "_y", "_v")
    x, y = F.col("a_value"), F.col("b_value")
    o = F.col("operation")
    value = (F.when(o == "add", x + y).when(o == "subtract", x - y).when(o == "multiply", x * y)
             .when(o == "divide", F.try_divide(x, y))
             .when(o == "percent_change", F.try_divide(y - x, F.abs(x)) * 100)
             .when(o == "percent_of", F.try_divide(x, y) * 100))
    zero = (o.isin("divide", "percent_of") & (y == 0)) | ((o == "percent_change") & (x == 0))
    status = (F.when(~o.isin(OPERATIONS), "unsupported").when(x.isNull() | y.isNull(), "bad_input")
              .when(zero, "zero").otherwise("ok"))
    value = F.round(value, 6)
    percent = o.isin("percent_change", "percent_of")
    sign = F.when(o == "add", " + ").when(o == "subtract", " - ").when(o == "multiply", " * ").otherwise(" / ")
    left = F.when(o == "percent_change", F.concat(
        F.lit("("), plain_number(y), F.lit(" - "), plain_number(x), F.lit(") / "), plain_number(F.abs(x)))
    ).otherwise(F.concat(plain_number(x), sign, plain_number(y)))
    formula = F.concat(left, F.when(percent, " * 100").otherwise(""), F.lit(" = "), plain_number(value),
                       F.when(percent, "%").otherwise(""))
    ok = status == "ok"
    return df.withColumns({"value": F.when(ok, value), "status": status,
                           "formula": F.when(ok, formula),
                           "unit": F.when(ok & percent, "percent")})


def price_earnings(eps: DataFrame, bars: DataFrame, requests: DataFrame) -> DataFrame:
    """P/E at a past close: the last close on or before the day over that year's diluted EPS."""
    # As-of by one ordered pass: distinct asked days and bars of a ticker share a window, so the work
    # is their sum, not their product.
    asked = requests.select("ticker", F.col("on_day").alias("day")).distinct().withColumns({
        "_bar": F.lit(None).cast("struct<price_day:date,close:double>"), "_asked": F.lit(True)})
    quoted = bars.select("ticker", "day", F.struct(F.col("day").alias("price_day"), F.col("close").cast("double").alias("close"))
                         .alias("_bar"), F.lit(False).alias("_asked"))
    w = Window.partitionBy("ticker").orderBy("day", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    last = quoted.unionByName(asked).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w))
    last = last.filter(F.col("_asked") & F.col("_bar").isNotNull()).select("ticker", F.col("day").alias("on_day"), "_bar.*")
    e = eps.select("ticker", "fiscal_year", F.col("value").alias("eps"))
    return requests.join(last, ["ticker", "on_day"]).join(e, ["ticker", "fiscal_year"]).withColumn(
        "pe", F.when(F.col("eps") > 0, F.col("close") / F.col("eps")))


def same_fiscal_end(a: DataFrame, b: DataFrame, days: int = 7) -> DataFrame:
    """Fiscal-year ends of two sources that are the same up to a week. Joined on the month the
    end falls in (and its neighbours), so the band is an equi-join."""
    a = a.withColumn("_m", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                 lambda k: F.add_months(F.trunc("end_a", "month"), k))))
    b = b.withColumn("_m", F.trunc("end_b", "month"))
    return a.join(b, ["ticker", "_m"]).filter(F.abs(F.datediff("end_a", "end_b")) <= days).drop("_m")
