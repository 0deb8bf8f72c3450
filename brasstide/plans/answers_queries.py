"""Answer figures, scoring, grounding, news and load-run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import answers, evidence
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import Ctes, r
from brasstide.sources.derived import table

QUERIES, SQL = {}, {}
C = Ctes()


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def _pick(values, index):
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), index)


def line_items(spark, sf):
    """One written answer per line item, its figures known from the row."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = F.concat(F.lit("Revenue was $"), q, F.lit(".5 million in fiscal "), F.year("l_shipdate").cast("string"), F.lit(", up "),
                    n.cast("string"), F.lit("% from the 10-K for 2023. So, net income was approximately $"), q,
                    F.lit(",500 thousand on March 3, 2024."))
    # Order and line number repeat in the table; part and supplier tell the rows apart.
    uid = (F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 10 + n
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey"), uid).alias("case_id"), F.col("l_orderkey").alias("turn"), n.alias("no"), uid.alias("uid"), text.alias("answer"),
        F.when(n == 1, "none").when(n == 2, "$7 billion").alias("final_figure"), F.lit("USD millions").alias("unit"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"))


C.add("li", "SELECT concat(l_orderkey, '-', (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber) AS case_id, (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS uid, l_orderkey AS turn, l_linenumber AS no, l_quantity AS q, l_extendedprice AS price, l_discount AS disc FROM lineitem")


@query("number_candidates", """
  SELECT case_id, 0 AS no, q + 0.5 AS value, 1000000.0 AS scale, false AS percent, true AS money FROM li UNION ALL
  SELECT case_id, 1, no, 1.0, true, false FROM li UNION ALL SELECT case_id, 2, q * 1000 + 500, 1000.0, false, true FROM li""")
def _candidates(spark, sf):
    return answers.number_candidates(line_items(spark, sf), "case_id", "answer").select(
        "case_id", "no", "value", "scale", "percent", "money")


def _scored(spark, sf):
    df = answers.scored_figures(line_items(spark, sf))
    df = df.withColumns({"expected": F.when(F.col("no") == 2, 7000.0).when(F.col("no") == 4, 1.0).otherwise(F.col("q") + 0.5),
                         "tolerance": F.lit(0.01), "error": F.col("no") == 7})
    return answers.verdicts(df)


C.add("scored", """
  SELECT *, CASE no WHEN 1 THEN NULL WHEN 2 THEN 7000.0 ELSE q + 0.5 END AS figure,
    CASE no WHEN 1 THEN 'declined' WHEN 2 THEN 'final_figure' ELSE 'answer' END AS origin,
    CASE WHEN no = 7 THEN 'error' WHEN no = 1 THEN 'no_number' WHEN no = 4 AND q <> 0.5 THEN 'wrong' ELSE 'pass' END AS verdict FROM li""")


@query("scored_figures", "SELECT case_id, figure, origin, verdict FROM scored")
def _scores(spark, sf):
    return _scored(spark, sf).select("case_id", "figure", "origin", "verdict")


@query("evaluation_summary", f"""
  SELECT no, count(*) AS cases, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'wrong') AS wrong,
    count(*) FILTER (verdict = 'no_number') AS no_number, count(*) FILTER (verdict = 'error') AS error,
    {r("avg(CAST(verdict = 'pass' AS INT))", 6, 'accuracy')}, {r('avg(price)', 4, 'mean_latency_ms')} FROM scored GROUP BY GROUPING SETS ((no), ())""")
def _summary(spark, sf):
    rows = _scored(spark, sf).withColumn("latency_ms", F.col("price"))
    return rounded(answers.evaluation_summary(rows, "no"), {"accuracy": 6, "mean_latency_ms": 4})


@query("evaluation_breakdown", f"""
  WITH l AS (SELECT *, 'all' AS grouping, NULL AS label FROM scored UNION ALL SELECT *, 'unit', CAST(no AS VARCHAR) FROM scored
    UNION ALL SELECT *, 'via', 'tool' FROM scored UNION ALL SELECT *, 'via', 'text' FROM scored WHERE q > 25)
  SELECT grouping, label, count(*) AS cases, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'wrong') AS wrong,
    count(*) FILTER (verdict = 'no_number') AS no_number, count(*) FILTER (verdict = 'error') AS error,
    {r("avg(CAST(verdict = 'pass' AS INT))", 6, 'accuracy')}, {r('avg(price)', 4, 'mean_latency_ms')}, {r('avg(no)', 6, 'mean_tool_calls')},
    CAST(sum(no * 10) AS BIGINT) AS sum_tokens FROM l GROUP BY grouping, label""")
def _breakdown(spark, sf):
    ways = F.when(F.col("q") > 25, F.array(F.lit("tool"), F.lit("text"), F.lit("tool"))).otherwise(F.array(F.lit("tool")))
    rows = _scored(spark, sf).withColumns({"latency_ms": F.col("price"), "tool_calls": F.col("no"), "tokens": F.col("no") * 10,
                                           "unit": F.col("no"), "via": ways})
    out = answers.evaluation_breakdown(rows, ["unit", "via[]"], ["latency_ms", "tool_calls"], ["tokens"])
    return rounded(out.withColumn("sum_tokens", F.col("sum_tokens").cast("bigint")), {"accuracy": 6, "mean_latency_ms": 4, "mean_tool_calls": 6})


def _runs(spark, sf):
    lab = table(spark, sf, "labels")
    verdict = lambda c: F.when(F.col(c) == 1, "pass").otherwise("wrong")        # noqa: E731
    base = lab.select(F.col("doc_id").alias("case_id"), verdict("quality").alias("verdict"))
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("n_chars") > 1000, "pass")
                                               .otherwise("no_number").alias("verdict"))
    return base, new


C.add("changes", """
  SELECT case_id, b.v AS before, n.v AS after, CASE WHEN b.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN b.v <> 'pass' AND n.v = 'pass'
    THEN 'fixed' WHEN b.v = 'pass' AND n.v <> 'pass' THEN 'regressed' WHEN b.v <> n.v THEN 'other' ELSE 'same' END AS change
  FROM (SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'wrong' END AS v FROM labels) b
  FULL JOIN (SELECT doc_id AS case_id, CASE WHEN n_chars > 1000 THEN 'pass' ELSE 'no_number' END AS v FROM documents) n USING (case_id)""")


@query("compare_runs", "SELECT * FROM changes")
def _compare(spark, sf):
    return answers.compare_runs(*_runs(spark, sf))


@query("run_direction", """
  SELECT count(*) FILTER (change = 'fixed') AS fixed, count(*) FILTER (change = 'regressed') AS regressed, count(*) FILTER (change = 'added') AS added,
    count(*) FILTER (change = 'removed') AS removed, fixed - regressed AS net,
    CASE WHEN fixed - regressed >= 2 THEN 'better' WHEN fixed - regressed <= -2 THEN 'worse' ELSE 'flat' END AS direction FROM changes""")
def _direction(spark, sf):
    return answers.run_direction(answers.compare_runs(*_runs(spark, sf)))


@query("configuration_difference", """
  SELECT n_nationkey AS key, CAST(n_regionkey AS BIGINT) AS before, n AS after FROM nation
  JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE n_regionkey <> n""")
def _config(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("bigint").alias("value"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return answers.configuration_difference(a, b)


@query("dataset_violations", """
  SELECT l_orderkey AS case_id, 'unknown unit' AS problem FROM lineitem WHERE l_returnflag = 'R' UNION ALL
  SELECT l_orderkey, 'no way to answer' FROM lineitem WHERE l_linestatus = 'F' UNION ALL
  SELECT l_orderkey, 'tolerance' FROM lineitem WHERE l_discount <= 0 UNION ALL
  SELECT l_orderkey, 'duplicate id' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def _violations(spark, sf):
    cases = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("unit"),
        F.when(F.col("l_linestatus") == "F", F.array().cast("array<string>")).otherwise(F.array(F.lit("tool"))).alias("answerable_via"),
        F.col("l_discount").alias("tolerance"))
    return answers.dataset_violations(cases, ["A", "N"])


@query("evidence_values", """
  SELECT event_id, '$.k' AS path, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, false AS percent FROM events WHERE event_type <> 'error'""")
def _evidence(spark, sf):
    steps = table(spark, sf, "events").select("event_id", F.col("props").alias("result"), (F.col("event_type") != "error").alias("ok"))
    return evidence.evidence_values(steps, ["event_id"], ["margin"])


def tool_steps(spark, sf):
    """One successful tool result per line item: nested fields, units beside values, figures in a sentence."""
    li = line_items(spark, sf)
    n, q = F.col("no"), F.col("q").cast("int").cast("string")
    unit = F.when(n % 3 == 0, "percent").when(n % 3 == 1, "pure").otherwise("USD")
    note = F.concat(F.lit("Margin fell to -"), q, F.lit(".5% on revenue of $"), q, F.lit(",500 thousand, Item 7"))
    body = F.struct(
        F.when(n == 2, -F.col("disc")).otherwise(F.col("disc")).alias("value"), unit.alias("unit"), (F.col("q") / 4).alias("change_pct"),
        n.alias("count"), F.array(F.struct((F.col("disc") / 2).alias("share"), F.col("q").alias("adx"))).alias("votes"), note.alias("note"))
    return li.select("turn", "uid", F.when(n % 2 == 0, "ratios").otherwise("facts").alias("tool"), F.lit(True).alias("ok"),
                     F.to_json(body).alias("result"))


def field_units(spark):
    return spark.createDataFrame([("ratios", "$.value", "unit_field"), ("facts", "$.value", "fact"), ("ratios", "$.votes[].adx", "level"),
                                  ("facts", "$.votes[].adx", "level")], "tool string, path string, unit string")


C.add("nums", """
  SELECT turn, uid, no, q, disc, unnest(['$.value', '$.change_pct', '$.count', '$.votes[].share', '$.votes[].adx', '$.note', '$.note']) AS path,
    unnest([CASE no WHEN 2 THEN -disc ELSE disc END, q / 4, no, disc / 2, q, -(q + 0.5), (q * 1000 + 500) * 1000]) AS value,
    unnest([1, 2, 3, 4, 5, 6, 7]) AS place FROM li""")
C.add("pcts", """
  SELECT turn, uid, path, unnest(CASE WHEN p < 0 THEN [p, -p] ELSE [p] END) AS value FROM (
    SELECT turn, uid, path, CASE place WHEN 1 THEN CASE WHEN no % 3 = 0 THEN value WHEN no % 3 = 1 OR no % 2 = 0 THEN value * 100 END
      WHEN 4 THEN value * 100 WHEN 2 THEN value WHEN 6 THEN value END AS p FROM nums) WHERE p IS NOT NULL""")


@query("result_values", f"""
  SELECT DISTINCT uid, turn, path, {r('value', 6, 'value')}, place = 6 AS percent FROM nums UNION
  SELECT uid, turn, '$.note', 7.0, false FROM li""")
def _result_values(spark, sf):
    return rounded(evidence.evidence_values(tool_steps(spark, sf), ["turn", "uid"]), {"value": 6})


@query("percent_evidence", f"SELECT DISTINCT uid, turn, path, {r('value', 6, 'value')} FROM pcts")
def _percent_evidence(spark, sf):
    return rounded(evidence.percent_evidence(tool_steps(spark, sf), ["turn", "uid"], field_units(spark)), {"value": 6})


@query("derivation_operands", f"SELECT DISTINCT uid, turn, path, {r('value', 6, 'value')} FROM nums WHERE place <> 3")
def _derivation_operands(spark, sf):
    return rounded(evidence.derivation_operands(tool_steps(spark, sf), ["turn", "uid"]), {"value": 6})


@query("unsupported_percentages", """
  WITH c AS (SELECT turn, uid AS no, CASE WHEN no % 2 = 0 THEN disc * 100 ELSE q END AS claim FROM li)
  SELECT turn, no, claim FROM c WHERE NOT EXISTS (SELECT 1 FROM pcts p WHERE p.turn = c.turn
    AND CASE WHEN p.value = 0 THEN abs(claim) < 1e-12 ELSE abs(claim - p.value) <= abs(p.value) * 0.005 END)""")
def _unsupported_percentages(spark, sf):
    steps = tool_steps(spark, sf)
    claims = line_items(spark, sf).select("turn", F.col("uid").alias("no"), F.when(F.col("no") % 2 == 0, F.col("disc") * 100).otherwise(
        F.col("q")).alias("claim"), F.lit(True).alias("percent"))
    found = answers.unsupported(claims, evidence.evidence_values(steps, ["turn"]), ["turn"],
                                evidence.percent_evidence(steps, ["turn"], field_units(spark)))
    return found.select("turn", "no", "claim")


def _claims(spark, sf):
    li = line_items(spark, sf)
    claims = li.select("turn", F.col("uid").alias("no"), F.col("q").alias("claim"), (F.col("no") == 7).alias("percent"), F.lit(0.0).alias("half_ulp"))
    evidence = li.select("turn", (F.col("price") / 1000).alias("value"), (F.col("no") == 6).alias("percent"))
    return claims, evidence


C.add("ev", "SELECT turn, price / 1000 AS v, no = 6 AS p FROM li")


@query("unsupported_figures", """
  SELECT turn, uid AS no, q AS claim FROM li WHERE NOT EXISTS (SELECT 1 FROM ev, (SELECT unnest([1.0, 100.0, 0.01, 1e-3, 1e3, 1e-6, 1e6, 1e-9, 1e9]) AS f) k
    WHERE ev.turn = li.turn AND abs(q * f - v) <= abs(v) * 0.005 AND (li.no <> 7 OR (p AND f = 1.0)))""")
def _unsupported(spark, sf):
    claims, evidence = _claims(spark, sf)
    return answers.unsupported(claims, evidence, ["turn"]).select("turn", "no", "claim")


@query("derivable_figures", """
  WITH o AS (SELECT DISTINCT turn, q AS v FROM li), p AS (SELECT a.turn, a.v AS x, b.v AS y FROM o a JOIN o b ON a.turn = b.turn AND a.v < b.v
      WHERE NOT (abs(a.v - b.v) <= b.v * 0.005 OR abs(a.v * 100 - b.v) <= b.v * 0.005 OR abs(a.v * 0.01 - b.v) <= b.v * 0.005)),
  s AS (SELECT turn, unnest([x * y, x + y, x - y, y - x, x / y, y / x]) AS z FROM p),
  c AS (SELECT turn, uid AS no, floor(price / 1000) AS claim FROM li)
  SELECT turn, no, claim FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.turn = c.turn AND (abs(claim - z) <= 0.05 + abs(claim) * 1e-9
    OR abs(claim - z * 100) <= 0.05 + abs(claim) * 1e-9 OR abs(claim - z * 0.01) <= 0.05 + abs(claim) * 1e-9))""")
def _derivable(spark, sf):
    li = line_items(spark, sf)
    claims = li.select("turn", F.col("uid").alias("no"), F.floor(F.col("price") / 1000).cast("double").alias("claim"), F.lit(0.05).alias("half_ulp"))
    return answers.derivable(claims, li.select("turn", F.col("q").alias("value")), ["turn"]).select("turn", "no", "claim")


def _stated(spark, sf):
    """Answers of an order that state some prices in thousands to one decimal, and quantities."""
    li = line_items(spark, sf)
    odd = F.col("no") % 2 == 1
    claims = li.select("turn", F.col("uid").alias("no"), F.when(odd, F.round(F.col("price") / 1000, 1)).otherwise(F.col("q")).alias("claim"),
                       F.when(odd, 0.05).otherwise(0.5).alias("half_ulp"))
    return claims, li.select("turn", (F.col("price") / 1000).alias("value"))


C.add("stated", """
  SELECT turn, uid AS no, CASE WHEN no % 2 = 1 THEN round(price / 1000, 1) ELSE q END AS claim, CASE WHEN no % 2 = 1 THEN 0.05 ELSE 0.5 END::DOUBLE AS h FROM li""")
C.add("shown", """
  SELECT s.turn, s.no, min_by(claim / f, place) AS shown FROM stated s JOIN li o ON o.turn = s.turn,
    (VALUES (0, 1.0::DOUBLE), (1, 100.0::DOUBLE), (2, 0.01::DOUBLE)) k(place, f)
  WHERE abs(claim - o.price / 1000 * f) <= h + abs(claim) * 1e-9::DOUBLE GROUP BY s.turn, s.no""")


@query("shown_roundings", f"SELECT turn, no, {r('shown', 6, 'shown')} FROM shown")
def _shown(spark, sf):
    return rounded(answers.shown_roundings(*_stated(spark, sf), ["turn"]), {"shown": 6})


@query("stated_derivations", """
  WITH p AS (SELECT c.turn, c.no, c.claim, c.h, a.shown AS x, b.shown AS y FROM stated c JOIN shown a ON a.turn = c.turn AND a.no <> c.no
      JOIN shown b ON b.turn = c.turn AND b.no <> c.no AND a.shown < b.shown
    WHERE NOT (abs(a.shown - b.shown) <= b.shown * 0.005 OR abs(a.shown * 100 - b.shown) <= b.shown * 0.005 OR abs(a.shown * 0.01 - b.shown) <= b.shown * 0.005)),
  s AS (SELECT turn, no, claim, h, unnest([x * y, x + y, x - y, y - x, x / y, y / x]) AS z FROM p)
  SELECT DISTINCT turn, no, claim FROM s WHERE abs(claim - z) <= h + abs(claim) * 1e-9 OR abs(claim - z * 100) <= h + abs(claim) * 1e-9
    OR abs(claim - z * 0.01) <= h + abs(claim) * 1e-9""")
def _stated_derivations(spark, sf):
    return answers.stated_derivations(*_stated(spark, sf), ["turn"]).select("turn", "no", "claim")


@query("ungrounded_operands", """
  SELECT turn, uid AS no FROM li WHERE NOT EXISTS (SELECT 1 FROM ev, (SELECT unnest([1.0, 100.0, 0.01, 1e-3, 1e3, 1e-6, 1e6, 1e-9, 1e9]) AS f) k
    WHERE ev.turn = li.turn AND abs(round(q * 1.1111, 2) - v * f) <= 0.005 + abs(round(q * 1.1111, 2)) * 1e-9)""")
def _ungrounded(spark, sf):
    li = line_items(spark, sf)
    v = F.round(F.col("q") * 1.1111, 2)
    ops = li.select("turn", F.col("uid").alias("no"), F.format_string("%.2f", v).alias("raw"), v.alias("value"))
    _, evidence = _claims(spark, sf)
    return answers.ungrounded_operands(ops, evidence, ["turn"]).select("turn", "no")


@query("answer_figures", """
  WITH f AS (SELECT case_id, q, no, [q * 1e6 + 5e5, no, q * 1e6 + 5e5] AS c FROM li)
  SELECT case_id, 0 AS no, q * 1e6 + 5e5 AS claim, 5e4 AS half_ulp, false AS percent FROM f UNION ALL
  SELECT case_id, 1, no, 0.5, true FROM f""")
def _answer_figures(spark, sf):
    f = answers.answer_figures(line_items(spark, sf), "case_id", "answer")
    return f.select("case_id", "no", "claim", "half_ulp", "percent")


def _judged(spark, sf):
    li = line_items(spark, sf)
    claims = li.select("turn", F.col("uid").alias("no"), F.col("q").alias("claim"), (F.col("disc") > 0.05).alias("literal"))
    rulings = li.select("turn", F.col("uid").alias("ruling_no"), F.col("q").alias("value"), (F.col("price") > 30000).alias("supported"))
    return answers.judge_claims(claims, rulings, ["turn"])


C.add("judged", """
  SELECT c.turn, c.uid AS no, any_value(c.q) AS claim, any_value(c.disc > 0.05) AS literal, min_by(r.price > 30000, r.uid) FILTER (abs(c.q - r.q) <= c.q * 0.002) AS ruling
  FROM li c JOIN li r ON r.turn = c.turn GROUP BY c.turn, c.uid""")


@query("judge_claims", "SELECT turn, no, claim, literal, ruling, NOT literal AND NOT ruling AS flagged FROM judged")
def _judge(spark, sf):
    return _judged(spark, sf).select("turn", "no", "claim", "literal", "ruling", "flagged")


@query("groundedness", f"""
  WITH p AS (SELECT turn, count(*) AS n, count(*) FILTER (literal) AS l, max(CAST(NOT literal AND NOT ruling AS INT)) AS f, count(*) FILTER (literal <> ruling) AS d FROM judged GROUP BY turn)
  SELECT count(*) AS answers, CAST(sum(n) AS BIGINT) AS claims, {r('sum(l) / sum(n)', 6, 'literal_share')}, count(*) FILTER (f = 1) AS flagged_answers,
    CAST(sum(d) AS BIGINT) AS disagreements FROM p""")
def _grounded(spark, sf):
    return rounded(answers.groundedness(_judged(spark, sf), ["turn"]), {"literal_share": 6})


@query("defang", "SELECT doc_id, md5(concat('&lt;Tool_Result x>', text, '&lt;/ tool_result>')) AS text_md5 FROM documents")
def _defang(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("<Tool_Result x>"), "text", F.lit("</ tool_result>"))
    return d.select("doc_id", F.md5(answers.defang(text)).alias("text_md5"))


_SAID = ["You should buy this stock now.", "According to Reuters, investors should buy.", "I cannot recommend that you buy now.",
         "We suggest holding.", "Revenue rose on strong demand.", "This is a strong buy for everyone.", "Margins were flat."]


@query("advice_spans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 4, 6)")
def _advice(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _pick(_SAID, F.col("l_linenumber")).alias("sentence"))
    return answers.advice_spans(s).select("l_orderkey", "l_linenumber")


_OPEN = ["## Summary\nFine.\n**Risks** many\nThis is not investment advice.", "Summary: ok\n- **Risks**: x\n{\"ok\": 1}. Not investment advice",
         "# Summary\nRisks\n", "Nothing at all", "### Summary\nRisks here. [Unverified] not investment advice"]


@query("open_ended_checks", "SELECT o_orderkey, o_custkey % 5 <> 3 AS sections, o_custkey % 5 = 0 AS passed FROM orders")
def _open(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", _pick(_OPEN, (F.col("o_custkey") % 5 + 1).cast("int")).alias("answer"))
    return answers.open_ended_checks(rows, ["Summary", "Risks"]).select("o_orderkey", "sections", "passed")


_ASKED = ["Latest news on Nvidia", "Nvidia share price", "What was Nvidia revenue in FY24?", "Nvidia net income", "Should I buy Nvidia?",
          "Nvidia price on 2024-01-02", "Nvidia EPS in 2023"]


@query("route_questions", """
  SELECT l_orderkey, l_linenumber, ['search_news', 'get_stock_price', 'get_financial_fact', 'get_financial_fact', NULL, NULL, NULL][l_linenumber] AS tool,
    [NULL, NULL, 'revenue', 'net_income', NULL, NULL, NULL][l_linenumber] AS fact, [NULL, NULL, '2024', 'latest', NULL, NULL, NULL][l_linenumber] AS fiscal_year FROM lineitem""")
def _route(spark, sf):
    q = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _pick(_ASKED, F.col("l_linenumber")).alias("text"))
    return answers.route(q).select("l_orderkey", "l_linenumber", "tool", "fact", "fiscal_year")


@query("companies_named", """
  WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), g AS (SELECT min(p_name) AS whole FROM part),
  a AS (SELECT whole AS alias, 'T1' AS ticker FROM g UNION ALL SELECT string_split(whole, ' ')[1], 'T2' FROM g)
  SELECT p_partkey, CASE WHEN array_to_string(w, ' ') = (SELECT whole FROM g) THEN 'T1' ELSE 'T2' END AS ticker FROM w
  WHERE list_contains(w, (SELECT alias FROM a WHERE ticker = 'T2'))""")
def _companies(spark, sf):
    p = table(spark, sf, "part")
    whole = p.agg(F.min("p_name").alias("whole"))
    companies = whole.select(F.explode(F.array(
        F.struct(F.lit("T1").alias("ticker"), F.col("whole").alias("alias")),
        F.struct(F.lit("T2").alias("ticker"), F.element_at(F.split("whole", " "), 1).alias("alias")))).alias("c")).select("c.*")
    return answers.companies_named(p.withColumnRenamed("p_name", "text"), companies, "p_partkey")


_NEWS_SQL = """SELECT p_partkey AS item_id, string_split(p_name, ' ')[1] AS query, p_name AS title, concat(p_type, ' ', CASE WHEN p_size % 3 = 0 THEN 'earnings' ELSE '' END) AS snippet,
    CASE WHEN p_size % 2 = 0 THEN 'Reuters' ELSE p_brand END AS source, CASE WHEN p_size = 7 THEN NULL ELSE DATE '2024-01-01' + p_size END AS published FROM part"""


@query("rank_news", f"""
  WITH n AS ({_NEWS_SQL}), s AS (SELECT *, CASE WHEN source = 'Reuters' THEN 2 ELSE 0 END + CASE WHEN snippet LIKE '%earnings' THEN 1 ELSE 0 END AS score
    FROM n WHERE published IS NULL OR published >= DATE '2024-01-11'),
  d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, title ORDER BY score DESC, published DESC NULLS LAST, item_id) = 1)
  SELECT query, item_id, score, row_number() OVER w AS rank FROM d WINDOW w AS (PARTITION BY query ORDER BY score DESC, published DESC NULLS LAST, title, item_id)
  QUALIFY row_number() OVER w <= 25""")
def _news(spark, sf):
    p = table(spark, sf, "part")
    items = p.select(
        F.col("p_partkey").alias("item_id"), F.element_at(F.split("p_name", " "), 1).alias("query"), F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(" "), F.when(F.col("p_size") % 3 == 0, "earnings").otherwise("")).alias("snippet"),
        F.when(F.col("p_size") % 2 == 0, "Reuters").otherwise(F.col("p_brand")).alias("source"),
        F.when(F.col("p_size") != 7, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))).alias("published"))
    return answers.rank_news(items, F.lit("2024-01-11").cast("date")).select("query", "item_id", "score", "rank")


@query("clean_news", """
  SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN 'Daily Brief' ELSE p_brand END AS source, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS snippet FROM part""")
def _clean(spark, sf):
    items = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" - "), F.when(F.col("p_size") > 25, "Daily Brief").otherwise(
            F.regexp_replace("p_brand", "[^A-Za-z0-9]", " "))).alias("title"),
        F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("source"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b> and more"))).otherwise(
            F.concat(F.lit("<p>"), "p_type", F.lit("</p>"))).alias("snippet"))
    return answers.clean_news(items)


C.add("load", "SELECT hour(ts) AS level, event_type AS outcome, event_type <> 'error' AS ok, epoch(ts) AS started, epoch(ts) + value AS ended, value FROM events")


def _load(spark, sf):
    e = table(spark, sf, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.hour("ts").alias("level"), F.col("event_type").alias("outcome"), (F.col("event_type") != "error").alias("ok"),
                    s.alias("started"), (s + F.col("value")).alias("ended"), "value")


@query("load_sweep", f"""
  WITH s AS (SELECT level, count(*) AS requests, count(*) FILTER (NOT ok) AS failures, max(ended) - min(started) AS wall FROM load GROUP BY level),
  p AS (SELECT *, requests - failures AS delivered, (requests - failures) * 60.0 / wall AS pm FROM s)
  SELECT level, requests, failures, delivered, {r('pm', 6, 'per_minute')}, {r('pm / (SELECT min_by(pm, level) FROM p)', 6, 'scaling')} FROM p""")
def _sweep(spark, sf):
    return rounded(answers.sweep_summary(_load(spark, sf)).drop("wall"), {"per_minute": 6, "scaling": 6})


@query("outcomes_by_level", "SELECT level, " + ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("click", "view", "error"))
       + " FROM load GROUP BY level")
def _outcomes(spark, sf):
    return answers.outcomes_by_level(_load(spark, sf), ["click", "view", "error"])


@query("token_throughput", f"""
  SELECT level, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, {r('sum(value) FILTER (ok) / (max(ended) - min(started))', 7, 'tokens_per_second')},
    {r('avg(value / 4) FILTER (ok)', 4, 'time_to_first_token')} FROM load GROUP BY level""")
def _throughput(spark, sf):
    s = _load(spark, sf).withColumns({"tokens": F.col("value"), "first_token": F.col("started") + F.col("value") / 4})
    return rounded(answers.token_throughput(s).drop("stream_rate"), {"tokens_per_second": 7, "time_to_first_token": 4})


@query("ground_truth_drift", "SELECT o_orderkey AS case_id FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n <> 4")
def _truth(spark, sf):
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(4.0).alias("expected"))
    rebuilt = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count(F.lit(1)).cast("double").alias("rebuilt"))
    return answers.ground_truth_drift(stored, rebuilt).select("case_id")
