"""Facts on hand-written entries; figures, chunks, blocks and admission rules on small texts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from brasstide.operators import answers, facts, filings, retrieval
from brasstide.sources import maintenance
from brasstide.streaming import jobs


def entry(start, end, val, fy, filed, accn, form="10-K"):
    return {"start": start, "end": end, "val": val, "fy": fy, "fp": "FY", "form": form, "filed": filed, "accn": accn}


def test_annual_facts_rules(spark):
    doc = {"cik": "7", "facts": {"us-gaap": {
        "Revenues": {"units": {"USD": [
            entry("2020-01-01", "2020-12-31", 10.0, 2020, "2021-02-01", "a1"),
            entry("2020-01-01", "2020-12-31", 11.0, 2021, "2022-02-01", "a2"),
            entry("2020-01-01", "2020-12-31", 12.0, 2021, "2022-02-01", "a3"),       # same day: accession decides
            entry("2020-10-01", "2020-12-31", 3.0, 2020, "2021-02-01", "a1"),        # a quarter
            entry("2020-01-01", "2020-12-31", 99.0, 2020, "2023-02-01", "q", "10-Q"),
            entry("2021-01-01", "2021-12-31", None, 2021, "2022-02-01", "a2")]}},
        "Assets": {"units": {"USD": [
            {"end": "2020-12-31", "val": 50.0, "fy": 2020, "form": "10-K", "filed": "2021-02-01", "accn": "a1"},
            {"end": "2020-06-30", "val": 40.0, "fy": 2020, "form": "10-K", "filed": "2021-02-01", "accn": "a1"}]}}}}}
    raw = spark.createDataFrame([(json.dumps(doc),)], "json string")
    rows = {(r["concept"], r["fiscal_year"]): r for r in facts.annual_facts(facts.company_entries(raw)).collect()}
    assert rows[("Revenues", 2020)]["value"] == 12.0 and rows[("Revenues", 2020)]["accession"] == "a3"
    assert rows[("Assets", 2020)]["value"] == 50.0 and rows[("Assets", 2020)]["period_start"] is None
    assert len(rows) == 2 and rows[("Assets", 2020)]["cik"] == "0000000007"
    early = facts.annual_facts(facts.company_entries(raw), "2021-12-31").filter("concept = 'Revenues'").collect()
    assert [r["value"] for r in early] == [10.0]


def test_upsert_keeps_another_providers_row(spark):
    old = spark.createDataFrame([("A", 1, 1.0, "x"), ("A", 2, 2.0, "y")], "ticker string, day int, close double, provider string")
    new = spark.createDataFrame([("A", 1, 9.0, "x"), ("A", 2, 9.0, "x"), ("A", 3, 9.0, "x")], old.schema)
    got = {r["day"]: r["close"] for r in maintenance.upsert_same_provider(old, new).collect()}
    assert got == {1: 9.0, 2: 2.0, 3: 9.0}


@pytest.mark.parametrize("text, values", [
    ("Revenue was $215.9 billion in fiscal 2026.", [215.9]),
    ("On March 3, 2024 it paid 1,234 and (5%).", [1234.0, 5.0]),
    ("The 10-K for 2023 shows 46.9%", [46.9]),
    ("FY2025 grew -3.5 percent", [-3.5]),
    ("nothing here", []),
])
def test_figures_in_text(text, values):
    assert [f["value"] for f in answers.find_figures(text)] == values


def test_percent_needs_percent_evidence(spark):
    c = spark.createDataFrame([(1, 0, 5.0, True), (1, 1, 215.9e9, False), (1, 2, 0.0, False), (1, 3, 7.0, False)],
                              "turn int, no int, claim double, percent boolean")
    e = spark.createDataFrame([(1, 5.0, False), (1, 215938.0, False), (1, 0.0, False)], "turn int, value double, percent boolean")
    assert sorted(r["no"] for r in answers.unsupported(c, e, ["turn"]).collect()) == [0, 3]


def _chunks(spark, paragraphs, **sizes):
    df = spark.createDataFrame([(1, "7", "\n\n".join(paragraphs)), (2, "7", None), (3, "7", " \n\n ")], "doc_id bigint, item string, text string")
    return filings.chunk_sections(df, **sizes).orderBy("chunk_index").collect()


def test_packing_respects_the_target(spark):
    random.seed(5)
    paragraphs = [" ".join("word" for _ in range(random.randint(1, 90))) + "." for _ in range(60)] + ["x " * 1300]
    chunks = _chunks(spark, paragraphs, target=120, overlap=20)
    assert {c.doc_id for c in chunks} == {1} and all(c.token_count <= 120 + 20 + 15 for c in chunks)
    assert any(c.hard_split for c in chunks)
    joined = " ".join(c.content for c in chunks)
    assert all(p.split("\n")[0][:40] in joined for p in paragraphs[:-1])


def test_chunk_packing_overlaps_sentences_and_moves_headings(spark):
    text = " ".join(f"Sentence number {i} of Acme Inc. is here." for i in range(60))
    chunks = [c.content for c in _chunks(spark, [text], target=60, overlap=14)]
    assert len(chunks) > 5 and all(b.split(" is here")[0] in a for a, b in zip(chunks, chunks[1:]))
    parts = ["word " * 30 + ".", "A heading", "more " * 40 + "."]
    first, second = _chunks(spark, [p.strip() for p in parts], target=50, overlap=5)
    assert "A heading" not in first.content and second.content.startswith("A heading\n\nmore")


def test_claims_at_band_edges_zeros_and_units(spark):
    import random as r
    r.seed(1)
    pairs = [(n, v * f, v) for n, (v, f) in enumerate((10 ** r.uniform(-3, 9), r.uniform(0.99501, 1.00499)) for _ in range(2000))]
    c = spark.createDataFrame([(n, 0, x, False) for n, x, _ in pairs] + [(-1, 0, 0.0, False)], "turn int, no int, claim double, percent boolean")
    e = spark.createDataFrame([(n, v, False) for n, _, v in pairs] + [(-1, 0.0, False)], "turn int, value double, percent boolean")
    assert answers.unsupported(c, e, ["turn"]).count() == 0
    o = spark.createDataFrame([(1, 0, "0", 0.0), (1, 1, "7", 7.0)], "turn int, no int, raw string, value double")
    z = spark.createDataFrame([(1, 0.0, False)], "turn int, value double, percent boolean")
    assert [x["no"] for x in answers.ungrounded_operands(o, z, ["turn"]).collect()] == [1]
    runs = spark.createDataFrame([("1,234 things", None, "furlongs"), ("1,234 things", None, "USD millions")], "answer string, final_figure string, unit string")
    assert {x.unit: x.figure for x in answers.scored_figures(runs).collect()} == {"furlongs": None, "USD millions": 1234.0}


def test_integers_are_claims_and_values_dedupe(spark):
    t = spark.createDataFrame([(1, "164000 employees and 12 plants"), (2, "25% or $25"), (3, "as in its 2026 Form 10-K"), (4, "FY‑2026 up 7"),
                               (5, "10-K (fiscal 2026) says 【3†L10-L22】 4.5 million")], "id int, text string")
    got = {}
    for r_ in answers.answer_figures(t, "id").collect():
        got.setdefault(r_["id"], []).append(r_["claim"])
    assert got == {1: [164000.0, 12.0], 2: [25.0], 4: [7.0], 5: [4.5e6]}


def test_operands_and_markers_have_no_caps(spark):
    o = spark.createDataFrame([(1, float(x)) for x in range(1000, 1300)], "turn int, value double")
    c = spark.createDataFrame([(1, 0, 2500.0, 0.1)], "turn int, no int, claim double, half_ulp double")
    assert answers.derivable(c, o, ["turn"]).count() == 1 and answers.derivable(c, o, ["turn"], operand_limit=120).count() == 0
    from brasstide.operators import retrieval
    chunks = spark.createDataFrame([(1, "A", "a long marker text of many words, whole"), (2, "B", "a long marker text of many words, whole"), (3, "A", "ab cd")], "chunk_id int, ticker string, content string")
    marks = spark.createDataFrame([(1, "A", "a long marker text of many words, whole"), (2, "A", "b c")], "item_id int, ticker string, marker string")
    got = sorted(map(tuple, retrieval.marker_chunks(marks, chunks, ("ticker",)).collect()))
    assert got == [(1, 1), (2, 3)]


def test_html_blocks(spark):
    page = "<body><p>One &amp; two</p><script>no()</script><table><tr><td>Item 1A.</td><td>7</td></tr></table><div>end</div></body>"
    got = filings.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["text"], r["in_table"]) for r in got] == [("One & two", False), ("Item 1A.", True), ("7", True), ("end", False)]


def test_item_markers_prefer_titles_and_the_last(spark):
    rows = [(1, 0, "Item 7", True), (1, 1, "Item 7. Discussion", False), (1, 2, "Item 7", False), (1, 3, "Item 1A: Risks", False),
            (1, 4, "Item 1A: Risks again", False), (1, 5, "Item 12", False)]
    b = spark.createDataFrame(rows, "doc_id int, pos int, text string, in_table boolean")
    assert {r["item"]: r["pos"] for r in filings.item_markers(b).collect()} == {"7": 1, "1A": 4, "12": 5}


def test_row_kind_carries_down(spark):
    b = spark.createDataFrame([(1, 0, "Net income per share:", []), (1, 1, "Basic", [1.0]), (1, 2, "Weighted average shares used:", []),
                               (1, 3, "Basic", [2.0]), (1, 4, "Other:", []), (1, 5, "Total", [3.0])],
                              "t int, row int, label string, values array<double>")
    got = [r["kind"] for r in filings.row_kinds(b, ["t"]).orderBy("row").collect()]
    assert got == ["heading", "per_share", "heading", "share_count", "heading", "amount"]


def test_admission_matches_a_loop(spark):
    random.seed(2)
    rows = [(k, i, random.uniform(0, 4000)) for k in range(4) for i in range(k * 1000, k * 1000 + (900 if k == 0 else 90))]
    got = {r["request_id"]: r["allowed"] for r in jobs.admissions(
        spark.createDataFrame(rows, "key long, request_id long, t double"), 5, 60.0).collect()}
    for k in range(4):
        log = []
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            log = [x for x in log if x > t - 60.0]
            ok = len(log) < 5
            log += [t] if ok else []
            assert got[i] == ok


def test_fusion_ties_by_first_appearance(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], a.schema)
    assert [r["chunk_id"] for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == ["x", "y", "z"]


def test_last_close_skips_weekends(spark):
    rows = [("2024-01-08 09:00:00", "2024-01-05 10:30:00"), ("2024-01-08 11:00:00", "2024-01-08 10:30:00"),
            ("2024-01-06 12:00:00", "2024-01-05 10:30:00")]
    df = spark.createDataFrame(rows, "now string, want string").withColumns({
        "now": F.to_timestamp("now"), "want": F.to_timestamp("want")})
    assert df.filter(maintenance.last_close(F.col("now"), F.lit(630)) != F.col("want")).count() == 0


def test_sales_by_category_and_sql_functions(spark):
    from brasstide.functions.sql import register
    from brasstide.operators import tables
    rows = [("Net sales:", []), ("Products", [307.0]), ("Services", [109.0]), ("Total net sales", [416.0]), ("Cost of sales:", []),
            ("Services", [26.0])]
    df = spark.createDataFrame([(rows,)], "rows array<struct<label:string,values:array<double>>>")
    got = df.select(tables.by_category("rows").alias("c")).first()["c"]
    assert got == "Net sales by category: Products net sales 307; Services net sales 109."
    register(spark)
    assert spark.sql("SELECT * FROM strike_ladder(101D, 2.5D, 2)").count() == 5
    assert abs(spark.sql("SELECT normal_cdf(0D) AS x").first()["x"] - 0.5) < 1e-12
