"""What surrounds and describes a financial table: periods, notes above it, caption, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.operators.filings import normalised

# How far up a note may be, and what row labels are called in questions.
LOOK_BACK, NEAR_LINE, HEADER_ROWS, PERIOD_CHARS = 8, 120, 8, 30
SYNONYMS = [
    (["revenue", "net sales", "total net sales", "sales"], "total revenue, net sales, turnover, the top line"),
    (["cost of revenue", "cost of sales", "cost of goods"], "cost of revenue, cost of sales, cost of goods sold, COGS"),
    (["gross profit", "gross margin"], "gross profit, gross margin, gross profitability"),
    (["operating income", "income from operations", "operating expenses"],
     "operating income, operating profit, income from operations, operating margin"),
    (["net income", "net earnings", "net profit"], "net income, net profit, earnings, the bottom line, profit after tax"),
    (["per share"], "earnings per share, EPS, basic and diluted EPS"),
    (["shares"], "share count, weighted average shares outstanding"),
    (["income tax", "provision for income"], "income tax expense, provision for income taxes, effective tax rate"),
    (["research and development"], "research and development, R&D spending"),
]
HEADLINES = ["revenue", "net sales", "total net sales", "gross profit", "gross margin", "operating income", "net income"]
SALES_HEADINGS = ["net sales", "revenue", "revenues", "net revenue", "net revenues"]


def table_periods(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column headers of each table: the first of its opening rows with two dated cells."""
    text = normalised(F.col("text"))
    dated = cells.filter((F.col("row") < HEADER_ROWS) & (F.length(text) <= PERIOD_CHARS) & text.rlike(r"(19|20)\d{2}"))
    rows = dated.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))),
                                                       lambda x: x["t"]).alias("periods")).filter(F.size("periods") >= 2)
    return rows.groupBy(*keys).agg(F.min_by("periods", "row").alias("periods"))


def without_header_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Drops leading rows that only repeat the periods; headings further down stay. Needs row,
    label, values, periods."""
    low = F.lower("label")
    header = (F.size("values") == 0) & (F.exists("periods", lambda p: F.lower(p) == low) | F.contains(low, F.lit("ended"))
                                        | low.rlike(r"(19|20)\d{2}"))
    body = F.min(F.when(~header, F.col("row"))).over(Window.partitionBy(*keys))
    return rows.withColumn("_b", body).filter(F.col("row") >= F.col("_b")).drop("_b")


def notes_above(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """For each block: the nearest units note and caption in the few blocks above it, and all the
    short lines there (what a disqualifying word is looked for in)."""
    text = normalised(F.col("text"))
    short = F.when((F.length(text) > 0) & (F.length(text) <= NEAR_LINE), text)
    units = F.regexp_extract(short, r"(?i)\(?\s*(in\s+(?:thousands|millions|billions)[^)]*)\)?", 1)
    title = F.when(short.rlike(r"(?i)consolidated statements?\s+of\s+(income|operations|earnings)"), short)
    df = blocks.withColumns({"_s": short, "_u": F.when(units != "", F.trim(units)), "_t": title})
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(-LOOK_BACK, -1)
    return df.withColumns({
        "units": F.coalesce(F.last("_u", ignorenulls=True).over(w), F.lit("")),
        "caption": F.coalesce(F.last("_t", ignorenulls=True).over(w), F.last("_s", ignorenulls=True).over(w), F.lit("")),
        "context": F.array_join(F.reverse(F.collect_list("_s").over(w)), " ")}).drop("_s", "_u", "_t")


def _figure(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 0), F.lit("n/a"))


def captions(statements: DataFrame, who: Column, period: Column) -> DataFrame:
    """A sentence introducing each statement, from its own labels. `statements` has title, units,
    periods and rows: ARRAY<STRUCT<label, values>> (a statement's rows are a few dozen)."""
    labels = F.lower(F.array_join(F.transform("rows", lambda x: x["label"]), " "))
    present = F.array_compact(F.array(*[F.when(
        F.exists(F.array(*map(F.lit, words)), lambda t: F.contains(F.col("_labels"), t)), F.lit(phrase))
        for words, phrase in SYNONYMS]))
    top = F.slice(F.transform(F.filter("rows", lambda x: F.lower(F.regexp_replace(x["label"], ":", "")).isin(HEADLINES)
                                       & (F.try_element_at(x["values"], F.lit(1)).isNotNull())),
                              lambda x: F.concat(x["label"], F.lit(" "), _figure(F.element_at(x["values"], 1)))), 1, 5)
    df = statements.withColumns({"_labels": labels, "_cat": by_category("rows")})
    df = df.withColumns({"_present": present, "_top": top})
    parts = F.concat_ws(
        " ", F.concat("title", F.lit(" for "), who, F.lit(", "), period, F.lit(".")),
        F.when(F.size("periods") > 0, F.concat(F.lit("Annual financial results for the periods ending "),
                                               F.array_join("periods", ", "), F.lit("."))),
        F.when(F.size("_present") > 0, F.concat(F.lit("Line items include "), F.array_join("_present", "; "), F.lit("."))),
        F.when(F.size("_top") > 0, F.concat(F.lit("Most recent period: "), F.array_join("_top", "; "), F.lit(" ("),
                                            F.when(F.col("units") != "", F.col("units")).otherwise("as reported"), F.lit(").")))
        , F.col("_cat"))
    return df.withColumn("caption", parts).drop("_labels", "_present", "_top", "_cat")


def by_category(rows: str) -> Column:
    """Sales by category spelled out, when a sales heading is followed by at least two members
    before a total. Folded over the statement's own few rows."""
    start = F.struct(F.lit("").alias("heading"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("members"))

    def step(acc, x):
        label = F.trim(F.regexp_replace(x["label"], ":", ""))
        empty = F.size(x["values"]) == 0
        stop = acc["done"] | (empty & (F.size(acc["members"]) > 0)) | (
            ~empty & (acc["heading"] != "") & F.lower(label).startswith("total"))
        heading = F.when(stop | ~empty, acc["heading"]).when(F.lower(label).isin(SALES_HEADINGS), label).otherwise("")
        name = F.concat(F.lower(F.substring(acc["heading"], 1, 1)), F.substr(acc["heading"], F.lit(2)))
        line = F.concat(label, F.lit(" "), name, F.lit(" "), F.array_join(F.transform(x["values"], _figure), ", "))
        members = F.when(~stop & ~empty & (acc["heading"] != ""), F.concat(acc["members"], F.array(line))).otherwise(acc["members"])
        return F.struct(heading.alias("heading"), stop.alias("done"), members.alias("members"))

    return F.aggregate(rows, start, step, lambda a: F.when(
        (a["heading"] != "") & (F.size(a["members"]) >= 2),
        F.concat(a["heading"], F.lit(" by category: "), F.array_join(a["members"], "; "), F.lit("."))))


def rendered(rows: str, width: int = 48, cell: int = 16) -> Column:
    """The statement as a text grid: labels left, figures right. Never split."""
    return F.array_join(F.transform(rows, lambda x: F.concat(
        F.rpad(x["label"], width, " "), F.array_join(F.transform(x["values"], lambda v: F.lpad(_figure(v), cell, " ")), ""))), "\n")


def table_chunks(statements: DataFrame, who: Column, period: Column, accession: str = "accession") -> DataFrame:
    """One chunk per statement: caption, blank line, grid; the parsed rows travel along."""
    df = captions(statements, who, period)
    return df.select(F.concat_ws(":", accession, F.lit("income_statement"), F.lit("0")).alias("chunk_id"),
                     F.concat("caption", F.lit("\n\n"), rendered("rows")).alias("content"),
                     F.lit("table").alias("content_type"), F.col("rows").alias("structured"))
