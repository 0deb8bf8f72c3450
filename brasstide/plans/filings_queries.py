"""Filing text jobs over the supplied documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import filings, tables
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import Ctes, r
from brasstide.sources import maintenance
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


# Lines of the documents as blocks; item headings, a contents table and page numbers in between.
_HEADING = ("CASE WHEN pos % 9 = 0 THEN 'Item 1A. Risk Factors' WHEN pos % 9 = 4 THEN 'ITEM 7' "
            "WHEN pos % 18 = 7 THEN 'Item 8: Statements' WHEN pos % 9 = 2 THEN CAST(pos AS VARCHAR) ELSE line END")
C.add("lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents")
C.add("blocks", f"SELECT doc_id, pos, pos < 3 AS in_table, trim(regexp_replace({_HEADING}, '\\s+', ' ', 'g')) AS text FROM lines")


def blocks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    p = F.col("pos")
    text = (F.when(p % 9 == 0, "Item 1A. Risk Factors").when(p % 9 == 4, "ITEM 7").when(p % 18 == 7, "Item 8: Statements")
            .when(p % 9 == 2, p.cast("string")).otherwise(F.col("line")))
    return d.select("doc_id", "pos", text.alias("text"), (p < 3).alias("in_table"))


@query("html_blocks")
def _html(spark, sf):
    return filings.html_blocks(table(spark, sf, "pages"))


@query("html_block_counts")
def _html_counts(spark, sf):
    b = filings.html_blocks(table(spark, sf, "pages"))
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


C.add("marks", """
  SELECT doc_id, item, coalesce(max(pos) FILTER (NOT bare), max(pos)) AS pos FROM (
    SELECT doc_id, pos, CASE text WHEN 'Item 1A. Risk Factors' THEN '1A' WHEN 'ITEM 7' THEN '7' ELSE '8' END AS item, text = 'ITEM 7' AS bare
    FROM blocks WHERE NOT in_table AND text IN ('Item 1A. Risk Factors', 'ITEM 7', 'Item 8: Statements')) GROUP BY doc_id, item""")


@query("item_markers", "SELECT doc_id, item, pos FROM marks")
def _markers(spark, sf):
    return filings.item_markers(blocks(spark, sf))


C.add("furniture", """
  SELECT doc_id, text, count(*) AS times FROM blocks WHERE length(text) BETWEEN 1 AND 80 GROUP BY doc_id, text HAVING count(*) >= 5""")


@query("boilerplate", "SELECT doc_id, text, times FROM furniture")
def _boilerplate(spark, sf):
    return filings.boilerplate(blocks(spark, sf))


C.add("placed", """
  SELECT b.doc_id, b.pos, b.text, m.item IS NOT NULL AS mark, last_value(m.item IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM blocks b LEFT JOIN marks m ON m.doc_id = b.doc_id AND m.pos = b.pos""")
C.add("kept", """
  SELECT p.doc_id, item, pos, p.text FROM placed p LEFT JOIN furniture f ON f.doc_id = p.doc_id AND f.text = p.text
  WHERE item IS NOT NULL AND NOT mark AND length(p.text) > 0 AND f.text IS NULL
    AND NOT (length(p.text) <= 80 AND (regexp_full_match(p.text, '\\d{1,4}') OR regexp_full_match(p.text, '.{0,60}\\|\\s*\\d{1,4}\\s*')))""")


@query("section_paragraphs", """
  SELECT doc_id, item, count(*) FILTER (fresh) AS paragraphs, sum(length(text)) + count(*) - count(*) FILTER (fresh) AS chars FROM (
    SELECT *, NOT coalesce(NOT regexp_matches(lag(text) OVER w, '[.!?:;”"'')\\]]$') AND lower(substr(text, 1, 1)) = substr(text, 1, 1)
      AND upper(substr(text, 1, 1)) <> substr(text, 1, 1), false) AS fresh FROM kept WINDOW w AS (PARTITION BY doc_id, item ORDER BY pos))
  GROUP BY doc_id, item""")
def _sections(spark, sf):
    p = filings.section_paragraphs(blocks(spark, sf))
    return p.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("table_cells", """
  SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN CAST(l_extendedprice AS INT) WHEN 2 THEN -(l_quantity + 0.25) WHEN 3 THEN NULL
    WHEN 4 THEN l_quantity WHEN 5 THEN NULL ELSE -l_quantity END + 0.0 AS value FROM lineitem""")
def _cells(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    price = F.format_number(F.rint("l_extendedprice"), 0)
    cell = (F.when(n == 1, F.concat(F.lit("$ "), price)).when(n == 2, F.concat(F.lit("("), q, F.lit(".25)")))
            .when(n == 3, "—").when(n == 4, F.concat(q, F.lit("%"))).when(n == 5, "Total assets")
            .otherwise(F.concat(F.lit("-"), q)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", filings.cell_number(cell).alias("value"))


@query("units_scale", """
  SELECT o_orderkey, [1000000, 1000000, 1000, 1, 1000000000][k + 1] AS amount_scale, [1000, 1000000, 1000, 1, 1000000][k + 1] AS share_scale
  FROM (SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS k FROM orders)""")
def _units(spark, sf):
    notes = ["In millions, except number of shares, which are reflected in thousands, and per-share amounts",
             "In millions, except per share data", "(in thousands)", "", "Dollars in billions; shares in millions"]
    note = F.element_at(F.array(*map(F.lit, notes)), (F.col("o_custkey") % 5 + 1).cast("int"))
    s = filings.units_scale(note)
    return table(spark, sf, "orders").select("o_orderkey", *[e.alias(n) for n, e in s.items()])


_LABELS = ["Total revenue", "Cost of revenue", "Gross profit", "Operating income", "Net income", "Basic", "Net income per share:"]


def statement(spark, sf):
    n = F.col("l_linenumber")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), n)
    values = F.when(n == 7, F.array().cast("array<double>")).otherwise(F.array("l_quantity", "l_extendedprice"))
    li = table(spark, sf, "lineitem").select("l_orderkey", n.alias("row"), label.alias("label"), values.alias("values"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"),
                                          F.col("o_orderkey").alias("pos"), F.when(
        F.col("o_orderpriority") == "1-URGENT", "Segment Information").otherwise("").alias("context"))
    return li.join(o, "l_orderkey")


@query("income_statement_choice", """
  WITH x AS (SELECT o_custkey AS doc_id, l_orderkey, count(*) AS n_rows, 2 * count(*) FILTER (l_linenumber <> 7) AS numbers,
      any_value(o_orderpriority) = '1-URGENT' AS bad, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (3, 4)) +
      max(CASE WHEN l_linenumber IN (1, 2) THEN 1 ELSE 0 END) + max(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) +
      max(CASE WHEN l_linenumber IN (5, 7) THEN 1 ELSE 0 END) AS s
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
  SELECT doc_id, l_orderkey, n_rows, numbers, s AS score FROM x WHERE n_rows >= 4 AND NOT bad AND s >= 4 AND numbers >= 6
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, l_orderkey) = 1""")
def _choice(spark, sf):
    out = filings.income_statements(statement(spark, sf), ["l_orderkey"], "doc_id")
    return out.select("doc_id", "l_orderkey", "n_rows", "numbers", "score")


@query("row_kinds", "SELECT l_orderkey, l_linenumber AS row, CASE WHEN l_linenumber = 7 THEN 'heading' ELSE 'amount' END AS kind FROM lineitem")
def _kinds(spark, sf):
    return filings.row_kinds(statement(spark, sf), ["l_orderkey"]).select("l_orderkey", "row", "kind")


C.add("pieces", """
  SELECT doc_id, unnest(string_split(m, chr(1))) AS piece, unnest(range(0, len(string_split(m, chr(1))))) AS i FROM (
    SELECT doc_id, regexp_replace(text, '([.!?;])\\s+(["“''(A-Z])', '\\1' || chr(1) || '\\2', 'g') AS m FROM documents)""")
_ABBR = "(" + ", ".join(f"'{a}'" for a in filings.ABBREVIATIONS) + ")"


@query("sentences", f"""
  WITH f AS (SELECT doc_id, i, piece, CAST(NOT coalesce(regexp_replace(lower(regexp_extract(trim(lag(piece) OVER w), '(\\S+)$', 1)), '\\.+$', '') IN {_ABBR}
      OR (lower(substr(piece, 1, 1)) = substr(piece, 1, 1) AND upper(substr(piece, 1, 1)) <> substr(piece, 1, 1) AND i > 0), false) AS INT) AS fresh
    FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  n AS (SELECT doc_id, i, piece, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM f)
  SELECT doc_id, md5(trim(string_agg(piece, ' ' ORDER BY i))) AS sentence_md5 FROM n GROUP BY doc_id, s HAVING trim(string_agg(piece, ' ' ORDER BY i)) <> ''""")
def _sentences(spark, sf):
    return filings.sentences(table(spark, sf, "documents"), "doc_id").select("doc_id", F.md5("sentence").alias("sentence_md5"))


@query("chunk_sections")
def _chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("7").alias("item"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return filings.chunk_sections(d).select("doc_id", "chunk_id", "token_count", "hard_split", F.length("content").alias("chars"))


@query("chunk_numbers", """
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, concat('FY', 2020 + doc_id % 3) AS fiscal_period FROM kept""")
def _numbers(spark, sf):
    kept = filings.section_blocks(blocks(spark, sf))
    end = F.make_date(2020 + F.col("doc_id") % 3, F.lit(12), F.lit(31))
    return filings.number_chunks(kept, "doc_id", ["pos"], end).select("doc_id", "pos", "chunk_index", "fiscal_period")


@query("token_windows", """
  SELECT doc_id, len(t) AS tokens, k AS window_no, md5(array_to_string(t[k * 446 + 1:k * 446 + 510], ' ')) AS window_md5 FROM (
    SELECT doc_id, t, unnest(range(CASE WHEN len(t) <= 510 THEN 1 ELSE 1 + (len(t) - 64 - 1) // 446 END)) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])') AS t FROM documents))""")
def _windows(spark, sf):
    w = filings.token_windows(table(spark, sf, "documents"), "doc_id")
    return w.select("doc_id", "tokens", "window_no", F.md5("window").alias("window_md5"))


@query("embedding_input_lengths", """
  SELECT source, count(*) AS texts, count(*) FILTER (n > 510) AS windowed, max(n) AS longest, round(count(*) FILTER (n > 510) / count(*), 6) AS rate
  FROM (SELECT source, len(regexp_extract_all(text, '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])')) AS n FROM documents) GROUP BY source""")
def _lengths(spark, sf):
    n = F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1))
    d = table(spark, sf, "documents").select("source", n.alias("n"))
    over = F.count_if(F.col("n") > 510)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), over.alias("windowed"), F.max("n").alias("longest"),
                                   F.round(over / F.count(F.lit(1)), 6).alias("rate"))


@query("mean_pool", f"""
  WITH d AS (SELECT label, unnest(range(0, 64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  m AS (SELECT label, d, avg(x) AS m FROM d GROUP BY label, d)
  SELECT label, d, {r('m / sqrt(sum(m * m) OVER (PARTITION BY label))', 7, 'x')} FROM m""")
def _pool(spark, sf):
    return rounded(filings.mean_pool(table(spark, sf, "embeddings"), "label"), {"x": 7})


@query("excerpts", """
  WITH w AS (SELECT doc_id, text, doc_id % 5 = 0 AS tab, substr(text, 1, 700) AS h FROM documents),
  c AS (SELECT *, greatest(CASE WHEN contains(h, '. ') THEN 700 - strpos(reverse(h), ' .') - 1 ELSE -1 END,
     CASE WHEN contains(h, '.' || chr(10)) THEN 700 - strpos(reverse(h), chr(10) || '.') - 1 ELSE -1 END,
     CASE WHEN contains(h, '? ') THEN 700 - strpos(reverse(h), ' ?') - 1 ELSE -1 END,
     CASE WHEN contains(h, '! ') THEN 700 - strpos(reverse(h), ' !') - 1 ELSE -1 END,
     CASE WHEN contains(h, '; ') THEN 700 - strpos(reverse(h), ' ;') - 1 ELSE -1 END) AS cut FROM w)
  SELECT doc_id, md5(CASE WHEN tab OR length(text) <= 700 THEN text WHEN cut >= 350 THEN substr(h, 1, cut + 1) || ' …'
    ELSE regexp_replace(h, '\\s+$', '') || ' …' END) AS excerpt_md5 FROM c""")
def _excerpts(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(filings.excerpt(F.col("text"), kind)).alias("excerpt_md5"))


@query("filing_catalogue", """
  SELECT o_custkey AS cik, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) <= 3""")
def _catalogue(spark, sf):
    rows = F.collect_list(F.struct(F.col("o_orderkey").alias("accession"), F.col("o_orderstatus").alias("form"),
                                   F.to_date("o_orderdate").alias("filed")))
    arrays = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(rows.alias("r")).select(
        "cik", F.col("r.accession").alias("accession"), F.col("r.form").alias("form"), F.col("r.filed").alias("filed"))
    return filings.catalogue(arrays, "F", 3).select("cik", "accession", "filed")


@query("load_summary", """
  SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN n_chars < 200 THEN 'failed' ELSE 'indexed' END AS outcome,
    count(*) AS filings FROM documents GROUP BY 1""")
def _load(spark, sf):
    cat = table(spark, sf, "documents").select(F.col("doc_id").alias("accession"), "n_chars")
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("accession"))
    return filings.load_summary(cat, stored, F.col("n_chars") < 200)


@query("pending_filings", "SELECT doc_id AS accession FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _pending(spark, sf):
    cat = table(spark, sf, "documents").select(F.col("doc_id").alias("accession"))
    return maintenance.pending(cat, table(spark, sf, "labels").select(F.col("doc_id").alias("accession")))


@query("strategy_cards", """
  SELECT p_name AS card_key, CASE WHEN p_size > 25 THEN 'equity' ELSE 'bond' END AS kind, section, content, p_size > 25 AS valid,
    sha256(content) AS content_hash FROM (SELECT *, unnest(['Summary', 'When it fails']) AS section, unnest([p_type, p_brand]) AS content FROM part)""")
def _cards(spark, sf):
    text = F.concat(F.lit("---\nkey: "), "p_name", F.lit("\nkind: "), F.when(F.col("p_size") > 25, "equity").otherwise("bond"),
                    F.lit("\nregime: any\n---\n# Card\n## Summary\n"), "p_type", F.lit("\n## When it fails\n"), "p_brand", F.lit("\n"))
    out = filings.cards(table(spark, sf, "part").select(text.alias("text")))
    return out.select("card_key", "kind", "section", "content", "valid", "content_hash")


@query("statement_rows", """
  SELECT l_orderkey AS chunk_id, l_linenumber AS row, l_quantity * 1000 AS absolute FROM lineitem WHERE l_linenumber <> 7""")
def _statement_rows(spark, sf):
    n = F.col("l_linenumber")
    row = F.struct(n.alias("row"), F.when(n == 7, "heading").otherwise("amount").alias("kind"),
                   (F.col("l_quantity") * 1000).alias("absolute"))
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(
        F.struct(F.collect_list(row).alias("rows")).alias("structured"))
    return filings.statement_rows(c).select("chunk_id", "row", "absolute")


@query("table_chunks", """
  WITH d AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey AS accession, count(*) AS lines,
    max(CASE WHEN l_linenumber = 3 THEN concat('Gross profit ', CAST(CAST(q AS INT) AS VARCHAR)) END) AS headline FROM d GROUP BY l_orderkey""")
def _table_chunks(spark, sf):
    n = F.col("l_linenumber")
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    row = F.struct(n.alias("n"), F.element_at(F.array(*map(F.lit, _LABELS)), n).alias("label"),
                   F.when(n == 7, F.array().cast("array<double>")).otherwise(F.array("q")).alias("values"))
    s = d.groupBy(F.col("l_orderkey").cast("string").alias("accession")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    s = s.withColumns({"title": F.lit("Consolidated income statement"), "units": F.lit("in millions"), "periods": F.array(F.lit("2025"))})
    c = tables.table_chunks(s, F.lit("Company (C)"), F.lit("FY2025"))
    grid = F.element_at(F.split("content", "\n\n"), 2)
    head = F.regexp_extract("content", r"Most recent period: .*?(Gross profit \d+)", 1)
    return c.select(F.split("chunk_id", ":")[0].cast("bigint").alias("accession"), F.size(F.split(grid, "\n")).cast("bigint").alias("lines"),
                    F.when(head != "", head).alias("headline"))


@query("notes_above", """
  WITH s AS (SELECT doc_id, pos, CASE WHEN length(text) BETWEEN 1 AND 120 THEN text END AS t FROM blocks)
  SELECT doc_id, pos, coalesce(last_value(t IGNORE NULLS) OVER w, '') AS caption, count(t) OVER w AS near
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def _notes(spark, sf):
    from pyspark.sql import Window
    b = tables.notes_above(blocks(spark, sf))
    t = filings.normalised(F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-8, -1)
    near = F.count(F.when(F.length(t).between(1, 120), 1)).over(w)
    return b.select("doc_id", "pos", "caption", near.alias("near"))


@query("table_periods", """
  SELECT l_orderkey, string_agg(CAST(year(l_shipdate) AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS periods FROM lineitem
  GROUP BY l_orderkey HAVING count(*) >= 2""")
def _periods(spark, sf):
    cells = table(spark, sf, "lineitem").select("l_orderkey", F.lit(0).alias("row"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("col"),
                                                F.year("l_shipdate").cast("string").alias("text"))
    return tables.table_periods(cells, ["l_orderkey"]).select("l_orderkey", F.array_join("periods", " ").alias("periods"))


@query("upsert_chunks", "SELECT doc_id AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS version FROM documents")
def _upsert_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("version"), F.lit(1).alias("at"))
    new = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit("new").alias("version"), F.lit(2).alias("at"))
    rows = d.unionByName(new).unionByName(new)
    return maintenance.latest_per_key(rows, ["chunk_id"], [F.col("at").desc()]).select("chunk_id", "version")
