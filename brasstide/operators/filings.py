"""Filing pages to blocks, sections, table rows and retrieval chunks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Heading, furniture and statement terms; abbreviations; chunk sizes.
ITEMS = ["1", "1A", "1B", "1C", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "9C", "10", "11",
         "12", "13", "14", "15", "16"]
MAX_HEADING, SHORT_LINE, MIN_REPEATS = 200, 80, 5
STATEMENT_LINES = [
    "revenue", "net sales", "cost of revenue", "cost of sales", "cost of goods", "gross profit", "gross margin",
    "operating expenses", "research and development", "operating income", "income from operations", "net income",
    "earnings per share", "provision for income taxes", "income before income taxes"]
DISQUALIFYING = ["segment", "geographic", "disaggregat", "by category"]
DASHES = ["—", "–", "-"]
ABBREVIATIONS = [
    "u.s", "u.k", "e.u", "inc", "corp", "co", "ltd", "llc", "plc", "no", "nos", "mr", "mrs", "ms", "dr", "jr",
    "sr", "st", "vs", "etc", "e.g", "i.e", "approx", "fig", "al", "dept", "est", "ch", "sec", "art"]
TARGET_TOKENS, OVERLAP_TOKENS, HEADING_TOKENS = 500, 50, 15
WINDOW_TOKENS, WINDOW_OVERLAP = 510, 64
EXCERPT = 700
CUT = " …"


class _Blocks(HTMLParser):
    """Text of block-level elements in document order, with whether a table holds them."""

    BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "article", "section",
             "nav", "br", "table", "ul", "ol", "title", "body", "main", "header", "footer", "blockquote", "pre"}
    SILENT = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.text, self.tag, self.tables, self.silent = [], [], "body", 0, 0

    def cut(self, tag):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.rows.append((len(self.rows), self.tag, text, self.tables > 0))
        self.text, self.tag = [], tag

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        if tag in self.BLOCK:
            self.cut(tag)
            self.tables += tag == "table"

    def handle_endtag(self, tag):
        self.silent -= tag in self.SILENT and self.silent > 0
        if tag in self.BLOCK:
            self.cut("body")
            self.tables -= tag == "table" and self.tables > 0

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def html_blocks(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """Pages to one row per block: (id, pos, tag, text, in_table). Whole pages, one at a time."""
    schema = f"{id_} bigint, pos int, tag string, text string, in_table boolean"

    def parse(batches):
        for pdf in batches:
            rows = []
            for page, source in zip(pdf[id_], pdf[html]):
                p = _Blocks()
                p.feed(source or "")
                p.close()
                p.cut("body")
                rows.extend((page, *r) for r in p.rows)
            yield pd.DataFrame(rows, columns=[id_, "pos", "tag", "text", "in_table"])

    return pages.select(id_, html).mapInPandas(parse, schema)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def item_markers(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Where each item's heading is: outside tables, a titled one before a bare label, the last
    of its kind. One row per (document, item)."""
    text = normalised(F.col("text"))
    item = F.upper(F.regexp_extract(text, r"(?i)^item\s*(\d{1,2}[ABC]?)(?=[\s.:)\-–—]|$)", 1))
    df = blocks.filter(~F.col("in_table") & (F.length(text) <= MAX_HEADING)).select(
        doc, "pos", item.alias("item"), text.rlike(r"(?i)^item\s*\d{1,2}[abc]?\s*[.:)\-–—]?$").alias("_bare"))
    df = df.filter(F.col("item").isin(ITEMS))
    return df.groupBy(doc, "item").agg(F.max_by("pos", F.struct(~F.col("_bare"), "pos")).alias("pos"))


def boilerplate(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Short texts repeated within one document; counted before the shuffle, so a line repeated a
    million times costs one row per task."""
    text = normalised(F.col("text"))
    return (blocks.select(doc, text.alias("text")).filter((F.length("text") > 0) & (F.length("text") <= SHORT_LINE))
            .groupBy(doc, "text").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= MIN_REPEATS))


def section_blocks(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks from an item's heading to the next heading found, without furniture."""
    marks = item_markers(blocks, doc).withColumnRenamed("item", "_item")
    w = Window.partitionBy(doc).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.select(doc, "pos", normalised(F.col("text")).alias("text")).join(marks, [doc, "pos"], "left")
    df = df.withColumn("item", F.last("_item", ignorenulls=True).over(upto))
    df = df.filter(F.col("item").isNotNull() & F.col("_item").isNull() & (F.length("text") > 0)).drop("_item")
    short = F.length("text") <= SHORT_LINE
    # What page furniture looks like.
    furniture = short & (F.col("text").rlike(r"^\d{1,4}$") | F.col("text").rlike(r"(?i)^table of contents$")
                         | F.col("text").rlike(r"^.{0,60}\|\s*\d{1,4}\s*$"))
    return df.filter(~furniture).join(boilerplate(blocks, doc).drop("times"), [doc, "text"], "left_anti")


def section_paragraphs(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Section paragraphs, with sentences that were split over two blocks rejoined."""
    df = section_blocks(blocks, doc)
    s = Window.partitionBy(doc, "item").orderBy("pos")
    first = F.substring("text", 1, 1)
    goes_on = (~F.lag("text").over(s).rlike("[.!?:;”\"')\\]]$")) & (F.lower(first) == first) & (F.upper(first) != first)
    df = df.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    df = df.withColumn("paragraph", F.sum("_new").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(doc, "item", "paragraph").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def cell_number(cell: Column) -> Column:
    """'$ 130,497' -> 130497, '(1,234)' -> -1234, a dash -> null."""
    text = F.trim(F.regexp_replace(cell, "[$ ]", ""))
    inner = F.trim(F.regexp_replace(text, "[(),%]", ""))
    value = F.when(inner.rlike(r"^-?\d+(\.\d+)?$|^-?\.\d+$"), inner.try_cast("double"))
    negative = text.startswith("(") & text.endswith(")")
    return F.when(text.isin("", *DASHES), None).when(negative, -value).otherwise(value)


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, text) to rows: first non-numeric cell as label, numbers as values."""
    text = normalised(F.col("text"))
    df = cells.withColumns({"text": text, "_v": cell_number(text)}).filter(
        (F.length("text") > 0) & ~F.col("text").isin("$", "%", "(", ")", *DASHES))
    return df.groupBy(*keys, "row").agg(
        F.coalesce(F.min_by("text", F.when(F.col("_v").isNull(), F.col("col"))), F.lit("")).alias("label"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("col", "_v")))),
                    lambda x: x["_v"]).alias("values"))


def row_kinds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """amount / share_count / per_share / heading; a heading's kind carries down to the next."""
    label = F.col("label")
    # Labels of share counts and amounts per share.
    own = (F.when(label.rlike(r"(?i)shares?\s+(used|outstanding)|weighted[- ]average\s+(number\s+of\s+)?shares"
                              r"|number\s+of\s+shares"), "share_count")
           .when(label.rlike(r"(?i)per[- ]share|per\s+common\s+share|earnings\s+per"), "per_share"))
    heading = F.size("values") == 0
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("_own", own)
    context = F.last(F.when(heading, F.struct("_own")), ignorenulls=True).over(w)["_own"]
    return df.withColumn("_ctx", context).withColumn("kind", F.when(heading, "heading").otherwise(
        F.coalesce("_own", "_ctx", F.lit("amount")))).drop("_own", "_ctx")


def units_scale(note: Column) -> dict[str, Column]:
    """Multipliers a units note implies: the first scale word is money's; one after the first later
    mention of shares is theirs, else they share money's."""
    word = r"(?i)\b(thousand|million|billion)s?\b"

    def times(x):
        x = F.lower(x)
        return F.when(x == "thousand", 1_000).when(x == "million", 1_000_000).when(x == "billion", 1_000_000_000)

    amount = F.coalesce(times(F.regexp_extract(note, word, 1)), F.lit(1))
    after = F.regexp_extract(note, r"(?is)^.*?(?:\b(?:thousand|million|billion)s?\b.*?)?\bshares?\b.*?"
                                   r"\b(thousand|million|billion)s?\b", 1)
    return {"amount_scale": amount, "share_scale": F.coalesce(times(after), amount)}


def income_statements(rows: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """The best income-statement table of each document: at least 4 rows, 4 statement terms and 6
    numbers, no disqualifying term; highest score, then earliest. `rows`: keys, doc, pos, row,
    label, values, context."""
    def seen(terms):
        return [F.max(F.contains(F.lower("label"), F.lit(t)).cast("int")) for t in terms]

    bad = None
    for t in DISQUALIFYING:
        hit = F.contains(F.lower(F.concat_ws(" ", "label", "context")), F.lit(t))
        bad = hit if bad is None else bad | hit
    score = sum(seen(STATEMENT_LINES[1:]), seen(STATEMENT_LINES[:1])[0])
    df = rows.groupBy(doc, *keys).agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("values")).alias("numbers"),
        score.alias("_s"), F.max(bad.cast("int")).alias("_bad"))
    df = df.withColumn("score", F.when(F.col("_bad") == 1, 0).otherwise(F.col("_s")))
    df = df.filter("n_rows >= 4 AND score >= 4 AND numbers >= 6").drop("_s", "_bad")
    w = Window.partitionBy(doc).orderBy(F.col("score").desc(), "pos", *keys)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def sentences(texts: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """One row per sentence; a piece after an abbreviation or opening lower-case joins the last."""
    marked = F.regexp_replace(text, r"([.!?;])\s+(?=[\"“'(A-Z])", "$1\u0001")
    df = texts.select(id_, F.posexplode(F.split(marked, "\u0001")).alias("_i", "_piece"))
    w = Window.partitionBy(id_).orderBy("_i")
    last = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(F.lag("_piece").over(w)), r"\s+"), -1)), r"\.+$", "")
    first = F.substring("_piece", 1, 1)
    joins = last.isin(ABBREVIATIONS) | ((F.lower(first) == first) & (F.upper(first) != first))
    df = df.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    df = df.withColumn("sentence_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(id_, "sentence_no").agg(F.trim(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_piece"))), lambda x: x["_piece"]), " ")).alias("sentence"))
    return out.filter(F.length("sentence") > 0)


_TOKEN = r"(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])"
_UNIT = "struct<text:string,part:int,tokens:int,hard:boolean>"


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks of a text."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("int")


def _inner_sentences(text: Column) -> Column:
    """Sentences of a paragraph: cut after an end mark that no abbreviation carries, before a capital or quote."""
    short = "|".join(re.escape(a) for a in ABBREVIATIONS)
    cut = rf"(?<!(?<![^\s])(?i:{short})\.)(?<=[.!?;])\s+(?=[\"“'(A-Z])"
    return F.filter(F.transform(F.split(text, cut), lambda s: F.trim(s)), lambda s: s != "")


def _units(text: Column, target: int) -> Column:
    """What a chunk is made of: paragraphs, or the sentences of too long ones, or token runs of too long sentences."""
    unit = lambda t, part, hard: F.struct(t.alias("text"), part.alias("part"), count_tokens(t).alias("tokens"), F.lit(hard).alias("hard"))
    runs = lambda s: F.regexp_extract_all(s, F.lit(rf"((?:{_TOKEN}\s*){{1,{target}}})"), 1)                       # noqa: E731

    def of_sentence(s, part):
        return F.when(count_tokens(s) <= target, F.array(unit(s, part, False))).otherwise(
            F.transform(runs(s), lambda r: unit(F.rtrim(r), part, True)))

    def of_paragraph(p, part):
        return F.when(count_tokens(p) <= target, F.array(unit(p, part, False))).otherwise(
            F.flatten(F.transform(_inner_sentences(p), lambda s: of_sentence(s, part))))

    paragraphs = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.flatten(F.transform(F.filter(F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                                          lambda x: x["p"] != ""), lambda x: of_paragraph(x["p"], x["i"])))


def _closing(items: Column, tokens, overlap: int) -> Column:
    """The longest run of last items that holds at most `overlap` tokens."""
    sums = F.aggregate(F.reverse(items), F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept"), F.lit(False).alias("full")), lambda acc, x: F.struct(
        (acc["n"] + tokens(x)).alias("n"),
        F.when(acc["full"] | (acc["n"] + tokens(x) > overlap), acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
        (acc["full"] | (acc["n"] + tokens(x) > overlap)).alias("full")))["kept"]
    return F.slice(items, F.size(items) - sums + 1, sums)


def _total(units: Column) -> Column:
    return F.aggregate(units, F.lit(0), lambda n, u: n + u["tokens"])


def _heading_at_end(units: Column) -> Column:
    """The last of several units, if it reads as a heading: short, no bullet, no end mark."""
    last = F.try_element_at(units, F.lit(-1))
    reads = (last["tokens"] <= HEADING_TOKENS) & ~last["text"].rlike("^[•\\-–]") & ~last["text"].rlike("[.!?:;”\"')]$")
    return F.when((F.size(units) > 1) & reads, F.slice(units, -1, 1)).otherwise(F.slice(units, 1, 0))


def packed(units: Column, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Units folded into chunks of at most `target` tokens, as arrays of units.

    A chunk opens with the closing units of the one before, up to `overlap` tokens (of a single long
    unit, its closing sentences); a heading at a chunk's end moves on to the next.
    """
    none = F.slice(units, 1, 0)

    def step(acc, u):
        heading = _heading_at_end(acc["open"])
        body = F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - F.size(heading))
        whole = _closing(body, lambda x: x["tokens"], overlap)
        last = F.try_element_at(body, F.lit(-1))
        rest = F.array_join(_closing(_inner_sentences(last["text"]), count_tokens, overlap), " ")
        part = F.when(rest != "", F.array(F.struct(rest.alias("text"), last["part"].alias("part"), count_tokens(rest).alias("tokens"), F.lit(False).alias("hard")))).otherwise(none)
        opened = F.concat(F.when(F.size(whole) > 0, whole).otherwise(part), heading)
        full = (F.size(acc["open"]) > 0) & (_total(acc["open"]) + u["tokens"] > target)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(body))).otherwise(acc["done"]).alias("done"),
                        F.concat(F.when(full, opened).otherwise(acc["open"]), F.array(u)).alias("open"))

    start = F.struct(F.array().cast(f"array<array<{_UNIT}>>").alias("done"), none.alias("open"))
    return F.aggregate(units, start, step, lambda acc: F.when(
        F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunk_sections(sections: DataFrame, id_: str = "doc_id", text: str = "text", part: str = "item",
                   target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Sections to overlapping chunks with ids `id:part:index`: column expressions over a section's
    own row, without shuffle or user functions."""
    content = F.aggregate("_c", F.struct(F.lit("").alias("t"), F.lit(-1).alias("part")), lambda acc, u: F.struct(
        F.concat(acc["t"], F.when(acc["part"] < 0, "").when(acc["part"] != u["part"], "\n\n").otherwise(" "), u["text"]).alias("t"),
        u["part"].alias("part")))["t"]
    df = sections.select(id_, part, _units(F.coalesce(text, F.lit("")), target).alias("_u"))
    df = df.select(id_, part, F.posexplode(packed(F.col("_u"), target, overlap)).alias("chunk_index", "_c"))
    df = df.select(id_, part, "chunk_index", content.alias("content"), F.exists("_c", lambda u: u["hard"]).alias("hard_split"))
    return df.withColumns({"token_count": count_tokens(F.col("content")),
                           "chunk_id": F.concat_ws(":", F.col(id_).cast("string"), part, F.col("chunk_index").cast("string"))})


def number_chunks(chunks: DataFrame, doc: str, order: list[str], period_end: Column) -> DataFrame:
    """A running index through each document and its fiscal label."""
    w = Window.partitionBy(doc).orderBy(*order)
    return chunks.withColumns({"chunk_index": F.row_number().over(w) - 1,
                               "fiscal_period": F.concat(F.lit("FY"), F.year(period_end).cast("string"))})


def token_windows(texts: DataFrame, id_: str, text: str = "text", size: int = WINDOW_TOKENS,
                  overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Overlapping token windows of long texts, for embedding piece by piece."""
    tokens = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)
    df = texts.select(id_, tokens.alias("_t"))
    step = size - overlap
    starts = F.when(F.size("_t") <= size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.size("_t") - overlap - 1, F.lit(step)))
    return df.select(id_, F.size("_t").alias("tokens"), F.posexplode(starts).alias("window_no", "_s"), "_t").select(
        id_, "tokens", "window_no", F.size(F.slice("_t", F.col("_s") + 1, F.lit(size))).alias("window_tokens"),
        F.array_join(F.slice("_t", F.col("_s") + 1, F.lit(size)), " ").alias("window"))


def mean_pool(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Mean of each key's vectors, scaled to unit length; averaged per dimension before the shuffle."""
    dims = vectors.select(key, F.posexplode(embedding).alias("d", "x"))
    mean = dims.groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return mean.withColumn("x", F.try_divide("m", size)).drop("m")


def excerpt(text: Column, content_type: Column, limit: int = EXCERPT) -> Column:
    """Tables whole; prose cut at a sentence end when one falls in the back half of the window."""
    head = F.substring(text, 1, limit)
    ends = [". ", ".\n", "? ", "! ", "; "]
    cut = F.greatest(*[F.when(F.contains(head, F.lit(e)), limit - F.locate(e[::-1], F.reverse(head)) - 1)
                       .otherwise(-1) for e in ends])          # 0-based start of the last such end
    kept = F.when(cut >= limit // 2, F.rtrim(F.substring(head, F.lit(1), cut + 1))).otherwise(
        F.regexp_replace(head, r"\s+$", ""))
    return F.when((content_type == "table") | (F.length(text) <= limit), text).otherwise(F.concat(kept, F.lit(CUT)))


def statement_rows(chunks: DataFrame) -> DataFrame:
    """Rows of a parsed statement without its headings, absolute values beside the stated ones."""
    return chunks.select("chunk_id", F.explode("structured.rows").alias("r")).select("chunk_id", "r.*").filter(
        "kind <> 'heading'")


def catalogue(filings: DataFrame, form: str, newest: int) -> DataFrame:
    """Parallel arrays to rows; one exact form; the newest n per company."""
    cols = [f.name for f in filings.schema.fields if f.dataType.typeName() == "array"]
    df = filings.select("cik", F.explode(F.arrays_zip(*cols)).alias("f")).select("cik", "f.*").filter(F.col("form") == form)
    w = Window.partitionBy("cik").orderBy(F.col("filed").desc(), F.col("accession").desc())
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= newest).drop("_k")


def load_summary(catalogue_rows: DataFrame, stored: DataFrame, failed: Column) -> DataFrame:
    """What a resumed load does with each filing: skipped, failed or indexed."""
    done = stored.select("accession").distinct().withColumn("_done", F.lit(True))
    df = catalogue_rows.join(done, "accession", "left")
    return df.groupBy(F.when(F.col("_done"), "skipped").when(failed, "failed").otherwise("indexed").alias("outcome")
                      ).agg(F.count(F.lit(1)).alias("filings"))


def cards(texts: DataFrame) -> DataFrame:
    """Card files (front matter, then ## sections) to one row per section, with domains checked."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.regexp_extract(head, rf"(?m)^{k}:\s*(.+?)\s*$", 1)        # noqa: E731
    body = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n?", "")
    pieces = F.split(body, r"(?m)^## ")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    df = texts.select(field("key").alias("card_key"), field("kind").alias("kind"), field("regime").alias("regime"),
                      F.posexplode(parts).alias("section_no", "_p"))
    df = df.withColumns({"section": F.trim(F.substring_index("_p", "\n", 1)),
                         "content": F.regexp_replace(F.regexp_replace("_p", r"(?s)^[^\n]*\n?", ""), r"^\s+|\s+$", "")}).drop("_p")
    return df.withColumns({"content_hash": F.sha2("content", 256), "valid": F.col("kind").isin("equity", "option")})
