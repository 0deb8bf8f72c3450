"""Search over the supplied vectors and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasstide.operators import retrieval, vectors as similar
from brasstide.plans.shared import rounded
from brasstide.plans.sqltext import Ctes, r
from brasstide.sources.derived import table, written

QUERIES, SQL = {}, {}
C = Ctes()


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = C.compose(sql)
        return fn
    return keep


def chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("ticker"),
                    F.col("lang").alias("section"), F.concat(F.lit("FY"), (2020 + F.col("doc_id") % 3).cast("string"))
                    .alias("fiscal_period"), F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("content_type"))


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def as_queries(v):
    return v.select(F.col("vec_id").alias("query_id"), "embedding")


C.add("doc_chunks", """
  SELECT doc_id AS chunk_id, text AS content, source AS ticker, lang AS section, concat('FY', 2020 + doc_id % 3) AS fiscal_period,
    CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS content_type FROM documents""")
C.add("sims", """
  SELECT a.vec_id AS query_id, b.vec_id, b.label, a.label AS qlabel, round(list_cosine_similarity(a.e, b.e), 9) AS score
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a,
       (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b WHERE a.vec_id <> b.vec_id""")
C.add("exact10", "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims "
      "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")


@query("vector_topk", f"SELECT query_id, vec_id, rank, {r('score', 6, 'score')} FROM exact10")
def _topk(spark, sf):
    v = vectors(spark, sf)
    return rounded(retrieval.exact_topk(as_queries(v), v, 10, exclude_self=True).select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "score"), {"score": 6})


@query("vector_topk_filtered", f"""
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, {r('score', 6, 'score')}
  FROM sims WHERE label = qlabel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def _filtered(spark, sf):
    v = vectors(spark, sf).withColumn("section", F.col("label").cast("string"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding", "section")
    return rounded(retrieval.exact_topk(q, v, 5, exclude_self=True).select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "score"), {"score": 6})


@query("vector_topk_min_score", f"SELECT query_id, vec_id, {r('score', 6, 'score')} FROM exact10 WHERE score >= 0.3")
def _min_score(spark, sf):
    v = vectors(spark, sf)
    hits = retrieval.exact_topk(as_queries(v), v, 10, exclude_self=True).filter("score >= 0.3")
    return rounded(hits.select("query_id", "vec_id", "score"), {"score": 6})


def _index(spark, sf):
    """One index per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = similar.build_index(vectors(spark, sf))
    return _INDEXES[key]


_INDEXES: dict = {}


@query("vector_topk_approximate")
def _ann(spark, sf):
    return similar.search_index(_index(spark, sf), as_queries(vectors(spark, sf)), 10, exclude_self=True)


@query("approximate_recall")
def _recall(spark, sf):
    v, index = vectors(spark, sf), _index(spark, sf)
    # Stored, for each depth below would search anew: its limit goes down into the search.
    exact = written(spark, sf, "exact_neighbours", lambda: retrieval.exact_topk(as_queries(v), v, 30, exclude_self=True))
    found = written(spark, sf, "found_neighbours", lambda: similar.search_index(index, as_queries(v), 30, exclude_self=True))
    one = [retrieval.recall_at(exact, found, k).agg(F.avg("recall").alias(f"recall_at_{k}"), F.count_if("short").alias(f"short_at_{k}"))
           .withColumn("one", F.lit(1)) for k in (5, 10, 30)]
    shares = similar.work_shares(index, as_queries(v), 30).withColumn("one", F.lit(1))
    return one[0].join(one[1], "one").join(one[2], "one").join(shares, "one").drop("one")


C.add("toks", "SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM doc_chunks")
C.add("posts", "SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM toks")
C.add("tfs", "SELECT chunk_id, n, term, count(*) AS tf FROM posts GROUP BY 1, 2, 3")
C.add("dfs", "SELECT term, count(*) AS df FROM tfs GROUP BY term")
C.add("qterms", "SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark")
C.add("lex", """
  SELECT query_id, chunk_id, round(sum(ln(1 + (SELECT count(*) FROM documents) / df) * ln(1 + tf)) / (1 + ln(any_value(n))), 9) AS score
  FROM qterms JOIN tfs USING (term) JOIN dfs USING (term) GROUP BY query_id, chunk_id""")
C.add("lex30", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex "
      "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 30")


@query("text_search", f"SELECT query_id, chunk_id, rank, {r('score', 6, 'score')} FROM lex30")
def _text(spark, sf):
    out = retrieval.text_search(questions(spark, sf), chunks(spark, sf))
    return rounded(out.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score"), {"score": 6})


def _doc_vectors(spark, sf):
    return chunks(spark, sf).join(vectors(spark, sf).select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


C.add("vec30", """
  SELECT query_id, vec_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM sims WHERE query_id IN (SELECT item_id FROM benchmark) AND vec_id IN (SELECT doc_id FROM documents)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 30""")
_WANTS = "regexp_matches(lower(text), '\\b(total|number|amount|figure)\\b')"
C.add("reranked", """
  SELECT query_id, chunk_id, round(v.score + 0.06 * list_sum([CAST(contains(lower(content), t) AS INT) FOR t IN terms]) / len(terms)
      + CASE WHEN content_type = 'table' THEN 0.09 ELSE 0 END, 9) AS score
  FROM vec30 v JOIN doc_chunks USING (chunk_id), (SELECT ['revenue', 'sales', 'eps'] AS terms) k""")


@query("rerank", f"SELECT query_id, chunk_id, {r('score', 6, 'score')} FROM reranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def _rerank(spark, sf):
    v = _doc_vectors(spark, sf)
    q = questions(spark, sf).join(as_queries(vectors(spark, sf)), "query_id")
    hits = retrieval.exact_topk(q.select("query_id", "embedding"), v.withColumnRenamed("chunk_id", "vec_id"), 30,
                                exclude_self=True).withColumnRenamed("vec_id", "chunk_id")
    asked = q.withColumn("text", F.lit("What was the total revenue, sales and eps?"))
    out = retrieval.rerank(hits.select("query_id", "chunk_id", "score"), asked, chunks(spark, sf), 10)
    return rounded(out.select("query_id", "chunk_id", "score"), {"score": 6})


@query("rank_fusion", f"""
  WITH u AS (SELECT query_id, chunk_id, rank, 0 AS l FROM vec30 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM lex30),
  f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score, min((l, rank)) AS first FROM u GROUP BY 1, 2)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, {r('score', 9, 'score')}
  FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) <= 10""")
def _fusion(spark, sf):
    v = _doc_vectors(spark, sf).withColumnRenamed("chunk_id", "vec_id")
    q = questions(spark, sf).join(as_queries(vectors(spark, sf)), "query_id")
    by_vector = retrieval.exact_topk(q.select("query_id", "embedding"), v, 30, exclude_self=True).withColumnRenamed("vec_id", "chunk_id")
    out = retrieval.fuse([by_vector, retrieval.text_search(questions(spark, sf), chunks(spark, sf))], 10)
    return rounded(out.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score"), {"score": 9})


@query("search_filings")
def _search(spark, sf):
    q = questions(spark, sf).join(as_queries(vectors(spark, sf)), "query_id")
    q = q.withColumn("text", F.concat("text", F.lit(" in fiscal 2021")))
    return retrieval.search(q, _doc_vectors(spark, sf), 5)


@query("search_fallback", """
  WITH t AS (SELECT query_id, chunk_id, 0 AS tier FROM lex30 JOIN doc_chunks USING (chunk_id) WHERE fiscal_period = 'FY2021' AND section = 'de'
    UNION ALL SELECT query_id, chunk_id, 1 FROM lex30 JOIN doc_chunks USING (chunk_id) WHERE section = 'fr'
    UNION ALL SELECT query_id, chunk_id, 2 FROM lex30)
  SELECT query_id, chunk_id, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""")
def _fallback(spark, sf):
    hits = retrieval.text_search(questions(spark, sf), chunks(spark, sf)).select("query_id", "chunk_id")
    h = hits.join(chunks(spark, sf).select("chunk_id", "section", "fiscal_period"), "chunk_id")
    tiers = [h.filter("fiscal_period = 'FY2021' and section = 'de'"), h.filter("section = 'fr'"), h]
    return retrieval.first_nonempty([t.select("query_id", "chunk_id") for t in tiers]).select("query_id", "chunk_id", "tier")


@query("query_intent", r"""
  WITH q AS (SELECT o_orderkey, ['What was total revenue in fiscal 2023?', 'Why did gross margin fall in FY2022?', 'How much income tax for fiscal year 2024 and FY 2023?',
      'Tell me about risks', 'Reported EPS per share'][CAST(o_custkey % 5 AS INT) + 1] AS t, o_custkey % 5 AS k FROM orders)
  SELECT o_orderkey, [1, 1, 1, 0, 2][k + 1] AS n_terms, k IN (0, 2, 4) AS value_seeking, k = 1 AS explanatory, k IN (0, 2, 4) AS wants_a_figure,
    ['FY2023 FY2024 FY2025', 'FY2022 FY2023 FY2024', 'FY2024 FY2025 FY2026', NULL, NULL][k + 1] AS periods FROM q""")
def _intent(spark, sf):
    texts = ["What was total revenue in fiscal 2023?", "Why did gross margin fall in FY2022?",
             "How much income tax for fiscal year 2024 and FY 2023?", "Tell me about risks", "Reported EPS per share"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_custkey") % 5 + 1).cast("int"))
    q = table(spark, sf, "orders").select("o_orderkey", t.alias("t"))
    i = retrieval.query_intent(F.col("t"))
    return q.select("o_orderkey", F.size(i["terms"]).alias("n_terms"), i["value_seeking"].alias("value_seeking"),
                    i["explanatory"].alias("explanatory"), i["wants_a_figure"].alias("wants_a_figure"),
                    F.array_join(retrieval.fiscal_periods_named(F.col("t")), " ").alias("periods"))


@query("resolve_section", """
  SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'Item 1A' WHEN 1 THEN 'Item 7' WHEN 2 THEN 'Income Statement' ELSE 'Item 9' END AS section FROM supplier""")
def _section(spark, sf):
    k = F.col("s_nationkey") % 4
    raw = F.when(k == 0, "Risk Factors").when(k == 1, " MD&A").when(k == 2, "table").otherwise("Item 9")
    return table(spark, sf, "supplier").select("s_suppkey", retrieval.resolve_section(raw).alias("section"))


C.add("gold", "SELECT item_id, doc_id AS chunk_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)")


def gold_rows(spark, sf):
    m = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("marker"))
    return written(spark, sf, "gold", lambda: retrieval.marker_chunks(m, chunks(spark, sf)))


@query("marker_chunks", "SELECT item_id, chunk_id FROM gold")
def _gold(spark, sf):
    return gold_rows(spark, sf)


@query("retrieval_metrics", f"""
  WITH g AS (SELECT item_id AS query_id, chunk_id, rank FROM gold LEFT JOIN lex30 ON query_id = item_id AND lex30.chunk_id = gold.chunk_id)
  SELECT query_id, {r('count(*) FILTER (rank <= 5) / count(*)', 6, 'recall')}, count(*) FILTER (rank <= 5) > 0 AS hit, min(rank) AS first_rank
  FROM g GROUP BY query_id""".replace("SELECT item_id AS query_id, chunk_id, rank", "SELECT gold.item_id AS query_id, gold.chunk_id, rank"))
def _metrics(spark, sf):
    ranked = retrieval.text_search(questions(spark, sf), chunks(spark, sf))
    g = gold_rows(spark, sf).withColumnRenamed("item_id", "query_id")
    out = retrieval.retrieval_metrics(ranked, g).withColumn("first_rank", F.col("first_rank").cast("bigint"))
    return rounded(out, {"recall": 6})


@query("retrieval_summary", f"""
  WITH m AS (SELECT gold.item_id, count(*) FILTER (rank <= 5) / count(*) AS recall, count(*) FILTER (rank <= 5) > 0 AS hit, min(rank) AS first
      FROM gold LEFT JOIN lex30 ON query_id = item_id AND lex30.chunk_id = gold.chunk_id GROUP BY gold.item_id),
  c AS (SELECT m.*, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS kind FROM m JOIN benchmark USING (item_id)),
  l AS (SELECT *, 'all' AS grouping, NULL AS label FROM c UNION ALL SELECT *, 'kind', kind FROM c)
  SELECT grouping, label, count(*) AS cases, {r('avg(recall)', 6, 'recall')}, {r('avg(CAST(hit AS INT))', 6, 'hit')}, count(first) AS found,
    {r('median(first)', 6, 'median_rank')}, {r('avg(first)', 6, 'mean_rank')} FROM l GROUP BY grouping, label""")
def _retrieval_summary(spark, sf):
    ranked = retrieval.text_search(questions(spark, sf), chunks(spark, sf))
    metrics = retrieval.retrieval_metrics(ranked, gold_rows(spark, sf).withColumnRenamed("item_id", "query_id"))
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.length("text") > 200, "long").otherwise("short").alias("kind"))
    return rounded(retrieval.retrieval_summary(metrics, cases, ["kind"]), {"recall": 6, "hit": 6, "median_rank": 6, "mean_rank": 6})


@query("corpus_stats", """
  SELECT ticker, section, fiscal_period, count(*) AS chunks, count(*) FILTER (content_type = 'table') AS tables
  FROM doc_chunks GROUP BY GROUPING SETS ((ticker, section, fiscal_period), ())""")
def _stats(spark, sf):
    return retrieval.corpus_stats(chunks(spark, sf))


@query("latency_percentiles", f"""
  SELECT event_type, count(value) AS n, {r('avg(value)', 6, 'mean')}, max(value) AS max, {r('quantile_cont(value, 0.5)', 6, 'p50')},
    {r('quantile_cont(value, 0.95)', 6, 'p95')} FROM events GROUP BY event_type""")
def _latency(spark, sf):
    out = retrieval.latency_summary(table(spark, sf, "events"), ["event_type"], "value")
    return rounded(out, {"mean": 6, "p50": 6, "p95": 6})
