from brasstide.llm import decontaminate


def words(text):
    import re
    return [w for w in re.split("[\x20\x09-\x0D]+", (text or "").lower()) if w]


def grams(ws, k):
    return {" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items):
    out = {}
    for item, t in items:
        ws = words(t)
        if not ws:
            continue
        k = min(5, len(ws))
        want = grams(ws, k)
        for doc, text in docs:
            n = len(want & grams(words(text), k))
            if 10 * n >= 8 * len(want):
                key = (doc, item)
                out[key] = max(out.get(key, (0, 0)), (len(want), n))
    return {(d, i, n, f) for (d, i), (n, f) in out.items()}


def found(docs, items, **kw):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.contaminated(docs, items, **kw).collect()}


def items_of(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, None), (3, ""), (4, "one"), (5, "two words"), (None, "the last of"), (6, "a a a a a a a a a"), (7, long), (8, "word5 and5 word6 and6 word7 and7 word8 and8")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id bigint, text string, words string, size string")


def test_odd_rows_and_near_copies(spark, odd):
    base = [f"w{i}" for i in range(40)]
    def changed(*at):
        return " ".join("CHANGED" if i in at else w for i, w in enumerate(base))
    more = [(50, "before " + changed() + " after"), (51, changed(0)), (52, changed(20)), (53, changed(20, 35)), (54, changed(3, 12, 30)),
            (55, "pad " * 5000 + changed(39).upper() + " pad" * 5000), (56, "a a a a a"), (50, changed(20)), (57, "x ONE\ty")]
    docs = odd.select("doc_id", "text", "words", "h").unionByName(
        spark.createDataFrame([(*r, "w", "h") for r in more], "doc_id bigint, text string, words string, h string"))
    items = items_of(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    assert {d for d, i, *_ in want if i == 1} == {50, 51, 52, 55}


def test_sides_without_rows(spark, odd, nothing):
    items = items_of(spark)
    assert found(nothing, items) == set() and found(odd, items.limit(0)) == set()


def test_large_item_tables_join_by_shuffle(spark, odd, monkeypatch):
    from brasstide.llm import common
    want = found(odd, items_of(spark))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert found(odd, items_of(spark)) == want and want


def test_clean_keeps_other_rows_whole(spark, odd):
    items = items_of(spark)
    bad = {r[0] for r in found(odd, items)}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.doc_id is None or r.doc_id not in bad for r in odd.collect())


def test_plan_has_no_python(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontaminate.contaminated(documents, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_document_that_repeats_an_item_is_verified_a_few_times_only(spark):
    import time
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(n, f"{item} " * n) for n in (1, 800)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    start = time.time()
    assert found(df, it) == {(1, 7, 26, 26), (800, 7, 26, 26)}
    assert time.time() - start < 15
