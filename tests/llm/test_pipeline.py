from collections import Counter

import corpus_pipeline
from brasstide.llm import mixing, ranker
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_classes
from tests.llm.test_tokens import brute as token_rows


def test_run_equals_the_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ranker.fit(*ranker.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = [r for r in docs.collect() if model.scores([ranker.features(r.text)])[0] >= 0.3]
    assert 0 < len(rows) < docs.count()
    kept = {d for d, _, c in brute_classes([(r.doc_id, r.text) for r in rows]) if d == c}
    assert len(kept) < len(rows)
    rows = [r for r in rows if r.doc_id in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in bad]
    mixed = mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()  # held against SQL by op7_mixing
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1])
    texts = {r.doc_id: r.text for r in mixed}
    assert Counter(g[0] for g in got) == Counter(r.doc_id for r in mixed)
    assert got == token_rows([(g[0], texts[g[0]]) for g in got])


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf, odd, nothing):
    for start in (odd, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns, name
        name, stage = corpus_pipeline.STAGES[-1]
        assert stage(spark, docs, sf).columns[0] == "doc_id"


def test_token_files_hold_the_shuffled_order(spark):
    docs = spark.createDataFrame([(n // 4, f"text of {n // 4}") for n in range(200)], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in corpus_pipeline.token_files(spark, docs, "").collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert sorted(ids) == sorted(n // 4 for n in range(200))
    assert got == token_rows([(i, f"text of {i}") for i in ids])
    assert sum(a == b for a, b in zip(ids, ids[1:])) < 20 and ids != sorted(ids)
