import numpy as np
from pyspark.sql import functions as F

from brasstide.llm import ranker


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ranker.fit(*ranker.training_rows(docs, labels))
    got = ranker.scored(docs, model)
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == docs.count() and len(rows) > 500
    for value in (0, 1):
        part = rows[rows.quality == value]
        assert (part.predicted == value).mean() > 0.98, value
    assert rows.score.between(0, 1).all()


def test_held_out_rows_never_train(spark, documents):
    import zlib
    labels = documents.select("doc_id", F.lit(1).alias("quality"))
    x, y = ranker.training_rows(documents, labels)
    ids = [r.doc_id for r in documents.collect()]
    assert len(x) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in ids)
    flags = {r.doc_id: r.h for r in documents.select("doc_id", ranker.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)


def test_sample_bound_and_changed_labels(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    x, y = ranker.training_rows(documents, labels, sample_rows=30)
    assert len(x) == 30 and set(y) == {0, 1}


def test_pairs_learn_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(ranker.FEATURES)))
    y = (x[:, 3] - 2 * x[:, 5] > 0.5).astype(int)
    model = ranker.fit(x, y)
    assert ((model.scores(x) >= model.threshold) == y).mean() > 0.97


def test_one_class_and_no_rows():
    x = np.ones((3, len(ranker.FEATURES)))
    assert (ranker.fit(x, np.ones(3, int)).scores(x) >= 0.3).all()
    assert (ranker.fit(x, np.zeros(3, int)).scores(x) < 0.3).all()
    assert len(ranker.fit(x[:0], np.zeros(0, int)).scores(x)) == 3


def test_odd_rows_score(spark, odd, nothing):
    x, y = np.vstack([ranker.features("good plain words of prose"), ranker.features("BAD!! BAD!! BAD!!")]), np.array([1, 0])
    model = ranker.fit(x, y)
    rows = ranker.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert ranker.scored(nothing, model).count() == 0 and ranker.accepted(nothing, model).count() == 0
    kept = ranker.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id bigint, quality int")
    assert len(ranker.training_rows(odd, labels)[0]) == 0
