"""Benchmark decontamination: exact prefix filter in MinHash order for containment, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.llm.common import small, text_of, words_of, written

SHINGLE = 5
CONTAINMENT = 0.8


def _shingles(words: Column, size: int) -> Column:
    """Distinct word shingles as text; an empty array for fewer words than `size`."""
    texts = F.transform(F.sequence(F.lit(0), F.size(words) - size),
                        lambda i: F.concat_ws(" ", *[words[i + k] for k in range(size)]))
    return F.when(F.size(words) >= size, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[words[at + k] for k in range(size)])


def _hasher(size: int):
    return lambda at: _hash(F.col("words"), at, size)


def sketches(items: DataFrame, item: str = "item_id", text: str = "text",
             shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, size, n_shingles, need, shingles, sketch) of every item with a word.

    `size` is the words in a shingle. An item of n shingles counts as contained when `need` = ceil(containment * n) of its shingles are in a document, so at most
    n - need are missing: its sketch, a prefix in hash order, keeps the n - need + 1 smallest shingle hashes, and
    a document that contains the item must hold at least one of them. The search loses nothing,
    for any document length. An item of fewer words than `shingle` is one shingle, all its words.
    """
    words = words_of(F.lower(text_of(text)))
    df = (items.select(F.col(item).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
          .withColumn("size", F.least(F.size("words"), F.lit(shingle))))
    by_size = F.lit(None).cast("array<string>")
    hashes = F.lit(None).cast("array<bigint>")
    for k in range(1, shingle + 1):
        by_size = F.when(F.col("size") == k, _shingles(F.col("words"), k)).otherwise(by_size)
        at = F.sequence(F.lit(0), F.size("words") - k)
        hashes = F.when((F.col("size") == k) & (F.size("words") >= k),
                        F.transform(at, _hasher(k))).otherwise(hashes)
    df = df.withColumn("shingles", by_size).withColumn("hashes", F.array_sort(F.array_distinct(hashes)))
    # one ten-thousandth less, so that e.g. 0.8 * 10 is not lifted over 8 by rounding
    need = F.ceil(F.size("shingles") * F.lit(containment) - 1e-4).cast("int")
    df = df.withColumn("n_shingles", F.size("shingles")).withColumn("need", F.greatest(need, F.lit(1)))
    return df.select("item_id", "size", "n_shingles", "need", "shingles",
                     F.slice("hashes", 1, F.col("n_shingles") - F.col("need") + 1).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text",
                 shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document that contains an item.

    Words are parted at ASCII white space and compared in lower case. Documents stream past the
    sketches (broadcast while they are few, else a shuffle of ids and hashes alone); only those that
    meet one are read again, once an item, and are verified by intersecting the shingle texts themselves. Rows
    of one doc_id give their best containment. Null and empty texts contain nothing; a null doc_id
    is reported as null; empty tables give no rows; no other column is read.
    """
    found = sketches(items, item, item_text, shingle, containment)
    n_rows, sizes = found.agg(F.sum(F.size("sketch")), F.collect_set("size")).first()  # one row, sizes 1 to `shingle`
    spark = docs.sparkSession
    probe = found.select("item_id", "size", F.explode("sketch").alias("h"))
    base = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    split = words_of(F.lower("text"))
    n_rows = n_rows or 0
    met = None
    for size in sorted(sizes or []):
        each = (base.select("doc_id", split.alias("words")).where(F.size("words") >= size)
                .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - size)))
                .select("doc_id", _hash(F.col("words"), F.col("at"), size).alias("h")))
        hit = each.join(small(probe.where(F.col("size") == size), n_rows), "h").select("doc_id", "item_id")
        met = hit if met is None else met.unionByName(hit)
    if met is None:
        return spark.createDataFrame([], f"doc_id {docs.schema[key].dataType.simpleString()}, item_id "
                                         f"{items.schema[item].dataType.simpleString()}, n_shingles int, n_found int, containment double")
    # one row a document and item, however often the document repeats it
    pairs = written(met.distinct(), "met-items").withColumnRenamed("doc_id", "hit_id")
    hits = (base.join(small(pairs, pairs.count()), base["doc_id"].eqNullSafe(pairs["hit_id"]))
            .select("doc_id", "item_id", split.alias("words")))
    checks = found.select("item_id", F.col("size").alias("item_size"), "n_shingles", "need", "shingles")
    held = hits.join(small(checks, n_rows), "item_id")
    own = F.lit(None).cast("array<string>")
    for k in sorted(sizes):
        own = F.when(F.col("item_size") == k, _shingles(F.col("words"), k)).otherwise(own)
    held = (held.withColumn("n_found", F.size(F.array_intersect("shingles", own)))
            .where(F.col("n_found") >= F.col("need")))
    return (held.groupBy("doc_id", "item_id")
            .agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
            .withColumn("containment", F.col("n_found") / F.col("n_shingles")))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, with all their columns; rows without an id stay."""
    bad = contaminated(docs, items, key, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs[key] == bad["bad_id"], "left_anti")
