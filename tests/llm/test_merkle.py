from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from brasstide.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        low = at - at % 8
        yield level[low:at], level[at + 1:low + 8]
        at //= 8


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            claim = own
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0:
                claim = leaf((*r[:4], lower(r[4])))
            path = [*siblings(trees[g], at), *siblings(top, n)]
            for a, b in path:
                claim = h(*a, claim, *b)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(*[x for a, b in path for x in a + b]), claim, claim == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def test_documents_match_brute_force(spark, sf, documents):
    want = brute(plain(documents))
    assert got(queries.op13_merkle(spark, sf)) == want
    assert {r[-1] for r in want} == {True, False}


def test_odd_rows_match_brute_force(odd):
    rows = odd.withColumn("n_chars", F.length("text")).drop("lang").withColumn("lang", F.when(F.col("doc_id") > 3, "x").when(F.col("doc_id") > 1, "é"))
    assert got(queries.merkle_rows(rows)) == brute(plain(rows))


def test_many_levels_and_many_groups(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"),
                                    F.when(F.col("id") > 700, F.concat(F.lit("g"), (F.col("id") % 601).cast("string"))).alias("lang"),
                                    F.lit(3).cast("bigint").alias("n_chars"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    assert got(queries.merkle_rows(rows)) == brute(plain(rows))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513])
def test_sizes_at_the_edges(spark, n):
    rows = spark.createDataFrame([(i, "s", "en", i, f"Row {i}") for i in range(n)],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert got(queries.merkle_rows(rows)) == brute(plain(rows))


def test_empty_table_and_long_text(spark, odd):
    rows = odd.withColumn("n_chars", F.length("text"))
    assert queries.merkle_rows(rows.limit(0)).count() == 0
    assert merkle.manifest(rows.limit(0)).root is None
    long = spark.createDataFrame([(1, None, "en", 5, "Ab " * 2_000_000)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert got(queries.merkle_rows(long)) == brute(plain(long))
