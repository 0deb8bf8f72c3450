import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brasstide.llm import simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = np.array([xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def brute_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and find(i) != find(j):
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, p, least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints))), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.classes(df).collect()), key=str)


def test_documents_and_odd_rows_match_brute_force(spark, documents, odd):
    both = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    assert got(both) == brute_classes([(r.doc_id, r.text) for r in both.collect()])


def test_empty_table(nothing):
    assert simhash.classes(nothing).count() == 0
    assert simhash.representatives(nothing).columns == nothing.columns


def test_pairs_equal_popcount_in_every_group():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 70, 200, 1, 65]
    base = [rng.integers(0, 2 ** 64, dtype=np.uint64) for _ in sizes]
    prints = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False))
                       for b, n in zip(base, sizes) for _ in range(n)], dtype=np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    found = {(int(i), int(j)) for a, b in simhash.near_pairs(prints, ends, 3, list(range(64))) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, int(ends[i])) if bin(int(prints[i] ^ prints[j])).count("1") <= 3}
    assert found == want


def test_bands_lose_no_pair():
    random.seed(2)
    for rows in (10, 10 ** 7, 10 ** 10):
        masks = [sum(1 << k for k in m) for m in simhash.bands(rows)]
        for _ in range(300):
            flips = sum(1 << k for k in random.sample(range(64), 3))
            assert any(not flips & m for m in masks)


def test_large_bucket_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    random.seed(3)
    base = random.getrandbits(63)
    prints = sorted({base ^ sum(1 << k for k in random.sample(range(63), 2)) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = simhash.components(simhash.links(df, len(prints)))
    roots = {r.root for r in found.collect()}
    label = {p: p for p in prints}
    for _ in range(len(prints)):
        new = {p: min(label[q] for q in prints if bin(p ^ q).count("1") <= 3) for p in prints}
        if new == label:
            break
        label = new
    assert roots == set(label.values()) and found.count() == len(prints)


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_representatives_keep_one_of_each_group(odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 7 not in ids and 3 not in ids and 2 in ids and ids.count(None) == 2


def test_texts_cut_into_slices_keep_their_print(spark, monkeypatch, odd):
    import pyarrow as pa
    monkeypatch.setattr(simhash, "SLICE", 7)
    texts = [r.text for r in odd.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = next(simhash._prints(iter([batch]))).column(1).to_pylist()
    assert [g % 2 ** 64 for g in got] == [brute_print(t) for t in texts]


def test_a_text_of_20_mb_stays_within_500_mb():
    code = """
import resource, sys
import pyarrow as pa
from brasstide.llm import simhash
text = " ".join(f"word{i % 9973:07d}" for i in range(1_600_000)) + " " + "tail " * 500_000
assert len(text) > 20_000_000
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
del text
import numpy, xxhash
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
next(simhash._prints(iter([batch])))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import subprocess
    import sys
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300, out.stdout
