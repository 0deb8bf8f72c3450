import random
import re

import numpy as np
from pyspark.sql import functions as F

from brasstide.llm import jaccard


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 3 else {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    """All pairs: (doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in jaccard.classes(df).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[k] = f"new{rng.randrange(10 ** 6)}"
        else:
            words.insert(k, f"more{rng.randrange(10 ** 6)}")
    return words


def near_copies(seed, groups, copies, length):
    """Texts in groups whose members lie around the threshold, with one passage in all texts."""
    rng = random.Random(seed)
    shared = [f"line{i}" for i in range(12)]
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(8, length))]
        for _ in range(copies):
            words = edited(rng, base, rng.randrange(0, 2 + len(base) // 45))
            out.append(" ".join(words + shared if g % 3 == 0 else words))
    rng.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def test_documents_and_odd_rows_match_brute_force(spark, documents, odd):
    both = documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    want = brute([(r.doc_id, r.text) for r in both.collect()])
    assert got(both) == want
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_near_copies_around_the_threshold(spark):
    rows = near_copies(4, 40, 8, 260)
    want = brute(rows)
    assert got(frame(spark, rows)) == want
    assert 40 < len({c for *_, c in want}) < len(rows) - 40


def test_small_pieces_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 600)
    rows = near_copies(9, 4, 70, 90)
    assert got(frame(spark, rows)) == brute(rows)


def test_empty_table_and_clashing_columns(nothing, odd):
    assert jaccard.classes(nothing).count() == 0
    assert jaccard.classes(odd).columns == ["doc_id", "n_shingles", "component_id"]


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [(100 - k, " ".join(words[6 * k:6 * k + 200])) for k in range(40)]
    want = brute(rows)
    assert len({c for *_, c in want}) == 1
    assert got(frame(spark, rows)) == want


def test_linking_sets_share_a_key():
    rng = random.Random(1)
    for share in ((9, 10), (8, 10)):
        for _ in range(400):
            n = rng.randrange(1, 60) if rng.random() < 0.7 else rng.randrange(60, 1500)
            base = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
            a, b = set(base.tolist()), set(base.tolist())
            for _ in range(rng.randrange(0, n // 8 + 2)):
                target = a if rng.random() < 0.5 else b
                if rng.random() < 0.5 and len(target) > 1:
                    target.discard(rng.choice(sorted(target)))
                else:
                    target.add(rng.getrandbits(64))
            if a != b and share[1] * len(a & b) >= share[0] * len(a | b):
                keys = [set(jaccard.meeting_keys(np.array(sorted(x), dtype=np.uint64), share).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_tree_finds_what_all_pairs_give():
    rng = random.Random(7)
    for trial in range(30):
        base = [rng.getrandbits(64) for _ in range(60)]
        sets = [np.unique(np.array([x for x in base if rng.random() < 0.97] + [rng.getrandbits(64) for _ in range(rng.randrange(4))],
                                   dtype=np.uint64)) for _ in range(25)]
        probes = [trial % 2 == 1 and i % 3 == 0 for i in range(25)]
        label = list(range(25))
        links = list(jaccard.linked(sets, probes, list(range(25))))
        real = {(i, j) for i in range(25) for j in range(i) if 10 * len(both := np.intersect1d(sets[i], sets[j])) >= 9 * (len(sets[i]) + len(sets[j]) - len(both))}
        assert all((max(p), min(p)) in real for p in links)
        for edges in (links, [p for p in real if not (probes[p[0]] and probes[p[1]])]):
            flat = list(range(25))
            for _ in flat:
                for i, j in edges:
                    flat[i] = flat[j] = min(flat[i], flat[j])
            label = flat if edges is links else label
        assert label == flat


def test_a_very_long_text(spark):
    words = [f"w{i % 7919}x{i % 5003}" for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[:200_000])), (4, "short one here")]
    assert got(frame(spark, rows)) == brute(rows)
