import gzip
import hashlib

from brasstide.llm import warc


def brute(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    seen, out = set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (html or "").encode()
        lead = first.get(data)
        revisit = len(data) >= 100 and (lead is not None and lead != page or (page, data) in seen)
        seen.add((page, data))
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    (lead if lead is not None else page) if revisit else None))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    got = warc.read(*warc.write(df, **options))
    assert sorted(map(tuple, got.drop("url").collect()), key=str) == brute(rows)
    return got


def test_odd_pages_round_trip(spark):
    big, small = "<p>" + "same " * 50, "<p>tiny"
    check(spark, [(3, "http://a/", big), (1, None, big), (2, "u\r\nInjected: 1", big), (5, "b", small), (4, "b", small), (6, "c", None),
                  (None, None, None), (None, "n", big), (7, "d", "é" * 60), (7, "d", "é" * 60), (8, "é ü", "x\r\n\r\ny" * 40), (9, "e", "")])


def test_archives_roll_and_are_deterministic(spark):
    rows = [(i, f"http://h/{i}", f"<p>{hashlib.sha256(str(i).encode()).hexdigest()}" * 5) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    (a, first), (b, second) = warc.write(df, roll_bytes=4000), warc.write(df.repartition(7), roll_bytes=4000)
    key = lambda m: sorted(map(tuple, m.collect()))
    assert key(first) == key(second) and first.count() > 8
    assert all(r.bytes < 4000 + 2000 for r in first.collect())
    name = sorted(r.file for r in first.collect())[0]
    raw = gzip.open(f"{a.removeprefix('file:')}/{name}").read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:")
    assert warc.read(a, first).count() == 200


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read(*warc.write(df)).count() == 0


def test_altered_archive_is_noticed(spark):
    import pytest
    df = spark.createDataFrame([(1, "u", "<p>" + "text " * 60)], "page_id bigint, url string, html string")
    folder, manifest = warc.write(df)
    file = f"{folder.removeprefix('file:')}/{manifest.first().file}"
    data = gzip.open(file).read().replace(b"text text", b"text tExt", 1)
    with open(file, "wb") as f:
        f.write(gzip.compress(data))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(folder, manifest).collect()
