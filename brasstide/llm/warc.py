"""WARC output: a deterministic sharded writer, and a reader that verifies what it reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from brasstide.llm.common import fresh_path, open_fs, small, text_of, written

#: Compressed bytes after which a task starts its next archive.
ROLL_BYTES = 32 << 20
#: Payloads under this size are always written out.
SHARED_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header_text(value: str) -> str:
    """A value that keeps to its header line: control characters percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _record(page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, revisit: bool, copy: int) -> bytes:
    """One record, gzip member of its own, with headers made anew from its content."""
    import gzip
    import uuid
    name = f"{page}|{url}|{digest}|{copy}"
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
        if refers is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, root = open_fs(folder)
        out, made = None, []
        last, copy = None, 0

        def close():
            nonlocal out
            if out is not None:
                stream, name, n, size, digest = out
                stream.close()
                fs.move(f"{name}.attempt-{task.taskAttemptId()}", name)
                made.append((name.rpartition("/")[2], n, size, digest.hexdigest()))
                out = None

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, first = (c[row].as_py() for c in batch.columns)
                # equal rows are neighbours: of one page's equal payloads the first is written out
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                shared = len(payload) >= SHARED_BYTES
                revisit = shared and (copy > 0 or first is not None and first != page)
                data = _record(page, url, payload, digest, first if first is not None else page, revisit, copy)
                if out is None:
                    name = f"{root}/pages-{task.partitionId():06d}-{len(made):05d}.warc.gz"
                    out = [fs.open_output_stream(f"{name}.attempt-{task.taskAttemptId()}", compression=None), name, 0, 0, hashlib.sha256()]
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                out[4].update(data)
                if out[3] >= roll_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["file", "records", "bytes", "sha256"])
    return write


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
          html: str = "html", roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Store every page as a WARC record and return the folder and its manifest of archives.

    Of equal payloads of SHARED_BYTES or more, the smallest key's is a response and the others
    revisits of it; a null key never is the smallest unless all are null. Null html is an empty
    payload, a null url leaves its header out. Records are range-sorted by key; each task rolls its archives by
    compressed size under temporary names, renames them when whole, and the manifest (file,
    records, bytes, sha256) commits last: readers go by it alone.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    body = text_of(html).cast("binary")
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    shared = written(base.where(F.octet_length("payload") >= SHARED_BYTES).groupBy("digest")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n"), "shared-payloads")
    marked = base.join(small(shared, shared.count()), "digest", "left")
    ranged = marked.repartitionByRange("page_id").sortWithinPartitions("page_id", "digest", "url")
    rows = ranged.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", "digest", F.col("first").cast("string"))
    files = rows.mapInArrow(_writer(folder, roll_bytes), "file string, records bigint, bytes bigint, sha256 string")
    path = f"{folder.rstrip('/')}/manifest"
    files.write.mode("overwrite").parquet(path)
    return folder, spark.read.parquet(path)


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one gzip member each, in bounded memory."""
    import zlib
    pending = b""
    while True:
        pending = pending or stream.read(size)
        if not pending:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(pending))
            pending = unpack.unused_data if unpack.eof else b""
        yield b"".join(parts)


def _reader(folder: str):
    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        fs, root = open_fs(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def fields(head: bytes) -> dict[str, str]:
            return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

        for batch in batches:
            for file in batch.to_pylist():
                found, n = [], 0
                with fs.open_input_stream(f"{root}/{file['file']}", compression=None) as stream:
                    for record in _members(stream):
                        head, _, rest = record.partition(b"\r\n\r\n")
                        meta = fields(head)
                        block = rest[:int(meta["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(fields(http)["Content-Length"])
                        digest = meta["WARC-Payload-Digest"].removeprefix("sha256:")
                        if meta["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{file['file']}: a payload differs from its digest")
                        found.append((meta.get("X-Page-Id"), meta.get("WARC-Target-URI"), length, digest, meta["WARC-Type"], meta.get("X-Refers-To-Page-Id")))
                        n += 1
                        if len(found) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                            found = []
                if n != file["records"]:
                    raise ValueError(f"{file['file']}: {n} records of {file['records']}")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
    return read


def read(folder: str, manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in the manifest's archives."""
    out = manifest.select("file", "records").repartition("file").mapInArrow(
        _reader(folder), "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})
