"""Token-ID output: flat unsigned integer files, 64-bit document offsets, memory-mapped reading.

A store is a folder of shards in ascending document order. Shard n has `n.ids` (token ids, little-
endian, 2 bytes each while the vocabulary allows, else 4), `n.off` (64-bit offsets of its documents
in ids, one more than documents) and `n.docs` (the documents' keys, as an Arrow file). The manifest
table names shards, their counts and `base`, the ids of all shards before: a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.llm.common import fresh_path, open_fs, text_of, written

END_ID = 0
#: Pieces of text whose ids a worker remembers: about 150 bytes each.
REMEMBERED = 1_200_000

_ENCODERS: dict = {}


class Encoder:
    """Ids of whole texts, equal to the library's own, as bytes.

    A pre-token never reaches over a single space between two non-blank characters, except that the
    space opens the next one, and a single line break between two such characters is a pre-token. So a
    text is cut there and the library encodes each distinct piece once. Texts with other blanks beside
    a space or a break, or with a special token's mark, go to the library whole.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        from array import array
        return array(self.code, ids).tobytes()

    def learn(self, pieces: set[str]) -> None:
        # an empty piece has a blank beside a break or a space at the start of a line
        good = [p for p in pieces if p == "\n" or p and not (p[-1].isspace() or p[:2].lstrip() == "" or p[0] != " " and p[0].isspace() or "<|" in p)]
        for at in range(0, len(good), 1000):
            part = good[at:at + 1000]
            for piece, found in zip(part, self.model.encode_batch(part, add_special_tokens=False)):
                self.known[piece] = self.pack(found.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in t else [""] for t in texts]
        need = set().union(*cut).difference(self.known)
        if len(self.known) + len(need) > REMEMBERED:
            # the pieces met first are the frequent ones, and stay
            self.known = dict(islice(self.known.items(), max(0, min(REMEMBERED // 2, REMEMBERED - len(need)))))
            need = set().union(*cut).difference(self.known)
        self.learn(need)
        out, get = [], self.known.__getitem__
        for text, pieces in zip(texts, cut):
            try:
                out.append(b"".join(map(get, pieces)))
            except KeyError:
                out.append(self.pack(self.model.encode(text, add_special_tokens=False).ids) if text else b"")
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(folder: str, tokenizer: str, end_id: int, slice_chars: int = 4_000_000):
    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        model = encoder(tokenizer)
        end = model.pack([end_id])
        fs, root = open_fs(folder)
        names = {kind: f"{root}/{shard:08d}.{kind}" for kind in ("ids", "off", "docs")}
        own = f".attempt-{task.taskAttemptId()}"
        docs = total = 0
        ids = off = keys = sink = None
        for batch in batches:
            if ids is None:
                ids, off, sink = (fs.open_output_stream(names[k] + own) for k in ("ids", "off", "docs"))
                off.write(np.zeros(1, dtype="<i8").tobytes())
                keys = pa.ipc.new_file(sink, pa.schema([("doc_id", batch.schema.field(0).type)]))
            start, texts = 0, []
            column = batch.column(1)
            lengths = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset:column.offset + len(column) + 1])
            while start < batch.num_rows:  # bounded slices, so that long texts don't pile up
                stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), slice_chars)))
                texts = [t or "" for t in column.slice(start, stop - start).to_pylist()]
                packed = [p + end for p in model.encode(texts)]
                sizes = np.array([len(p) // model.width for p in packed], dtype=np.int64)
                ids.write(b"".join(packed))
                off.write((total + np.cumsum(sizes)).astype("<i8").tobytes())
                total += int(sizes.sum())
                start = stop
            keys.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"]))
            docs += batch.num_rows
        if ids is None:
            return
        keys.close()
        for stream in (ids, off, sink):
            stream.close()
        for name in names.values():  # a repeated attempt replaces a file by an equal one
            fs.move(name + own, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([docs], pa.int64()),
                                          pa.array([total], pa.int64()), pa.array([model.width], pa.int32())],
                                         names=["shard", "docs", "ids", "width"])
    return write


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id",
          text: str = "text", end_id: int = END_ID, order: Column | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text and store the ids, each document closed by `end_id`.

    Returns the store's folder and its manifest (shard, docs, ids, width, base). Order: ascending
    `order`, an expression over `docs` (none: the key), then key, nulls first; rows of one key by
    their text's hash. A null text is an empty one. Documents
    are range-partitioned and each task streams its range to one shard: temporary names first, then
    renamed, so lost tasks repeat without a trace; the manifest, written last, commits the store.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    place = [] if order is None else [order.alias("place")]
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"), *place)
    by = [*(["place"] if place else []), "doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    shards = written(ranged.mapInArrow(_writer(folder, tokenizer, end_id), "shard bigint, docs bigint, ids bigint, width int"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    path = f"{folder.rstrip('/')}/manifest"
    manifest.coalesce(1).write.mode("overwrite").parquet(path)
    return folder, spark.read.parquet(path)


def _mapped(fs, path: str, kind: str):
    """A file as an array: memory-mapped where the folder is mounted, else read."""
    import numpy as np
    from pyarrow import fs as pafs
    if isinstance(fs, pafs.LocalFileSystem):
        import os
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def _reader(folder: str):
    def read(batches: Iterator) -> Iterator:
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        fs, root = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/{row['shard']:08d}"
                ids = _mapped(fs, f"{name}.ids", f"<u{row['width']}")
                off = _mapped(fs, f"{name}.off", "<i8")
                with fs.open_input_file(f"{name}.docs") as f:
                    done = 0
                    reader = pa.ipc.open_file(f)
                    for b in range(reader.num_record_batches):
                        keys = reader.get_batch(b).column(0)
                        cuts = np.asarray(off[done:done + len(keys) + 1])
                        sums = [crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                        done += len(keys)
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read(folder: str, manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a store."""
    shards = manifest.select("shard", "ids", "width", "base").repartition("shard")
    return shards.mapInArrow(_reader(folder), f"doc_id {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
