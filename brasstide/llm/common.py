"""Shared pieces: words, files in the shared folder, and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brasstide.session import shared_folder

#: The white space that parts words: space and U+0009 to U+000D, nothing else.
SPACE = "[\\x20\\x09-\\x0D]"
_BLANKS = " \t\n\x0b\f\r"
#: Rows a table may have to be broadcast; callers count before they ask.
BROADCAST_ROWS = 200_000


def text_of(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a text without any."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/brasstide-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` stored in the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast where its counted `rows` are few; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def regrouped(batches: Iterator, same: Callable, rows: int):
    """Arrow batches of sorted rows, cut only where `same(table)` gives no group across the cut.

    `same` returns, for a table, a boolean array: row i belongs with row i-1. Pieces hold at
    least `rows` rows (the last fewer), so a group is never split over two pieces.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cuts = np.flatnonzero(~same(table)[1:])
        if len(cuts):
            at = int(cuts[-1]) + 1
            yield table.slice(0, at)
            table = table.slice(at)
        held, size = [table], table.num_rows
    if size:
        yield pa.concat_tables(held).combine_chunks()


def open_fs(uri: str):
    """(file system, path) of a shared location, for use inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
