"""Tables that streams keep: corrections merged day by day, late rows set apart, views recomputed on close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _replace_days(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


class TableMerge:
    """foreachBatch writer that keeps the newest version of each key in a table partitioned by `day`.

    A batch reads and rewrites only the days it brings rows for. A row replaces the stored one if its
    `order` values are newer. Rows whose event time `at` lies more than `delay` behind the latest time
    of the batches before go to a table of late rows instead, one folder a batch. Running a batch
    again rewrites its own days and folders with the same rows.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], day: str = "day", at: str = "at", delay: str | None = None):
        self.path, self.keys, self.order, self.day, self.at, self.delay = path, keys, order, day, at, delay

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/table")

    def late(self, spark: SparkSession) -> DataFrame | None:
        return _read(spark, f"{self.path}/late")

    def _on_time(self, rows: DataFrame, batch: int) -> DataFrame:
        spark = rows.sparkSession
        marks = _read(spark, f"{self.path}/marks")
        before = marks.where(F.col("batch") < batch).agg(F.max("latest")).first()[0] if marks is not None else None
        one = rows.agg(F.max(self.at).alias("latest")).withColumn("batch", F.lit(batch))
        _replace_days(one, f"{self.path}/marks", "batch")
        if before is None or self.delay is None:
            return rows
        line = F.lit(before).cast(rows.schema[self.at].dataType) - F.expr(f"INTERVAL {self.delay}")
        _replace_days(rows.where(F.col(self.at) < line).withColumn("batch", F.lit(batch)), f"{self.path}/late", "batch")
        return rows.where((F.col(self.at) >= line) | F.col(self.at).isNull())

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = self._on_time(rows, batch)
        stored = _read(spark, f"{self.path}/table", rows.schema)
        if stored is not None:
            days = rows.select(self.day).distinct()
            rows = rows.unionByName(stored.join(days, self.day, "left_semi").select(rows.columns))
        w = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        newest = rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
        _replace_days(newest, f"{self.path}/table", self.day)


class ViewStore:
    """foreachBatch writer of views recomputed when a day closes: one row per (key, as_of, version).

    Batches bring closed bars (as `daily_bars` emits them once the watermark has passed a day's end).
    They join the history kept beside the views, then `compute(history, days)` makes the view rows of
    the closed days, `days` being (as_of) rows. Both are written by day, replacing what the same days
    held, so a batch that runs twice leaves each key once.
    """

    def __init__(self, path: str, compute: Callable[[DataFrame, DataFrame], DataFrame], version: str, key: str = "ticker", day: str = "day"):
        self.path, self.compute, self.version, self.key, self.day = path, compute, version, key, day

    def views(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/views")

    def __call__(self, bars: DataFrame, batch: int) -> None:
        spark = bars.sparkSession
        if bars.isEmpty():
            return
        TableMerge(f"{self.path}/history", [self.key, self.day], [self.day], self.day, self.day)(bars, batch)
        days = bars.select(F.col(self.day).alias("as_of")).distinct()
        made = self.compute(spark.read.parquet(f"{self.path}/history/table"), days).withColumn("version", F.lit(self.version))
        stored = _read(spark, f"{self.path}/views", made.schema)
        if stored is not None:  # other versions of the same days stay
            kept = stored.where(F.col("version") != self.version).join(days, "as_of", "left_semi")
            made = made.unionByName(kept.select(made.columns))
        _replace_days(made, f"{self.path}/views", "as_of")


def trailing_views(history: DataFrame, days: DataFrame, key: str = "ticker", reach: int = 5) -> DataFrame:
    """Mean and range of each key's last `reach` closes on each of `days`; only bars within reach are read."""
    w = Window.partitionBy(key).orderBy("day").rowsBetween(-reach + 1, 0)
    seen = history.withColumns({"mean": F.avg("close").over(w), "low": F.min("close").over(w), "high": F.max("close").over(w),
                                "bars": F.count("close").over(w)})
    return seen.withColumnRenamed("day", "as_of").join(days, "as_of", "left_semi").select(key, "as_of", "mean", "low", "high", "bars")
