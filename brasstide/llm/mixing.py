"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.llm.common import small

#: Largest mean of one Poisson draw; a larger mean is the sum of several independent draws.
DRAW_MEAN = 16.0
#: Terms of the distribution function of one draw. Beyond it the tail of a mean of 16 is under
#: 1e-30, far below the 2**-52 step of the uniform number: the inversion loses nothing.
TERMS = 80


def _uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 digest as a number in [0, 1): the same on every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2 ** 52))


def _distribution(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... TERMS for a mean of at most DRAW_MEAN."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["all"]


def order_key(seed: int, key: Column, copy: Column) -> Column:
    """Place of one copy of a row in the global shuffle: a digest of (seed, key, copy)."""
    return F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(key.cast("string"), F.lit("null")), copy.cast("string")))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5,
          total: int | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate): mean copies of each document, so that sources reach their shares.

    `weights` gives target weights per source (absent sources weigh nothing); without it a source
    weighs its document count to the power `temper`. `total` is the wanted number of rows, by
    default as many as came in. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temper))))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        found = pairs[F.col("mix_source")] if weights else F.lit(None).cast("double")
        weighed = counts.withColumn("weight", F.coalesce(found, F.lit(0.0)))
    all_weight, all_n = weighed.agg(F.sum("weight"), F.sum("n")).first()
    wanted = float(total if total is not None else all_n or 0)
    share = F.col("weight") / F.lit(float(all_weight) if all_weight else None)
    return weighed.select("mix_source", "n", F.coalesce(share * wanted / F.col("n"), F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5,
        total: int | None = None, seed: int = 17, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every document as often as a Poisson number seeded by its id says, in globally shuffled order.

    Columns of `docs` plus mix_copy (0-based copy), mix_copies and mix_key (the shuffle key); columns
    that had these names give way. The count comes from inverting the distribution function at a hash of
    (seed, id, draw), so reruns, lost tasks and other partitionings give the same rows. A null id
    hashes as "null"; rows with one id get one count; an empty table stays empty. The source table
    is joined by broadcast only while it is small; a hot source needs no group of its own.
    """
    per_source = rates(docs, weights, temper, total, source)
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_MEAN), F.lit(1)).cast("int")
    per_source = per_source.withColumn("mix_draws", draws).withColumn(
        "mix_cdf", _distribution(F.col("rate") / F.col("mix_draws")))
    table = per_source.select("mix_source", "mix_draws", "mix_cdf")
    # the row travels as one struct, so that its column names can't clash
    packed = docs.select(F.col(source).alias("row_source"), F.col(key).alias("row_id"), F.struct("*").alias("row"))
    n_sources = packed.select("row_source").distinct().count()
    joined = packed.join(small(table, n_sources), F.col("row_source").eqNullSafe(F.col("mix_source")))

    def one(draw: Column) -> Column:
        u = _uniform(seed, F.col("row_id"), draw)
        return F.size(F.filter(F.col("mix_cdf"), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(0), F.col("mix_draws") - 1), F.lit(0), lambda acc, d: acc + one(d))
    order = order_key(seed, F.col("row_id"), F.col("mix_copy"))
    copied = (joined.withColumn("mix_copies", count).where("mix_copies > 0")
              .select("row", "row_id", "mix_copies", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_copy"))
              .withColumn("mix_key", order))
    own = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_copies", "mix_key")]
    return (copied.repartitionByRange("mix_key", "row_id").sortWithinPartitions("mix_key", "row_id")
            .select(*[F.col("row")[c].alias(c) for c in own], "mix_copy", "mix_copies", "mix_key"))
