"""Figures of the last n rows of a key, over rows that arrive in order as Arrow batches.

Spark partitions rows by key, sorts and numbers them; a task reads them as a stream. A row's window are
the rows just before it in the stream, as far as its number within the key reaches back, so many short
keys share a batch and a long key is never held whole: of the batch before, only the rows that windows
still reach are kept. A window frame of Spark would add up its n rows anew, one by one, for every row.

A column is a pair (values, defined): undefined entries hold 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Pair = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Slide:
    """`of(number, *columns)`, a pair, from columns whose last `reach` rows matter besides a row's own."""

    of: Callable[..., Pair]
    sources: tuple[str, ...]
    reach: int


@dataclass(frozen=True)
class Scan:
    """`sources[0]` smoothed exponentially with factor `alpha`, shown from its n-th value on. Undefined entries
    after the first value add nothing; what came before weighs less and less."""

    alpha: float
    n: int
    sources: tuple[str, ...]


@dataclass(frozen=True)
class Walk:
    """`start()` gives a function of (number, *columns), called with the rows of one batch after the
    other; it keeps what it must remember. Undefined entries are NaN."""

    start: Callable[[], Callable[..., np.ndarray]]
    sources: tuple[str, ...]


def _spans(x: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """Row by row the n values that end `back` rows before it."""
    padded = np.concatenate([np.zeros(n - 1 + back, dtype=x.dtype), x[:len(x) - back]])[:len(x) + n - 1]
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def _whole(number: np.ndarray, defined: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """Whether the key has all n rows, each of them defined."""
    return (number >= n - 1 + back) & _spans(defined, n, back).all(axis=1)


def mean(n: int) -> Callable[..., Pair]:
    def of(number, x):
        v, known = x
        # Measured from the row's own value: equal values give just that value.
        return v + (_spans(v, n) - v[:, None]).mean(axis=1), _whole(number, known, n)
    return of


def deviation(n: int, sample: bool = False, times: float = 1.0) -> Callable[..., Pair]:
    def of(number, x):
        v, known = x
        return (_spans(v, n) - v[:, None]).std(axis=1, ddof=int(sample)) * times, _whole(number, known, n)
    return of


def highest_before(n: int) -> Callable[..., Pair]:
    return lambda number, x: (_spans(x[0], n, 1).max(axis=1), _whole(number, x[1], n, 1))


def lowest_before(n: int) -> Callable[..., Pair]:
    """What is not a number counts as the largest, as it does in Spark."""
    return lambda number, x: (np.fmin.reduce(_spans(x[0], n, 1), axis=1), _whole(number, x[1], n, 1))


def growth(n: int) -> Callable[..., Pair]:
    """Change against the value n rows before."""
    def of(number, x):
        v, known = x
        old, was = _spans(v, 1, n)[:, 0], _spans(known, 1, n)[:, 0]
        fit = (number >= n) & known & was & (old != 0)
        return np.divide(v, old, out=np.ones_like(v), where=fit) - 1.0, fit
    return of


def percentile_rank(lookback: int) -> Callable[..., Pair]:
    """Share of the previous `lookback` rows' values that are <= this one (this row excluded)."""
    distance = np.arange(lookback, 0, -1)

    def of(number, x):
        v, known = x
        past = _spans(known, lookback, 1) & (distance <= number[:, None])
        size = past.sum(axis=1)
        below = (past & ((_spans(v, lookback, 1) <= v[:, None]) | np.isnan(v)[:, None])).sum(axis=1)
        return below / np.maximum(size, 1), known & (size >= max(lookback // 2, 1))
    return of


class _Smoothing:
    """A scan over batch after batch: the level and the number of values of the key that the last one ended in."""

    def __init__(self, scan: Scan):
        self.alpha, self.n = scan.alpha, scan.n
        self.level, self.seen = 0.0, 0

    def __call__(self, number: np.ndarray, x: Pair) -> Pair:
        v, known = x
        left = 1.0 - self.alpha
        if left <= 0.0 or not len(v):
            return v, known & self._count(number, known)[1]
        seen, shown = self._count(number, known)
        level = np.where(known, v, 0.0) * np.where(known & (seen == 1), 1.0, self.alpha)
        if number[0] > 0:
            level[0] += left * self.level
        # Each step adds what lies k rows before, which by then stands for the k rows up to there.
        k, decay = 1, left
        while k < len(level) and decay > 1e-300:       # old rows count however small newer ones are
            level[k:] += np.where(number[k:] >= k, decay, 0.0) * level[:-k]
            k, decay = 2 * k, decay * decay
        self.level = level[-1]
        return level, shown

    def _count(self, number: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values the key has had up to each row, and whether they are enough."""
        if not len(number):
            return number, known
        total = np.cumsum(known)
        begun = np.maximum.accumulate(np.where(number == 0, np.arange(len(number)), -1))
        seen = total - np.where(begun > 0, total[begun - 1], np.where(begun == 0, 0, -self.seen))
        self.seen = seen[-1]
        return seen, seen >= self.n


def _pair(column: pd.Series) -> Pair:
    values = column.to_numpy(float)
    known = ~np.isnan(values)
    return np.where(known, values, 0.0), known


def add(df: DataFrame, figures: dict[str, Slide | Scan], walks: dict[str, Walk], number: str = "_i") -> DataFrame:
    """One column each, in order: a figure may read the figures before it, a walk all of them.

    `df` must be partitioned by key and sorted within its partitions by key and `number`, the row's
    place within its key from 0. Rows stay where they are, and only the columns read go to Python.
    """
    if not figures and not walks:
        return df
    read = list(dict.fromkeys(s for x in [*figures.values(), *walks.values()] for s in x.sources
                              if s not in figures and s not in walks))
    # A slide is made anew for the rows that are kept; a scan goes on from where it was, so its figures are kept.
    scans = [n for n, x in figures.items() if isinstance(x, Scan)]
    tail: dict[str, int] = {}
    for name, x in figures.items():
        tail[name] = 0 if name in scans else x.reach + max((tail.get(s, 0) for s in x.sources), default=0)
    keep = max(tail.values(), default=0)
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in (*figures, *walks)])

    def stream(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        before: dict[str, Pair] | None = None
        walking = {n: x.start() for n, x in walks.items()}
        smoothing = {n: _Smoothing(figures[n]) for n in scans}

        def after(name: str, new: Pair) -> Pair:
            return new if before is None else tuple(np.concatenate(x) for x in zip(before[name], new))

        for columns in batches:
            size = len(columns[0])
            found = {c: after(c, _pair(x)) for c, x in zip((number, *read), columns)}
            at = found[number][0]
            first = len(at) - size
            with np.errstate(all="ignore"):
                for name, x in figures.items():
                    sources = [found[s] for s in x.sources]
                    if name in smoothing:
                        v, known = smoothing[name](at[first:], tuple(y[first:] for y in sources[0]))
                    else:
                        v, known = x.of(at, *sources)
                    made = np.where(known, v, 0.0), known
                    found[name] = after(name, made) if name in smoothing else made
            before = {c: tuple(y[max(0, len(at) - keep):] for y in found[c]) for c in (number, *read, *scans)}
            plain = {n: np.where(d, v, np.nan)[first:] for n, (v, d) in found.items()}
            for name, x in walks.items():
                plain[name] = walking[name](at[first:], *[plain[s] for s in x.sources])
            yield pd.DataFrame({n: plain[n] for n in (*figures, *walks)})

    # Not deterministic by row: what it gives hangs on the rows before, so no filter may go below it.
    made = F.pandas_udf(stream, schema).asNondeterministic()(number, *read)
    return df.withColumn("_made", made).withColumns({n: F.col(f"_made.{n}") for n in (*figures, *walks)}).drop("_made")
