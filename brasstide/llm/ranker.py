"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.llm.common import written

#: Labelled rows the ranker is fitted on at most (those with the least hash of their id).
SAMPLE_ROWS = 20_000
#: Preference pairs each document of the smaller class takes part in.
PAIRS = 24
THRESHOLD = 0.3

FEATURES = ("log_words", "mean_length", "shout_share", "mixed_share", "symbol_share", "digit_share",
            "bang_share", "bar_share", "stutter_share", "repeat_share", "capital_share", "mark_share",
            "repeated_lines", "comma_share", "stop_share", "log_stutters", "log_marks", "log_bars", "log_shouts",
            "stutter_run", "mark_run", "shout_run")
_STOPS = frozenset("the of and to in that is with for on by it der die und den von zu mit ist des im le la les de et "
                   "en un une que pour dans el los y las del por con se para".split())


def features(text: str) -> list[float]:
    """Shares, counts and longest runs that tell running prose from junk; all zero for an empty text."""
    from math import log1p
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    shouts = marks = bars = stutters = stops = letters = 0
    run = {"stutter": 0, "mark": 0, "shout": 0}
    best = dict(run)
    previous = None
    for w in words:
        if w == previous:
            stutters += 1
            run["stutter"] += 1
        else:
            if run["stutter"] > best["stutter"]:
                best["stutter"] = run["stutter"]
            run["stutter"] = 0
        previous = w
        if w.isalpha():
            letters += 1
            odd = False
        else:
            last = w[-1]
            odd = last in "#*$%&|<>" and len(w) > 1
            if w == "|":
                bars += 1
        if odd:
            marks += 1
            run["mark"] += 1
        elif run["mark"]:
            best["mark"] = max(best["mark"], run["mark"])
            run["mark"] = 0
        if len(w) > 1 and w.isupper():
            shouts += 1
            run["shout"] += 1
        elif run["shout"]:
            best["shout"] = max(best["shout"], run["shout"])
            run["shout"] = 0
        if w in _STOPS:
            stops += 1
    for k, v in run.items():
        best[k] = max(best[k], v)
    symbols = sum(map(text.count, "#*$%&|<>"))
    digits = sum(map(text.count, "0123456789"))
    bangs = text.count("!")
    lines = [x for x in text.split("\n") if x]
    # shares lean to zero in short texts: a single word proves nothing
    most = n + 5
    return [log1p(n), chars / n, shouts / most, (n - letters) / most, symbols / (chars + 20), digits / (chars + 20),
            bangs / most, bars / most, stutters / most, (n - len(set(words))) / most,
            sum(w[0].isupper() for w in words) / most, marks / most, (len(lines) - len(set(lines))) / (len(lines) + 5),
            text.count(",") / most, stops / most, log1p(stutters), log1p(marks), log1p(bars), log1p(shouts),
            log1p(best["stutter"]), log1p(best["mark"]), log1p(best["shout"])]


def _measure(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        rows = [features(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass
class Ranker:
    """weights over standardised features; score = logistic(slope * (margin - cut) + logit(threshold))."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float
    threshold: float

    def scores(self, x):
        """Scores in (0, 1) of feature rows; at the cut quantile the score is the threshold."""
        import numpy as np
        z = np.clip((np.asarray(x, dtype=float) - self.mean) / self.scale, -8, 8)
        margin = z @ np.asarray(self.weights)
        at = self.slope * (margin - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  label: str = "quality", modulus: int = 5, sample_rows: int = SAMPLE_ROWS):
    """Features and labels of at most `sample_rows` labelled rows, as arrays.

    Only rows with crc32(id as text) mod `modulus` other than 0 and a label are ever read. The
    sample is the rows with the least (hash of id, id): sorted and cut by Spark, so what reaches the driver is
    bounded by the parameter. A document without a row, or a label without one, drops out.
    """
    import numpy as np
    usable = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (held_out("doc_id", modulus) == F.lit(False)))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = written(chosen, "labelled-sample")
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text)).join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = (texts.mapInArrow(_measure, f"doc_id {docs.schema[key].dataType.simpleString()}, x array<double>")
            .join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "x").limit(2 * sample_rows).toPandas())
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return x, rows["y"].to_numpy(dtype=int)


def fit(x, y, pairs: int = PAIRS, rounds: int = 400, ridge: float = 1e-3, threshold: float = THRESHOLD) -> Ranker:
    """Bradley-Terry weights: P(good beats bad) = logistic(w . (good - bad)).

    Each row of the smaller class meets `pairs` rows of the other, spread evenly; the logistic loss
    on the feature differences falls by accelerated gradient steps. The cut is the quantile of the training margins that
    parts them with the least balanced error, and the slope is fitted there. With a class missing
    every score is the same: just above the threshold without bad rows, below it without good ones.
    """
    import numpy as np
    good, bad = x[y == 1], x[y != 1]
    if not len(good) or not len(bad):
        sure = 1.0 if len(good) or not len(bad) else -1.0
        k = len(FEATURES)
        return Ranker([0.0] * k, [1.0] * k, [0.0] * k, -sure, 1.0, threshold)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    g, b = z[y == 1], z[y != 1]
    few, many = (g, b) if len(g) <= len(b) else (b, g)
    step = np.arange(len(few) * pairs)
    left = few[step % len(few)]
    right = many[(step * 7919 + step // len(few)) % len(many)]
    diff = left - right if few is g else right - left
    w = np.zeros(diff.shape[1])
    ahead, pace = w.copy(), 1.0
    rate = 4 / (np.linalg.norm(diff, 2) ** 2 / len(diff) + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ ahead, -30, 30)))
        new = ahead + rate * (diff.T @ p / len(diff) - ridge * ahead)
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / next_pace * (new - w)
        w, pace = new, next_pace
    margin = z @ w
    order = np.sort(margin)
    marks = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    marks = np.unique(marks[np.linspace(0, len(marks) - 1, min(len(marks), 2000)).astype(int)])
    # cumulative counts at each candidate quantile
    lost_good = np.searchsorted(np.sort(margin[y == 1]), marks, side="left") / len(good)
    kept_bad = 1 - np.searchsorted(np.sort(margin[y != 1]), marks, side="left") / len(bad)
    error = lost_good + kept_bad
    ties = np.flatnonzero(error <= error.min() + 1e-12)
    cut = float(marks[ties].mean())
    spread = float(np.std(margin)) or 1.0
    return Ranker(mean.tolist(), scale.tolist(), w.tolist(), cut, 4.0 / spread, threshold)


def held_out(key: str = "doc_id", modulus: int = 5) -> Column:
    """True for the rows that stay out of training; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def scored(docs: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text", modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null texts score as empty ones.

    Only the text enters a score. Repeated rows score alike; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                s = ranker.scores([features(t.as_py() or "") for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    found = docs.select(F.col(key), F.col(text)).mapInArrow(judge, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out("doc_id", modulus).alias("held_out"), "score",
                        (F.col("score") >= ranker.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, whose text scores at or above the threshold."""
    schema = docs.schema
    at = docs.columns.index(text)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                s = ranker.scores([features(t.as_py() or "") for t in batch.column(at)])
                yield batch.filter(pa.array(s >= ranker.threshold))

    return docs.mapInArrow(keep, schema)
