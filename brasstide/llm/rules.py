"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brasstide.llm.common import SPACE, text_of, words_of

#: Words that running text of the covered languages can't do without.
STOP_WORDS = ("the", "of", "and", "to", "in", "that", "is", "with", "for", "on", "by", "it",
              "der", "die", "und", "den", "von", "zu", "mit", "ist", "des", "im", "für", "ein",
              "le", "la", "les", "de", "et", "des", "en", "un", "une", "que", "pour", "dans",
              "el", "los", "y", "las", "del", "por", "con", "una", "se", "para")

#: (rule, measure, lowest allowed or None, highest allowed or None). A measure that is null passes.
THRESHOLDS = (
    ("mean_word_length", "mean_word_length", 1.5, 20.0),
    ("symbols_per_word", "symbol_ratio", None, 0.1),
    ("shouted_letters", "upper_ratio", None, 0.5),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("cell_lines", "bar_ratio", None, 0.05),
    ("stuttered_words", "stutter_ratio", None, 0.2),
    ("exclamations", "bang_ratio", None, 0.3),
)
MIN_WORDS = 10
#: Shorter texts may lack stop words by chance: their stop_ratio is null and passes.
STOP_MIN_WORDS = 50
REPEAT_PERCENT = 20
WINDOW = 5


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus the counts and ratios of the rules, prefixed `q_`; row by row, no shuffle.

    A null text counts as empty: every count is 0 and the ratios are null. n_repeat_words is the
    size of the union of all WINDOW-word windows that occur at least twice in the text: windows
    are sorted by hash with their place, so that equal ones are neighbours, whatever the length.
    """
    df = docs.withColumn("q_text", text_of(text))
    df = df.withColumn("q_words", words_of(F.col("q_text")))
    df = df.withColumns({
        "q_n_words": F.size("q_words").cast("bigint"),
        "q_word_chars": F.char_length(F.array_join("q_words", "")).cast("bigint"),
        "q_n_symbols": F.char_length(F.regexp_replace("q_text", "[^#*$%&|<>]+", "")).cast("bigint"),
        "q_lines": F.filter(F.split("q_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        "q_n_stop": F.size(F.filter(F.transform("q_words", F.lower), lambda w: w.isin(*STOP_WORDS))),
        "q_n_stutter": F.size(F.filter("q_words", lambda w, i: F.when(
            i > 0, w == F.col("q_words")[F.greatest(i - 1, F.lit(0))]).otherwise(False))),
        "q_n_bars": F.size(F.filter("q_words", lambda w: w == "|")),
        "q_n_bangs": F.char_length(F.regexp_replace("q_text", "[^!]+", "")),
        "q_n_upper": F.char_length(F.regexp_replace("q_text", "[^\\p{Lu}]+", "")),
        "q_n_letters": F.char_length(F.regexp_replace("q_text", "[^\\p{L}]+", "")),
        "q_windows": F.when(F.size("q_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("q_words") - WINDOW),
            lambda i: F.xxhash64(*[F.col("q_words")[i + k] for k in range(WINDOW)]))),
    })
    df = df.withColumn("q_repeats", F.coalesce(F.size(F.array_distinct("q_windows")) < F.size("q_windows"), F.lit(False)))
    df = df.withColumn("q_placed", F.when(F.col("q_repeats"), F.array_sort(F.transform(
        "q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("q_placed") - 1
    twice = F.filter("q_placed", lambda p, j: (
        F.when(j > 0, F.col("q_placed")[F.greatest(j - 1, F.lit(0))]["h"] == p["h"]).otherwise(False)
        | F.when(j < last, F.col("q_placed")[F.least(j + 1, last)]["h"] == p["h"]).otherwise(False)))
    df = df.withColumn("q_starts", F.array_sort(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(
        "q_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")))["n"]
    df = df.withColumns({
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint"),
        "q_n_lines": F.size("q_lines"),
        "q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
    })

    # One row a row: a generator keeps a filter on the results from being rewritten, through all
    # these layers, into an expression of the text that repeats each of them many times over.
    counts = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_n_lines", "q_n_stop",
              "q_n_bars", "q_n_bangs", "q_n_upper", "q_n_letters", "q_n_stutter"]
    df = df.select(*docs.columns, F.explode(F.array(F.struct(*counts))).alias("q")).select(*docs.columns, *[F.col("q")[c].alias(c) for c in counts])

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double"))

    return df.withColumns({
        "q_mean_word_length": ratio("q_word_chars", "q_n_words"),
        "q_symbol_ratio": ratio("q_n_symbols", "q_n_words"),
        "q_upper_ratio": ratio("q_n_upper", "q_n_letters"),
        "q_stop_ratio": F.when(F.col("q_n_words") >= STOP_MIN_WORDS, ratio("q_n_stop", "q_n_words")),
        "q_stutter_ratio": ratio("q_n_stutter", "q_n_words"),
        "q_dup_line_ratio": ratio("q_n_dup_lines", "q_n_lines"),
        "q_bar_ratio": ratio("q_n_bars", "q_n_words"),
        "q_bang_ratio": ratio("q_n_bangs", "q_n_words"),
    })


def compiled(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one expression: the names of the rules a row breaks."""
    broken = []
    for name, measure, low, high in thresholds:
        value = F.col(f"q_{measure}")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < F.lit(low))
        if high is not None:
            bad = bad | (value > F.lit(high))
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")


def judged(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """`docs` with measures, base_failed, broken (names of broken rules) and kept.

    base_failed: under MIN_WORDS words, or over REPEAT_PERCENT percent of the words in repeated
    windows. Null and empty texts fail. Columns of `docs` that start with q_ or carry the names
    of results would clash and are replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    clash = {"base_failed", "broken", "kept", "q"}
    docs = docs.select(*[c for c in docs.columns if not c.startswith("q_") and c not in clash])
    df = measures(docs, text)
    failed = (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words"))
    return (df.withColumn("base_failed", failed).withColumn("broken", compiled(thresholds))
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)))
