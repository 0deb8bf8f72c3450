import re
from collections import Counter

from brasstide.llm import rules
from tests.llm.conftest import odd_rows

WS = "[\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(WS, text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_counts_match_brute_force(spark, odd):
    more = ["a b c d e a b c d e", "a b c d e f\na b c d e f\n\n \nx", "# * $ % & | < > end", "w " * 3000, "\n\n", "a\x0bb\x0cc d"]
    df = odd.select("doc_id", "text", "q_n_words", "kept").unionByName(
        spark.createDataFrame([(100 + i, t, "x", "y") for i, t in enumerate(more)], "doc_id bigint, text string, q_n_words string, kept string"))
    got = sorted((tuple(r) for r in rules.judged(df).select(
        "doc_id", "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "base_failed").collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t in [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(more)]), key=str)
    assert got == want


def test_each_rule_is_reported_and_decides(spark):
    prose = "The weather of the day is fine and it stays so for the rest of this very long week in town"
    bad = {"symbols_per_word": prose.replace(" ", "# "), "shouted_letters": prose.upper(), "exclamations": prose.replace(" ", "! "),
           "cell_lines": prose.replace(" ", " | "), "stuttered_words": " ".join(w + " " + w for w in prose.split())}
    df = spark.createDataFrame([(n, t) for n, t in bad.items()] + [("none", prose)], "doc_id string, text string")
    for r in rules.judged(df).collect():
        assert (r.doc_id in r.broken) != (r.doc_id == "none") and r.kept == (r.doc_id == "none"), r


def test_plan_is_one_projection_without_python(documents):
    plan = rules.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_no_rules(nothing, documents):
    assert rules.judged(nothing).count() == 0
    free = rules.judged(documents, thresholds=())
    assert free.where("kept = base_failed").count() == 0
