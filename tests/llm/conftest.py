import pytest

LONG_TEXT = " ".join(f"word{i % 977} and{i % 31}" for i in range(5_000))
EXTRA = ("h", "fp", "words", "rank", "mix_copy", "mix_source", "q_n_words", "row", "bad_id", "kept_id", "kept", "k", "score", "at")


def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, one id twice, a long text."""
    base = [(1, "A small text of some words. It is the first of them, and not the last."), (2, None), (3, ""), (4, " \t\n "),
            (5, "two words"), (6, "one"), (None, "a text without an id but with enough words to be looked at by all rules"),
            (None, None), (7, "A small text of some words. It is the first of them, and not the last."),
            (7, "A small text of some words. It is the first of them, and not the last."), (8, "first text of this id"),
            (8, "second text of this id"), (9, LONG_TEXT), (10, "é ü   wide  spaces <|endoftext|> and\x00zero \r\n end "),
            (11, "ab" * 400), (12, "x" * 350 + " tail " + "x" * 120)]
    return [(i, t, "src0" if n % 3 else None, None if n % 2 else "en") for n, (i, t) in enumerate(base)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names operators use inside."""
    names = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *[f"{c}!" for c in EXTRA]) for r in odd_rows()],
                                 f"doc_id bigint, text string, source string, lang string, {names}").cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
