import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda", "zeta", "eta", "iota")):
    return " ".join(rng.choice(words) + rng.choice(("", "", ",", ".")) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, line ends of all kinds, one very long text."""
    rng = random.Random(7)
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", None, "b", 5), (4, "ONE", "fr", None, 3),
        (5, "One two\r\nthree\n\nfour", "de", "b", 20), (5, "One two\r\nthree\n\nfour", "de", "b", 20), (5, "another text of the same id", "de", "b", 27),
        (None, "a row without an id", "en", "c", 19), (6, "é日本語 🎉 ﬁ x  y", "es", "é", 15), (7, "x" * 5000, "en", "a", 5000),
        (8, "\n".join("the very same line" for _ in range(30)), "en", "a", 0), (9, prose(rng, 40_000), "en", "a", 0),
    ]
    rows += [(20 + i, "\n".join(prose(rng, 12) for _ in range(5)), "en", f"s{i % 5}", 0) for i in range(40)]
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    rows += [(100 + i, f"{prose(rng, 10)}\n{passage}\n{prose(rng, 10)}", "en", "hot", 0) for i in range(30)]
    whole = prose(rng, 200)
    rows += [(200 + i, whole if i % 2 else whole + f" tail{i}", "en", "hot", 0) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with columns that are called like those the operators compute."""
    from pyspark.sql import functions as F

    names = ("key", "version", "fp", "size", "copies", "rank", "line", "gone", "lines", "fail_bits", "n_words", "component", "target", "ids", "n_tokens", "score", "limit", "Text")
    return odd_docs.withColumns({n: F.lit("extra") for n in names if n != "Text"})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
