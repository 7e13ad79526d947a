import random

import pytest

# columns that operators use for names of their own
CLASHING = "id fp component component_id score lang_pred held_out host lines epoch n_tokens n key text_hash tokens ids start part"


@pytest.fixture(scope="session")
def prose():
    """A maker of repeatable invented prose."""

    def make(n, seed):
        draw = random.Random(seed)
        parts = "an be co di en fo gu hi jo ka le mo ni op qu ra si to um ve".split()
        words = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 5))) for _ in range(n)]
        return " ".join(words)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Null ids, texts, sources and languages, blank, long and repeated texts, clashing names."""
    long = prose(60_000, 1)
    rows = [
        (1, prose(80, 2), "en", "a"),
        (1, prose(80, 2), "en", "a"),
        (2, prose(80, 2), "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\r\x0b ", "de", "b"),
        (6, long, "fr", "b"),
        (7, long + " one more", "fr", "b"),
        (None, prose(90, 3), None, "c"),
        (None, None, None, None),
        (8, "Ünïcode   ß 漢字 \U0001f600 é", "de", "c"),
        (9, "word", "en", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHING.split():
        docs = docs.selectExpr("*", f"'other' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
