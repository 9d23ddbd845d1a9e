import pytest

LONG = " ".join(f"word{i % 977} über{i % 13}" for i in range(30_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash."""
    rows = [
        (1, WORDS, "en", "a"), (2, WORDS, "en", "a"), (3, WORDS.upper(), None, "a"),
        (4, None, "de", "b"), (5, "", "de", None), (6, " \n\t ", "de", "b"),
        (7, LONG, "de", "b"), (8, LONG + " ende", "de", "b"), (9, "ein Wort", "de", None),
        (9, "ein Wort", "de", None), (None, "ohne Nummer " + WORDS, "de", "b"), (11, "1234 !!", "en", "a"),
        (12, None, None, None),
    ]
    rows = [(*row, 1, "x", 0.5, "y", 3, True, "z", 7, 8) for row in rows]
    names = ("doc_id long, text string, lang string, source string, size int, law string, score double, "
             "lang_pred string, slot int, kept boolean, component_id string, taken int, n_lines int")
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
