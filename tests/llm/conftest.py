import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, label string, host string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    word = ["alpha", "beta", "Gamma", "delta", "naïve", "日本語", "omega", "zeta"]
    long = " ".join(word[(i * 7 + i // 5) % 8] + str(i % 97) for i in range(40_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 1, 9, 0.5, "x", "h"),
        (2, "One  two three\nfour five six seven", None, "a", 1, 9, 0.5, "x", "h"),
        (3, None, "en", "b", None, None, None, None, None),
        (4, "", "en", None, 0, 0, 0.0, "", ""),
        (5, " \t\n", "en", None, 3, 0, 0.0, "", ""),
        (6, "two words", "en", "b", 9, 1, 0.1, "y", "h"),
        (7, "two words", "en", "c", 9, 1, 0.1, "y", "h"),
        (7, "two words", "en", "c", 9, 1, 0.1, "y", "h"),
        (8, long, "en", "c", len(long), 1, 0.1, "y", "h"),
        (9, long + " tail", "en", "c", len(long) + 5, 1, 0.1, "y", "h"),
        (10, "x" * 50_000, "en", "d", 50_000, 1, 0.1, "y", "h"),
        (None, "two words", None, None, None, None, None, None, None),
        (11, "mail a.b@c.example.org ip 10.0.0.1 card 4111 1111 1111 1111 call +1 (413) 555-2866", "en", "d", 1, 1, 0.1, "y", "h"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
