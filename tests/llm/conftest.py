import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, extra columns whose names clash with working columns."""
    long = "\n".join(f"line {i} of a very long text with Words and words {i % 7}" for i in range(20_000))
    common = "A line that all of them share\n"
    rows = [(1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "no id here at all but words", None, None, 3), (3, long, "en", "b", 1), (3, long, "en", "b", 1), (4, long + " x", "de", None, 1),
            (4, "same id, other text", "de", "b", 1), (5, " \n\n ", "fr", "c", 1), (None, None, None, None, None), (6, "under the MIT license", "en", "a", 1), (6, "under the MIT license", "en", "a", 1)]
    rows += [(i, common + f"own text {i} with a few more words to stand on its own feet", "en", "a", 1) for i in range(20, 35)]
    extra = "row string, tk long, key string, kept string, n_lines int, words string, target double, label string, n int, size int, fp long, h long, drops string, packed string, start int, word string, toxic int"
    values = ("r", 1, "k", "kept", 7, "w", 0.5, "l", 1, 2, 3, 4, "d", "p", 5, "word", 1)
    return spark.createDataFrame([(*r, *values) for r in rows], f"{DOC}, {extra}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
