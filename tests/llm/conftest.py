import pytest

ROWS = [
    (1, "One two three four five. The quick brown fox jumps over the lazy dog", "en", "a", 5),
    (1, "One two three four five. The quick brown fox jumps over the lazy dog", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (None, "no id here but words", None, "b", 1),
    (5, "word", "en", "b", 4),
    (6, "é ß 日本 🙂 <|endoftext|> ~1 <s>[x]</s>", "de", "a", 9),
    (7, "long " * 30000, "en", "a", 9),
    (8, "x" * 50000, "en", "a", 9),
    (9, "All rights reserved.\nReleased under the MIT License.", "fr", "a", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names could clash."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "component_id", "score", "path", "host", "salt", "n", "window", "label", "mask", "key", "ids"):
        rows = rows.withColumn(name, F.lit("other"))
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
