import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and repeated texts, ties, a long text, extra columns that clash."""
    long = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))
    rows = [
        (0, "the cat sat on the mat, and then it went away to sea again with nobody", "en", "a", "x"),
        (1, "", "en", "a", "x"),
        (2, None, None, None, None),
        (3, "   \t\n ", "en", "b", "y"),
        (5, "the cat sat on the mat, and then it went away to sea again with nobody", None, "b", "y"),
        (8, "the cat sat on the mat, and then it went away to sea again with nobody else", "en", None, "z"),
        (9, long, "en", "c", "z"),
        (11, long + " tail", "en", "c", "z"),
        (12, "été naïf 北京 \U0001f600 ok", "fr", "c", None),
        (None, "a row without an id", "fr", "d", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string").repartition(3)
