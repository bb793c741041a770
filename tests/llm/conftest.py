import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows with a schema, over several partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


#: Rows that every text operator has to take: nulls in any column, empty, spaces, repeated rows, clashing columns.
ODD = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, "en", None, None),
       (3, "", None, "a", 0), (4, " \n\t ", "en", "b", 4), (None, "one two three four five six", None, "a", 27), (5, "word " * 4000, "de", "b", 20000),
       (6, "ß é 😀 ▁x\x00y", "de", None, 9), (7, "12345 678", "en", "c", 9)]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(frame):
    from pyspark.sql import functions as F

    return frame(ODD, ODD_SCHEMA).withColumns({"size": F.lit("x"), "row": F.lit(1), "_made": F.lit(2), "n_tokens": F.lit("t"), "lang_pred": F.lit("q")})


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([], ODD_SCHEMA)
