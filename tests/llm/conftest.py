import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Texts of every kind that an operator has to bear: null, empty, blank, no letters, ties, very long.
ODD = [None, "", " \n\t", "!!! 123 ...", "a", "İ ΣΑΣ é x́ 日本 \U0001f642", "the same words here now again", "the same words here now again", "word " * 30_000, "x" * 50_000]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with nulls in every column, a repeated row, a null id and columns of clashing names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 2 else len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[6], (None, "no id here at all my friend", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"id": F.lit("x"), "score": F.lit("y"), "kept": F.lit(1), "ids": F.lit(2), "a": F.lit(3), "component": F.lit(4), "n": F.lit(5), "_text": F.lit(6)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
