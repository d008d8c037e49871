import os

import pytest

SMALL = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(spark, tmp_path_factory):
    from gridcells.llm.common import share_code

    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    share_code(spark)
    return spark


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(os.path.join(SMALL, "documents.parquet"))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [(1, None, "x", 1, "a"), (2, "", "x", 2, None), (3, " \n\t ", "x", 3, "c"), (None, "no id at all " * 30, "x", 4, "d"),
            (4, "one two three four five", "x", 5, "e"), (4, "one two three four five", "x", 5, "e"),
            (5, "alpha beta " * 4000, "x", None, "f"), (5, "same id, other text " * 9, "x", 7, "g"),
            (6, "x" * 200_000, "x", 8, "h"), (7, "naïve café ñandú 你好 😀 " * 60, None, 9, "i"),
            (8, "\r\x0b\x0cA B C\u0085D" * 40, "x", 10, "j"), (None, None, "x", 11, "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block string, n_words int, fingerprint string")
