"""Small tables with nulls, repeated rows and clashing extra columns."""

import pytest
from awkward import nasty_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, bits long, v string"


@pytest.fixture(scope="session")
def nasty(spark):
    rows = [(d, t, "en" if d and d % 2 else None, "src", 0, "x", "y", 1, "z") for d, t in nasty_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
