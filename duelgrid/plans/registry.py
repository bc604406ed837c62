"""The registered queries and, where there is one, the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUDGE = 1e-9


def query(sql: str | None = None):
    """Register a function under its own name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree.

    The nudge keeps values that lie on a rounding boundary on one side of it.
    """
    scale = f"{10.0**digits!r}D"
    return df.selectExpr(
        *[
            f"rint((`{c}` + {NUDGE!r}D) * {scale}) / {scale} AS `{c}`" if t == "double" else f"`{c}`"
            for c, t in df.dtypes
        ]
    )
