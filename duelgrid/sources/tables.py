"""Canonical tables on disk: layout, versions, checks before a replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.session import path_exists, run_dir

MANIFEST_SCHEMA = "source_version string, location string, built_at timestamp"


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite a dated table, partitioned by year and ordered inside its files.

    The rebalance splits a year that is too large for one task and joins years that are small.
    """
    dated = df.withColumn("event_year", F.year("event_date"))
    dated.hint("rebalance", "event_year").sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "event_year"
    ).parquet(path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("event_year")


def current_version(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(source version, location) of the newest complete build below `root`."""
    if not path_exists(spark, f"{root}/manifest/_SUCCESS"):
        return None
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")
    newest = rows.agg(F.max_by(F.struct("source_version", "location"), "built_at").alias("v")).first()["v"]
    return newest["source_version"], newest["location"]


def refresh_if_stale(spark: SparkSession, root: str, wanted: str, build: Callable[[str], None]) -> dict:
    """Build the tables unless the manifest already names `wanted`.

    `build` gets a fresh location. The manifest row is written last, so a build that dies half-way
    is never taken for complete.
    """
    current = current_version(spark, root)
    if current and current[0] == wanted:
        return {"source_version": wanted, "location": current[1], "rebuilt": False}
    location = run_dir(spark, "canonical")
    build(location)
    row = spark.range(1).select(
        F.lit(wanted).alias("source_version"), F.lit(location).alias("location"), F.current_timestamp().alias("built_at")
    )
    row.write.mode("append").parquet(f"{root}/manifest")
    return {"source_version": wanted, "location": location, "rebuilt": True}


def schema_violations(df: DataFrame, expected: list[str]) -> DataFrame:
    """Columns that are missing from or unknown to the expected header. Looks at the header only."""
    spark = df.sparkSession
    rows = [(c, "missing") for c in expected if c not in df.columns]
    rows += [(c, "unexpected") for c in df.columns if c not in expected]
    return spark.createDataFrame(rows, "column_name string, problem string")


def replace_checked(df: DataFrame, expected: list[str], root: str) -> str:
    """Write a new copy of a source table if it has every expected column; returns its location."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"not the expected source table, missing columns: {missing}")
    location = run_dir(df.sparkSession, root)
    df.write.parquet(location)
    return location
