"""Canonical tables of one source, built once per source version and read back by every job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelgrid.session import path_exists, session_dir


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of all source files, those in table folders too; changes with the data."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(jvm_path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return ";".join(sorted(seen))


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named table of this source version, written by `build` if it is not there yet."""
    path = session_dir(spark, f"{name}|{source_version(spark, sf_dir)}")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def staged(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether `stage` has written the named table of this source version."""
    return path_exists(spark, f"{session_dir(spark, f'{name}|{source_version(spark, sf_dir)}')}/_SUCCESS")


def store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a store that all jobs of this application on this source version share."""
    return session_dir(spark, f"{name}|{source_version(spark, sf_dir)}")
