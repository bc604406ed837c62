"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Null, empty, repeated and very long texts are handled by the operators that the stages call; see their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelgrid.llm import langid, packing, secret_scan, simhash, substring
from duelgrid.llm.arrow import spread
from duelgrid.session import run_dir

FILE_BYTES = 24 << 20  # of text in each file that a stage writes, about
REMEMBERED_UNITS = 300_000  # Python workers live through all stages, so the last one keeps less than it would alone


def _in_files(docs: DataFrame, out: DataFrame) -> DataFrame:
    """`out` in as many partitions as the stage's input fills files: no crowd of small files, no large tasks."""
    return out.coalesce(spread(docs, FILE_BYTES))

ORACLE_SQL = None  # fingerprints, token ids and the language model are beyond SQL; tests hold run() against brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return _in_files(docs, langid.recognised(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies stays."""
    return _in_files(docs, simhash.one_of_each(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of 35 words that occur more than once go; the documents stay."""
    return _in_files(docs, substring.cleaned(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become labels."""
    return _in_files(docs, secret_scan.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return _in_files(docs, packing.packed(docs, remembered=REMEMBERED_UNITS, forget=True))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), run_dir(spark, "corpus")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
