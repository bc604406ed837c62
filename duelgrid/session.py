"""Where a job may keep tables between steps."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings that suit these jobs. The method limit sends stages with very wide projections to
# Spark's split code path, because the JVM does not compile methods above that size.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a local-mode session may run without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="duelgrid-")
    return _LOCAL_DIRS[context.applicationId]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder for one run of a job."""
    return f"{shared_dir(spark)}/duelgrid/{label}-{uuid.uuid4().hex}"


def session_dir(spark: SparkSession, label: str) -> str:
    """A folder name below the shared folder that all jobs of this application agree on."""
    digest = hashlib.sha256(label.encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/duelgrid/{spark.sparkContext.applicationId}-{digest}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def written(df: DataFrame, path: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """Write once, read back with the known schema: cuts lineage and survives lost executors.

    `rules` name conditions that no row may fulfil (NULL counts as fulfilled). One aggregation over the rules' columns of
    the written table counts such rows, and the first broken rule raises before anyone else reads the table. No
    `observe`: the session then holds its observations, and fitted models, whose summaries hold the session, could no
    longer be sent to tasks.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if rules:
        breaches = [F.count_if(F.coalesce(broken, F.lit(True))).alias(f"rule_{i}") for i, broken in enumerate(rules.values())]
        for name, n in zip(rules, table.agg(*breaches).first()):
            if n:
                raise ValueError(f"data quality: {name}: {n} rows")
    return table
