"""Where lineage is cut: tables written to the folder that ``spark.checkpoint.dir`` names and read again.

A written table survives lost executors.  It is read without a known partitioning, so a join on it shuffles both
sides directly and the adaptive planner can split a hot key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The configured folder; a session that runs on this machine alone may do without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tierlens-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame, partition_by=()) -> DataFrame:
    """Write ``df`` once to shared storage so that later steps restart from files, not from a long plan."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_lineage(spark: SparkSession) -> None:
    """Delete every table this application has cut; DataFrames that still read one can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
