"""Shared-folder tables between steps, and row helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a scratch folder of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_FOLDER.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


class Scratch:
    """Tables one operator writes and reads again, all below one folder.

    A written table cuts the lineage, survives lost executors, and is read without a known partitioning, so a join
    on it shuffles both sides and the adaptive planner can split a hot key.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made, self._paths = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.path}/{self._made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete every table but those the result still reads."""
        self.drop(*[df for key, (df, _) in list(self._paths.items()) if key not in {id(t) for t in tables}])


def null_safe_key(column: str, prefix: str) -> dict[str, Column]:
    """Two columns that join like ``<=>`` on a text column: its value or '', and whether it is NULL."""
    return {f"{prefix}_key": F.coalesce(F.col(column).cast("string"), F.lit("")), f"{prefix}_null": F.col(column).isNull()}


def hash_fraction_long(*parts: Column, digits: int = 15) -> Column:
    """A long from the first hex digits of md5 over the parts; NULL parts count as the text 'null'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
