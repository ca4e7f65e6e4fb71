"""Order-independent fingerprints of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import content_digest


def multiset_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rows, fingerprint), one row without keys: SHA-256 over the sums of four 60-bit slices of every row digest.

    Sums combine before the shuffle, so no task ever holds more than one partial state, and row order and
    partitioning do not matter.
    """
    digest = df.select(*keys, content_digest(*columns).alias("_h"))
    slices = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(4)]
    sums = digest.groupBy(*keys).agg(F.count("*").alias("rows"), *slices)
    text = F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return sums.select(*keys, "rows", F.sha2(text, 256).alias("fingerprint"))
