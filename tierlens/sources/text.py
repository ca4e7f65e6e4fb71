"""Whole-file text scans and number parsing shared by the log and geometry readers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, let

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[EeDd][-+]?\d+)?"


def read_text_files(spark: SparkSession, path) -> DataFrame:
    """(path, text), one row per file; files are independent records of bounded size."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_listed_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, text) for files Spark's readers skip because their names start with a dot.

    The folder must be mounted on every executor: a missing file gives NULL text, a missing folder is an error.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for p in batch[path]:
                try:
                    with open(p, encoding="utf-8") as handle:
                        texts.append(handle.read())
                except FileNotFoundError:
                    if not os.path.isdir(os.path.dirname(p) or "."):
                        raise
                    texts.append(None)
            yield pd.DataFrame({"path": batch[path], "text": texts})

    return paths.select(path).mapInPandas(load, "path string, text string")


def lines_of(text) -> Column:
    """Lines without a trailing empty one."""
    # no patterns: a split by one letter and a plain replacement are several times cheaper
    breaks = F.replace(col(text), F.lit("\r\n"), F.lit("\n"))
    ended = let(breaks, lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t))
    return F.split(ended, "\n")


def words_of(line: Column) -> Column:
    # a single blank is left as it is, so most lines are not written anew
    return F.split(F.trim(F.regexp_replace(line, r"\s{2,}|[\t\n\x0B\f\r]", " ")), " ")


def to_number(token: Column) -> Column:
    """Double from a token that may use D exponents; NULL when it is not a plain number."""
    plain = F.replace(F.replace(token, F.lit("D"), F.lit("E")), F.lit("d"), F.lit("E"))
    # of these letters a cast takes what NUMBER describes, no names of values, suffixes or hexadecimal digits
    return F.when(~token.rlike("[^-+.0-9EeDd]"), plain.try_cast("double"))


def last_number(text, pattern: str) -> Column:
    """First group of the last match, as a number; NULL without a match."""
    found = F.regexp_extract_all(col(text), F.lit(f"(?im){pattern}"), F.lit(1))
    return to_number(F.try_element_at(found, F.lit(-1)))
