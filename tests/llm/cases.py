"""Documents with every awkward case, and helpers for brute force."""

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("fp", "row", "key", "size", "unit", "shard", "items", "node", "_row", "bucket")],
])
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, None, "en", "a"), (3, "", "en", None), (4, "   \n\t ", None, None), (5, "12345 !!! ???", "de", "b"),
    (6, LONG, "en", "b"), (7, LONG + " tail", "en", "b"), (None, "Ein kurzer Satz ohne Nummer.", "de", "c"),
    (8, "Ein kurzer Satz ohne Nummer.", "de", "c"), (9, "é", "fr", "c"), (10, "a", None, ""),
]


def awkward(spark):
    extra = tuple(None for _ in SCHEMA.fieldNames()[5:])
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *extra) for r in ROWS], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def all_null(spark):
    return spark.createDataFrame([tuple(None for _ in SCHEMA)] * 3, SCHEMA)


def groups(n, links):
    """Smallest member of each connected group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()
