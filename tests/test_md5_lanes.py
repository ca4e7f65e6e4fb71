"""MD5 of many texts at once, and the draws of the bootstrap made from it."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierlens.operators import md5_lanes, metrics


def test_digests_of_all_lengths():
    rng = np.random.default_rng(2)
    for size in range(1, 56):
        texts = rng.integers(32, 127, (7, size)).astype(np.uint8)
        got = np.stack(md5_lanes.md5_words(md5_lanes.block_words(texts), 7), axis=1)
        want = [np.frombuffer(hashlib.md5(bytes(x)).digest(), ">u4") for x in texts]
        assert (got == np.stack(want)).all()
    with pytest.raises(ValueError, match="one block"):
        md5_lanes.block_words(np.zeros((1, 56), np.uint8))


def test_digit_ranges_cover_all_numbers():
    found = [(x, places) for lo, hi, places in md5_lanes.digit_ranges(7, 20_050) for x in range(lo, hi)]
    assert found == [(x, len(str(x))) for x in range(7, 20_050)]
    assert bytes(md5_lanes.digits(np.array([100, 987]), 3).reshape(-1)) == b"100987"


@pytest.mark.parametrize("groups", [1, 1000, 11_000])
def test_draws_fall_where_their_index_says(spark, monkeypatch, groups):
    monkeypatch.setattr(metrics, "_DRAWS_A_TASK", 4000)
    slices = -(-groups // 4000)
    parts = iter([pa.RecordBatch.from_pydict({"id": list(range(2 * slices))})])
    got = Counter()
    for batch in metrics._fallen(42, groups, 11, slices)(parts):
        for r in batch.to_pylist():
            got[r["replicate"], r["_bucket_no"]] += r["_m"]
    drawn = spark.range(11 * groups).select(F.expr(f"id div {groups}").alias("r"), F.expr(f"id % {groups}").alias("d"))
    index = metrics.draw_index(42, groups, F.col("r"), F.col("d"))
    want = {(x.r, x.b): x["count"] for x in drawn.select("r", F.floor(index / 1024).alias("b")).groupBy("r", "b").count().collect()}
    assert dict(got) == want


def test_picks_inside_a_bucket():
    replicates, draws = [3, 9, 10, 128], np.array([1, 41, 1100, 5000])
    got = {}
    for row, pick in metrics._picks(7, 12, replicates, draws):
        for r, x in zip(row.tolist(), pick.tolist()):
            got.setdefault(replicates[r], Counter())[x] += 1
    for r, m in zip(replicates, draws.tolist()):
        digests = b"".join(hashlib.md5(f"7|{r}|12|{k}".encode()).digest() for k in range(-(-m // 4)))
        assert got[r] == Counter(np.frombuffer(digests, ">u4")[:m].tolist())


def test_draws_make_no_row_each(spark):
    """The draws of a replicate are counted where they are made: no plan has a row per replicate and draw."""
    df = spark.range(300).select(F.col("id").cast("double").alias("v"), (F.col("id") % 150).alias("g"))
    plan = metrics.bootstrap_replicates(df, "v", "g", 40, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(concat_ws(|, 42" not in plan and "Range (0, 6000" not in plan
