"""Files larger than one task may read have the digest of their whole content."""

import gzip
import hashlib
import random

import pytest

from tierlens.sources import datasets, digests


@pytest.mark.parametrize("resume", [True, False])
def test_long_files_are_digested_in_blocks(spark, tmp_path, monkeypatch, resume):
    if resume and not digests.can_resume():
        pytest.skip("no libcrypto")
    monkeypatch.setattr(digests, "can_resume", lambda: resume)
    rng = random.Random(4)
    files = {
        "noise.bin": rng.randbytes(300_000), "ends.txt": b"a line\r\n\n" * 20_000, "mark.txt": b"\xef\xbb\xbfx\n" + b"y\n\n" * 30_000,
        "mark_open.txt": b"\xef\xbb\xbf" + b"no end\n" * 9_000 + b"!", "one line.txt": b"\x00\xff" * 50_000, "breaks.txt": b"\n" * 70_000,
        "packed.gz": gzip.compress(rng.randbytes(60_000)), "small.txt": b"\xef\xbb\xbfs\n", "edge.bin": rng.randbytes(32_768)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = datasets.file_manifest(spark, str(tmp_path), block_bytes=32_768).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in rows}
    assert len(rows) == len(files) and got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}


def test_no_task_is_given_a_whole_long_file(spark, tmp_path, monkeypatch):
    """The pieces of one turn of a file, which one task reads, are about a block."""
    (tmp_path / "f.bin").write_bytes(random.Random(5).randbytes(1_000_000))
    kept, cut = [], digests.cut_lineage
    monkeypatch.setattr(digests, "cut_lineage", lambda df, *by: kept.append(cut(df, *by)) or kept[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert datasets.file_manifest(spark, str(tmp_path), block_bytes=100_000).count() == 1
        turns = kept[0].selectExpr("turn", "length(content) as n").groupBy("turn").sum("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(turns) == 10 and max(r[1] for r in turns) < 110_000
