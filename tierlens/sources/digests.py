"""SHA-256 of files too large for one task: read in pieces by many, digested one block after the other."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage

PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"  # names of files that Spark unpacks when it reads lines
_MARK = b"\xef\xbb\xbf"  # a line reader drops it at the start of a file


class _State(ctypes.Structure):
    """OpenSSL's SHA256_CTX, which unlike the objects of hashlib can be written down."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("sizes", ctypes.c_uint32 * 2)]


def can_resume() -> bool:
    return ctypes.util.find_library("crypto") is not None


def _crypto() -> ctypes.CDLL:
    lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
    lib.SHA256_Init.argtypes = [ctypes.c_void_p]
    lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return lib


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(located, turn, start, seq, size, content) from the lines of file splits in order.

    A line break stands before every line but the first of a file, so a piece needs nothing of its neighbours.
    """
    at, seq, done = None, 0, 0
    for batch in batches:
        split, located, start, length, block, lines = batch.columns
        keys = split.to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi == lo:
                continue
            if keys[lo] != at:
                at, seq, done = keys[lo], 0, 0
            first, some = start[lo].as_py(), lines.slice(lo, hi - lo)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), b"\n")[0].as_py()
            content = joined if first == 0 and seq == 0 else b"\n" + joined
            # the last line may reach into the next split
            turn = min(first + done, first + length[lo].as_py() - 1) // block[lo].as_py()
            yield pa.RecordBatch.from_pydict({
                "located": [located[lo].as_py()], "turn": pa.array([turn], pa.int32()), "start": [first], "seq": [seq],
                "size": [len(content)], "content": [content]})
            seq, done = seq + 1, done + len(content)


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(located, state, sha256) of each file, from rows sorted by file: the state so far, if any, then pieces in order."""
    lib = _crypto() if can_resume() else None
    at, run = None, None

    def told():
        if lib is None:
            state, digest = b"", run.digest()
        else:
            state, out = bytes(run), ctypes.create_string_buffer(32)
            lib.SHA256_Final(out, ctypes.byref(_State.from_buffer_copy(state)))
            digest = out.raw
        return pa.RecordBatch.from_pydict({"located": [at], "state": pa.array([state], pa.binary()), "sha256": [digest.hex()]})

    for batch in batches:
        for located, seq, content in zip(*(batch.column(c) for c in ("located", "seq", "content"))):
            if located.as_py() != at:
                if at is not None:
                    yield told()
                at = located.as_py()
                if lib is None:
                    run = hashlib.sha256()
                else:
                    run = _State()
                    lib.SHA256_Init(ctypes.byref(run))
            data = content.as_py()
            if seq.as_py() < 0 and lib is not None:
                run = _State.from_buffer_copy(data)
            elif lib is None:
                run.update(data)
            else:
                lib.SHA256_Update(ctypes.byref(run), data, len(data))
    if at is not None:
        yield told()


def sequential_sha256(spark: SparkSession, path, files: DataFrame, block_bytes: int) -> DataFrame:
    """(located, sha256) of ``files`` (located, bytes) below ``path``, all longer than ``block_bytes``.

    Tasks read splits of the files as lines and write them in pieces.  Turn after turn a task then digests the next
    ``block_bytes`` of a file, from the state in which the last turn left it.  Without OpenSSL's library a state cannot
    be written down, and all turns of a file are one.
    """
    where = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_block_length")]
    # "\n" alone ends a line, so every byte can be told from the lines
    chosen = (F.col("_metadata.file_size") > block_bytes) & ~F.lower("_metadata.file_name").rlike(PACKED)
    lines = spark.read.option("lineSep", "\n").text(path).where(chosen).select(
        F.xxhash64(*where[:2]).alias("split"), where[0].alias("located"), where[1].alias("start"), where[2].alias("length"),
        F.lit(block_bytes if can_resume() else 1 << 62).alias("block"), F.col("value").cast("binary").alias("line"))
    pieces = cut_lineage(lines.mapInArrow(_pieces, "located string, turn int, start long, seq long, size long, content binary"), ["turn"])
    read = pieces.groupBy("located").agg(F.sum("size").alias("read"), F.max("turn").alias("last"))
    # a line reader does not tell a last line break, nor a byte order mark, from none
    told = cut_lineage(files.join(read, "located").select("located", "last", (F.col("bytes") - F.col("read")).alias("short")))
    short, wrong = F.col("short"), F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("located")))
    told = told.withColumn("short", F.when(short.isin(0, 1, 3, 4), short).otherwise(wrong))

    def piece(df, turn, start, seq, content):
        return df.select("located", turn.alias("turn"), F.lit(start).cast("long").alias("start"), F.lit(seq).cast("long").alias("seq"), content.alias("content"))

    ends = piece(told.where("short >= 3"), F.lit(0), -1, 0, F.lit(_MARK)).unionByName(
        piece(told.where("short in (1, 4)"), F.col("last"), (1 << 63) - 1, 0, F.lit(b"\n")))
    n = told.agg(F.count("*").alias("files"), F.max("last").alias("last")).first()
    out, state = None, None
    for turn in range(n["last"] + 1):
        rows = pieces.drop("size").unionByName(ends).where(F.col("turn") == turn).select("located", "start", "seq", "content")
        if state is not None:
            going = state.join(told.where(F.col("last") >= turn).select("located"), "located")
            rows = rows.unionByName(piece(going, F.lit(turn), -1, -1, F.col("state")).drop("turn"))
        dealt = rows.repartition(min(2 * n["files"], 10_000), "located").sortWithinPartitions("located", "start", "seq")
        state = cut_lineage(dealt.mapInArrow(_updated, "located string, state binary, sha256 string"))
        ended = state.join(told.where(F.col("last") == turn).select("located"), "located").select("located", "sha256")
        out = ended if out is None else out.unionByName(ended)
    return out
