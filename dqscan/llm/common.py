"""Helpers shared by the corpus operators: table access, bytes of texts, hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dqscan.operators.graph import components
from dqscan.plans.spool import new_path, passing, spool

__all__ = ["components", "ids_of", "mixed", "new_path", "on_workers", "passing", "pieces", "prefix_hash", "schema_of", "small_batches", "span_hash", "spool", "table", "text_bytes"]

#: Stands for a null doc_id wherever ids travel as plain 64-bit integers; it sorts first, as nulls do.
NULL_ID = -(2**63)

#: Multiplier of the polynomial hashes; odd, so that it has an inverse modulo 2**64.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Ships this package to the executors, once a session, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_dqscan_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "dqscan_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._dqscan_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keeps an Arrow batch of texts within a worker's memory, by rows and by bytes. Settings of the session that no result depends on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def schema_of(first: T.StructType, rest: str) -> T.StructType:
    """The fields of `first`, which may have any names, and those of a DDL string."""
    return T.StructType([*first.fields, *T._parse_datatype_string(rest).fields])


# ---------------------------------------------------------------- bytes of texts


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece holds at most `limit` bytes of text, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- hashing


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64 for i < n, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        made = []
        for x in (base, inverse):
            p = np.full(size, np.uint64(x))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
        if size > 1 << 24:
            del _powers[base]
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums S with S[j] - S[i] = sum of values[t] * base**t, and the inverse powers that shift it to 0."""
    n = len(values)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, down


def span_hash(pre: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts:ends] for every pair, the same wherever the span lies."""
    sums, down = pre
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
