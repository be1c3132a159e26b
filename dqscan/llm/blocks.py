"""Rows packed into blocks, and a count-min sketch over blocks that grows with the input.

`packed` writes a table's rows once, some megabytes of text a row, bucketed by block number. What a
stage finds out about a block goes back to it by that number, so that texts never travel again: the
bucketed side of the join stays where it is.

`counted` is the sketch. Every block sends the cells of its own partial sketch to the shards of the
sketch, which are ranges of the hash; a shard adds up the partial sketches it gets, as wide as their
number asks for, and answers each block for each of its entries whether its count may reach two. No
machine holds more than a shard, shards are added as the input grows, and the share of single
entries that pass stays the same at every size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, new_path, on_workers, passing, small_batches

#: Bytes of text a block holds, unless a single row has more.
BLOCK = 2 << 20


def _murmur(x: int, seed: int = 42) -> int:
    """Spark's hash of a long, by which buckets are dealt (Murmur3, 32 bits)."""
    h, mask = seed, 0xFFFFFFFF
    for k in (x & mask, x >> 32 & mask):
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) * 0x1B873593 & mask
        h ^= k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def _numbers(task: int, buckets: int) -> Iterator[int]:
    """Block numbers of a task, all of which fall into one bucket, so that a task writes one file."""
    x = task << 40
    while True:
        if _murmur(x) % buckets == task % buckets:
            yield x
        x += 1


def packed(rows: DataFrame, text: str, size: int, name: str, limit: int = BLOCK) -> DataFrame:
    """(block, data): the rows as compressed Arrow batches in the shared folder, bucketed by block.

    Numbers follow from a task's place among the tasks and are fixed once the table is written.
    """
    spark = rows.sparkSession
    on_workers(spark)
    small_batches(spark)
    # Fewer buckets than shuffle partitions, and joins would deal the blocks out anew.
    buckets = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (16 << 20)), 100_000))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(TaskContext.get().partitionId(), buckets)
        held, total = [], 0

        def send():
            whole = pa.Table.from_batches(held).combine_chunks()
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + (not held), int(np.searchsorted(ends, before + limit - total, "right")))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    total += int(ends[to - 1] - before)
                    at = to
                if at < batch.num_rows or total >= limit:
                    yield send()
                    held, total = [], 0
        if held:
            yield send()

    at = f"dqscan_{name}_{uuid.uuid4().hex}"
    made = rows.mapInArrow(pack, "block long, data binary")
    path = new_path(spark, name)
    made.write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(at)
    passing(spark, path)
    table = spark.table(at)
    spark.sql(f"DROP TABLE {at}")  # the name alone; the files stay
    return table


def opened(data: bytes) -> pa.RecordBatch:
    """The rows of a block."""
    with pa.ipc.open_stream(data) as r:
        return r.read_all().combine_chunks().to_batches()[0]


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """(block, data, known): each block with all (kind, shard, answer) that are meant for it."""
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    known = every.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "answer")).alias("known"))
    return blocks.join(known.hint("shuffle_hash"), "block", "left")


def known_of(known: list | None, kind: int) -> dict[int, bytes]:
    """shard -> answer of one kind."""
    return {x["shard"]: x["answer"] for x in known or () if x["kind"] == kind}


def asked(rows: DataFrame, ask: Callable[[bytes, list | None], Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]], kind: int) -> DataFrame:
    """(block, kind, shard, answer): `ask` makes (shard, piece) of a block, `answer` sees all pieces of a shard."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known") if "known" in batch.schema.names else None
            for k, block in enumerate(batch.column("block").to_pylist()):
                found = list(ask(batch.column("data")[k].as_py(), known[k].as_py() if known is not None else None))
                if found:
                    arrays = [pa.array([s for s, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([p for _, p in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "piece"])

    def answering(key, group):
        shard, n = key[0].as_py(), group.num_rows
        got = answer([x.as_py() for x in group["piece"]])
        return pa.table({"block": group["block"], "kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "answer": pa.array(got, pa.binary())})

    return rows.mapInArrow(asking, "shard int, block long, piece binary").groupBy("shard").applyInArrow(answering, "block long, kind int, shard int, answer binary")


class Sketch:
    """A count-min sketch in shards. Counts are only ever overestimated.

    An entry is the first `bits` bits of a hash, which grow with the number expected: about one in
    2**SPARE single entries shares them with another one. A shard has `depth` rows of CELLS counters
    or more for every entry it gets, and holds one of them at a time.
    """

    depth = 3
    SPARE, CELLS, SHARD = 7, 4, 2 << 20

    def __init__(self, expected: int):
        self.shards = int(max(12, -(-expected // self.SHARD)))
        self.bits = int(min(64, max(24, np.ceil(np.log2(max(2, expected))) + self.SPARE)))
        self.wide = -(-(2**self.bits) // self.shards)

    def entries(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different entries of a block in ascending order, how often each is met, and the entry of each hash.

        Hashes are mixed anew, as those that were picked for being small would crowd the first shards.
        """
        v, where, n = np.unique(mixed(hashes) >> np.uint64(64 - self.bits), return_inverse=True, return_counts=True)
        return v, n, where

    def _cuts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shards that entries fall into, and where each one's begin."""
        shard = v // np.uint64(self.wide)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)])
        return shard[first].astype(np.int64), np.r_[first, len(v)]

    def pieces(self, v: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The block's partial sketch, cut by shard: entries as differences, and their counts, 255 at most."""
        shards, cuts = self._cuts(v)
        for k, shard in enumerate(shards.tolist()):
            own, times = v[cuts[k] : cuts[k + 1]] - np.uint64(shard * self.wide), n[cuts[k] : cuts[k + 1]]
            steps = np.diff(own >> np.uint64(16), prepend=np.uint64(0))
            counts = b"" if (times == 1).all() else np.minimum(times, 255).astype(np.uint8).tobytes()
            far = steps[steps >= 255].tobytes()
            yield shard, np.array([len(own), len(far), len(counts)], np.int64).tobytes() + (own & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + np.minimum(steps, 255).astype(np.uint8).tobytes() + far + counts

    @staticmethod
    def _read(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, far, counts = np.frombuffer(piece, np.int64, 3).tolist()
        low = np.frombuffer(piece, np.uint16, n, 24)
        steps = np.frombuffer(piece, np.uint8, n, 24 + 2 * n).astype(np.uint64)
        steps[steps == 255] = np.frombuffer(piece[24 + 3 * n : 24 + 3 * n + far], np.uint64)
        return np.cumsum(steps, dtype=np.uint64) << np.uint64(16) | low, np.frombuffer(piece, np.uint8, counts, 24 + 3 * n + far) if counts else np.ones(n, np.uint8)

    def estimates(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Counts of all entries of all pieces, from the sum of their partial sketches."""
        sizes = [int(np.frombuffer(p, np.int64, 1)[0]) for p in pieces]
        to = np.cumsum([0, *sizes])
        v, n = np.empty(to[-1], np.uint64), np.empty(to[-1], np.uint8)
        for k, p in enumerate(pieces):
            v[to[k] : to[k + 1]], n[to[k] : to[k + 1]] = self._read(p)
        width = max(6, int(np.ceil(np.log2(self.CELLS * len(v)))))
        out = np.full(len(v), 2**32 - 1, np.uint32)
        counters = np.empty(1 << width, np.uint32)
        parts = [slice(k, k + (1 << 18)) for k in range(0, len(v), 1 << 18)]
        for row in range(self.depth):
            cells = lambda part: (mixed(v[part] + np.uint64((row + 1) * 0xC2B2AE3D27D4EB4F % 2**64)) >> np.uint64(64 - width)).astype(np.int64)  # noqa: E731, B023
            counters[:] = 0
            for part in parts:
                np.add.at(counters, cells(part), n[part].astype(np.uint32))  # other types take a slow path
            for part in parts:
                np.minimum(out[part], counters[cells(part)], out=out[part])
        return np.split(out, to[1:-1])

    def codes(self, v: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """For each entry of a block: 0 single, 1 perhaps repeated, 2 perhaps met `hot` times."""
        shards, cuts = self._cuts(v)
        out = np.zeros(len(v), np.uint8)
        for k, shard in enumerate(shards.tolist()):
            n = int(cuts[k + 1] - cuts[k])
            bits = np.unpackbits(np.frombuffer(answers[shard], np.uint8)).reshape(-1, -(-n // 8) * 8)[:, :n]
            out[cuts[k] : cuts[k + 1]] = bits.sum(0)
        return out


def counted(rows: DataFrame, hashes: Callable[[bytes, list | None], np.ndarray], sketch: Sketch, kind: int, hot: int | None = None) -> DataFrame:
    """Answers of the sketch over the hashes of all blocks: one bit an entry, and a second one where `hot` is given."""

    def ask(data: bytes, known: list | None) -> Iterator[tuple[int, bytes]]:
        found = hashes(data, known)
        if len(found):
            v, n, _ = sketch.entries(found)
            yield from sketch.pieces(v, n)

    def answer(pieces: list[bytes]) -> list[bytes]:
        return [np.packbits(e >= 2).tobytes() + (np.packbits(e >= hot).tobytes() if hot else b"") for e in sketch.estimates(pieces)]

    return asked(rows, ask, answer, kind)
