"""Block-compressed class matrices, for exchange with other tools; Parquet is the format to store them in.

The file counts its leading classes that are just the transcript of their own number. The other classes follow in blocks: for
each the number of its transcripts, then their differences raised by one, a run of neighbours as 2 and its length, all
Fibonacci-coded in words of 16 bits. Blocks are coded and decoded one by one, so that no task holds a matrix.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, blocks

MAGIC, END = b"BEC\0", bytes(8)
NEIGHBOUR = 2  # the raised difference of neighbours
WORD_BITS = 16


def codes(txs: list[int]) -> list[int]:
    """The numbers that stand for a class of these transcripts, which are in order."""
    out = [len(txs)]
    for step, run in groupby(b - a + 1 for a, b in zip([0, *txs], txs)):
        n = sum(1 for _ in run)
        out += [step, n] if step == NEIGHBOUR else [step] * n
    return out


def transcripts(numbers: Iterator[int]) -> list[int]:
    """The transcripts of the class whose numbers come next."""
    n, out, last = next(numbers), [], 0
    while len(out) < n:
        step = next(numbers)
        times = next(numbers) if step == NEIGHBOUR else 1
        for _ in range(times):
            last += step - 1
            out.append(last)
    return out


def encode_block(classes: list[list[int]]) -> bytes:
    numbers = np.array([c for txs in classes for c in codes(txs)], np.uint64)
    body = blocks.to_bytes(blocks.fibonacci(numbers), WORD_BITS)
    return struct.pack("<Q", len(body) << 30 | len(classes)) + body


def decode_block(body: bytes, rows: int) -> list[list[int]]:
    numbers = iter(blocks.unfibonacci(blocks.to_bits(body, WORD_BITS))[0].tolist())
    return [transcripts(numbers) for _ in range(rows)]


def write_bec(ec_tx: DataFrame, path: str, rows: int = blocks.ROWS) -> None:
    """``ec_tx`` (ec, tx) as one file; classes must be numbered from 0 without gaps."""
    sets = ec_tx.groupBy("ec").agg(F.array_sort(F.collect_set("tx")).alias("txs"))
    itself = (F.size("txs") == 1) & (F.get("txs", F.lit(0)) == F.col("ec"))
    n, least, last, first_other = sets.agg(F.count(F.lit(1)), F.min("ec"), F.max("ec"), F.min(F.when(~itself, F.col("ec")))).first()
    if n and (least != 0 or last != n - 1):
        raise ValueError("classes must be numbered from 0 without gaps")
    own = n if first_other is None else first_other

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield pa.RecordBatch.from_arrays([pa.array([encode_block(b.column(0).slice(at, rows).to_pylist())], pa.binary())], names=["chunk"])

    def every() -> Iterator[bytes]:
        yield MAGIC + struct.pack("<2I", own, n - own)
        packed = sets.where(F.col("ec") >= own).orderBy("ec").select("txs").mapInArrow(pack, "chunk binary")
        yield from (bytes(r[0]) for r in packed.toLocalIterator(prefetchPartitions=True))
        yield END

    binary.write_file(ec_tx.sparkSession, path, every())


def read_bec(spark: SparkSession, path: str) -> DataFrame:
    """(ec, tx) of a compressed class matrix: one task cuts it at its heads, then every block is decoded on its own."""
    head = binary.read_head(spark, path, 12)
    if head[:4] != MAGIC:
        raise ValueError("no compressed class matrix")
    own = struct.unpack("<2I", head[4:12])[0]

    def cut(batches):
        for b in batches:
            for content in b.column(0):
                raw, at, n = content.as_py(), 12, own
                while (word := struct.unpack("<Q", raw[at : at + 8])[0]) != 0:
                    size, rows = word >> 30, word & ((1 << 30) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([raw[at + 8 : at + 8 + size]], pa.binary()), pa.array([rows], pa.int64())], names=["n", "body", "rows"])
                    at, n = at + 8 + size, n + rows

    def decode(batches):
        for b in batches:
            for n, body, rows in zip(*(c.to_pylist() for c in b.columns)):
                got = decode_block(body, rows)
                yield pa.RecordBatch.from_arrays([pa.array(range(n, n + rows), pa.int32()), pa.array(got, pa.list_(pa.int32()))], names=["ec", "txs"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "n long, body binary, rows long")
    others = found.repartition("n").mapInArrow(decode, "ec int, txs array<int>").select("ec", F.explode("txs").alias("tx"))
    first = spark.range(own).select(F.col("id").cast("int").alias("ec"), F.col("id").cast("int").alias("tx"))
    return first.unionByName(others)
