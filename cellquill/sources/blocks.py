"""Block-compressed record files, for exchange with other tools; Parquet is the format to store records in.

A block holds up to a set number of records column by column: barcodes as differences, UMIs as differences within a barcode,
classes in frames of fixed width with patched exceptions, counts and flags as they are; runs of the commonest value are
counted, and numbers are Fibonacci-coded. Blocks are coded and decoded as arrays, one block a row; ``pad`` isn't stored.

The header's text is padded so that a file takes whole pieces; tasks then read these, and whole blocks are put together by
shuffling. Files of others are read by one task each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hints import TASK_ROWS, dealt, dictionary
from . import binary

MAGIC, END = b"BUS\1", bytes(8)
ROWS, FRAME = 100_000, 512
PIECE, TASK_PIECES = 4096, 4096  # bytes of a piece; pieces of a task, if there are so many
_fib = [1, 2]
while _fib[-1] + _fib[-2] < 1 << 64:
    _fib.append(_fib[-1] + _fib[-2])
FIBONACCI = np.array(_fib, np.uint64)


def to_bytes(bits: np.ndarray, word: int) -> bytes:
    """Bits, first bit highest, in little-endian words of so many bits; the last word is filled with zeros."""
    bits = np.concatenate([bits, np.zeros(-len(bits) % word, np.uint8)])
    return np.packbits(bits).reshape(-1, word // 8)[:, ::-1].tobytes()


def to_bits(raw: bytes, word: int) -> np.ndarray:
    raw = raw[: len(raw) // (word // 8) * (word // 8)]
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, word // 8)[:, ::-1])


def fibonacci(values: np.ndarray) -> np.ndarray:
    """Bits of the Fibonacci codes of numbers from 1 on, lowest term first, each closed by a further 1."""
    rest = values.astype(np.uint64)
    top = np.searchsorted(FIBONACCI, rest, side="right") - 1
    ends = np.cumsum(top + 2)
    starts = ends - (top + 2)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    bits[ends - 1] = 1
    for i in range(int(top.max(initial=-1)), -1, -1):
        takes = rest >= FIBONACCI[i]
        bits[starts[takes] + i] = 1
        rest[takes] -= FIBONACCI[i]
    return bits


def unfibonacci(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, positions behind their codes): in a run of ones every second one closes a code."""
    ones = np.flatnonzero(bits)
    if not len(ones):
        return np.zeros(0, np.uint64), ones
    first = np.r_[True, np.diff(ones) != 1]
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(ones)), 0))
    closing = (np.arange(len(ones)) - run_start) % 2 == 1
    ends = ones[closing] + 1
    terms = ones[~closing]
    code = np.searchsorted(ends, terms, side="right")
    terms, code = terms[code < len(ends)], code[code < len(ends)]
    values = np.zeros(len(ends), np.uint64)
    place = terms - np.r_[0, ends][code]
    ok = place < len(FIBONACCI)  # what follows the column may look like longer codes
    np.add.at(values, code[ok], FIBONACCI[place[ok]])
    return values, ends


def runs_out(values: np.ndarray, common: int) -> np.ndarray:
    """Numbers to code: each run of ``common`` becomes 1 and its length; with ``common`` 0 the others are raised by one."""
    hit = values == common
    edge = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]]) if len(values) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[edge, len(values)])
    out = np.where(hit, np.uint64(1), values.astype(np.uint64) + np.uint64(common == 0))
    keep = ~hit
    keep[edge[hit[edge]]] = True
    at = np.flatnonzero(keep)
    size = np.zeros(len(values), np.int64)
    size[edge] = lengths
    pairs = np.column_stack([out[at], size[at].astype(np.uint64)])
    return pairs.ravel()[np.column_stack([np.ones(len(at), bool), hit[at]]).ravel()]


def runs_in(codes: np.ndarray, ends: np.ndarray, rows: int, common: int) -> tuple[np.ndarray, int]:
    """(values, position behind the last code) of ``rows`` values."""
    one = codes == 1
    index = np.arange(len(codes))
    start = np.maximum.accumulate(np.where(one & ~np.r_[False, one[:-1]], index, 0))
    marker = one & ((index - start) % 2 == 0)
    length = np.r_[False, marker[:-1]]  # the number after a marker
    times = np.where(marker, 0, np.where(length, np.minimum(codes, np.uint64(rows)), np.uint64(1))).astype(np.int64)
    n = int(np.searchsorted(np.cumsum(times), rows)) + 1
    value = np.where(length[:n], np.uint64(common), codes[:n] - np.uint64(common == 0))
    return np.repeat(value, times[:n])[:rows], int(ends[n - 1])


def frames(ecs: np.ndarray, frame: int) -> bytes:
    out = []
    for at in range(0, len(ecs), frame):
        part = ecs[at : at + frame].astype(np.int64)
        low = int(part.min())
        width = max(1, int(np.sort(part)[int(len(part) * 0.9)] - low).bit_length())
        part = part - low
        odd = np.flatnonzero(part >> width)
        numbers = np.concatenate([[width + 1, low + 1, len(odd) + 1], np.diff(np.r_[0, odd]) + 1, part[odd] >> width])
        out.append(to_bytes(fibonacci(numbers), 32))
        full = np.zeros(frame, np.int64)
        full[: len(part)] = part & ((1 << width) - 1)
        out.append(to_bytes(((full[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel(), 32)[: frame * width // 32 * 4])
    return b"".join(out)


def unframed(raw: bytes, rows: int, frame: int) -> tuple[np.ndarray, int]:
    out, at = [], 0
    for first in range(0, rows, frame):
        # a frame's head is short unless it has many exceptions
        reach = 256
        while True:
            numbers, ends = unfibonacci(to_bits(raw[at : at + reach], 32))
            if len(numbers) >= 3 and len(numbers) >= 3 + 2 * (int(numbers[2]) - 1) or at + reach >= len(raw):
                break
            reach *= 4
        width, low, odd = int(numbers[0]) - 1, int(numbers[1]) - 1, int(numbers[2]) - 1
        at += -(-int(ends[2 + 2 * odd]) // 32) * 4
        size = frame * width // 32 * 4
        part = to_bits(raw[at : at + size], 32).reshape(frame, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        where = np.cumsum(numbers[3 : 3 + odd].astype(np.int64) - 1)
        part[where] |= numbers[3 + odd : 3 + 2 * odd].astype(np.int64) << width
        out.append(part[: min(frame, rows - first)] + low)
        at += size
    return np.concatenate(out), at


def encode_block(raw: np.ndarray, frame: int = FRAME) -> bytes:
    """A block of records in order of barcode and UMI, with its head."""
    barcode, umi = raw["barcode"].astype(np.uint64), raw["umi"].astype(np.uint64) + np.uint64(1)
    new = np.r_[barcode[:1] != 0, barcode[1:] != barcode[:-1]]
    last = np.where(new, np.uint64(0), np.r_[np.uint64(0), umi[:-1]])
    if (barcode[1:] < barcode[:-1]).any() or (umi < last).any():
        raise ValueError("records must be sorted")
    columns = [
        to_bytes(fibonacci(runs_out(np.diff(np.r_[np.uint64(0), barcode]), 0)), 64), to_bytes(fibonacci(runs_out(umi - last, 0)), 64), frames(raw["ec"], frame),
        to_bytes(fibonacci(runs_out(raw["count"].astype(np.uint64), 1)), 64), to_bytes(fibonacci(runs_out(raw["flags"].astype(np.uint64), 0)), 64),
    ]
    body = b"".join(columns)
    return struct.pack("<Q", len(body) << 30 | len(raw)) + body


def decode_block(body: bytes, rows: int, frame: int = FRAME) -> np.ndarray:
    out, at = np.zeros(rows, binary.DTYPE), 0

    def column(common: int) -> np.ndarray:
        nonlocal at
        # 16 bytes hold any code; so many bytes hold any column
        codes, ends = unfibonacci(to_bits(body[at : at + 16 * 2 * rows + 16], 64))
        values, end = runs_in(codes, ends, rows, common)
        at += -(-end // 64) * 8
        return values

    barcode = np.cumsum(column(0), dtype=np.uint64)
    steps = np.cumsum(column(0), dtype=np.uint64)
    start = np.maximum.accumulate(np.where(np.r_[True, barcode[1:] != barcode[:-1]], np.arange(rows), 0))
    out["barcode"], out["umi"] = barcode.astype(np.int64), (steps - np.r_[np.uint64(0), steps[:-1]][start] - np.uint64(1)).astype(np.int64)
    out["ec"], size = unframed(body[at:], rows, frame)
    at += size
    out["count"], out["flags"] = column(1), column(0)
    return out


def write_busz(bus: DataFrame, path: str, bclen: int, umilen: int, frame: int = FRAME, rows: int = ROWS) -> None:
    """``bus`` in order of barcode and UMI as one file, in blocks of ``rows`` records at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield encode_block(binary._packed(b.slice(at, rows)), frame)

    def head(size: int) -> bytes:
        text = b" " * (-(32 + size + len(END)) % PIECE if size else 0)
        return MAGIC + struct.pack("<4I", binary.VERSION, bclen, umilen, len(text)) + text + struct.pack("<3I", rows, frame, 0)

    binary.write_packed(bus, path, pack, head, END)


def blocks(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(body, rows, frame) of each block of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("no block file")
    at = 20 + struct.unpack("<I", raw[16:20])[0]
    frame = struct.unpack("<3I", raw[at : at + 12])[1]
    at += 12
    while (head := struct.unpack("<Q", raw[at : at + 8])[0]) != 0:
        size, rows = head >> 30, head & ((1 << 30) - 1)
        yield raw[at + 8 : at + 8 + size], rows, frame
        at += 8 + size


def heads(spark: SparkSession, path: str) -> list[tuple[int, int, int, int, int]]:
    """(first record, where the body starts, its bytes, its records, frame) of each block; only heads are read."""
    p, fs = binary._hadoop(spark, path)
    stream, found, n = fs.open(p), [], 0
    number = lambda word: int.from_bytes(word.to_bytes(8, "big", signed=True), "little")
    try:
        stream.seek(16)
        at = 20 + (number(stream.readLong()) & 0xFFFFFFFF)
        stream.seek(at + 4)
        frame, at = number(stream.readLong()) & 0xFFFFFFFF, at + 12
        stream.seek(at)
        while (head := number(stream.readLong())) != 0:
            found.append((n, at + 8, head >> 30, head & ((1 << 30) - 1), frame))
            n, at = n + found[-1][3], at + 8 + found[-1][2]
            stream.seek(at)
    finally:
        stream.close()
    return found


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces of blocks, which follow each other in order."""
    now, held = None, []

    def block() -> pa.RecordBatch:
        first, start, size, rows, frame, piece = now
        skip = start - piece * PIECE
        return binary._arrays(decode_block(b"".join(held)[skip : skip + size], rows, frame), np.arange(first, first + rows))

    for b in batches:
        *keys, values = (c.to_pylist() for c in b.columns)
        for *key, value in zip(*keys, values):
            if now is None or key[0] != now[0]:
                if now:
                    yield block()
                now, held = key, []
            held.append(value)
    if now:
        yield block()


def read_busz(spark: SparkSession, path: str) -> DataFrame:
    """Records of a block file with their number, ``_rid``: the driver reads the blocks' heads, and every block is decoded on its own."""
    p, fs = binary._hadoop(spark, path)
    size = fs.getFileStatus(p).getLen() if fs.isFile(p) else 0
    if size and size % PIECE == 0 and binary.read_head(spark, path, 4) == MAGIC:
        table = spark.createDataFrame(heads(spark, path), "first long, start long, size long, rows long, frame long")
        table = table.withColumn("piece", F.explode(F.sequence(F.expr(f"start div {PIECE}"), F.expr(f"(start + size - 1) div {PIECE}"))))
        # a piece may hold the end of a block and the start of the next
        pieces = binary.pieces(spark, path, PIECE).withColumnRenamed("_rid", "piece").join(dictionary(table), "piece")
        pieces = dealt(pieces, size // PIECE * (TASK_ROWS // TASK_PIECES), "first").sortWithinPartitions("first", "piece")
        return pieces.select("first", "start", "size", "rows", "frame", "piece", "value").mapInArrow(_decoded, binary.SCHEMA)

    def cut(batches):
        n = 0
        for b in batches:
            for content in b.column(0):
                for body, rows, frame in blocks(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((n, pa.int64()), (body, pa.binary()), (rows, pa.int64()), (frame, pa.int64()))], names=["n", "body", "rows", "frame"])
                    n += rows

    def decode(batches):
        for b in batches:
            for n, body, rows, frame in zip(*(c.to_pylist() for c in b.columns)):
                yield binary._arrays(decode_block(body, rows, frame), np.arange(n, n + rows))

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "n long, body binary, rows long, frame long")
    return found.repartition("n").mapInArrow(decode, binary.SCHEMA)
