"""Binary record files: a header, then 32 bytes a record (little-endian barcode, UMI, class, count, flags, pad).

The header's text is padded so that it takes whole records; Spark then splits such a file anywhere. Files of others, with any
header, are read by one task each. To write one file of any Hadoop store, tasks write their chunks beside it, and the driver's
JVM copies these into it by a buffer; only standard output gets them through the driver's Python.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fresh, numbered

MAGIC, VERSION, RECORD = b"BUS\0", 1, 32
DTYPE = np.dtype([("barcode", "<i8"), ("umi", "<i8"), ("ec", "<i4"), ("count", "<u4"), ("flags", "<u4"), ("pad", "<u4")])
SCHEMA = "barcode long, umi long, ec int, count long, flags long, pad long, _rid long"
STDOUT = "-"
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def header(bclen: int, umilen: int, text: bytes = b"") -> bytes:
    text += b" " * (-(20 + len(text)) % RECORD)
    return MAGIC + struct.pack("<4I", VERSION, bclen, umilen, len(text)) + text


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, chunks: Iterator[bytes]) -> None:
    if path == STDOUT:
        for chunk in chunks:
            sys.stdout.buffer.write(chunk)
        sys.stdout.buffer.flush()
        return
    p, fs = _hadoop(spark, path)
    out = fs.create(p)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()


def read_head(spark: SparkSession, path: str, n: int) -> bytes:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        n = min(n, fs.getFileStatus(p).getLen())
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(n)))
    finally:
        stream.close()


def parse_header(head: bytes) -> tuple[int, int, int]:
    """(bclen, umilen, bytes of the header)."""
    if head[:4] != MAGIC:
        raise ValueError("no record file")
    _, bclen, umilen, n = struct.unpack("<4I", head[4:20])
    return bclen, umilen, 20 + n


def _arrays(raw: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(raw[f].astype(k.to_pandas_dtype()), k) for f, k in zip(DTYPE.names, KINDS)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(rid, pa.int64())], names=[*DTYPE.names, "_rid"])


def pieces(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(value, _rid): the pieces of ``size`` bytes of a file that takes whole ones, with their number."""
    rdd = spark._jsc.sc().binaryRecords(path, size, spark._jsc.hadoopConfiguration())
    rows = DataFrame(spark._jsparkSession.createDataset(rdd, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return numbered(rows.select("value", F.spark_partition_id().alias("_part")), "_part")


def read_bus(spark: SparkSession, path: str) -> DataFrame:
    """Records with their number in the file, ``_rid``."""
    _, _, n = parse_header(read_head(spark, path, 20))
    if n % RECORD == 0:
        skip = n // RECORD
        split = pieces(spark, path, RECORD).where(F.col("_rid") >= skip).select("value", F.col("_rid") - skip)
        return split.mapInArrow(lambda it: (_arrays(np.frombuffer(b"".join(b.column(0).to_pylist()), DTYPE), b.column(1).to_numpy()) for b in it if b.num_rows), SCHEMA)

    def whole(batches):
        for b in batches:
            for content in b.column(0):
                raw = np.frombuffer(content.as_buffer(), DTYPE, offset=n)
                for at in range(0, len(raw), 100_000):
                    part = raw[at : at + 100_000]
                    yield _arrays(part, np.arange(at, at + len(part)))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, SCHEMA)


CHUNK = 16 << 20  # bytes of a chunk at which it is closed


def _gathered(chunks: Iterator[bytes], least: int) -> Iterator[pa.RecordBatch]:
    """Chunks in rows of ``least`` bytes or so, each behind its length."""
    row = lambda: pa.RecordBatch.from_arrays([pa.array([struct.pack(">Q", size) + b"".join(held)], pa.binary())], names=["chunk"])
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= least:
            yield row()
            held, size = [], 0
    if size:
        yield row()


def _copied(spark: SparkSession, folder: str, path: str, head: Callable[[int], bytes], tail: bytes) -> None:
    """One file of the chunks in a folder, in order of its files; the JVM moves their bytes."""
    at, fs = _hadoop(spark, folder)
    number = lambda f: tuple(map(int, re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", f.getPath().getName()).groups("0")))
    files = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()), key=number)
    found = []  # (file, where a chunk starts, its bytes)
    for f in files:
        stream, start = fs.open(f.getPath()), 8
        while start < f.getLen():
            stream.seek(start - 8)
            found.append((f.getPath(), start, stream.readLong()))
            start += found[-1][2] + 1 + 8
        stream.close()
    p, to = _hadoop(spark, path)
    out, stream, last = to.create(p), None, None
    try:
        out.write(bytearray(head(sum(n for *_, n in found))))
        for name, start, n in found:
            if name is not last:
                if stream:
                    stream.close()
                stream, last = fs.open(name), name
            stream.seek(start)
            if spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, n) != n:
                raise OSError(f"{name.toString()} ends early")
        out.write(bytearray(tail))
    finally:
        out.close()
        if stream:
            stream.close()


def write_packed(bus: DataFrame, path: str, pack: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], head: Callable[[int], bytes], tail: bytes = b"") -> None:
    """One file of the packed chunks of an ordered DataFrame, below ``head`` (given the bytes of all chunks; none for standard output)."""
    spark, least = bus.sparkSession, CHUNK
    packed = bus.select(*[F.col(c) for c in DTYPE.names]).mapInArrow(lambda batches: _gathered(pack(batches), least), "chunk binary")
    if path == STDOUT:
        chunks = (bytes(r[0])[8:] for r in packed.toLocalIterator(prefetchPartitions=True))
        write_file(spark, path, (x for part in ((head(0),), chunks, (tail,)) for x in part))
        return
    folder = fresh(spark, "chunks")
    try:
        # the text sink writes a string's bytes as they are, and a line's end
        packed.select(F.col("chunk").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(folder)
        _copied(spark, folder, path, head, tail)
    finally:
        at, fs = _hadoop(spark, folder)
        fs.delete(at, True)


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    raw = np.zeros(batch.num_rows, DTYPE)
    for f, c in zip(DTYPE.names, batch.columns):
        raw[f] = c.to_numpy(zero_copy_only=False).astype(DTYPE[f])
    return raw


def write_bus(bus: DataFrame, path: str, bclen: int, umilen: int, text: bytes = b"") -> None:
    write_packed(bus, path, lambda batches: (_packed(b).tobytes() for b in batches), lambda _: header(bclen, umilen, text))
