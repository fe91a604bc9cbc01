"""What the operators of this folder share: whitespace words, folds, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and tab to carriage return. Python's bytes.split() cuts the same.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words of a text; [] for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null keys fall in no fold (-1)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % mod, F.lit(-1))


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a fresh local one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='cellquill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


#: Least rows of narrow columns, and least bytes of texts, for which a step that writes them gets a task and a file of its own.
PART_ROWS, PART_BYTES = 500_000, 32 << 20


def parts(spark: SparkSession, rows: int = 0, size: int = 0) -> int:
    """How many files so many rows or bytes are worth: two for each core at least."""
    return min(1_000_000, max(2 * spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS), -(-size // PART_BYTES)))


def table_bytes(df: DataFrame) -> int:
    """What the optimiser takes the rows to be in bytes; for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def written(df: DataFrame, name: str, rows: int = 0, size: int = 0, compression: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts lineage and outlives executors.

    A bound on its ``rows`` or on the ``size`` of what it is made from keeps a small table from being cut into many tiny files.
    """
    path = fresh(df.sparkSession, name)
    if rows or size:
        df = df.coalesce(parts(df.sparkSession, rows, size))
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: No side of more rows than this is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of narrow rows) with a broadcast hint if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted = "_" + wanted
    return wanted


#: Rows that travel between Spark and Python at once, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
