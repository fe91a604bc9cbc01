"""Text sources and sinks; records as tab-separated lines, dictionaries as whitespace-separated ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.hints import dictionary


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir, or a local one where that is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='cellquill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def to_lines(bus: DataFrame, bclen: int, umilen: int, flags: bool = False, pad: bool = False) -> DataFrame:
    """One ``value`` a record; ``bclen`` 32 shows what is stored above the barcode too."""
    cols: list[Column] = [dna.decode(F.col("barcode"), bclen), dna.decode(F.col("umi"), umilen), F.col("ec").cast("string"), F.col("count").cast("string")]
    cols += [F.col(c).cast("string") for c, on in (("flags", flags), ("pad", pad)) if on]
    return bus.select(F.concat_ws("\t", *cols).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of lines; blank ones and comments are skipped, a fifth token counts as flags if it is a whole number."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = lines.select(line.alias("l"), *[c for c in lines.columns if c == "_rid"]).where("l != '' AND NOT startswith(l, '#')").withColumn("p", F.split("l", " "))
    whole = lambda i: F.get("p", F.lit(i)).try_cast("long")
    return parts.select(
        dna.encode(F.get("p", F.lit(0))).alias("barcode"), dna.encode(F.get("p", F.lit(1))).alias("umi"), whole(2).cast("int").alias("ec"), whole(3).alias("count"),
        F.coalesce(whole(4), F.lit(0).cast("long")).alias("flags"), F.lit(0).cast("long").alias("pad"), *[c for c in lines.columns if c == "_rid"],
    )


def numbered(rows: DataFrame, *block: str) -> DataFrame:
    """``rows`` with their number, ``_rid``: a row's place in its input block, behind the rows of all blocks before.

    ``block`` are columns that name a row's block and sort blocks; a block is read by one task. Two passes, no Python.
    """
    rows = rows.withColumn("_i", F.monotonically_increasing_id())
    blocks = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    blocks = blocks.select(*block, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    return rows.join(dictionary(blocks), list(block)).withColumn("_rid", F.col("_i") + F.col("_base")).drop("_i", "_base", *block)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _rid): lines with their number over all files in order of name."""
    return numbered(spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start")), "_file", "_start")


def read_text(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Records of text files; with ``numbered`` also their line's number, which costs a second pass over the files."""
    return from_lines(numbered_lines(spark, path) if numbered else spark.read.text(path))


def write_text(bus: DataFrame, path: str, bclen: int, umilen: int, flags: bool = False, pad: bool = False) -> None:
    to_lines(bus, bclen, umilen, flags, pad).write.text(path)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    return lines.select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("p"), "_rid").where("size(p) > 0")


def read_ecs(spark: SparkSession, path: str) -> DataFrame:
    """(ec, tx) of a class matrix; transcripts in any order, separated by commas."""
    return _tokens(spark, path).select(F.get("p", F.lit(0)).cast("int").alias("ec"), F.explode(F.split(F.get("p", F.lit(1)), ",").cast("array<int>")).alias("tx")).distinct()


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(tx, name): transcripts numbered in order of the file."""
    return _tokens(spark, path).select(F.col("_rid").cast("int").alias("tx"), F.get("p", F.lit(0)).alias("name"))


def read_genes(spark: SparkSession, path: str, transcripts: DataFrame) -> DataFrame:
    """(tx, gene) of the known transcripts; of repeated ones the last line holds."""
    t = _tokens(spark, path).select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("gene"), "_rid")
    return t.groupBy("name").agg(F.max_by("gene", "_rid").alias("gene")).join(transcripts, "name").select("tx", "gene")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, dest) of a map, cluster or replacement file; of repeated sources the last line holds."""
    t = _tokens(spark, path).where("size(p) > 1").select(F.get("p", F.lit(0)).alias("source"), F.get("p", F.lit(1)).alias("dest"), "_rid")
    return t.groupBy("source").agg(F.max_by("dest", "_rid").alias("dest"))


def read_onlist(spark: SparkSession, path: str) -> DataFrame:
    """(column, barcode, bases): the sets of an on-list, a column each; - is no entry."""
    return _tokens(spark, path).select(F.posexplode("p").alias("column", "s")).where("s != '-'").select("column", dna.encode(F.col("s")).alias("barcode"), F.length("s").alias("bases")).distinct()


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """(value, prefix): barcodes or UMIs to capture; ``prefix`` for 16 bases and a star."""
    t = _tokens(spark, path).select(F.get("p", F.lit(0)).alias("s"))
    return t.select(dna.encode(F.rtrim(F.col("s"), F.lit("*"))).alias("value"), (F.endswith("s", F.lit("*")) & (F.length("s") == 17)).alias("prefix"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, seq, qual) of a FASTQ file, plain or compressed as Spark's text source reads it."""
    lines = numbered_lines(spark, path).select(F.floor(F.col("_rid") / 4).alias("ordinal"), (F.col("_rid") % 4).alias("k"), "value")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return lines.groupBy("ordinal").agg(F.substring(part(0), 2, 1 << 30).alias("name"), part(1).alias("seq"), part(3).alias("qual"))


def write_reads(reads: DataFrame, path: str) -> None:
    """Gzipped FASTQ in order of the ordinal."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), F.col("seq"), F.lit("+"), F.col("qual"))
    reads.orderBy("ordinal").select(record.alias("value")).write.option("compression", "gzip").text(path)


def indexed(counts: DataFrame, row: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, col, value) numbered from 1, and both label tables (n, label), labels in order."""
    labels = [counts.select(F.col(c).alias("label")).distinct().withColumn("n", F.row_number().over(Window.orderBy("label"))) for c in (row, column)]
    out = counts.join(labels[0].withColumnsRenamed({"label": row, "n": "_r"}), row).join(labels[1].withColumnsRenamed({"label": column, "n": "_c"}), column)
    return out.select(F.col("_r").alias("row"), F.col("_c").alias("col"), "value"), *labels


def matrix_lines(triplets: DataFrame) -> DataFrame:
    """Matrix Market lines in order; the size line is padded to 66 characters."""
    size = triplets.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count(F.lit(1)).alias("n"))
    head = size.select(F.lit(0).alias("k"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.concat(F.lit("%%MatrixMarket matrix coordinate real general\n%\n"), F.rpad(F.concat_ws(" ", F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0)), "n"), 66, " ")).alias("value"))
    value = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    body = triplets.select(F.lit(1).alias("k"), "row", "col", F.concat_ws(" ", F.col("row"), F.col("col"), value).alias("value"))
    return head.unionByName(body).orderBy("k", "row", "col").select("value")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a Matrix Market file."""
    body = numbered_lines(spark, path).where("NOT startswith(value, '%')")
    first = body.agg(F.min("_rid").alias("first"))
    p = body.crossJoin(F.broadcast(first)).where("_rid > first").select(F.split(F.trim("value"), r"\s+").alias("p"))  # one row
    return p.select(F.get("p", F.lit(0)).cast("long").alias("row"), F.get("p", F.lit(1)).cast("long").alias("col"), F.get("p", F.lit(2)).cast("double").alias("value"))
