"""Text sinks of counts: labels, class matrices, histograms, copies an UMI, and a JSON summary. Each gives lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import records

PREFIX = 16  # bases shown of what is stored above the barcode
# Names of the JSON summary's entries, by column of the summaries.
NAMES = {
    "records": "numRecords", "reads": "numReads", "barcodes": "numBarcodes", "median_reads": "medianReadsPerBarcode", "mean_reads": "meanReadsPerBarcode", "umis": "numUMIs", "pairs": "numBarcodeUMIs",
    "median_umis": "medianUMIsPerBarcode", "mean_umis": "meanUMIsPerBarcode", "gt_records": "gtRecords",
}
TARGET_NAMES = {"targets": "numTargets", "median_targets": "medianTargetsPerSet", "mean_targets": "meanTargetsPerSet", "singleton_reads": "numSingleton", "gt_targets": "gtTargets"}
LISTED_NAMES = {"barcodes_onlist": "numBarcodesOnOnlist", "barcode_share": "percentageBarcodesOnOnlist", "reads_onlist": "numReadsOnOnlist", "read_share": "percentageReadsOnOnlist"}


def number(value: Column) -> Column:
    """A double without a fraction of zero."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def label_lines(labels: DataFrame) -> DataFrame:
    """Labels (label, n) one a line, for genes and for classes by name."""
    return labels.orderBy("n").select(F.col("label").cast("string").alias("value"))


def barcode_lines(labels: DataFrame, bclen: int) -> DataFrame:
    return labels.orderBy("n").select(dna.decode(F.col("label"), bclen).alias("value"))


def prefix_lines(labels: DataFrame, bclen: int) -> DataFrame:
    """What is stored above each barcode; no line if nothing is, or if barcodes leave no room."""
    above = F.shiftrightunsigned("label", 2 * bclen) if bclen < 32 else F.lit(0).cast("long")
    return labels.where(F.lit(not labels.where(above != 0).isEmpty())).orderBy("n").select(dna.decode(above, PREFIX).alias("value"))


def class_lines(ec_tx: DataFrame) -> DataFrame:
    """Each class with its transcripts in order."""
    sets = ec_tx.groupBy("ec").agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs"))
    return sets.orderBy("ec").select(F.concat_ws("\t", F.col("ec").cast("string"), "txs").alias("value"))


def histogram_lines(hist: DataFrame, genes: DataFrame) -> DataFrame:
    """A line for each gene (label, n): molecules of 1, 2, ... copies up to the last number that occurs; 0 without any."""
    bins = hist.where("n != 0").groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct(F.col("copies").cast("long"), "n"))).alias("m"), F.max("copies").cast("long").alias("last"))
    value = F.transform(F.sequence(F.lit(1).cast("long"), F.col("last")), lambda c: number(F.coalesce(F.try_element_at("m", c), F.lit(0.0))))
    rows = genes.join(bins, genes["label"] == bins["gene"], "left").orderBy(genes["n"])
    return rows.select(F.when(F.col("last").isNull(), "0").otherwise(F.array_join(value, "\t")).alias("value"))


def _with_head(head: str, rows: DataFrame) -> DataFrame:
    """``rows`` (n, value) in order, below a line of names."""
    first = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit(head).alias("value"))
    return first.unionByName(rows.withColumn("n", F.col("n").cast("long"))).orderBy("n").select("value")


def copies_lines(copies: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean copies and molecules of each gene (label, n), NA where there are none."""
    rows = genes.join(copies, genes["label"] == copies["gene"], "left")
    cells = F.concat_ws("\t", "label", F.coalesce(number(F.col("cu")), F.lit("NA")), F.coalesce(number(F.col("umis")), F.lit("0")))
    return _with_head("gene\tCU\tUMIs", rows.select("n", cells.alias("value")))


def cell_copies_lines(copies: DataFrame, cells: DataFrame, bclen: int) -> DataFrame:
    """Mean copies and molecules of each cell (label, n); a cell without any has NA and 0."""
    rows = cells.join(copies, cells["label"] == copies["barcode"], "left")
    value = F.concat_ws("\t", dna.decode(F.col("label"), bclen), F.coalesce(number(F.col("cu")), F.lit("NA")), F.coalesce(F.col("umis").cast("string"), F.lit("0")))
    return _with_head("barcode\tCU\tUMIs", rows.select("n", value.alias("value")))


def summary_json(bus: DataFrame, ec_tx: DataFrame | None = None, onlist: DataFrame | None = None, bclen: int = 32) -> DataFrame:
    """One ``value``: the figures of ``inspect`` as JSON, with those of targets and of the on-list if they are given."""
    rows, names = records.inspect(bus), dict(NAMES)
    if ec_tx is not None:
        rows, names = rows.crossJoin(F.broadcast(records.inspect_targets(bus, ec_tx))), names | TARGET_NAMES  # one row each
    if onlist is not None:
        listed = records.inspect_onlist(bus, onlist, bclen)
        rows, names = rows.crossJoin(F.broadcast(listed)), names | LISTED_NAMES  # one row each
        rows = rows.withColumns({"barcode_share": 100 * F.col("barcodes_onlist") / F.col("barcodes"), "read_share": 100 * F.col("reads_onlist") / F.col("reads")})
    return rows.select(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()])).alias("value"))
