"""Record-wise operators and small aggregates: sort, correct, capture, project, linker, collapse, inspect, allowlist, extract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.hints import dealt, dictionary
from .count import MOLECULE, molecules

ORDERS = {
    "default": ("barcode", "umi", "ec", "flags"),
    "umi": ("umi", "barcode", "ec"),
    "flags": ("flags", "pad", "ec", "barcode", "umi"),
    "count": ("count", "barcode", "umi", "ec"),
    "flags_bc": ("flags", "pad", "barcode", "umi", "ec"),
}
KEYS = ("barcode", "umi", "ec", "flags", "pad")


def merged(bus: DataFrame, no_flags: bool = False) -> DataFrame:
    """Duplicate records merged, their counts summed."""
    bus = bus.withColumn("flags", F.lit(0).cast("long")) if no_flags else bus
    return bus.groupBy(*KEYS).agg(F.sum("count").alias("count"))


def sort(bus: DataFrame, order: str = "default", no_flags: bool = False) -> DataFrame:
    """Merged records in a global order, the remaining keys breaking ties; range-partitioned, so it scales out."""
    first = ORDERS[order]
    keys = [*first, *(k for k in (*KEYS, "count") if k not in first)]
    return merged(bus, no_flags).orderBy(*[dna.unsigned(F.col(k)) if k in ("barcode", "umi") else F.col(k) for k in keys])


def corrections(onlist: DataFrame, bases: int) -> DataFrame:
    """(seen, barcode): on-list values as they are, and values with exactly one on-list value one base away."""
    near = onlist.select(F.col("barcode"), F.explode(dna.neighbours(F.col("barcode"), bases)).alias("seen"))
    near = near.groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.min("barcode").alias("barcode")).where("n = 1").join(onlist.select(F.col("barcode").alias("seen")), "seen", "left_anti")
    return onlist.select(F.col("barcode").alias("seen"), "barcode").unionByName(near.select("seen", "barcode"))


def correct(bus: DataFrame, segments: list[tuple[DataFrame, int]]) -> DataFrame:
    """Barcodes corrected segment by segment (given from left to right as on-list and length); a record goes if any fails.

    Adds ``corrected``, the number of segments that changed. Bits above the barcode stay.
    """
    total = sum(n for _, n in segments)
    out, right = bus.withColumn("_new", F.col("barcode").bitwiseAND(F.lit(~dna.mask(total)))).withColumn("corrected", F.lit(0)), total
    for listed, n in segments:
        right -= n
        part = F.shiftrightunsigned("barcode", 2 * right).bitwiseAND(F.lit(dna.mask(n)))
        table = corrections(listed.select("barcode").distinct(), n).select(F.col("seen").alias("_seen"), F.col("barcode").alias("_parent"))
        out = out.withColumn("_part", part).join(dictionary(table), F.col("_part") == F.col("_seen"))
        out = out.withColumn("_new", F.col("_new").bitwiseOR(F.shiftleft("_parent", 2 * right))).withColumn("corrected", F.col("corrected") + (F.col("_part") != F.col("_parent")).cast("int")).drop("_part", "_seen", "_parent")
    return out.withColumn("barcode", F.col("_new")).drop("_new")


def correct_exact(bus: DataFrame, onlist: DataFrame, bases: int) -> DataFrame:
    """Only records whose barcode is on the list."""
    table = onlist.select(F.col("barcode").alias("_b")).distinct()
    return bus.join(dictionary(table), F.col("barcode").bitwiseAND(F.lit(dna.mask(bases))) == F.col("_b"), "left_semi")


def halves(onlist: DataFrame, bases: int) -> list[tuple[DataFrame, int]]:
    """Segments for the correction of both halves on their own; the recombined barcode isn't checked."""
    low = bases // 2
    return [(onlist.select(F.shiftrightunsigned("barcode", 2 * low).alias("barcode")).distinct(), bases - low), (onlist.select(F.col("barcode").bitwiseAND(F.lit(dna.mask(low))).alias("barcode")).distinct(), low)]


def correct_stats(bus: DataFrame, segments: list[tuple[DataFrame, int]]) -> DataFrame:
    """One row: records on the list, corrected, and not."""
    got = correct(bus, segments).agg(F.count(F.when(F.col("corrected") == 0, 1)).alias("onlist"), F.count(F.when(F.col("corrected") > 0, 1)).alias("corrected"))
    every = bus.agg(F.count(F.lit(1)).alias("n"))
    return every.crossJoin(F.broadcast(got)).select("onlist", "corrected", (F.col("n") - F.col("onlist") - F.col("corrected")).alias("uncorrected"))  # one row each


def replace(bus: DataFrame, table: DataFrame, kind: str, bclen: int, key_len: int, length: int) -> DataFrame:
    """Barcode surgery by ``table`` (barcode, replacement), the replacement of ``length`` bases; rows without an entry stay.

    record: in place of the barcode; msb_meta and lsb_meta: into the top of the metadata, or below it; msb_bus and lsb_bus:
    over the barcode's first or last bases. A record replacement shorter than the barcode moves the metadata down.
    """
    bc, m = F.col("barcode"), dna.mask
    inside = bc.bitwiseAND(F.lit(m(bclen)))
    key = {"record": inside, "msb_bus": F.shiftrightunsigned(inside, 2 * (bclen - key_len))}.get(kind, inside.bitwiseAND(F.lit(m(key_len))))
    new, above = F.col("_r"), bc.bitwiseAND(F.lit(~m(bclen)))
    lower = F.shiftrightunsigned(bc, 2 * max(0, bclen - length)).bitwiseAND(F.lit(~m(length)))
    done = {
        "record": new.bitwiseOR(bc.bitwiseAND(F.lit(~m(max(length, bclen)))) if length >= bclen else F.lit(0).cast("long")),
        "msb_meta": F.shiftleft(new, 2 * (32 - length)).bitwiseOR(bc.bitwiseAND(F.lit(m(32 - length)))),
        "lsb_meta": F.shiftleft(new, 2 * bclen).bitwiseOR(inside).bitwiseOR(F.shiftleft(bc, 2 * length).bitwiseAND(F.lit(~m(length + bclen)))),
        "msb_bus": above.bitwiseOR(bc.bitwiseAND(F.lit(m(max(0, bclen - length))))).bitwiseOR(F.shiftleft(new, 2 * max(0, bclen - length))),
        "lsb_bus": new.bitwiseOR(bc.bitwiseAND(F.lit(~m(length)))),
    }[kind]
    if kind == "record" and length < bclen:
        done = new.bitwiseOR(lower.bitwiseAND(F.lit(~m(bclen))))
    rest = lower.bitwiseOR(bc.bitwiseAND(F.lit(m(length)))) if kind == "record" and length < bclen else bc
    joined = bus.withColumn("_k", key).join(dictionary(table.select(F.col("barcode").alias("_b"), F.col("replacement").alias("_r"))), F.col("_k") == F.col("_b"), "left")
    return joined.withColumn("barcode", F.when(F.col("_b").isNotNull(), done).otherwise(rest)).drop("_k", "_b", "_r")


def capture(bus: DataFrame, wanted: DataFrame, kind: str, bclen: int = 32, complement: bool = False, ec_tx: DataFrame | None = None) -> DataFrame:
    """Records that match ``wanted`` (value), or with ``complement`` the others. Kinds: tx, barcode, prefix (the 16 bases above the barcode, else the whole), umi, flags."""
    how = "left_anti" if complement else "left_semi"
    values = wanted.select(F.col("value").alias("_v")).distinct()
    if kind == "tx":
        known = ec_tx.select(F.col("ec").alias("_e")).distinct()
        hit = ec_tx.join(values, F.col("tx") == F.col("_v"), "left_semi").select(F.col("ec").alias("_v")).distinct()
        rows = bus.join(dictionary(known), F.col("ec") == F.col("_e"), "left_semi")  # unknown classes go in either case
        return rows.join(dictionary(hit), F.col("ec") == F.col("_v"), how)
    column = {"barcode": F.col("barcode").bitwiseAND(F.lit(dna.mask(bclen))), "prefix": F.shiftrightunsigned("barcode", 2 * bclen).bitwiseAND(F.lit(dna.mask(16))), "umi": F.col("umi"), "flags": F.col("flags")}[kind]
    return bus.join(values, column == F.col("_v"), how)


def capture_combo(bus: DataFrame, ec_tx: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captured records with their class cut down to the captured transcripts, as a sorted list."""
    values = wanted.select(F.col("value").alias("_v")).distinct()
    cut = ec_tx.join(values, F.col("tx") == F.col("_v"), "left_semi").groupBy("ec").agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs"))
    return bus.join(dictionary(cut), "ec").select(*KEYS, "count", "txs")


def project(bus: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``column`` replaced where ``table`` (source, dest) has it; of equal sources the last by dest holds."""
    t = table.groupBy(F.col("source").alias("_s")).agg(F.max("dest").alias("_d"))
    return bus.join(dictionary(t), F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_d", column)).drop("_s", "_d")


def project_genes(bus: DataFrame, ec_gene: DataFrame) -> DataFrame:
    """(barcode, umi, genes, ec, count): counts by molecule and gene set, sets numbered in lexicographic order."""
    sets = ec_gene.groupBy("ec").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    ids = sets.select("genes").distinct().withColumn("gs", (F.row_number().over(Window.orderBy("genes")) - 1).cast("int"))
    return bus.join(dictionary(sets.join(ids, "genes").select("ec", F.array_join("genes", ",").alias("genes"), "gs")), "ec").groupBy(*MOLECULE, "genes", F.col("gs").alias("gene_ec")).agg(F.sum("count").alias("count"))


def linker(bus: DataFrame, start: int, end: int, bclen: int) -> DataFrame:
    """The bases [start, end) cut out of the barcode; what stands above moves down."""
    keep = bclen - end
    prefix = F.shiftrightunsigned(F.col("barcode").bitwiseAND(F.lit(~dna.mask(bclen - start))), 2 * (end - start))
    return bus.withColumn("barcode", prefix.bitwiseOR(F.col("barcode").bitwiseAND(F.lit(dna.mask(keep)))))


def collapse(bus: DataFrame, ec_gene: DataFrame) -> DataFrame:
    """(barcode, umi, gene, count): molecules of a single gene."""
    return molecules(bus, ec_gene).where("gn = 1").select(*MOLECULE, "gene", F.col("copies").alias("count"))


RUN_BLOCK_BITS = 20  # records of a block: 2 ** 20


def with_runs(bus: DataFrame) -> DataFrame:
    """``run``: the _rid at which the run of adjacent records (by _rid) of one molecule starts.

    Blocks of neighbouring records are windowed on their own; what one block hands to the next is a row for each block.
    """
    key, before = F.struct(*MOLECULE), (Window.unboundedPreceding, -1)
    rows = bus.withColumn("_block", F.shiftright("_rid", RUN_BLOCK_BITS))
    inner, outer = Window.partitionBy("_block").orderBy("_rid"), Window.orderBy("_block")
    tails = rows.groupBy("_block").agg(F.max_by(key, "_rid").alias("_tail")).select("_block", F.lag("_tail").over(outer).alias("_ahead"))
    last = F.coalesce(F.lag(key).over(inner), F.col("_ahead"))
    rows = rows.join(tails, "_block").withColumn("_start", F.when(last.isNull() | (last != key), F.col("_rid")))
    starts = rows.groupBy("_block").agg(F.max("_start").alias("_s")).select("_block", F.last("_s", ignorenulls=True).over(outer.rowsBetween(*before)).alias("_open"))
    run = F.coalesce(F.last("_start", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return rows.join(starts, "_block").withColumn("run", run).drop("_block", "_ahead", "_start", "_open")


def collapse_runs(bus: DataFrame, ec_gene: DataFrame) -> DataFrame:
    """``collapse`` over runs in file order in place of groups: a molecule whose records are apart counts again."""
    runs = with_runs(bus)
    apart = collapse(runs.withColumn("umi", F.struct("run", "umi")), ec_gene)
    return apart.select("barcode", F.col("umi.umi").alias("umi"), "gene", "count", F.col("umi.run").alias("run"))


def inspect(bus: DataFrame) -> DataFrame:
    """One row of summary figures; molecule and barcode sums first, so that no distinct count is expanded."""
    pairs = bus.groupBy(*MOLECULE).agg(F.count(F.lit(1)).alias("records"), F.sum("count").alias("reads"), F.sum(F.when(F.col("count") % 2 == 1, 1).otherwise(-1)).alias("gt"))
    cells = pairs.groupBy("barcode").agg(F.sum("records").alias("records"), F.sum("reads").alias("reads"), F.count(F.lit(1)).alias("umis"), F.sum("gt").alias("gt"))
    total = cells.agg(
        F.sum("records").alias("records"), F.sum("reads").alias("reads"), F.count(F.lit(1)).alias("barcodes"), F.expr("percentile(reads, 0.5)").alias("median_reads"), F.avg("reads").alias("mean_reads"),
        F.sum("umis").alias("pairs"), F.expr("percentile(umis, 0.5)").alias("median_umis"), F.avg("umis").alias("mean_umis"), F.sum("gt").alias("gt_records"),
    )
    umis = pairs.groupBy("umi").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("umis"))
    return total.crossJoin(F.broadcast(umis))  # one row each


def inspect_targets(bus: DataFrame, ec_tx: DataFrame) -> DataFrame:
    """One row: distinct targets, mean and median targets a record, reads with one target."""
    sizes = ec_tx.groupBy("ec").agg(F.count(F.lit(1)).alias("n"))
    per = bus.groupBy("ec").agg(F.count(F.lit(1)).alias("records"), F.sum("count").alias("reads"))
    rows = per.join(dictionary(sizes), "ec").agg(F.sum(F.col("n") * F.col("records")).alias("targets_all"), F.sum("records").alias("r"), F.sum(F.when(F.col("n") == 1, F.col("reads")).otherwise(0)).alias("singleton_reads"), F.expr("percentile(n, 0.5, records)").alias("median_targets"))
    seen = per.join(dictionary(ec_tx), "ec").groupBy("tx").agg(F.sum("records").alias("f"))
    seen = seen.agg(F.count(F.lit(1)).alias("targets"), F.sum(F.when(F.col("f") % 2 == 1, 1).otherwise(-1)).alias("gt_targets"))
    return rows.crossJoin(F.broadcast(seen)).select("targets", (F.col("targets_all") / F.col("r")).alias("mean_targets"), "median_targets", "singleton_reads", "gt_targets")


def inspect_onlist(bus: DataFrame, onlist: DataFrame, bclen: int) -> DataFrame:
    cells = bus.groupBy(F.col("barcode").bitwiseAND(F.lit(dna.mask(bclen))).alias("b")).agg(F.sum("count").alias("reads"))
    hits = cells.join(dictionary(onlist.select(F.col("barcode").alias("b")).distinct()), "b", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("barcodes_onlist"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads_onlist"))


TOP = 10


def allowlist(bus: DataFrame, threshold: int | None = None, bclen: int = 16) -> DataFrame:
    """(barcode, reads) of at least ``threshold`` reads; without one, of the mean of the top 10, times 1 - 0.99 ** bclen, rounded down."""
    cells = bus.groupBy("barcode").agg(F.sum("count").alias("reads"))
    if threshold is not None:
        return cells.where(F.col("reads") >= threshold)
    top = cells.orderBy(F.desc("reads"), "barcode").limit(TOP).agg(F.floor(F.avg("reads") * (1 - 0.99**bclen)).alias("t"))
    return cells.crossJoin(F.broadcast(top)).where("reads >= t").select("barcode", "reads")  # one row


def cluster_histograms(bus: DataFrame, ec_gene: DataFrame, clusters: DataFrame) -> DataFrame:
    from .count import histograms

    return histograms(molecules(bus, ec_gene).join(dictionary(clusters), "barcode"), keys=("cluster", "gene"))


def extract(reads: DataFrame, bus: DataFrame, complement: bool = False, ordinal: str = "ordinal") -> DataFrame:
    """Reads whose ordinal is (or isn't) among the records' flags."""
    flags = bus.select(F.col("flags").alias("_f")).distinct()
    return reads.join(flags, F.col(ordinal) == F.col("_f"), "left_anti" if complement else "left_semi")


def mash(parts: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datasets (records, ec_tx, transcripts (tx, name)) as one: (records, ec_tx, transcripts) with new numbers.

    Transcripts are numbered by first appearance; classes are first those of one transcript each, then the other sets
    in order of file and number.
    """
    names = reduce(DataFrame.unionByName, [t.select("name", F.lit(i).alias("file"), "tx") for i, (_, _, t) in enumerate(parts)])
    names = names.groupBy("name").agg(F.min(F.struct("file", "tx")).alias("at"))
    tx = names.select("name", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("new_tx"))
    sets = []
    for i, (_, ec_tx, t) in enumerate(parts):
        moved = ec_tx.join(t.join(tx, "name").select("tx", "new_tx"), "tx")
        sets.append(moved.groupBy("ec").agg(F.array_sort(F.collect_set("new_tx")).alias("txs")).select(F.lit(i).alias("file"), "ec", "txs"))
    every = reduce(DataFrame.unionByName, sets)
    single = tx.select(F.array("new_tx").alias("txs"), F.struct(F.lit(-1).alias("file"), F.col("new_tx").alias("ec")).alias("at"))
    order = every.select("txs", F.struct("file", "ec").alias("at")).unionByName(single).groupBy("txs").agg(F.min("at").alias("at"))
    ids = order.select("txs", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("new_ec"))
    moved = every.join(ids, "txs").select("file", "ec", "new_ec")
    rows = [r.join(dictionary(moved.where(F.col("file") == i).drop("file")), "ec").withColumn("ec", F.col("new_ec")).drop("new_ec") for i, (r, _, _) in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows), ids.select(F.col("new_ec").alias("ec"), F.explode("txs").alias("tx")), tx.select(F.col("new_tx").alias("tx"), "name")


def merge(bus: DataFrame, ec_tx: DataFrame) -> DataFrame:
    """(flags, barcode, umi, txs): the fragments of a read as one set.

    A class opens at its first position (pad) and closes at the next it is seen at, and so on; at every later position, before
    its own records, the transcripts of the open classes are one snapshot; the read's set is the intersection of all snapshots.
    """
    read = ("flags", "barcode", "umi")
    w, by_class = Window.partitionBy(*read), Window.partitionBy(*read, "ec").orderBy("step")
    # dealt out by the read's number once, which all that follows keeps, also where the other two are constants
    seen = dealt(bus.select(*read, "pad", "ec"), bus.count(), "flags").distinct()
    turn = seen.withColumn("step", F.dense_rank().over(w.orderBy("pad"))).withColumn("steps", F.max("step").over(w))
    spans = turn.withColumn("nth", F.row_number().over(by_class)).withColumn("until", F.lead("step").over(by_class))
    spans = spans.where("nth % 2 = 1").withColumn("until", F.coalesce("until", "steps"))
    open_at = spans.where("until > step").select(*read, "ec", F.explode(F.sequence(F.col("step") + 1, F.col("until"))).alias("snap"))
    open_at = open_at.withColumn("_nth", F.dense_rank().over(w.orderBy("snap"))).withColumn("n", F.max("_nth").over(w)).drop("_nth")
    tx = open_at.join(dictionary(ec_tx), "ec").groupBy(*read, "snap", "tx").agg(F.first("n").alias("n"))
    kept = tx.groupBy(*read, "tx").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where("k = n")
    return kept.groupBy(*read).agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs"))
