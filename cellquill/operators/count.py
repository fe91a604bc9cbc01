"""Count matrices: the set intersection of a molecule's classes as relational division.

Records are dealt out by (barcode, umi) once; distinct classes, molecule-wide counts by window and the division by gene all
reuse that partitioning, so a crowded barcode is spread over tasks, and only the small per-gene sums are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hints import dealt, dictionary, small

MOLECULE = ("barcode", "umi")


def classes(bus: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct (barcode, umi, ec) with n_ec and the molecule's copies. ``rows`` of ``bus`` are counted if they aren't given."""
    w = Window.partitionBy(*MOLECULE)
    d = dealt(bus, bus.count() if rows is None else rows, *MOLECULE).groupBy(*MOLECULE, "ec").agg(F.sum("count").alias("c"))
    return d.select(*MOLECULE, "ec", F.count(F.lit(1)).over(w).alias("n_ec"), F.sum("c").over(w).alias("copies"))


def molecules(bus: DataFrame, ec_gene: DataFrame, rows: int | None = None) -> DataFrame:
    """(barcode, umi, gene, gn, copies): the genes that all classes of a molecule share, and how many they are."""
    d = classes(bus, rows).join(dictionary(ec_gene), "ec")
    d = d.groupBy(*MOLECULE, "gene").agg(F.count(F.lit(1)).alias("k"), F.first("n_ec").alias("n_ec"), F.first("copies").alias("copies")).where("k = n_ec")
    return d.select(*MOLECULE, "gene", F.count(F.lit(1)).over(Window.partitionBy(*MOLECULE)).alias("gn"), "copies")


def gene_counts(bus: DataFrame, ec_gene: DataFrame, multimap: bool = False, raw: bool = False) -> DataFrame:
    """(barcode, gene, value)."""
    m = molecules(bus, ec_gene)
    weight = (F.col("copies") if raw else F.lit(1)).cast("double")
    m = m.withColumn("w", weight / F.col("gn")) if multimap else m.where("gn = 1").withColumn("w", weight)
    return m.groupBy("barcode", "gene").agg(F.sum("w").alias("value"))


def gene_multiplicities(bus: DataFrame, ec_gene: DataFrame, multimap: bool = False) -> DataFrame:
    """Sums of counts by gene, record by record; shared ones are divided without remainder."""
    gn = ec_gene.select("ec", "gene", F.count(F.lit(1)).over(Window.partitionBy("ec")).alias("gn"))
    r = bus.join(dictionary(gn), "ec")
    r = r if multimap else r.where("gn = 1")
    return r.groupBy("barcode", "gene").agg(F.sum(F.expr("`count` div gn")).cast("double").alias("value"))


def class_multiplicities(bus: DataFrame, ec_gene: DataFrame, multimap: bool = False) -> DataFrame:
    r = bus
    if not multimap:
        r = r.join(dictionary(ec_gene.groupBy("ec").count().where("count = 1").select("ec")), "ec", "left_semi")
    return r.groupBy("barcode", "ec").agg(F.sum("count").alias("value"))


def transcript_sets(bus: DataFrame, ec_tx: DataFrame, tx_gene: DataFrame) -> DataFrame:
    """(barcode, umi, txs, n_genes): each molecule's transcript set.

    The classes' intersection; if that is empty, the union for one gene, or else gene by gene the intersection of
    what the classes have of the gene, or its union where that is empty too. Molecules without a gene then are dropped.
    """
    rows = bus.count()
    w, in_gene = Window.partitionBy(*MOLECULE), Window.partitionBy(*MOLECULE, "gene")
    # a class counts for a gene by the first of its transcripts there
    head = F.row_number().over(Window.partitionBy("ec", "gene").orderBy("tx")) == 1
    genes = ec_tx.join(dictionary(tx_gene), "tx", "left").withColumn("head", head.cast("int"))
    d = classes(bus, rows)
    d = d.join(F.broadcast(genes), "ec") if small(genes) else dealt(d.join(genes, "ec"), rows, *MOLECULE)
    t = d.groupBy(*MOLECULE, "gene", "tx").agg(F.count(F.lit(1)).alias("k"), F.sum("head").alias("heads"), F.first("n_ec").alias("n_ec"))
    # one sort, by gene and transcript, serves all windows
    t = t.withColumn("nth", F.row_number().over(in_gene.orderBy("tx"))).withColumn("own", F.col("k") == F.sum("heads").over(in_gene)).withColumn("any_own", F.max("own").over(in_gene))
    shared, genes_of = F.col("k") == F.col("n_ec"), F.count(F.when((F.col("nth") == 1) & F.col("gene").isNotNull(), 1))
    t = t.select(*MOLECULE, "gene", "tx", "own", "any_own", shared.alias("shared"), F.max(shared).over(w).alias("any_shared"), genes_of.over(w).alias("ng"))
    kept = F.when(F.col("any_shared"), F.col("shared")).when(F.col("ng") == 1, True).otherwise(F.col("gene").isNotNull() & (F.col("own") | ~F.col("any_own")))
    t = t.where(kept & (F.col("any_shared") | (F.col("ng") > 0)))
    return t.groupBy(*MOLECULE).agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs"), F.size(F.collect_set("gene")).alias("n_genes"))


def tcc(bus: DataFrame, ec_tx: DataFrame, tx_gene: DataFrame, multimap: bool = False) -> DataFrame:
    """(barcode, txs, value): molecules by transcript set; without ``multimap`` only sets of one gene."""
    s = transcript_sets(bus, ec_tx, tx_gene)
    s = s if multimap else s.where("n_genes = 1")
    return s.groupBy("barcode", "txs").agg(F.count(F.lit(1)).alias("value"))


def with_class_ids(counts: DataFrame, ec_tx: DataFrame) -> DataFrame:
    """``tcc`` with a class id: an existing one, the lowest of equal sets, or a new one after all others in order of the set."""
    known = ec_tx.groupBy("ec").agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs")).groupBy("txs").agg(F.min("ec").alias("ec"))
    new = counts.select("txs").distinct().join(known, "txs", "left_anti")
    last = ec_tx.agg(F.max("ec").alias("last"))
    new = new.crossJoin(F.broadcast(last)).select("txs", (F.col("last") + F.row_number().over(Window.orderBy("txs"))).cast("int").alias("ec"))  # one row
    return counts.join(known.unionByName(new), "txs").select("barcode", "ec", "txs", "value")


def split_counts(bus: DataFrame, ec_tx: DataFrame, tx_gene: DataFrame, listed: DataFrame) -> DataFrame:
    """(barcode, gene, part, value): gene counts by where the molecule's transcripts lie: outside the list (default), inside (split) or both (ambiguous).

    Molecules of several genes are tried again without the listed transcripts.
    """
    w = Window.partitionBy(*MOLECULE)
    marked = ec_tx.join(listed.select("tx").distinct().withColumn("_in", F.lit(1)), "tx", "left").select("ec", "tx", F.coalesce("_in", F.lit(0)).alias("mark"))
    # genes, marked if a class has them outside the list, and transcripts, marked if they are on it, as one dictionary
    genes = marked.join(tx_gene, "tx").groupBy("ec", "gene").agg((1 - F.min("mark")).alias("mark"))
    both = genes.select("ec", F.lit(True).alias("is_gene"), "gene", F.lit(None).cast(marked.schema["tx"].dataType).alias("tx"), "mark")
    both = both.unionByName(marked.select("ec", F.lit(False).alias("is_gene"), F.lit(None).cast(genes.schema["gene"].dataType).alias("gene"), "tx", "mark"))
    d = classes(bus).join(dictionary(both), "ec").groupBy(*MOLECULE, "is_gene", "gene", "tx")
    d = d.agg(F.count(F.lit(1)).alias("k"), F.sum("mark").alias("marks"), F.first("n_ec").alias("n_ec")).where("k = n_ec")
    again, number = F.col("marks") == F.col("n_ec"), lambda x: F.count(F.when(x, 1)).over(w)
    d = d.select(
        *MOLECULE, "is_gene", "gene", again.alias("again"), number(F.col("is_gene")).alias("gn"), number(F.col("is_gene") & again).alias("gn_again"),
        number(~F.col("is_gene")).alias("n"), number(~F.col("is_gene") & (F.col("marks") > 0)).alias("inside"),
    )
    unique = d.where(F.col("is_gene") & ((F.col("gn") == 1) | (F.col("again") & (F.col("gn_again") == 1))))
    part = F.when(F.col("inside") == 0, F.when(F.col("n") == 0, "split").otherwise("default")).when(F.col("inside") == F.col("n"), "split").otherwise("ambiguous")
    return unique.groupBy("barcode", "gene", part.alias("part")).agg(F.count(F.lit(1)).cast("double").alias("value"))


HISTOGRAM = 100


def histograms(m: DataFrame, multimap: bool = False, keys: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(keys, copies, n): molecules by number of copies, the last bin open."""
    m = m if multimap else m.where("gn = 1")
    return m.groupBy(*keys, F.least("copies", F.lit(HISTOGRAM)).alias("copies")).agg(F.sum(1 / F.col("gn")).alias("n"))


def copies_per_umi(hist: DataFrame) -> DataFrame:
    """(gene, cu, umis): mean copies, and molecules."""
    return hist.groupBy("gene").agg((F.sum(F.col("copies") * F.col("n")) / F.sum("n")).alias("cu"), F.sum("n").alias("umis"))


def copies_per_cell(m: DataFrame, multimap: bool = False) -> DataFrame:
    m = m.select(*MOLECULE, "copies").distinct() if multimap else m.where("gn = 1")  # then a row is a molecule
    return m.groupBy("barcode").agg((F.sum("copies") / F.count(F.lit(1))).alias("cu"), F.count(F.lit(1)).alias("umis"))


def downsampled(bus: DataFrame, ec_gene: DataFrame, factor: float, seed: int = 42) -> DataFrame:
    """Gene counts after keeping each copy of a molecule with probability ``factor``; a hash of molecule and copy decides."""
    draw = lambda i: F.pmod(F.xxhash64("barcode", "umi", i, F.lit(seed)), F.lit(1_000_003)) < factor * 1_000_003
    m = molecules(bus, ec_gene).where((F.col("gn") == 1) & F.exists(F.sequence(F.lit(1).cast("long"), F.col("copies")), draw))
    return m.groupBy("barcode", "gene").agg(F.count(F.lit(1)).cast("double").alias("value"))
