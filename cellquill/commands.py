"""The command line: ``python -m cellquill VERB [options] files`` runs an operator over files and writes its files.

Record files may be plain or block-compressed; an output of ``-`` (or ``-p``) is standard output. Paths go to Spark as they are,
so any store that Spark reaches can be named. What Spark takes care of by itself (threads, memory, temporary files) is accepted
and ignored. Outputs are single files in order, streamed through the driver; pipelines within Spark use the operators themselves.
"""

from __future__ import annotations

import argparse
import struct
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import CITATION, __version__
from .functions import dna
from .operators import count as C
from .operators import grouped as G
from .operators import records as R
from .sources import binary, blocks, classes, outputs
from .sources import text as T

FILE_BITS = 40  # of a record's number within its file


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, int, int]:
    """Records of plain or compressed files, numbered through all of them, and the first file's lengths of barcodes and UMIs."""
    parts, lengths = [], []
    for i, path in enumerate(paths):
        head = binary.read_head(spark, path, 20)
        read = blocks.read_busz if head[:4] == blocks.MAGIC else binary.read_bus
        parts.append(read(spark, path).withColumn("_rid", F.col("_rid") + (i << FILE_BITS)))
        lengths.append(struct.unpack("<4I", head[4:20])[1:3])
    return reduce(DataFrame.unionByName, parts), *lengths[0]


def write_lines(lines: DataFrame, path: str) -> None:
    """``value`` of each row in order, as one file."""
    binary.write_file(lines.sparkSession, path, ((r[0] + "\n").encode() for r in lines.select("value").toLocalIterator(prefetchPartitions=True)))


def in_order(bus: DataFrame) -> DataFrame:
    return bus.orderBy("_rid")


def stem(path: str) -> str:
    """A folder's outputs are called ``output``."""
    return path + "output" if path.endswith("/") else path


def dictionaries(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ec, tx), (tx, gene) and (ec, gene) of the files named by -e, -t and -g."""
    ec_tx = read_classes(spark, a.ecmap)
    genes = T.read_genes(spark, a.genemap, T.read_transcripts(spark, a.txnames))
    return ec_tx, genes, ec_tx.join(genes, "tx").select("ec", "gene").distinct()


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    return classes.read_bec(spark, path) if binary.read_head(spark, path, 4) == classes.MAGIC else T.read_ecs(spark, path)


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    binary.write_bus(R.sort(bus.drop("_rid"), a.order or "default", a.no_flags), a.output, bclen, umilen)


#: The marks of a replacement file's second column, and what they stand for.
REPLACEMENTS = {"<": ("lsb_meta", "msb_meta"), "*": ("lsb_bus", "msb_bus")}  # before and after the bases


def replacements(table: DataFrame) -> tuple[DataFrame, str, int, int]:
    """(barcode, replacement) of (source, dest), with the kind and both lengths, which all rows share."""
    one = table.first()
    if one is None:
        raise ValueError("an empty replacement file")
    kind, dest = "record", one["dest"]
    for mark, (before, after) in REPLACEMENTS.items():
        kind = before if dest.startswith(mark) else after if dest.endswith(mark) else kind
    bases = F.translate("dest", "<*", "")
    pairs = table.select(dna.encode(F.col("source")).alias("barcode"), dna.encode(bases).alias("replacement"))
    return pairs, kind, len(one["source"]), len(dest.strip("<*"))


def correct(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    if a.replace:
        binary.write_bus(in_order(R.replace(bus, *(t := replacements(T.read_pairs(spark, a.onlist)))[:2], bclen, *t[2:])), a.output, bclen, umilen)
        return
    listed = T.read_onlist(spark, a.onlist)
    if a.nocorrect:
        binary.write_bus(in_order(R.correct_exact(bus, listed.where("column = 0"), bclen)), a.output, bclen, umilen)
        return
    sizes = [r["bases"] for r in listed.groupBy("column").agg(F.max("bases").alias("bases")).orderBy("column").collect()]  # a row a column
    segments = R.halves(listed.where("column = 0"), bclen) if a.split else [(listed.where(F.col("column") == i), n) for i, n in enumerate(sizes)]
    if sum(n for _, n in segments) != bclen:
        raise ValueError("the on-list's lengths don't add up to the barcode's")
    fixed = R.correct(bus.withColumn("_old", F.col("barcode")), segments)
    if a.dump:
        changed = fixed.where("corrected > 0").groupBy("_old", "barcode").agg(F.min("_rid").alias("_rid")).orderBy("_rid")
        write_lines(changed.select(F.concat_ws("\t", dna.decode(F.col("_old"), bclen), dna.decode(F.col("barcode"), bclen)).alias("value")), a.dump)
    binary.write_bus(in_order(fixed), a.output, bclen, umilen)


def umicorrect(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    fixed = G.correct_umis(bus, dictionaries(spark, a)[2], umilen)
    binary.write_bus(R.sort(fixed), a.output, bclen, umilen)


def write_matrix(counts: DataFrame, column: str, path: str, bclen: int, texts: DataFrame | None = None) -> None:
    """``counts`` (barcode, column, value) as a matrix with its barcodes and the labels of its columns, or their ``texts`` (label, text)."""
    triplets, cells, names = T.indexed(counts, "barcode", column)
    write_lines(T.matrix_lines(triplets), f"{path}.mtx")
    write_lines(outputs.barcode_lines(cells, bclen), f"{path}.barcodes.txt")
    prefixes = outputs.prefix_lines(cells, bclen)
    if not prefixes.isEmpty():
        write_lines(prefixes, f"{path}.barcodes.prefix.txt")
    if texts is not None:
        names = names.join(texts, "label").select(F.col("text").alias("label"), "n")
    write_lines(outputs.label_lines(names), f"{path}.{'genes' if column == 'gene' else 'ec'}.txt")


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, _ = read_records(spark, a.files)
    ec_tx, genes, ec_gene = dictionaries(spark, a)
    path = stem(a.output)
    if (a.hist or a.em or a.rawcounts) and not a.genecounts:
        raise ValueError("--hist, --em and --rawcounts need --genecounts")
    if a.em and (a.multimapping or a.cm or a.rawcounts or a.split) or a.cm and (a.hist or a.split or a.umi_gene):
        raise ValueError("options that exclude each other")
    if not a.genecounts:
        if a.cm:
            write_matrix(C.class_multiplicities(bus, ec_gene, a.multimapping), "ec", path, bclen)
            return
        counts = C.with_class_ids(C.tcc(bus, ec_tx, genes, a.multimapping), ec_tx)
        texts = counts.select(F.col("ec").alias("label"), F.concat_ws("\t", F.col("ec").cast("string"), "txs").alias("text")).distinct()
        write_matrix(counts.select("barcode", "ec", "value"), "ec", path, bclen, texts)
        return
    if a.split:
        names = T.read_transcripts(spark, a.txnames)
        listed = T.read_transcripts(spark, a.split).select("name").join(names, "name").select("tx")
        counts = C.split_counts(bus, ec_tx, genes, listed)
        for part, end in (("default", ""), ("split", ".2"), ("ambiguous", ".ambiguous")):
            write_matrix(counts.where(F.col("part") == part).drop("part"), "gene", path + end, bclen)
        return
    if a.cm:
        counts = C.gene_multiplicities(bus, ec_gene, a.multimapping)
    elif a.em:
        counts = G.gene_counts_em(bus, ec_gene)
    elif a.umi_gene:
        counts = G.gene_counts_with_collisions(bus, ec_gene)
    elif a.downsample is not None:
        counts = C.downsampled(bus, ec_gene, a.downsample)
    else:
        counts = C.gene_counts(bus, ec_gene, a.multimapping, a.rawcounts)
    write_matrix(counts, "gene", path, bclen)
    if a.hist:
        m = C.molecules(bus, ec_gene)
        hist = C.histograms(m, a.multimapping)
        _, cells, names = T.indexed(counts, "barcode", "gene")
        write_lines(outputs.histogram_lines(hist, names), f"{path}.hist.txt")
        write_lines(outputs.copies_lines(C.copies_per_umi(hist), names), f"{path}.cu.txt")
        write_lines(outputs.cell_copies_lines(C.copies_per_cell(m, a.multimapping), cells, bclen), f"{path}.CUPerCell.txt")


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads what ``count --genecounts --hist`` wrote, and writes a rescaled matrix and the fitted parameters."""
    source, path = stem(a.files[0]), stem(a.output)
    names = T.numbered_lines(spark, f"{source}.genes.txt").select((F.col("_rid") + 1).alias("col"), F.col("value").alias("gene"))
    bins = T.numbered_lines(spark, f"{source}.hist.txt").select((F.col("_rid") + 1).alias("col"), F.posexplode(F.split("value", "\t")).alias("copies", "n"))
    hist = bins.join(names, "col").select("gene", (F.col("copies") + 1).alias("copies"), F.col("n").cast("double").alias("n")).where("n > 0")
    fitted = G.predict(hist, a.predict_t)
    counts = T.read_matrix(spark, f"{source}.mtx").join(names, "col").select(F.col("row").alias("barcode"), "gene", "value")
    scaled = G.rescale(counts, fitted).join(names, "gene").select(F.col("barcode").alias("row"), "col", "value")
    write_lines(T.matrix_lines(scaled), f"{path}.mtx")
    for kind in ("barcodes", "genes"):
        write_lines(T.numbered_lines(spark, f"{source}.{kind}.txt").orderBy("_rid"), f"{path}.{kind}.txt")
    rows = fitted.join(names, "gene").orderBy("col").select(F.concat_ws("\t", "gene", *[F.col(c).cast("string") for c in ("size", "mu", "predicted", "scale")]).alias("value"))
    write_lines(rows, f"{path}.nb_params.txt")


def capture(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    if a.kind is None:
        raise ValueError("one of -s, -u, -b and -F is needed")
    if a.kind == "tx":
        ec_tx = read_classes(spark, a.ecmap)
        wanted = T.read_transcripts(spark, a.capture).select("name").join(T.read_transcripts(spark, a.txnames), "name").select(F.col("tx").alias("value"))
        if a.combo:
            rows = R.capture_combo(bus.drop("_rid"), ec_tx, wanted)
            sets = rows.select("txs").distinct().withColumn("_n", F.dense_rank().over(T.Window.orderBy("txs")) - 1)  # a row a class
            binary.write_bus(R.sort(rows.join(sets, "txs").withColumn("ec", F.col("_n").cast("int"))), a.output, bclen, umilen)
            write_lines(sets.orderBy("_n").select(F.concat_ws("\t", F.col("_n").cast("string"), "txs").alias("value")), f"{a.output}.ec")
            return
        got = R.capture(bus, wanted, "tx", bclen, a.complement, ec_tx)
    elif a.kind == "flags":
        got = R.capture(bus, T.numbered_lines(spark, a.capture).select(F.trim("value").try_cast("long").alias("value")).dropna(), "flags", bclen, a.complement)
    else:
        listed = T.read_capture(spark, a.capture)
        kind = "prefix" if a.kind == "barcode" and bclen < 32 and not listed.where("prefix").isEmpty() else a.kind
        got = R.capture(bus, listed.select("value"), kind, bclen, a.complement)
    binary.write_bus(in_order(got), a.output, bclen, umilen)


def project(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    if a.kind == "tx":
        ec_tx = read_classes(spark, a.ecmap)
        genes = T.read_genes(spark, a.map, T.read_transcripts(spark, a.txnames))
        rows = R.project_genes(bus.drop("_rid"), ec_tx.join(genes, "tx").select("ec", "gene").distinct())
        path = stem(a.output)
        records = rows.select("barcode", "umi", F.col("gene_ec").alias("ec"), F.lit(0).cast("long").alias("flags"), F.lit(0).cast("long").alias("pad"), "count")
        binary.write_bus(R.sort(records), f"{path}.bus", bclen, umilen)
        write_lines(rows.select("gene_ec", "genes").distinct().orderBy("gene_ec").select(F.concat_ws("\t", F.col("gene_ec").cast("string"), "genes").alias("value")), f"{path}.ec")
        return
    if a.kind is None:
        raise ValueError("one of -s, -u, -b and -F is needed")
    pairs = T.read_pairs(spark, a.map)
    code = (lambda c: F.col(c).cast("long")) if a.kind == "flags" else (lambda c: dna.encode(F.col(c)))
    binary.write_bus(in_order(R.project(bus, pairs.select(code("source").alias("source"), code("dest").alias("dest")), a.kind)), a.output, bclen, umilen)


def to_text(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    write_lines(T.to_lines(in_order(bus), 32 if a.showAll else bclen, umilen, a.flags, a.pad), a.output)


def fromtext(spark: SparkSession, a: argparse.Namespace) -> None:
    first = spark.read.text(a.files).where("trim(value) != '' AND NOT startswith(trim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("p")).first()
    bclen, umilen = (len(x) for x in first["p"][:2]) if first else (0, 0)
    parts = [T.read_text(spark, path).withColumn("_rid", F.col("_rid") + (i << FILE_BITS)) for i, path in enumerate(a.files)]
    binary.write_bus(in_order(reduce(DataFrame.unionByName, parts)), a.output, bclen, umilen)


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, _ = read_records(spark, a.files)
    ec_tx = read_classes(spark, a.ecmap) if a.ecmap else None
    listed = T.read_onlist(spark, a.onlist).where("column = 0").select("barcode") if a.onlist else None
    write_lines(outputs.summary_json(bus, ec_tx, listed, bclen), a.output)


def linker(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    end = bclen if a.end is None else a.end
    if not 0 <= a.start <= end <= bclen or end - a.start == bclen:
        raise ValueError("the section must lie in the barcode and leave some of it")
    binary.write_bus(in_order(R.linker(bus, a.start, end, bclen)), a.output, bclen - (end - a.start), umilen)


def allowlist(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, _ = read_records(spark, a.files)
    write_lines(R.allowlist(bus, a.threshold, bclen).orderBy(dna.unsigned(F.col("barcode"))).select(dna.decode(F.col("barcode"), bclen).alias("value")), a.output)


def collapse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of molecules with a single gene, whose class is the gene's number; the genes in order are beside them."""
    bus, bclen, umilen = read_records(spark, a.files)
    rows = R.collapse_runs(bus, dictionaries(spark, a)[2])
    genes = rows.select("gene").distinct().select("gene", (F.row_number().over(T.Window.orderBy("gene")) - 1).cast("int").alias("ec"))  # a row a gene
    zero = F.lit(0).cast("long")
    records = rows.join(genes, "gene").select("barcode", "umi", "ec", "count", zero.alias("flags"), zero.alias("pad"), F.col("run").alias("_rid"))
    path = stem(a.output)
    binary.write_bus(in_order(records), f"{path}.bus", bclen, umilen)
    write_lines(genes.orderBy("ec").select(F.col("gene").alias("value")), f"{path}.genes.txt")


def clusterhist(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, _, _ = read_records(spark, a.files)
    _, genes, ec_gene = dictionaries(spark, a)
    clusters = T.read_pairs(spark, a.clusterfile).select(dna.encode(F.col("source")).alias("barcode"), F.col("dest").alias("cluster"))
    hist = R.cluster_histograms(bus, ec_gene, clusters).cache()
    labels = genes.select(F.col("gene").alias("label")).distinct().withColumn("n", F.row_number().over(T.Window.orderBy("label")))  # a row a gene
    for r in hist.select("cluster").distinct().orderBy("cluster").collect():  # a file a cluster
        write_lines(outputs.histogram_lines(hist.where(F.col("cluster") == r["cluster"]), labels), f"{a.output.rstrip('/')}/cluster_hists/{r['cluster']}.txt")
    write_lines(outputs.label_lines(labels), f"{a.output.rstrip('/')}/genes.txt")
    hist.unpersist()


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads are numbered through all runs; the files of a run are parallel."""
    bus, _, _ = read_records(spark, a.files)
    files = a.fastq.split(",")
    if len(files) % a.nFastqs:
        raise ValueError("the number of FASTQ files must be a multiple of -N")
    for k in range(a.nFastqs):
        runs, before = [], 0
        for path in files[k :: a.nFastqs]:
            reads = T.read_reads(spark, path).withColumn("ordinal", F.col("ordinal") + before)
            runs.append(reads)
            before += reads.count()
        T.write_reads(R.extract(reduce(DataFrame.unionByName, runs), bus, a.exclude).coalesce(1), f"{a.output.rstrip('/')}/{k + 1}.fastq.gz")


def datasets(spark: SparkSession, folders: list[str]) -> Iterator[tuple[DataFrame, DataFrame, DataFrame, int, int]]:
    for folder in (f.rstrip("/") for f in folders):
        bus, bclen, umilen = read_records(spark, [f"{folder}/output.bus"])
        yield bus.drop("_rid"), T.read_ecs(spark, f"{folder}/matrix.ec"), T.read_transcripts(spark, f"{folder}/transcripts.txt"), bclen, umilen


def mash(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = list(datasets(spark, a.files))
    rows, ec_tx, tx = R.mash([p[:3] for p in parts])
    folder = a.output.rstrip("/")
    binary.write_bus(R.sort(rows, "flags"), f"{folder}/mashed.bus", *parts[0][3:])
    write_lines(outputs.class_lines(ec_tx), f"{folder}/matrix.ec")
    write_lines(tx.orderBy("tx").select(F.col("name").alias("value")), f"{folder}/transcripts.txt")


def merge(spark: SparkSession, a: argparse.Namespace) -> None:
    bus, bclen, umilen = read_records(spark, a.files)
    ec_tx = read_classes(spark, a.ecmap)
    rows = R.merge(bus.drop("_rid"), ec_tx).withColumn("value", F.lit(1).cast("long"))
    rows = C.with_class_ids(rows.withColumn("barcode", F.struct("barcode", "umi", "flags")), ec_tx)
    folder, key = a.output.rstrip("/"), F.col("barcode")
    records = rows.select(key["barcode"].alias("barcode"), key["umi"].alias("umi"), "ec", F.col("value").alias("count"), key["flags"].alias("flags"), F.lit(0).cast("long").alias("pad"))
    binary.write_bus(R.sort(records, "flags"), f"{folder}/merged.bus", bclen, umilen)
    new = rows.select("ec", F.explode(F.split("txs", ",").cast("array<int>")).alias("tx")).distinct()
    write_lines(outputs.class_lines(ec_tx.select("ec", "tx").unionByName(new).distinct()), f"{folder}/merged.ec")


def compress(spark: SparkSession, a: argparse.Namespace) -> None:
    if binary.read_head(spark, a.files[0], 4) != binary.MAGIC:
        classes.write_bec(T.read_ecs(spark, a.files[0]), a.output, a.chunk_size)
        return
    bus, bclen, umilen = read_records(spark, a.files)
    blocks.write_busz(in_order(bus), a.output, bclen, umilen, rows=a.chunk_size)


def inflate(spark: SparkSession, a: argparse.Namespace) -> None:
    if binary.read_head(spark, a.files[0], 4) == classes.MAGIC:
        write_lines(outputs.class_lines(classes.read_bec(spark, a.files[0])), a.output)
        return
    bus, bclen, umilen = read_records(spark, a.files)
    binary.write_bus(in_order(bus), a.output, bclen, umilen)


Option = tuple[tuple[str, ...], dict]


def flag(*names: str, **more) -> Option:
    return names, {"action": "store_true", **more}


def value(*names: str, **more) -> Option:
    return names, more


def choice(dest: str, const: str, *names: str) -> Option:
    return names, {"action": "store_const", "dest": dest, "const": const, "default": None}


CLASSES = [value("-e", "--ecmap", help="classes and their transcripts"), value("-t", "--txnames", help="names of the transcripts")]
GENES = [*CLASSES, value("-g", "--genemap", help="transcripts and their genes")]
IGNORED = [value(n, m, help="left to Spark") for n, m in (("-t", "--threads"), ("-m", "--memory"), ("-T", "--temp"))]
KINDS = [choice("kind", "flags", "-F", "--flags"), choice("kind", "tx", "-s", "--transcripts"), choice("kind", "umi", "-u", "--umis", "--umi"), choice("kind", "barcode", "-b", "--barcode")]

VERBS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], list[Option]]] = {
    "sort": (sort, [*IGNORED, choice("order", "umi", "-u", "--umi"), choice("order", "count", "-c", "--count"), choice("order", "flags", "--flags"), choice("order", "flags_bc", "--flags-bc"), flag("-n", "--no-flags")]),
    "correct": (correct, [value("-w", "--onlist", "--whitelist", required=True), value("-d", "--dump"), flag("-s", "--split"), flag("-r", "--replace"), flag("--nocorrect")]),
    "umicorrect": (umicorrect, GENES),
    "count": (count, [*GENES, flag("--genecounts"), flag("-m", "--multimapping"), flag("--cm"), flag("--rawcounts"), flag("--umi-gene"), flag("--em"), flag("--hist"), value("-d", "--downsample", type=float), value("-s", "--split")]),
    "predict": (predict, [value("-t", "--predict_t", type=float, required=True)]),
    "capture": (capture, [*KINDS, value("-c", "--capture", required=True), value("-e", "--ecmap"), value("-t", "--txnames"), flag("-x", "--complement"), flag("-f", "--combo")]),
    "project": (project, [*KINDS, value("-m", "--map", required=True), value("-e", "--ecmap"), value("-t", "--txnames")]),
    "text": (to_text, [flag("-f", "--flags"), flag("-d", "--pad"), flag("-a", "--showAll")]),
    "fromtext": (fromtext, []),
    "inspect": (inspect, [value("-e", "--ecmap"), value("-w", "--onlist", "--whitelist")]),
    "linker": (linker, [value("-s", "--start", type=int, default=0), value("-e", "--end", type=int)]),
    "allowlist": (allowlist, [value("-f", "--threshold", type=int)]),
    "collapse": (collapse, GENES),
    "clusterhist": (clusterhist, [*GENES, value("-c", "--clusterfile", required=True)]),
    "extract": (extract, [value("-f", "--fastq", required=True), value("-N", "--nFastqs", type=int, required=True), flag("-x", "--exclude"), flag("-i", "--include")]),
    "mash": (mash, []),
    "merge": (merge, CLASSES),
    "compress": (compress, [value("-N", "--chunk-size", type=int, default=blocks.ROWS)]),
    "inflate": (inflate, []),
}
ALIASES = {"dump": "text", "whitelist": "allowlist", "onlist": "allowlist", "decompress": "inflate"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellquill", description=__doc__.split("\n")[0])
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version")
    verbs.add_parser("cite")
    for name, (run, options) in VERBS.items():
        sub = verbs.add_parser(name, aliases=[x for x, y in ALIASES.items() if y == name], help=(run.__doc__ or "").split("\n")[0])
        sub.set_defaults(run=run)
        for names, more in options:
            sub.add_argument(*names, **more)
        out = sub.add_mutually_exclusive_group(required=True)
        out.add_argument("-o", "--output")
        out.add_argument("-p", "--pipe", dest="output", action="store_const", const=binary.STDOUT)
        sub.add_argument("files", nargs="+")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    if a.verb in ("version", "cite"):
        print(__version__ if a.verb == "version" else CITATION)
        return
    a.run(spark or SparkSession.builder.appName(f"cellquill {a.verb}").getOrCreate(), a)
