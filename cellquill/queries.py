"""Driver queries over the adapter's records, with the SQL that each must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import dna
from .operators import count as C
from .operators import grouped as G
from .operators import records as R
from .plans import adapter as A
from .sources import binary, blocks, classes, outputs, text

BCLEN, UMILEN = A.BCLEN, A.UMILEN
FLAT = [*R.KEYS, "cnt"]


def flat(df: DataFrame) -> DataFrame:
    """Records with the count as ``cnt``, a name that SQL can take."""
    return df.withColumnRenamed("count", "cnt").select(*FLAT)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _genes(**options):
    return lambda s, d: _rounded(C.gene_counts(A.bus(s, d), A.ec_gene(s, d), **options), "value")


def _sorted(order: str, no_flags: bool = False):
    def run(s, d):
        return flat(R.sort(A.bus(s, d), order, no_flags))

    return run


def _values(s, d, kind: str) -> DataFrame:
    if kind == "tx":
        return A.transcripts(s, d).where("tx % 3 = 0").select(F.col("tx").alias("value"))
    if kind in ("barcode", "prefix"):
        return A.onlist(s, d).where("barcode % 2 = 0").select(F.col("barcode").alias("value"))
    if kind == "umi":
        return s.range(0, 1024, 5).select(F.col("id").alias("value"))
    return A.bus(s, d).where("flags % 7 = 0").select(F.col("flags").alias("value"))


def _tall(s, d) -> DataFrame:
    """Records with a prefix stored above the barcode."""
    return A.bus(s, d).withColumn("barcode", F.col("barcode").bitwiseOR(F.shiftleft("barcode", 2 * BCLEN)))


def _capture(kind: str, complement: bool):
    def run(s, d):
        rows = _tall(s, d) if kind == "prefix" else A.bus(s, d)
        return flat(R.capture(rows, _values(s, d, kind), kind, BCLEN, complement, A.ec_tx(s, d)))

    return run


def _correct(segments):
    def run(s, d):
        return flat(R.correct(A.bus(s, d), segments(s, d)))

    return run


def _one(s, d):
    return [(A.onlist(s, d), BCLEN)]


def _two(s, d):
    """Sparse on-lists of two columns, so that segments fail too."""
    high, low = R.halves(A.onlist(s, d), BCLEN)
    return [(high[0].where("barcode % 3 = 0"), 4), (low[0].where("barcode % 5 = 0"), 4)]


REPLACED = {"record": (8, 6), "msb_meta": (8, 4), "lsb_meta": (8, 4), "msb_bus": (3, 3), "lsb_bus": (3, 3)}


def _replace(kind: str):
    keys, length = REPLACED[kind]

    def run(s, d):
        table = s.range(0, 4**keys, 3).select(F.col("id").alias("barcode"), ((F.col("id") * 7 + 1) % 4**length).alias("replacement"))
        return flat(R.replace(_tall(s, d), table, kind, BCLEN, keys, length))

    return run


def _map(s, d) -> DataFrame:
    return s.range(0, 65536, 3).select(F.col("id").alias("source"), ((F.col("id") * 11) % 65536).alias("dest"))


def _reads(s, d) -> DataFrame:
    return A._table(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.length("text").cast("long").alias("bases"))


def _flagged(s, d) -> DataFrame:
    return A._table(s, d, "labels").select(F.col("doc_id").alias("flags"))


def _datasets(s, d):
    names = A.transcripts(s, d).select("tx", F.concat(F.lit("t"), F.col("tx").cast("string")).alias("name"))
    other = A.transcripts(s, d).select("tx", F.concat(F.lit("t"), (199 - F.col("tx")).cast("string")).alias("name"))
    bus = A.bus(s, d)
    return [(bus.where("barcode % 2 = 0"), A.ec_tx(s, d), names), (bus.where("barcode % 2 = 1"), A.ec_tx(s, d), other)]


def _mash(s, d):
    rows, ec_tx, tx = R.mash(_datasets(s, d))
    sets = ec_tx.join(tx, "tx").groupBy("ec").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return rows.join(sets, "ec").groupBy("names").agg(F.count(F.lit(1)).alias("records"), F.sum("count").alias("cnt"))


def _mash_ecs(s, d):
    _, ec_tx, _ = R.mash(_datasets(s, d))
    return ec_tx.groupBy("ec").agg(F.array_join(F.array_sort(F.collect_set("tx")), ",").alias("txs"))


def _fragments(s, d) -> DataFrame:
    """Several positions a read: order number as the read, line number as the position."""
    return A.bus(s, d).withColumns({"pad": F.col("flags") % 8, "flags": F.shiftright("flags", 3), "barcode": F.lit(0).cast("long"), "umi": F.lit(0).cast("long"), "ec": (F.col("ec") % 3 + 400).cast("int")})


def _roundtrip(write, read):
    def run(s, d):
        path = text.fresh(s, "roundtrip")
        write(R.sort(A.bus(s, d)), path, BCLEN, UMILEN)
        return flat(read(s, path).drop("_rid"))

    return run


def _text_roundtrip(s, d) -> DataFrame:
    """Records written as text files and read back."""
    path = text.fresh(s, "text")
    text.write_text(A.bus(s, d), path, BCLEN, UMILEN, flags=True)
    return flat(text.read_text(s, path, numbered=False))


def _classes_roundtrip(s, d) -> DataFrame:
    """Classes renumbered without gaps, compressed and read back."""
    path, sets = text.fresh(s, "classes"), A.ec_tx(s, d)
    ids = sets.select("ec").distinct().select("ec", (F.row_number().over(Window.orderBy("ec")) - 1).cast("int").alias("n"))
    classes.write_bec(sets.join(ids, "ec").select(F.col("n").alias("ec"), "tx"), path)
    return classes.read_bec(s, path)


QUERIES = {
    "count_genes": _genes(), "count_genes_multimap": _genes(multimap=True), "count_genes_raw": _genes(raw=True), "count_genes_raw_multimap": _genes(raw=True, multimap=True),
    "count_genes_cm": lambda s, d: C.gene_multiplicities(A.bus(s, d), A.ec_gene(s, d)),
    "count_genes_cm_multimap": lambda s, d: C.gene_multiplicities(A.bus(s, d), A.ec_gene(s, d), True),
    "count_tcc": lambda s, d: C.tcc(A.bus(s, d), A.ec_tx(s, d), A.transcripts(s, d)),
    "count_tcc_multimap": lambda s, d: C.tcc(A.bus(s, d), A.ec_tx(s, d), A.transcripts(s, d), True),
    "count_tcc_cm": lambda s, d: C.class_multiplicities(A.bus(s, d), A.ec_gene(s, d)),
    "count_tcc_cm_multimap": lambda s, d: C.class_multiplicities(A.bus(s, d), A.ec_gene(s, d), True),
    "count_split": lambda s, d: C.split_counts(A.bus(s, d), A.ec_tx(s, d), A.transcripts(s, d), A.transcripts(s, d).where("tx % 4 = 0").select("tx")),
    "count_hist": lambda s, d: _rounded(C.histograms(C.molecules(A.bus(s, d), A.ec_gene(s, d))), "n"),
    "count_hist_multimap": lambda s, d: _rounded(C.histograms(C.molecules(A.bus(s, d), A.ec_gene(s, d)), True), "n"),
    "count_cu": lambda s, d: _rounded(C.copies_per_umi(C.histograms(C.molecules(A.bus(s, d), A.ec_gene(s, d)))), "cu", "umis"),
    "count_cu_per_cell": lambda s, d: _rounded(C.copies_per_cell(C.molecules(A.bus(s, d), A.ec_gene(s, d))), "cu"),
    "count_downsample": lambda s, d: C.downsampled(A.bus(s, d), A.ec_gene(s, d), 0.05),
    "count_umigene": lambda s, d: G.gene_counts_with_collisions(A.bus(s, d), A.ec_gene(s, d)),
    "count_em": lambda s, d: G.gene_counts_em(A.bus(s, d), A.ec_gene(s, d)),
    "clusterhist": lambda s, d: _rounded(R.cluster_histograms(A.bus(s, d), A.ec_gene(s, d), A.clusters(s, d)), "n"),
    "umicorrect": lambda s, d: flat(G.correct_umis(A.bus(s, d), A.ec_gene(s, d), UMILEN)),
    "predict": lambda s, d: G.predict(C.histograms(C.molecules(A.bus(s, d), A.ec_gene(s, d))), 2.0),
    **{f"sort_{o}": _sorted(o) for o in R.ORDERS}, "sort_noflags": _sorted("default", True),
    "correct": _correct(_one), "correct_split": _correct(lambda s, d: R.halves(A.onlist(s, d), BCLEN)), "correct_multi": _correct(_two),
    "correct_nocorrect": lambda s, d: flat(R.correct_exact(A.bus(s, d), A.onlist(s, d), BCLEN)),
    "correct_stats": lambda s, d: R.correct_stats(A.bus(s, d), _one(s, d)),
    **{f"correct_replace_{k}": _replace(k) for k in REPLACED},
    **{f"capture_{k}{'_complement' * c}": _capture(k, c) for k in ("tx", "barcode", "prefix", "umi", "flags") for c in (False, True)},
    "capture_combo": lambda s, d: R.capture_combo(A.bus(s, d), A.ec_tx(s, d), _values(s, d, "tx")).withColumnRenamed("count", "cnt"),
    "project_barcode": lambda s, d: flat(R.project(A.bus(s, d), _map(s, d), "barcode")),
    "project_umi": lambda s, d: flat(R.project(A.bus(s, d), _map(s, d), "umi")),
    "project_genes": lambda s, d: R.project_genes(A.bus(s, d), A.ec_gene(s, d)).withColumnRenamed("count", "cnt"),
    "linker": lambda s, d: flat(R.linker(_tall(s, d), 2, 5, BCLEN)),
    "collapse": lambda s, d: R.collapse(A.bus(s, d), A.ec_gene(s, d)).withColumnRenamed("count", "cnt"),
    "inspect": lambda s, d: _rounded(R.inspect(A.bus(s, d)), "mean_reads", "mean_umis"),
    "inspect_ec": lambda s, d: _rounded(R.inspect_targets(A.bus(s, d), A.ec_tx(s, d)), "mean_targets", "median_targets"),
    "inspect_onlist": lambda s, d: R.inspect_onlist(A.bus(s, d), A.onlist(s, d).where("barcode % 3 = 0"), BCLEN),
    "allowlist_fixed": lambda s, d: R.allowlist(A.bus(s, d), 900),
    "allowlist_auto": lambda s, d: R.allowlist(A.bus(s, d), None, BCLEN),
    "text": lambda s, d: text.to_lines(A.bus(s, d), BCLEN, UMILEN, flags=True, pad=True),
    "text_showall": lambda s, d: text.to_lines(_tall(s, d), 32, UMILEN, flags=True, pad=True),
    "fromtext": _text_roundtrip,
    "hamming": lambda s, d: A.bus(s, d).groupBy("barcode", "umi").agg(F.count(F.lit(1)).alias("n")).select("barcode", "umi", dna.hamming(F.col("barcode"), F.col("umi")).cast("long").alias("distance"), "n"),
    "extract_include": lambda s, d: R.extract(_reads(s, d), _flagged(s, d)),
    "extract_exclude": lambda s, d: R.extract(_reads(s, d), _flagged(s, d), True),
    "mash": _mash, "mash_ecs": _mash_ecs,
    "merge": lambda s, d: R.merge(_fragments(s, d), A.ec_tx(s, d)),
    "bus_roundtrip": _roundtrip(binary.write_bus, binary.read_bus),
    "busz_roundtrip": _roundtrip(blocks.write_busz, blocks.read_busz),
    "bec_roundtrip": _classes_roundtrip,
    "ec_lines": lambda s, d: outputs.class_lines(A.ec_tx(s, d)),
}


def sql(tail: str, ctes: str = "") -> str:
    return f"WITH {A.SQL.strip()}{', ' + ctes if ctes else ''}\n{tail}"


_CLS = "cls AS (SELECT barcode, umi, ec, count(*) OVER (PARTITION BY barcode, umi) AS n_ec, sum(sum(cnt)) OVER (PARTITION BY barcode, umi) AS copies FROM bus GROUP BY barcode, umi, ec)"
_MOL = _CLS + """,
mol AS (SELECT barcode, umi, gene, CAST(max(copies) AS BIGINT) AS copies, count(*) OVER (PARTITION BY barcode, umi) AS gn FROM cls JOIN ec_gene USING (ec) GROUP BY barcode, umi, gene HAVING count(*) = max(n_ec))"""
_ONE = "(SELECT ec FROM ec_gene GROUP BY ec HAVING count(*) = 1)"
_MERGED = "SELECT barcode, umi, ec, {flags} AS flags, pad, CAST(sum(cnt) AS BIGINT) AS cnt FROM bus GROUP BY ALL"
_SETS = _CLS + """,
j AS (SELECT barcode, umi, n_ec, ec, tx, gene FROM cls JOIN ec_tx USING (ec) LEFT JOIN tx USING (tx)),
g AS (SELECT barcode, umi, gene, count(DISTINCT ec) AS m FROM j GROUP BY ALL),
t AS (SELECT barcode, umi, n_ec, gene, tx, count(*) AS k FROM j GROUP BY ALL),
u AS (SELECT t.*, g.m, bool_or(k = n_ec) OVER (PARTITION BY t.barcode, t.umi) AS any_shared, bool_or(k = m) OVER (PARTITION BY t.barcode, t.umi, t.gene) AS any_own,
  (SELECT count(DISTINCT gene) FROM g x WHERE x.barcode = t.barcode AND x.umi = t.umi) AS ng FROM t JOIN g ON g.barcode = t.barcode AND g.umi = t.umi AND g.gene IS NOT DISTINCT FROM t.gene),
s AS (SELECT barcode, umi, array_to_string(list_sort(list(tx)), ',') AS txs, count(DISTINCT gene) AS n_genes FROM u
  WHERE CASE WHEN any_shared THEN k = n_ec WHEN ng = 1 THEN true ELSE k = m OR NOT any_own END GROUP BY barcode, umi)"""
_TALL = "tall AS (SELECT barcode | (barcode << 16) AS barcode, umi, ec, flags, pad, cnt FROM bus)"


def _near(name: str, source: str, bases: int) -> str:
    return f"""{name}_n AS (SELECT xor(v, CAST(x AS BIGINT) << CAST(2 * i AS BIGINT)) AS seen, v FROM {source}, range(1, 4) a(x), range({bases}) b(i)),
{name} AS (SELECT v AS seen, v AS parent FROM {source} UNION ALL SELECT seen, min(v) FROM {name}_n WHERE seen NOT IN (SELECT v FROM {source}) GROUP BY seen HAVING count(*) = 1)"""


_FIX1 = "src AS (SELECT barcode AS v FROM onlist), " + _near("fix", "src", 8)


def _two_sql(high: str, low: str) -> str:
    ctes = f"hi AS (SELECT DISTINCT barcode >> 8 AS v FROM onlist {high}), lo AS (SELECT DISTINCT barcode & 255 AS v FROM onlist {low}), " + _near("fh", "hi", 4) + ", " + _near("fl", "lo", 4)
    return sql("SELECT (fh.parent << 8) | fl.parent AS barcode, umi, ec, flags, pad, cnt FROM bus JOIN fh ON fh.seen = barcode >> 8 JOIN fl ON fl.seen = barcode & 255", ctes)


def _replace_sql(kind: str) -> str:
    keys, length = REPLACED[kind]
    table = f"tab AS (SELECT k, (k * 7 + 1) % {4**length} AS r FROM range(0, {4**keys}, 3) q(k)), {_TALL}"
    inside = "(barcode & 65535)"
    key = {"record": inside, "msb_bus": f"({inside} >> 10)"}.get(kind, f"(barcode & {4**keys - 1})")
    new = {
        "record": "r | (((barcode >> 4) & ~4095) & ~65535)", "msb_meta": "(r << 56) | barcode", "lsb_meta": "(r << 16) | (barcode & 65535) | ((barcode << 8) & ~16777215)",
        "msb_bus": "(barcode & ~65535) | (barcode & 1023) | (r << 10)", "lsb_bus": "(barcode & ~63) | r",
    }[kind]
    if kind == "msb_meta":  # the top bit is the sign
        new = "CASE WHEN r >= 128 THEN ((r - 256) * 72057594037927936) ELSE r * 72057594037927936 END + barcode"
    rest = "((barcode >> 4) & ~4095) | (barcode & 4095)" if kind == "record" else "barcode"
    return sql(f"SELECT CASE WHEN k IS NOT NULL THEN {new} ELSE {rest} END AS barcode, umi, ec, flags, pad, cnt FROM tall LEFT JOIN tab ON k = {key}", table)


def _capture_sql(kind: str, complement: bool) -> str:
    no = "NOT " if complement else ""
    test = {
        "tx": f"ec IN (SELECT ec FROM ec_tx) AND ec {no}IN (SELECT ec FROM ec_tx WHERE tx % 3 = 0)", "barcode": f"(barcode & 65535) {no}IN (SELECT barcode FROM onlist WHERE barcode % 2 = 0)",
        "prefix": f"((barcode >> 16) & 4294967295) {no}IN (SELECT barcode FROM onlist WHERE barcode % 2 = 0)", "umi": f"{no}(umi % 5 = 0)", "flags": f"{no}(flags % 7 = 0)",
    }[kind]
    return sql(f"SELECT * FROM {'tall' if kind == 'prefix' else 'bus'} WHERE {test}", _TALL)


def _dna_sql(column: str, bases: int) -> str:
    return f"array_to_string(list_transform(range({bases - 1}, -1, -1), lambda i: substr('ACGT', CAST((({column} >> (2 * i)) & 3) + 1 AS INT), 1)), '')"


_MASH = """
n0 AS (SELECT tx, 't' || tx AS name FROM tx), n1 AS (SELECT tx, 't' || (199 - tx) AS name FROM tx)"""
_NAMES = "array_to_string(list_sort(list(DISTINCT name)), ',')"

ORACLE_SQL = {
    "count_genes": sql("SELECT barcode, gene, CAST(count(*) AS DOUBLE) AS value FROM mol WHERE gn = 1 GROUP BY ALL", _MOL),
    "count_genes_multimap": sql("SELECT barcode, gene, round(sum(1.0 / gn::DOUBLE), 6) AS value FROM mol GROUP BY ALL", _MOL),
    "count_genes_raw": sql("SELECT barcode, gene, CAST(sum(copies) AS DOUBLE) AS value FROM mol WHERE gn = 1 GROUP BY ALL", _MOL),
    "count_genes_raw_multimap": sql("SELECT barcode, gene, round(sum(copies::DOUBLE / gn), 6) AS value FROM mol GROUP BY ALL", _MOL),
    "count_genes_cm": sql(f"SELECT barcode, gene, CAST(sum(cnt) AS DOUBLE) AS value FROM bus JOIN ec_gene USING (ec) WHERE ec IN {_ONE} GROUP BY ALL"),
    "count_genes_cm_multimap": sql("SELECT barcode, gene, CAST(sum(cnt // n) AS DOUBLE) AS value FROM bus JOIN ec_gene USING (ec) JOIN (SELECT ec, count(*) AS n FROM ec_gene GROUP BY ec) USING (ec) GROUP BY ALL"),
    "count_tcc": sql("SELECT barcode, txs, count(*) AS value FROM s WHERE n_genes = 1 GROUP BY ALL", _SETS),
    "count_tcc_multimap": sql("SELECT barcode, txs, count(*) AS value FROM s GROUP BY ALL", _SETS),
    "count_tcc_cm": sql(f"SELECT barcode, ec, CAST(sum(cnt) AS BIGINT) AS value FROM bus WHERE ec IN {_ONE} GROUP BY ALL"),
    "count_tcc_cm_multimap": sql("SELECT barcode, ec, CAST(sum(cnt) AS BIGINT) AS value FROM bus GROUP BY ALL"),
    "count_split": sql("""SELECT barcode, gene, CASE WHEN coalesce(inside, 0) = 0 THEN CASE WHEN n IS NULL THEN 'split' ELSE 'default' END WHEN inside = n THEN 'split' ELSE 'ambiguous' END AS part, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT barcode, umi, gene FROM mol WHERE gn = 1 UNION ALL SELECT barcode, umi, gene FROM mol2 WHERE gn = 1 AND (barcode, umi) IN (SELECT (barcode, umi) FROM mol WHERE gn > 1)) LEFT JOIN sides USING (barcode, umi) GROUP BY ALL""", _MOL + """,
eg2 AS (SELECT DISTINCT ec, gene FROM ec_tx JOIN tx USING (tx) WHERE tx % 4 <> 0),
mol2 AS (SELECT barcode, umi, gene, count(*) OVER (PARTITION BY barcode, umi) AS gn FROM cls JOIN eg2 USING (ec) GROUP BY barcode, umi, gene HAVING count(*) = max(n_ec)),
sides AS (SELECT barcode, umi, count(*) AS n, count(*) FILTER (tx % 4 = 0) AS inside FROM (SELECT barcode, umi, tx FROM cls JOIN ec_tx USING (ec) GROUP BY ALL HAVING count(*) = max(n_ec)) GROUP BY ALL)"""),
    "count_hist": sql("SELECT gene, least(copies, 100) AS copies, CAST(count(*) AS DOUBLE) AS n FROM mol WHERE gn = 1 GROUP BY ALL", _MOL),
    "count_hist_multimap": sql("SELECT gene, least(copies, 100) AS copies, round(sum(1.0 / gn::DOUBLE), 6) AS n FROM mol GROUP BY ALL", _MOL),
    "count_cu": sql("SELECT gene, round(sum(least(copies, 100)) / count(*)::DOUBLE, 6) AS cu, CAST(count(*) AS DOUBLE) AS umis FROM mol WHERE gn = 1 GROUP BY ALL", _MOL),
    "count_cu_per_cell": sql("SELECT barcode, round(sum(copies) / count(*)::DOUBLE, 6) AS cu, count(*) AS umis FROM mol WHERE gn = 1 GROUP BY ALL", _MOL),
    "clusterhist": sql("SELECT cluster, gene, least(copies, 100) AS copies, CAST(count(*) AS DOUBLE) AS n FROM mol JOIN clusters USING (barcode) WHERE gn = 1 GROUP BY ALL", _MOL),
    **{f"sort_{o}": sql(_MERGED.format(flags="flags")) for o in R.ORDERS}, "sort_noflags": sql(_MERGED.format(flags="CAST(0 AS BIGINT)")),
    "correct": sql("SELECT parent AS barcode, umi, ec, flags, pad, cnt FROM bus JOIN fix ON seen = barcode", _FIX1),
    "correct_split": _two_sql("", ""), "correct_multi": _two_sql("WHERE (barcode >> 8) % 3 = 0", "WHERE (barcode & 255) % 5 = 0"),
    "correct_nocorrect": sql("SELECT * FROM bus WHERE barcode IN (SELECT barcode FROM onlist)"),
    "correct_stats": sql("SELECT count(*) FILTER (parent = barcode) AS onlist, count(*) FILTER (parent <> barcode) AS corrected, count(*) FILTER (parent IS NULL) AS uncorrected FROM bus LEFT JOIN fix ON seen = barcode", _FIX1),
    **{f"correct_replace_{k}": _replace_sql(k) for k in REPLACED},
    **{f"capture_{k}{'_complement' * c}": _capture_sql(k, c) for k in ("tx", "barcode", "prefix", "umi", "flags") for c in (False, True)},
    "capture_combo": sql("SELECT bus.*, txs FROM bus JOIN (SELECT ec, array_to_string(list_sort(list(tx)), ',') AS txs FROM ec_tx WHERE tx % 3 = 0 GROUP BY ec) USING (ec)"),
    **{f"project_{c}": sql(f"SELECT {', '.join(f'coalesce(CASE WHEN {c} % 3 = 0 THEN ({c} * 11) % 65536 END, {c}) AS {c}' if x == c else x for x in FLAT)} FROM bus") for c in ("barcode", "umi")},
    "project_genes": sql("SELECT barcode, umi, array_to_string(genes, ',') AS genes, CAST(dense_rank - 1 AS INT) AS gene_ec, CAST(sum(cnt) AS BIGINT) AS cnt FROM bus JOIN (SELECT ec, genes, dense_rank() OVER (ORDER BY genes) AS dense_rank FROM (SELECT ec, list_sort(list(gene)) AS genes FROM ec_gene GROUP BY ec)) USING (ec) GROUP BY ALL"),
    "linker": sql("SELECT ((barcode & ~4095) >> 6) | (barcode & 63) AS barcode, umi, ec, flags, pad, cnt FROM tall", _TALL),
    "collapse": sql("SELECT barcode, umi, gene, copies AS cnt FROM mol WHERE gn = 1", _MOL),
    "inspect": sql("""SELECT CAST(sum(records) AS BIGINT) AS records, CAST(sum(reads) AS BIGINT) AS reads, count(*) AS barcodes, CAST(median(reads) AS DOUBLE) AS median_reads, round(CAST(sum(reads) AS DOUBLE) / count(*), 6) AS mean_reads,
CAST(sum(umis) AS BIGINT) AS pairs, CAST(median(umis) AS DOUBLE) AS median_umis, round(CAST(sum(umis) AS DOUBLE) / count(*), 6) AS mean_umis, CAST(sum(gt) AS BIGINT) AS gt_records, (SELECT count(DISTINCT umi) FROM bus) AS umis
FROM (SELECT barcode, count(*) AS records, sum(cnt) AS reads, count(DISTINCT umi) AS umis, sum(CASE WHEN cnt % 2 = 1 THEN 1 ELSE -1 END) AS gt FROM bus GROUP BY barcode)"""),
    "inspect_ec": sql("SELECT (SELECT count(DISTINCT tx) FROM bus JOIN ec_tx USING (ec)) AS targets, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_targets, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median_targets, CAST(sum(CASE WHEN n = 1 THEN cnt ELSE 0 END) AS BIGINT) AS singleton_reads, (SELECT CAST(sum(CASE WHEN f % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) FROM (SELECT tx, count(*) AS f FROM bus JOIN ec_tx USING (ec) GROUP BY tx)) AS gt_targets FROM bus JOIN (SELECT ec, count(*) AS n FROM ec_tx GROUP BY ec) USING (ec)"),
    "inspect_onlist": sql("SELECT count(DISTINCT barcode) AS barcodes_onlist, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS reads_onlist FROM bus WHERE barcode IN (SELECT barcode FROM onlist WHERE barcode % 3 = 0)"),
    "allowlist_fixed": sql("SELECT barcode, CAST(sum(cnt) AS BIGINT) AS reads FROM bus GROUP BY barcode HAVING sum(cnt) >= 900"),
    "allowlist_auto": sql("SELECT * FROM c WHERE reads >= (SELECT floor(avg(reads) * (1 - 0.99 ** 8)) FROM (SELECT reads FROM c ORDER BY reads DESC, barcode LIMIT 10))", "c AS (SELECT barcode, CAST(sum(cnt) AS BIGINT) AS reads FROM bus GROUP BY barcode)"),
    "text": sql(f"SELECT concat_ws(chr(9), {_dna_sql('barcode', 8)}, {_dna_sql('umi', 5)}, ec, cnt, flags, pad) AS value FROM bus"),
    "text_showall": sql(f"SELECT concat_ws(chr(9), {_dna_sql('barcode', 32)}, {_dna_sql('umi', 5)}, ec, cnt, flags, pad) AS value FROM tall", _TALL),
    "fromtext": sql("SELECT * FROM bus"),
    "hamming": sql("SELECT barcode, umi, CAST(bit_count((xor(barcode, umi) | (xor(barcode, umi) >> 1)) & 6148914691236517205) AS BIGINT) AS distance, count(*) AS n FROM bus GROUP BY barcode, umi"),
    "extract_include": "SELECT doc_id AS ordinal, CAST(length(text) AS BIGINT) AS bases FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "extract_exclude": "SELECT doc_id AS ordinal, CAST(length(text) AS BIGINT) AS bases FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "mash": sql("SELECT names, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT barcode, cnt, ec, barcode % 2 AS f FROM bus) JOIN sets USING (ec, f) GROUP BY names", _MASH + f", sets AS (SELECT 0 AS f, ec, {_NAMES} AS names FROM ec_tx JOIN n0 USING (tx) GROUP BY ec UNION ALL SELECT 1, ec, {_NAMES} FROM ec_tx JOIN n1 USING (tx) GROUP BY ec)"),
    "mash_ecs": sql("SELECT CAST(row_number() OVER (ORDER BY f, e) - 1 AS INT) AS ec, txs FROM (SELECT txs, f, e FROM o QUALIFY row_number() OVER (PARTITION BY txs ORDER BY f, e) = 1)", """
sets AS (SELECT 0 AS f, ec AS e, array_to_string(list_sort(list(tx)), ',') AS txs FROM ec_tx GROUP BY ec UNION ALL SELECT 1, ec, array_to_string(list_sort(list(199 - tx)), ',') FROM ec_tx GROUP BY ec),
o AS (SELECT * FROM sets UNION ALL SELECT -1, tx, CAST(tx AS VARCHAR) FROM tx)"""),
    "merge": sql("SELECT flags, CAST(0 AS BIGINT) AS barcode, CAST(0 AS BIGINT) AS umi, array_to_string(list_sort(list(tx)), ',') AS txs FROM (SELECT flags, tx FROM opened JOIN ec_tx USING (ec) JOIN (SELECT flags, count(DISTINCT snap) AS n FROM opened GROUP BY flags) USING (flags) GROUP BY flags, tx HAVING count(DISTINCT snap) = max(n)) GROUP BY flags", """
f AS (SELECT DISTINCT flags >> 3 AS flags, flags % 8 AS pad, CAST(ec % 3 + 400 AS INT) AS ec FROM bus),
p AS (SELECT DISTINCT flags, pad FROM f),
opened AS (SELECT p.flags, p.pad AS snap, f.ec FROM p JOIN f ON f.flags = p.flags AND f.pad < p.pad GROUP BY ALL HAVING count(*) % 2 = 1)"""),
    "bus_roundtrip": sql(_MERGED.format(flags="flags")),
    "busz_roundtrip": sql(_MERGED.format(flags="flags")),
    "bec_roundtrip": sql("SELECT CAST(dense_rank() OVER (ORDER BY ec) - 1 AS INT) AS ec, tx FROM ec_tx"),
    "ec_lines": sql("SELECT ec || chr(9) || string_agg(tx, ',' ORDER BY tx) AS value FROM ec_tx GROUP BY ec"),
}
