"""Small worked cases with known results."""

import os

import pytest

from cellquill.functions import dna
from cellquill.operators import count as C
from cellquill.operators import grouped as G
from cellquill.operators import records as R
from cellquill.sources import outputs as O
from cellquill.sources import text as T

DATA = "file://" + os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


def rows_of(name):
    with open(f"{DATA[7:]}/{name}") as f:
        return [line.split() for line in f if line.strip()]


@pytest.fixture(scope="module")
def dictionaries(spark):
    tx = T.read_transcripts(spark, f"{DATA}/transcripts.txt")
    genes = T.read_genes(spark, f"{DATA}/genes.txt", tx).cache()
    ec_tx = T.read_ecs(spark, f"{DATA}/classes.txt").cache()
    return ec_tx, genes, ec_tx.join(genes, "tx").select("ec", "gene").distinct().cache()


def as_text(df, *columns):
    return df.select(dna.decode(df["barcode"], 16).alias("barcode"), dna.decode(df["umi"], 10).alias("umi"), *columns)


def test_collapse_counts_runs(spark, dictionaries):
    _, _, ec_gene = dictionaries
    got = R.collapse_runs(T.read_text(spark, f"{DATA}/collapse.txt"), ec_gene)
    got = sorted((r.barcode, r.umi, int(r.gene[-3]), r["count"]) for r in as_text(got, "gene", "count").collect())
    assert got == sorted((a, b, int(c), int(d)) for a, b, c, d in rows_of("collapse_expected.txt"))


def test_umi_correction(spark, dictionaries):
    _, _, ec_gene = dictionaries
    got = as_text(G.correct_umis(T.read_text(spark, f"{DATA}/umis.txt"), ec_gene, 10), "ec", "count").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, int(c), int(d)) for a, b, c, d in rows_of("umis_expected.txt"))


@pytest.mark.parametrize("raw", [False, True])
def test_count_matrix(spark, dictionaries, raw):
    _, genes, ec_gene = dictionaries
    cells = [r[0] for r in rows_of("barcodes_expected.txt")]
    names = sorted({r.gene for r in genes.collect()})
    counts = C.gene_counts(T.read_text(spark, f"{DATA}/counts.txt"), ec_gene, multimap=True, raw=raw)
    got = {(cells.index(r.barcode) + 1, names.index(r.gene) + 1): r.value for r in counts.select(dna.decode(counts["barcode"], 16).alias("barcode"), "gene", "value").collect()}
    expected = {(int(r), int(c)): float(v) for r, c, v in rows_of(f"counts{'_raw' * raw}_expected.mtx")[3:]}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-5 * v for k, v in expected.items())


def test_copies(spark, dictionaries):
    _, _, ec_gene = dictionaries
    m = C.molecules(T.read_text(spark, f"{DATA}/counts.txt"), ec_gene).cache()
    genes = spark.createDataFrame([(r[0], i) for i, r in enumerate(rows_of("cu_expected.txt")[1:])], "label string, n int")
    written = [r.value.split("\t") for r in O.copies_lines(C.copies_per_umi(C.histograms(m, True)), genes).collect()]
    assert [[r[0], f"{float(r[1]):.6g}", f"{float(r[2]):.6g}"] for r in written[1:]] == rows_of("cu_expected.txt")[1:]
    ragged = [[float(x) for x in r.value.split("\t")] for r in O.histogram_lines(C.histograms(m, True), genes).collect()]
    assert all(abs(sum(r) - float(x[2])) < 1e-5 * (1 + sum(r)) and r[-1] > 0 for r, x in zip(ragged, written[1:]))
    cells = m.select("barcode").distinct().selectExpr("barcode AS label", "barcode AS n")
    lines = {r.value.split("\t")[0]: r.value.split("\t")[1:] for r in O.cell_copies_lines(C.copies_per_cell(m, True), cells, 16).collect()}
    assert all(abs(float(lines[b][0]) - float(cu)) < 1e-4 and lines[b][1] == n for b, cu, n in rows_of("cells_expected.txt")[1:])
    got = {r.gene: (r.cu, r.umis) for r in C.copies_per_umi(C.histograms(m, True)).collect()}
    for gene, cu, umis in rows_of("cu_expected.txt")[1:]:
        assert abs(got[gene][0] - float(cu)) < 1e-4 and abs(got[gene][1] - float(umis)) < 1e-6
    cells = C.copies_per_cell(m, True)
    got = {r.barcode: (r.cu, r.umis) for r in cells.select(dna.decode(cells["barcode"], 16).alias("barcode"), "cu", "umis").collect()}
    for cell, cu, umis in rows_of("cells_expected.txt")[1:]:
        assert abs(got[cell][0] - float(cu)) < 1e-4 and got[cell][1] == int(umis)
