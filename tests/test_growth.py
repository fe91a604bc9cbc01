"""What a task gets follows a fixed number of rows, not the input divided by the cores."""

import glob

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellquill import queries as core
from cellquill.operators import count as C
from cellquill.operators import records as R
from cellquill.plans import hints
from cellquill.sources import binary, blocks
from cellquill.sources import text as T

RECORDS = "barcode long, umi long, ec int, count long, flags long, pad long"


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(i % 7, i * 5 % 31, i * i % 11, 1 + i % 3, i, 0) for i in range(1000)], RECORDS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


def test_molecules_get_tasks_by_rows(spark, records, monkeypatch):
    before = rows_of(C.classes(records))
    monkeypatch.setattr(hints, "TASK_ROWS", 100)
    assert C.classes(records).rdd.getNumPartitions() == 10 and rows_of(C.classes(records)) == before


def test_transcript_sets_are_gathered_once(spark, sf_dir, capsys):
    """Lists that grow, which are sorted and spilled, are made of the kept transcripts only (the two halves of one aggregate)."""
    for name in ("count_tcc", "count_tcc_multimap"):
        assert plan(core.QUERIES[name](spark, sf_dir), capsys).count("ObjectHashAggregate") == 2


def test_transcript_sets_with_a_large_dictionary(spark, records, monkeypatch):
    """Classes without transcripts, and transcripts without a gene; the dictionary joined by shuffling gives the same."""
    ec_tx = spark.createDataFrame([(e, t) for e in range(9) for t in (e, (e * 3 + 1) % 9, 9 + e % 2)], "ec int, tx int").distinct()
    tx_gene = spark.createDataFrame([(t, f"g{t % 4}") for t in range(10)], "tx int, gene string")
    once = rows_of(C.transcript_sets(records, ec_tx, tx_gene))
    monkeypatch.setattr(C, "small", lambda df: False)
    monkeypatch.setattr(hints, "TASK_ROWS", 100)
    assert once and rows_of(C.transcript_sets(records, ec_tx, tx_gene)) == once


def roundtrip(spark, df, write, read, **options):
    path = T.fresh(spark, "roundtrip")
    write(df, path, 8, 5, **options)
    return path, [tuple(r) for r in read(spark, path).orderBy("_rid").drop("_rid").collect()]


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 24])
def test_record_files_do_not_pass_the_driver(spark, records, monkeypatch, chunk):
    """Empty partitions, chunks of any size and bytes that are no text; no rows are sent to the driver."""
    monkeypatch.setattr(binary, "CHUNK", chunk)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    df = R.sort(records.withColumn("barcode", F.col("barcode") * 0x0A0DFF80C3)).repartitionByRange(5, "barcode").sortWithinPartitions("barcode", "umi", "ec", "flags")
    expected = [tuple(r) for r in df.select("barcode", "umi", "ec", "count", "flags", "pad").collect()]
    path, got = roundtrip(spark, df, binary.write_bus, binary.read_bus)
    assert got == expected and not glob.glob(f"{path.removeprefix('file://').rpartition('/')[0]}/chunks-*")
    assert roundtrip(spark, df, blocks.write_busz, blocks.read_busz, rows=37)[1] == expected
    for write, read in ((binary.write_bus, binary.read_bus), (blocks.write_busz, blocks.read_busz)):
        assert roundtrip(spark, df.where("false"), write, read)[1] == []


def test_split_deals_molecules_out_once(spark, sf_dir, capsys):
    text = plan(core.QUERIES["count_split"](spark, sf_dir), capsys)  # molecules, then the sums by gene
    assert text.count("Exchange hashpartitioning(barcode") == 2 and "SortMergeJoin" not in text


def test_merge_deals_reads_out_once(spark, sf_dir, capsys):
    text = plan(core.QUERIES["merge"](spark, sf_dir), capsys)
    assert text.count("Exchange hashpartitioning(flags") == 1 and "SortMergeJoin" not in text


def test_collisions_deal_molecules_out_once_a_branch(spark, sf_dir, capsys):
    text = plan(core.QUERIES["count_umigene"](spark, sf_dir), capsys)  # the branches' is the same one; then the sums
    assert text.count("Exchange hashpartitioning(barcode") == 3 and "SortMergeJoin" not in text


MOLECULES = ["count_genes", "count_genes_multimap", "count_genes_raw", "count_genes_raw_multimap", "count_hist", "count_hist_multimap", "count_cu", "count_cu_per_cell", "count_downsample", "count_em", "clusterhist", "collapse", "predict", "count_umigene", "count_split", "count_tcc"]


@pytest.mark.parametrize("name", MOLECULES)
def test_queries_of_molecules_get_tasks_by_rows(spark, sf_dir, capsys, monkeypatch, name):
    monkeypatch.setattr(hints, "TASK_ROWS", 1000)
    assert "6), REPARTITION_BY_NUM" in plan(core.QUERIES[name](spark, sf_dir), capsys)  # of about 6,000 records
