"""Codes, formats, orders and edge cases."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellquill.functions import dna
from cellquill.operators import count as C
from cellquill.operators import grouped as G
from cellquill.operators import records as R
from cellquill.sources import binary, blocks, classes, outputs
from cellquill.sources import text as T
from cellquill.streaming import cell_totals, event_counts, record_stream

SCHEMA = "barcode long, umi long, ec int, count long, flags long, pad long"


def test_dna_round_trip(spark):
    seqs = ["A" * 32, "T" * 32, "ACGT", "acgt", "G", "T" * 16, "CT" * 13]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("b", dna.encode(F.col("s")))
    for n in {len(s) for s in seqs}:
        for r in df.where(F.length("s") == n).select("s", dna.decode(F.col("b"), n).alias("t")).collect():
            assert r.t == r.s.upper()
    assert spark.range(1).select(dna.encode(F.lit("N"))).first()[0] == 2


def test_hamming_and_neighbours(spark):
    r = spark.range(1).select(dna.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), F.size(F.array_distinct(dna.neighbours(F.lit(5).cast("long"), 32)))).first()
    assert tuple(r) == (32, 96)


def test_sort_is_ordered_and_idempotent(spark):
    rows = [(random.Random(i).randrange(4), i % 3, i % 2, 1, 0, 0) for i in range(200)] + [(-1, 0, 0, 1, 0, 0)]
    once = R.sort(spark.createDataFrame(rows, SCHEMA)).collect()
    keys = [(r.barcode & (2**64 - 1), r.umi, r.ec, r.flags) for r in once]
    assert keys == sorted(keys) and len(set(keys)) == len(keys) and sum(r["count"] for r in once) == 201
    again = R.sort(spark.createDataFrame([(r.barcode, r.umi, r.ec, r["count"], r.flags, r.pad) for r in once], SCHEMA)).collect()
    assert again == once


def test_correct_drops_ties_and_keeps_metadata(spark):
    onlist = spark.createDataFrame([(0b0000,), (0b0101,)], "barcode long")
    seen = [(0b0000, 0), (0b0010, 0), (0b0001, None), (0b1111, None), (0b0010 | 3 << 4, 3 << 4)]
    got = R.correct(spark.createDataFrame([(b, i, 0, 1, 0, 0) for i, (b, _) in enumerate(seen)], SCHEMA), [(onlist, 2)]).collect()
    assert {r.umi: r.barcode for r in got} == {i: b for i, (_, b) in enumerate(seen) if b is not None}


def test_capture_is_complete(spark):
    df = spark.createDataFrame([(i, i % 5, i % 4 - 1, 1, i, 0) for i in range(50)], SCHEMA)
    wanted = spark.createDataFrame([(1,), (3,), (1,)], "value long")
    for kind in ("barcode", "umi", "flags"):
        assert R.capture(df, wanted, kind).count() + R.capture(df, wanted, kind, complement=True).count() == 50
    ec_tx = spark.createDataFrame([(0, 1), (1, 2)], "ec int, tx int")
    assert R.capture(df, wanted, "tx", ec_tx=ec_tx).count() + R.capture(df, wanted, "tx", complement=True, ec_tx=ec_tx).count() == df.where("ec IN (0, 1)").count()


def test_empty_input(spark):
    empty, genes = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(0, "g")], "ec int, gene string")
    assert C.gene_counts(empty, genes).count() == 0 and G.correct_umis(empty, genes, 5).count() == 0 and R.sort(empty).count() == 0
    assert R.allowlist(empty).count() == 0 and R.inspect(empty).count() == 1


def test_collisions_and_em():
    a, b = frozenset("x"), frozenset("xy")
    assert G.collided([a, frozenset("z"), b]) == [frozenset("x"), frozenset("z")]
    got = G.expectation_maximisation({"a": 3.0, "b": 1.0}, [(("a", "b"), 4.0), (("c", "d"), 1.0)])
    assert abs(got["a"] + got["b"] - 8) < 1e-9 and abs(got["a"] - 6) < 1e-6


def test_em_of_a_cell_without_unique_genes(spark):
    genes = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "ec int, gene string")
    bus = spark.createDataFrame([(1, 1, 0, 1, 0, 0), (2, 1, 1, 1, 0, 0), (2, 2, 0, 1, 0, 0)], SCHEMA)
    assert [tuple(r) for r in G.gene_counts_em(bus, genes).collect()] == [(2, "a", 2.0)]


def test_truncated_fit_finds_its_parameters():
    rng = np.random.default_rng(0)
    size, mu = 2.0, 3.0
    x = rng.negative_binomial(size, size / (size + mu), 200_000)
    copies, n = np.unique(x[x > 0], return_counts=True)
    got = G.fit_truncated(copies.astype(float), n.astype(float))
    assert abs(got[0] - size) < 0.1 and abs(got[1] - mu) < 0.1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), min_size=1, max_size=200))
def test_fibonacci_round_trip(values):
    values = np.array(values, np.uint64)
    assert (blocks.unfibonacci(blocks.fibonacci(values))[0] == values).all()


@pytest.mark.parametrize("n", [1, 511, 512, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    raw = np.zeros(n, binary.DTYPE)
    raw["barcode"], raw["umi"] = rng.integers(0, max(2, n // 3), n), rng.integers(0, 50, n)
    raw = raw[np.lexsort((raw["umi"], raw["barcode"]))]
    raw["ec"], raw["count"], raw["flags"] = rng.choice([0, 1, 5, 7000], n, p=[0.4, 0.3, 0.2, 0.1]), rng.choice([1, 1, 2, 70], n), rng.choice([0, 0, 3], n)
    assert (blocks.decode_block(blocks.encode_block(raw)[8:], n) == raw).all()


def test_binary_files(spark):
    rows = [(i, i * 7 % 11, i % 5 - 1, i + 1, i % 3, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = T.fresh(spark, "bus")
    binary.write_bus(df, path, 8, 5, b"text")
    assert sorted(tuple(r)[:6] for r in binary.read_bus(spark, path).collect()) == rows
    odd = T.fresh(spark, "bus")  # a header of another length
    binary.write_file(spark, odd, iter([binary.MAGIC + np.array([1, 8, 5, 3], "<u4").tobytes() + b"abc", binary._packed(df.toArrow().to_batches()[0]).tobytes()]))
    assert [tuple(r)[:6] for r in binary.read_bus(spark, odd).orderBy("_rid").collect()][:3] == rows[:3]


def test_matrix_and_reads(spark):
    counts = spark.createDataFrame([("b", "y", 1.5), ("a", "x", 2.0)], "cell string, gene string, value double")
    triplets, _, _ = T.indexed(counts, "cell", "gene")
    lines = [r.value for r in T.matrix_lines(triplets).collect()]
    assert lines[0].startswith("%%MatrixMarket") and lines[1:] == ["1 1 2", "2 2 1.5"]
    path = T.fresh(spark, "mtx")
    T.matrix_lines(triplets).coalesce(1).write.text(path)
    assert sorted(map(tuple, T.read_matrix(spark, path).collect())) == [(1, 1, 2.0), (2, 2, 1.5)]
    reads = spark.createDataFrame([(i, f"r{i}", "ACGT", "IIII") for i in range(9)], "ordinal long, name string, seq string, qual string")
    path = T.fresh(spark, "reads")
    T.write_reads(reads.coalesce(1), path)
    assert sorted(map(tuple, T.read_reads(spark, path).collect())) == sorted(map(tuple, reads.collect()))


def test_streams(spark, sf_dir):
    path, out = T.fresh(spark, "in"), T.fresh(spark, "out")
    T.write_text(spark.createDataFrame([(i % 3, i, 0, 2, 0, 0) for i in range(30)], SCHEMA), path, 8, 5)
    cell_totals(record_stream(spark, path), out, T.fresh(spark, "state")).processAllAvailable()
    assert {r[0]: r[1] for r in spark.read.parquet(out).groupBy("barcode").sum("reads").collect()} == {0: 20, 1: 20, 2: 20}
    batch = event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_class_codes():
    assert classes.codes([0, 1, 2, 5]) == [4, 1, 2, 2, 4] and classes.codes([3]) == [1, 4]
    # 2 1 2 1 as 011 11 011 11 in one word, whose low byte is first
    assert classes.encode_block([[0, 1]]) == (2 << 30 | 1).to_bytes(8, "little") + bytes([0xC0, 0x7B])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 3000), min_size=1, max_size=60), min_size=1, max_size=30))
def test_class_blocks_round_trip(sets):
    sets = [sorted(x) for x in sets]
    assert classes.decode_block(classes.encode_block(sets)[8:], len(sets)) == sets


@pytest.mark.parametrize("sets", [[[0], [1], [0, 1], [5, 6, 7, 9]], [[0], [1]], [[1], [1, 2]], []])
def test_class_files(spark, sets):
    rows = [(i, t) for i, txs in enumerate(sets) for t in txs]
    path = T.fresh(spark, "classes")
    classes.write_bec(spark.createDataFrame(rows + rows[:1], "ec int, tx int"), path, rows=1)
    assert sorted(map(tuple, classes.read_bec(spark, path).collect())) == rows


def test_class_numbers_without_gaps(spark):
    with pytest.raises(ValueError):
        classes.write_bec(spark.createDataFrame([(0, 0), (2, 1)], "ec int, tx int"), T.fresh(spark, "classes"))


def test_runs_cross_blocks(spark, monkeypatch):
    keys = [0, 0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 2, 0, 0, 0]
    df = spark.createDataFrame([(k, k, 0, 1, 0, 0, i) for i, k in enumerate(keys)], SCHEMA + ", _rid long")
    starts = [max(j for j in range(i + 1) if j == 0 or keys[j] != keys[j - 1]) for i in range(len(keys))]
    for bits in (1, 2, 20):
        monkeypatch.setattr(R, "RUN_BLOCK_BITS", bits)
        assert [r.run for r in R.with_runs(df).orderBy("_rid").collect()] == starts
    assert R.with_runs(df.where("false")).count() == 0


def test_labels_and_summary(spark):
    labels = spark.createDataFrame([(1, 2), (5, 1)], "label long, n int")
    lines = lambda df: [r.value for r in df.collect()]
    assert lines(outputs.barcode_lines(labels, 4)) == ["AACC", "AAAC"] and lines(outputs.prefix_lines(labels, 4)) == [] and lines(outputs.prefix_lines(labels, 32)) == []
    assert lines(outputs.prefix_lines(labels, 1)) == ["A" * 15 + "C", "A" * 16]
    bus = spark.createDataFrame([(0, 0, 0, 3, 0, 0), (0, 1, 1, 1, 0, 0), (2, 1, 1, 2, 0, 0)], SCHEMA)
    got = json.loads(lines(outputs.summary_json(bus, spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "ec int, tx int"), spark.createDataFrame([(2,)], "barcode long")))[0])
    assert got["numRecords"] == 3 and got["numReads"] == 6 and got["numUMIs"] == 2 and got["medianTargetsPerSet"] == 2 and got["numTargets"] == 2 and got["numSingleton"] == 3
    assert got["percentageBarcodesOnOnlist"] == 50 and abs(got["percentageReadsOnOnlist"] - 100 / 3) < 1e-9
    assert len(outputs.NAMES | outputs.TARGET_NAMES | outputs.LISTED_NAMES) == len(got)


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    for k, (a, b) in enumerate([(0, 1200), (1200, 1201), (1201, 3000)]):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[a:b]) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("5000", "1")):
        spark.conf.set(k, v)
    try:
        got = T.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5 and [r.value for r in got.orderBy("_rid").collect()] == lines
        assert got.agg({"_rid": "max"}).first()[0] == 2999
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
