"""The command line over files, against the operators and worked cases."""

import os

import pytest

from cellquill import __version__, commands
from cellquill.functions import dna
from cellquill.sources import binary, blocks
from cellquill.sources import text as T

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
CLASSES = ["-e", f"file://{DATA}/classes.txt", "-t", f"file://{DATA}/transcripts.txt"]
GENES = [*CLASSES, "-g", f"file://{DATA}/genes.txt"]


@pytest.fixture
def run(spark, tmp_path):
    def call(*arguments):
        commands.main([str(x) for x in arguments], spark)

    call.at = lambda name: f"file://{tmp_path}/{name}"
    call.lines = lambda name: open(f"{tmp_path}/{name}").read().splitlines()
    call.rows = lambda name: [tuple(r)[:6] for r in binary.read_bus(spark, f"file://{tmp_path}/{name}").orderBy("_rid").collect()]
    return call


def rows_of(name):
    with open(f"{DATA}/{name}") as f:
        return [line.split() for line in f if line.strip() and line[0] != '#']


def test_text_and_back(run, tmp_path):
    run("fromtext", "-o", run.at("a.bus"), f"file://{DATA}/umis.txt")
    run("text", "-o", run.at("a.txt"), run.at("a.bus"))
    assert [x.split("\t") for x in run.lines("a.txt")] == [x[:4] for x in rows_of("umis.txt")]
    run("text", "-f", "-d", "-a", "-o", run.at("b.txt"), run.at("a.bus"))
    assert all(len(x.split("\t")) == 6 and len(x.split("\t")[0]) == 32 for x in run.lines("b.txt"))


def test_umi_correction_and_compression(run, spark):
    run("fromtext", "-o", run.at("a.bus"), f"file://{DATA}/umis.txt")
    run("umicorrect", *GENES, "-o", run.at("b.bus"), run.at("a.bus"))
    run("text", "-o", run.at("b.txt"), run.at("b.bus"))
    assert sorted(x.split("\t") for x in run.lines("b.txt")) == sorted(rows_of("umis_expected.txt"))
    run("compress", "-o", run.at("b.busz"), run.at("b.bus"))
    run("decompress", "-o", run.at("c.bus"), run.at("b.busz"))
    assert run.rows("c.bus") == run.rows("b.bus") and binary.read_head(spark, run.at("b.busz"), 4) == blocks.MAGIC
    run("text", "-o", run.at("c.txt"), run.at("b.busz"))
    assert run.lines("c.txt") == run.lines("b.txt")
    run("compress", "-o", run.at("m.ecz"), f"file://{DATA}/classes.txt")
    run("inflate", "-o", run.at("m.ec"), run.at("m.ecz"))
    assert {tuple(x.split("\t")) for x in run.lines("m.ec")} == {(x[0], ",".join(sorted(x[1].split(","), key=int))) for x in rows_of("classes.txt")}


def test_counts(run):
    run("fromtext", "-o", run.at("a.bus"), f"file://{DATA}/counts.txt")
    run("count", *GENES, "--genecounts", "--hist", "-m", "-o", run.at("m"), run.at("a.bus"))
    cells, genes = run.lines("m.barcodes.txt"), run.lines("m.genes.txt")
    listed = [r[0] for r in rows_of("barcodes_expected.txt")]
    assert cells == sorted(listed) and genes == sorted({r[0] for r in rows_of("cu_expected.txt")[1:]})
    named = lambda rows, names: {(names[int(r) - 1], genes[int(c) - 1]): float(v) for r, c, v in rows}
    got, expected = named([x.split() for x in run.lines("m.mtx")[3:]], cells), named(rows_of("counts_expected.mtx")[3:], listed)
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-5 * v for k, v in expected.items())
    assert [x.split("\t")[0] for x in run.lines("m.cu.txt")] == [x[0] for x in rows_of("cu_expected.txt")] and len(run.lines("m.hist.txt")) == len(run.lines("m.genes.txt"))
    run("predict", "-t", 2, "-o", run.at("p"), run.at("m"))
    assert run.lines("p.genes.txt") == run.lines("m.genes.txt") and len(run.lines("p.mtx")) == len(run.lines("m.mtx")) and len(run.lines("p.nb_params.txt")) == len(run.lines("m.genes.txt"))
    for options in ([], ["--cm"], ["--genecounts", "--em"], ["--genecounts", "--umi-gene"]):
        run("count", *GENES, *options, "-o", run.at("x"), run.at("a.bus"))
        assert run.lines("x.mtx")[0].startswith("%%MatrixMarket")
    with pytest.raises(ValueError):
        run("count", *GENES, "--hist", "-o", run.at("x"), run.at("a.bus"))


def test_collapse_inspect_allowlist_clusters(run, tmp_path):
    run("fromtext", "-o", run.at("a.bus"), f"file://{DATA}/collapse.txt")
    run("collapse", *GENES, "-o", run.at("bug"), run.at("a.bus"))
    genes = run.lines("bug.genes.txt")
    got = sorted((r[0], r[1], genes[r[2]][-3], r[3]) for r in run.rows("bug.bus"))
    assert [(c, d) for *_, c, d in got] and sorted((c, str(d)) for *_, c, d in got) == sorted((c, d) for *_, c, d in rows_of("collapse_expected.txt"))
    run("inspect", "-e", CLASSES[1], "-o", run.at("i.json"), run.at("a.bus"))
    assert '"numRecords":' in run.lines("i.json")[0] and '"numTargets":' in run.lines("i.json")[0]
    run("allowlist", "-f", 1, "-o", run.at("on.txt"), run.at("a.bus"))
    barcodes = sorted({r[0] for r in rows_of("collapse.txt")})
    assert run.lines("on.txt") == barcodes
    (tmp_path / "clusters.txt").write_text("".join(f"{b}\tk{i % 2}\n" for i, b in enumerate(barcodes)))
    run("clusterhist", *GENES, "-c", run.at("clusters.txt"), "-o", run.at("hists"), run.at("a.bus"))
    assert os.path.exists(tmp_path / "hists/cluster_hists/k0.txt")


def test_record_verbs(run, tmp_path, capsysbinary):
    lines = ["AAAAAAAA\tACGTA\t0\t3\t5", "AAAAAAAC\tACGTA\t1\t1\t2", "CCCCTTTT\tCCCCC\t2\t2\t1", "GGGGGGGG\tACGTA\t0\t1\t0"]
    (tmp_path / "a.txt").write_text("# note\n" + "\n".join(lines) + "\n")
    (tmp_path / "on.txt").write_text("AAAAAAAA\nCCCCTTTT\n")
    run("fromtext", "-o", run.at("a.bus"), run.at("a.txt"))

    def after(*arguments):
        run(*arguments, "-o", run.at("b.bus"), run.at("a.bus"))
        run("text", "-f", "-o", run.at("b.txt"), run.at("b.bus"))
        return run.lines("b.txt")

    assert after("sort", "-t", 4, "--flags") == sorted(lines, key=lambda x: int(x.split("\t")[4]))
    assert after("correct", "-w", run.at("on.txt"), "-d", run.at("d.txt")) == [lines[0], lines[1].replace("AAAAAAAC", "AAAAAAAA"), lines[2]] and run.lines("d.txt") == ["AAAAAAAC\tAAAAAAAA"]
    assert after("correct", "--nocorrect", "-w", run.at("on.txt")) == [lines[0], lines[2]]
    assert len(after("correct", "-s", "-w", run.at("on.txt"))) == 3
    (tmp_path / "rep.txt").write_text("AAAA\t*CCC\n".replace("AAAA", "AAA"))
    assert after("correct", "-r", "-w", run.at("rep.txt"))[0].startswith("AAAAACCC")
    (tmp_path / "umis.txt").write_text("CCCCC\n")
    assert after("capture", "-u", "-c", run.at("umis.txt")) == [lines[2]] and after("capture", "-u", "-x", "-c", run.at("umis.txt")) == [lines[0], lines[1], lines[3]]
    assert after("capture", "-b", "-c", run.at("on.txt")) == [lines[0], lines[2]]
    (tmp_path / "flags.txt").write_text("2\n0\n")
    assert after("capture", "-F", "-c", run.at("flags.txt")) == [lines[1], lines[3]]
    (tmp_path / "tx.txt").write_text("t0\nt1\nt2\n")
    (tmp_path / "ec.txt").write_text("0\t0\n1\t1,2\n2\t2\n")
    (tmp_path / "want.txt").write_text("t1\n")
    names = ["-e", run.at("ec.txt"), "-t", run.at("tx.txt")]
    assert after("capture", "-s", "-c", run.at("want.txt"), *names) == [lines[1]]
    assert after("capture", "-s", "-f", "-c", run.at("want.txt"), *names) == [lines[1].replace("\t1\t1\t", "\t0\t1\t")] and run.lines("b.bus.ec") == ["0\t1"]
    (tmp_path / "map.txt").write_text("CCCCC\tGGGGG\n")
    assert after("project", "-u", "-m", run.at("map.txt"))[2].split("\t")[1] == "GGGGG"
    (tmp_path / "genes.txt").write_text("t0\tx\nt1\ty\nt2\ty\n")
    run("project", "-s", "-m", run.at("genes.txt"), *names, "-o", run.at("p"), run.at("a.bus"))
    assert run.lines("p.ec") == ["0\tx", "1\ty"] and len(run.rows("p.bus")) == 4
    assert [x.split("\t")[0] for x in after("linker", "-s", 2, "-e", 6)] == ["AAAA", "AAAC", "CCTT", "GGGG"]
    run("merge", *names, "-o", run.at("merged"), run.at("a.bus"))
    assert run.lines("merged/merged.ec")[0] == "0\t0"
    run("text", "-p", run.at("a.bus"))
    assert capsysbinary.readouterr().out.decode().splitlines() == ["\t".join(x.split("\t")[:4]) for x in lines]


def test_mash_and_extract(run, tmp_path):
    for k in (0, 1):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}/matrix.ec").write_text("0\t0\n1\t1\n2\t0,1\n")
        (tmp_path / f"d{k}/transcripts.txt").write_text("t0\nt1\n" if k else "t1\nt2\n")
        (tmp_path / f"d{k}/a.txt").write_text(f"AAAA\tCC\t{k}\t1\t{k}\nAAAA\tCC\t2\t1\t{k + 2}\n")
        run("fromtext", "-o", run.at(f"d{k}/output.bus"), run.at(f"d{k}/a.txt"))
    run("mash", "-o", run.at("all"), run.at("d0"), run.at("d1"))
    assert run.lines("all/transcripts.txt") == ["t1", "t2", "t0"] and len(run.rows("all/mashed.bus")) == 4
    (tmp_path / "r.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(5)))
    run("extract", "-f", run.at("r.fastq"), "-N", 1, "-o", run.at("reads"), run.at("all/mashed.bus"))
    run("extract", "-f", run.at("r.fastq"), "-N", 1, "-x", "-o", run.at("others"), run.at("all/mashed.bus"))


def test_names(capsys):
    commands.main(["version"])
    assert capsys.readouterr().out.strip() == __version__ and set(commands.ALIASES.values()) <= set(commands.VERBS)
    assert dna.mask(4) == 255
