"""The operators against brute force, SQL, round trips and held-out rows."""

import base64
import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from cellquill.llm import jpeg, langid, linededup, lm, media, packing, simhash, topk, toxicity, warc
from cellquill.llm.common import fold, fresh, table, written
from cellquill.llm.components import components
from cellquill.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import same_rows

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df())


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_nearest_terms():
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 11))) for _ in range(25)]
    lexicon = toxicity.Lexicon([*terms, "abcab*"])
    for _ in range(3000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
        expected = min(((d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits(t)), default=None)
        expected = (0, "abcab*") if word.startswith("abcab") else expected
        got = lexicon.match(word)
        assert (got and got[::-1]) == expected


def test_quotation_counts_less():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 1.0}))
    plain, misspelled, quote, said = (scorer.features(t) for t in ("you idiot go", "you idoit idi0t idiott go", 'he wrote "you idiot" here', "they said idiot here"))
    assert plain[0] > quote[0] == said[0] > 0 and misspelled[0] == 0 < misspelled[1]


def test_digits_and_marks_within_words_are_edits():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 1.0, "stupid": 1.0, "loser": 1.0, "moron": 1.0}))
    for w in ("idi0t", "st*pid", "l_oser", "m0ron", "(idi0t)!", "1diot", "idio\u0301t"):
        assert scorer.features(f"you {w} go")[:2] == (0, math.log(2)), w
    assert scorer.features("an idiot-like thing")[0] > 0


def test_rare_certain_terms_are_learned(spark):
    rows = [("the dolt sat", 1)] * 595 + [("ein trottel sass", 1)] * 5 + [("the ein sass sat sun", 0)] * 3000
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic long").repartition(3))
    assert {"dolt", "trottel"} <= set(terms)
    assert not {"the", "ein", "sat", "sun"} & set(terms)


def test_terms_beside_a_stem_are_matched_misspelled(spark):
    forms = ["idiot", "idiots", "idiotic"]
    rows = [(f"you {forms[i % 3]} there", 1) for i in range(60)] + [("a day in the sun", 0)] * 597 + [("one iddiot, once", 0)] + [("the iadiot is a bird", 0)] * 2
    sample = spark.createDataFrame(rows, "text string, toxic long").repartition(3)
    terms = toxicity.learn_terms(sample)
    assert "idio*" in terms and set(forms) <= set(terms)
    ordinary = toxicity.ordinary_words(sample, terms)
    assert ordinary == {"iadiot"}
    scorer = toxicity.Scorer(toxicity.Model(terms, ordinary))
    assert all(scorer.features(f"you {w} go")[1] > 0 for w in ("iddiot", "iidiots", "idoiotic"))
    assert scorer.features("the iadiot sang") == (0, 0, 0)


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = toxicity.op1(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


# line dedup


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def hash_of(b):
    return signed(xxhash.xxh64_intdigest(b, 42))


def repeated_lines(rows, least=25):
    """Deletes what is in a run of ``least`` words or more that occurs before, by looking at all runs."""
    docs = sorted({(linededup.LAST if i is None else i, hash_of(t.encode()), t) for i, t in rows if t is not None})
    seen, gone = set(), collections.defaultdict(set)
    for a, b, text in docs:
        u = [(k, line.strip(" \t\n\v\f\r"), len(line.encode().split())) for k, line in enumerate(text.split("\n"))]
        u = [x for x in u if x[2]]
        for p in range(len(u)):
            run, n = (), 0
            for q in range(p, len(u)):
                run, n = (*run, u[q][1]), n + u[q][2]
                if n >= least and run in seen:
                    gone[a, b].update(u[k][0] for k in range(p, q + 1))
                elif n >= least:
                    seen.add(run)
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[linededup.LAST if i is None else i, hash_of(t.encode())])) for i, t in rows]


def test_line_dedup_like_brute_force(spark, texts):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 5, 12, 30, 60]))) for _ in range(60)]
    rows = list(texts.items())
    for i in range(120):
        lines = []
        while len(lines) < rnd.randint(1, 40):
            k = rnd.randrange(len(pool))
            lines += rnd.choice([pool[k : k + rnd.randint(1, 6)], ["", " "], [" ".join(str(rnd.random()) for _ in range(rnd.randint(1, 20))) + " "]])
        rows.append((1000 + i if i % 17 else None, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, repeated_lines(rows)))


def test_long_passages_leave_one_copy(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(18)) for i in range(3))
    rows = [(i, f"own line {i} of a text\n{passage}\nlast line {i}") for i in range(20)]
    got = [r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == rows[0][1] and all(t == f"own line {i} of a text\nlast line {i}" for i, t in enumerate(got) if i)


def test_line_dedup_deletes_all_repeated_runs(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    own = lambda: [line(rnd.randint(5, 15)) for _ in range(rnd.randint(3, 12))]
    rows, n = [], 0
    for trial in range(60):
        run = [line(rnd.choice([10, 20])) for _ in range(6)]
        # the second document holds only some of the run, the third is to match the first and the second
        for lines in (own() + run[1:4] + own(), own() + run + own(), own() + run[: rnd.randint(3, 6)] + [" "] + own(), run + own() + run):
            rows.append((n, "\n".join(lines)))
            n += 1
    rows += [(None, "\n".join([line(10)] * 9)), (n, "\n".join([line(4), " "] * 15))]
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(linededup.dedup_lines(got, gram_words=5).collect(), key=str) == sorted(got := linededup.dedup_lines(got).collect(), key=str)
    expected = repeated_lines(rows)
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, expected))
    lines = {i: len(t.split("\n")) - len(x.split("\n")) if x else len(t.split("\n")) for (i, t), (_, x) in zip(rows, expected)}
    assert {r.doc_id: r.removed_lines for r in got} == lines


def test_line_dedup_writes_files_by_size(spark, texts):
    df = written(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "texts", len(texts))
    expected = sorted(linededup.dedup_lines(df).collect(), key=str)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        linededup.dedup_lines(df).write.parquet(path := fresh(spark, "result"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(glob.glob(f"{path.removeprefix('file://')}/part-*")) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(spark.read.parquet(path).collect(), key=str) == expected


# language model


def test_lattice_sums_all_segmentations():
    vocab = lm.vocabulary(PIECES)
    rng = np.random.default_rng(0)
    p = np.where(vocab.used, rng.random(vocab.size), 0)
    logp = np.log(np.maximum(p / p.sum(), 1e-300))
    lattice = lm.Lattice(vocab, logp)

    def brute(t):
        total = 1.0 if not t else sum(math.exp(logp[vocab.pieces[t[:n]]]) * brute(t[n:]) for n in range(1, min(len(t), vocab.longest) + 1) if t[:n] in vocab.pieces)
        return total + (math.exp(logp[lattice.spelled(t[0])].sum()) * brute(t[1:]) if t and t[0] not in vocab.pieces else 0)

    words = ["the", "thhaes", "über", "éeaux", "日本", "\U0001f600b", "ﬁx", "a"] * 10
    many = lattice.many(words)
    assert np.allclose(many, [lattice.one(w) for w in words]) and np.allclose(many[:8], [math.log(brute(lm.MARK + w)) for w in words[:8]])
    counts = lattice.expected(["abc"])  # every letter is in one piece
    assert abs(sum(counts[i] * len(w) for w, i in vocab.pieces.items()) - 4) < 1e-9


def test_long_words_are_fitted(monkeypatch):
    vocab = lm.vocabulary(PIECES)
    rng = np.random.default_rng(2)
    lattice = lm.Lattice(vocab, lm.probabilities(vocab, rng.random(vocab.size)))
    words = ["日本語の文は空白を持たない" * 9, "https://example.org/" + "path/" * 30, "a\U0001f600" * 40]
    long = lattice.expected(words)
    assert abs(sum(long[i] * len(w) for w, i in vocab.pieces.items()) - sum(len(lm.MARK + w) for w in words) + sum(w[k] not in vocab.pieces for w in words for k in range(len(w)))) < 1e-6
    monkeypatch.setattr(lm, "LONG", 1000)
    assert np.allclose(long, lattice.expected(words))


def test_frequent_words_are_bounded(spark):
    table = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(300)] + [("unseen", 0)], "word string, c long").repartition(7)
    got = sorted(r.c for r in lm.frequent(table, 20))
    assert 10 < len(got) <= 20 and got == sorted(1000 // (i + 1) for i in range(300))[-len(got) :]
    assert lm.frequent(table.where("c = 1"), 20) == [] and len(lm.frequent(table, 1000)) == 301 and lm.frequent(table.where("false"), 5) == []


def test_every_round_uses_all_words(spark):
    rows = [(f"w{i}", 1) for i in range(31_000)] + [("unlearned", 0)]
    counted = spark.createDataFrame(rows, "word string, c long").repartition(3)
    words = [w for w, c in rows if c]
    got = lm.fitted(counted, PIECES)
    vocab = lm.vocabulary(PIECES)
    cuts = lm.piece_counts(counted, PIECES)
    logp = lm.probabilities(vocab, cuts)
    for _ in range(lm.ROUNDS + 1):
        sums = lm.Lattice(vocab, logp).expected(words)
        sums[vocab.byte] = cuts[vocab.byte]
        logp = lm.probabilities(vocab, sums)
    assert np.allclose(got, logp, rtol=1e-9)


def test_lm_base_scores(spark, sf_dir, texts):
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in lm.op4(spark, sf_dir).collect():
        ws = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_texts_are_sums_over_kinds(spark, monkeypatch):
    vocab = lm.vocabulary(PIECES)
    logp = lm.probabilities(vocab, np.random.default_rng(4).random(vocab.size))
    monkeypatch.setattr(lm, "fitted", lambda *_: logp)
    monkeypatch.setattr(lm, "HOT", 4)
    rows = [(1, "a b a c", "x"), (2, "a d d d e", "x"), (3, "q r q", "y"), (4, "q s a", "y"), (5, "b a z", None), (6, None, "x"), (7, "q q a unseen", None), (8, "", None), (9, "w" * 700, "z"), (10, "a d a b e", "y")]
    train = F.col("doc_id") <= 6
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), PIECES, train, kind_col="lang").collect()}
    tokens = {i: [*(t or "").split(), None] for i, t, _ in rows}

    def model(ids, back):
        c = collections.Counter(w for i in ids for w in tokens[i])
        n, ends = sum(c.values()), c.pop(None)
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice)))
        return lambda w: ends / n if w is None else max(c[w] - d, 0) / n + d * len(c) / n * back(w)

    lattice = lm.Lattice(vocab, logp)
    whole = model(range(1, 7), lambda w: math.exp(lattice.one(w)))
    share = 1 - whole(None)
    models = [(1 + 1, whole), *((n + 1, model(ids, lambda w: whole(w) / share)) for n, ids in ((3, (1, 2, 6)), (2, (3, 4))))]
    for i, r in got.items():
        if i != 9:
            assert abs(r.score - math.log10(sum(n / 9 * math.prod(map(m, tokens[i])) for n, m in models))) < 1e-9, i
    assert -20_000 < got[9].score < -1000  # below what a float's probability can be
    plain = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, train).collect()}
    assert abs(plain[10] - math.log10(math.prod(map(whole, tokens[10])))) < 1e-9 and got[10].score != plain[10]


def test_rare_words_are_joined_like_frequent_ones(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    whole = {r.doc_id: r for r in lm.score(docs, PIECES, F.lit(True)).collect()}
    monkeypatch.setattr(lm, "HOT", 5)
    for r in lm.score(docs, PIECES, F.lit(True)).collect():
        assert r.n_known == whole[r.doc_id].n_known and abs(r.score - whole[r.doc_id].score) < 1e-6 * abs(r.score)


# web archives


def test_magic_in_payloads(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "3000")
    spark.conf.set(keys[1], "1")
    try:
        inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:cellquill:page:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nnope"
        rows = [(i, f"u{i}", ("é" * i + inner * (i % 3) if i % 4 else "") if i % 7 else "same") for i in range(60)] + [(100, "u", "WARC/1.1\r\n" * 500), (101, "u", "same")]
        path = fresh(spark, "warc")
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
        first = {}
        for i, _, h in rows:
            first.setdefault(h, i)
        expected = {(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows}
        assert {tuple(r) for r in warc.read_warc(spark, path).collect()} == expected
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


# languages


def test_language_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = langid.op6(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_mixture_proportions():
    rng = np.random.default_rng(0)
    p = rng.random((300, 3)) ** 8
    p /= p.sum(axis=0)
    n = rng.multinomial(100_000, p @ np.array([0.7, 0.0, 0.3])).astype(float)
    pi, _ = langid.Model.expectation_maximisation(p, n, n.sum())
    assert np.abs(pi - [0.7, 0, 0.3]).max() < 0.02


# packing


def test_packing_round_trip(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    got = packing.op7(spark, sf_dir).toPandas()
    loads = got.groupby("sequence_id")["length"].sum()
    padding = ((4096 - loads) * (np.bitwise_count(loads.to_numpy()) != 1)).sum()
    assert loads.max() <= 4096 and padding < 0.03 * loads.sum() + 4096
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.r_[0, np.cumsum(s["length"])[:-1]]).all()
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        ids, at = np.array([*t.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_words_make_up_texts():
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    odd = ["<|endoftext|>Ab<|startoftext|> x", "İstanbul ΣΑΣ. naïve don't \"we'll\" (e.g.) 3.14 ﬁx 日本語 é́ áb\xa0nbsp em", "it's.IT'S 'tis \"'s\"", "\U0001f600 ok…", "", "ǅ ª ʰx Aͅ <|x", "a.b.c, (d)!"]
    assert fast(odd) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]


def test_last_windows_are_merged_whole(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").repartition(40)
    got = packing.pack(docs, WORDS).toPandas()
    loads = got.groupby("sequence_id")["length"].sum()
    assert loads.max() <= 4096 and len(loads) < loads.sum() / 4096 + 15


# near-duplicates


def test_links_are_complete(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 400)  # cuts the crowded anchors into tiles
    rng = np.random.default_rng(0)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    points = [base, np.uint64(12345) ^ one(3000) ^ one(3000)]
    for k in range(1, 6):
        x = base.copy()
        for _ in range(k):
            x ^= one(300)
        points.append(x)
    points = np.unique(np.concatenate(points))
    parent = list(range(len(points)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points ^ p) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    values = points.view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.root for r in components(found).collect()}
    ours, brute = collections.defaultdict(set), collections.defaultdict(set)
    for i, v in enumerate(values):
        ours[got.get(v, v)].add(v)
        brute[root(i)].add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, brute.values()))


def test_fingerprints(texts):
    for text in list(texts.values())[:40]:
        ws = (text or "").encode().lower().split()
        grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# media


@pytest.mark.parametrize("n", [64, 640, 64 * 37, 64 * 6 * 5000, 64 * 6 * 33_000])
def test_jpeg_keeps_payloads(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    image = jpeg.decode(jpeg.encode(data))
    assert jpeg.payload(image) == data and jpeg.rgb(image, 0, 2).shape[2] == 3


def test_jpeg_symbol_by_symbol():
    """A small grey file with runs, end-of-band runs and refinement, written bit by bit."""
    symbols = [0x00, 0x01, 0x02, 0x11, 0x21, 0xF0, 0x10, 0x20]  # eight symbols of four bits
    code = {s: format(i, "04b") for i, s in enumerate(symbols)}
    table = lambda kind: jpeg._segment(0xC4, bytes([kind << 4, 0, 0, 0, 8] + [0] * 12) + bytes(symbols))
    scan = lambda ss, se, ah, al, bits: jpeg._scan([1], ss, se, ah, al, jpeg._packed(np.array(list(map(int, bits)), np.uint8)))
    frame = jpeg._segment(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    dc = code[0x02] + "11" + code[0x00] + code[0x01] + "0"  # differences 3, 0, -1
    first = code[0x11] + "1" + code[0x01] + "0" + code[0x00] + code[0x10] + "0"  # block 0: +1 at 2, -1 at 3; then two blocks end at once
    refine = code[0x01] + "1" + code[0x21] + "0" + "10" + code[0x20] + "01" + ""  # block 0: new +1 at 1, correct 2 and 3, new -1 two zeros on
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\1" * 64) + frame + table(0) + table(1) + scan(0, 0, 0, 0, dc) + scan(1, 63, 0, 1, first) + scan(1, 63, 1, 0, refine) + b"\xff\xd9"
    coef = jpeg.decode(data).components[1]["coef"].reshape(3, 64)
    assert coef[:, 0].tolist() == [3, 3, 2] and coef[0, 1:8].tolist() == [1, 3, -2, 0, 0, -1, 0] and not coef[1:, 1:].any()


def test_inverse_transform_and_colour():
    image = jpeg.decode(jpeg.encode(bytes(range(64)) * 6))
    comp = image.components[1]
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = comp["coef"][0, 0]
    assert np.abs(jpeg.DCT.T @ natural.reshape(8, 8) @ jpeg.DCT - jpeg._pixels(comp["coef"], comp["quant"])[:8, :8]).max() < 1e-3
    for c in image.components.values():
        c["coef"][:] = 0
    assert (jpeg.rgb(image) == 128).all()


def test_media_rows(spark, sf_dir, texts):
    for r in media.op9(spark, sf_dir).collect():
        n, raw = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def test_tensors_come_in_bands(spark):
    data = bytes(np.random.default_rng(5).integers(32, 127, 64 * 6 * (2 * media.STRIP + 9), dtype=np.uint8))
    made = media.stored(spark.createDataFrame([(1, "abc"), (2, data.decode())], "doc_id long, text string"))
    got = media.tensors(made).orderBy("doc_id", "first").collect()
    assert [r.doc_id for r in got] == [1, 2, 2, 2]  # 4105 units in two rows
    for doc, raw in ((1, media.padded("abc")[1]), (2, data)):
        bands = [np.frombuffer(r.rgb, np.uint8).reshape(r.height, -1, 3) for r in got if r.doc_id == doc]
        assert [r.first for r in got if r.doc_id == doc] == [0, *np.cumsum([b.shape[1] for b in bands])[:-1]]
        assert (np.concatenate(bands, axis=1) == jpeg.rgb(jpeg.decode(jpeg.encode(raw)))).all()


# top-k


def test_top_k_prunes_without_loss(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 24)) * np.exp(rng.normal(size=(400, 1))) * 0.2
    v[100:160] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(64 * v).astype(np.int64)
    expected = {}
    for i in range(0, 400, 20):
        s = q @ q[i]
        expected[i] = [(j, int(s[j])) for j in sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:20]]
    got = collections.defaultdict(dict)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert {i: [x[r] for r in range(1, 21)] for i, x in got.items()} == expected


def test_words_pattern():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb c d\x0be") == [w.decode() for w in "a\x1cb c d\x0be".encode().split()]


def test_fold(spark):
    df = spark.createDataFrame([(7,), (None,)], "doc_id long").select(fold(F.col("doc_id"), 5)).collect()
    assert [r[0] for r in df] == [zlib.crc32(b"7") % 5, -1]
