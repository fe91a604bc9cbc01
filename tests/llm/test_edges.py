"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from cellquill.llm import langid, linededup, lm, media, mixing, packing, simhash, topk, toxicity, warc
from cellquill.llm.common import fresh, parts, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the first text of all, with words", "en", "a", 33), (1, "the first text of all, with words", "en", "a", 33), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "a text without id", "en", "b", 17),
    (None, None, None, None, None), (4, " \n\t ", "de", "", 4), (5, LONG, "en", "a", len(LONG)), (6, "der text und die wörter — ünïcode \U0001f600 \x00", "de", "b", 40), (7, "the first text of all, with words", "en", "b", 33), (8, "x" * 5000, None, "a", 5000),
]
CLASHING = ["base", "src", "size", "score", "lang_pred", "_text", "fp", "row", "kept", "mix_size", "mix_copies", "_lines", "_a", "gone", "n_lines", "bucket", "rank", "a", "target"]
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    none = toxicity.train(docs, labels.where("false"), lambda k: F.lit(False))
    assert none.terms == {} and {r.score_ for r in toxicity.score(docs.drop("score"), none).select(F.col("score").alias("score_")).collect()} == {0.0}
    scored = toxicity.score(docs, toxicity.Model({"first": 1.0}, weights=toxicity.np.array([-1.0, 2.0, 1.0, 1.0])))
    assert scored.count() == len(ROWS) and scored.columns[-1] == "_score" and toxicity.score(nothing, none).count() == 0
    got = {r.doc_id: r["_score"] for r in scored.collect()}
    assert got[1] == got[7] > 0.5 > got[2] == got[3]
    toxicity.train(docs, labels, lambda k: F.lit(False))


def test_mixing(docs, nothing):
    m = mixing.mix(docs)
    names = mixing.names(docs)
    assert m.count() == len(ROWS) and set(docs.columns) < set(m.columns) and names[0] == "_mix_size"
    by = {(r.doc_id, r.source): r for r in m.collect()}
    assert by[2, None][names[0]] == 0 and by[2, None][names[2]] == 0.0 and by[5, "a"][names[0]] == 60_000
    assert all(0 <= r[names[3]] <= 2 for r in by.values())
    assert mixing.emitted(docs).columns == docs.columns and mixing.mix(nothing).count() == 0 and mixing.emitted(nothing).count() == 0


def test_line_dedup(docs, nothing):
    got = linededup.dedup_lines(docs, gram_words=3, window_words=6)
    rows = got.select("doc_id", "source", "text", F.col(got.columns[-1]).alias("gone"), F.col(got.columns[-2]).alias("n")).collect()
    assert len(rows) == len(ROWS) and linededup.dedup_lines(nothing).count() == 0
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.source), []).append(r)
    assert [r.text for r in by[1, "a"]] == [ROWS[0][1]] * 2 and by[7, "b"][0].text == "" and by[7, "b"][0].gone == 1
    assert by[2, None][0].text is None and by[2, None][0].n == 0 and by[3, "a"][0].text == "" and by[4, ""][0].text == " \n\t "


def test_lm(docs, nothing):
    rows = lm.score(docs, PIECES, F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score(nothing, PIECES, F.lit(True)).count() == 0
    unseen = lm.score(docs, PIECES, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and -1e7 < r.score < 0 for r in unseen)


def test_warc(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u\r\nv", "x"), (3, "u", "x"), (3, "u", "x"), (4, "u", LONG)], "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(2))
    path = fresh(spark, "warc")
    warc.write_warc(pages, path)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "revisit", 1), (0, 1, "revisit", 3), (3, 1, "response", None), (3, 1, "response", None), (4, len(LONG), "response", None)], key=str)


def test_language_id(docs, nothing):
    model = langid.train(docs, F.lit(False))
    assert model.langs == ["de", "en"] and langid.train(nothing, F.lit(False)).langs == []
    got = langid.identify(docs, model)
    by = {r.doc_id: (r["_lang_pred"], r["_score"]) for r in got.collect()}
    assert got.count() == len(ROWS) and by[2] == by[3] == by[4] == ("und", 0.0) and by[6][0] == "de" and by[5][0] == "en"
    assert langid.identify(nothing, model).count() == 0 and {r["_lang_pred"] for r in langid.identify(docs, langid.train(nothing, F.lit(False))).collect()} == {"und"}


def test_packing(docs, nothing):
    got = packing.pack(docs, WORDS, window=64).toPandas()
    assert got["length"].sum() == sum(got.drop_duplicates(["doc_id", "doc_tokens", "start", "sequence_id", "offset"])["length"]) and packing.pack(nothing, WORDS).count() == 0
    assert got.groupby("sequence_id")["length"].sum().max() <= 64 and set(got.loc[got["doc_id"].isin([2, 3, 4]), "doc_tokens"]) == {1} and (got["doc_id"].isna().sum()) >= 2


def test_simhash(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[1].component_id == by[7].component_id == 1 and by[2].fingerprint == "0" * 16 and by[2].component_id == by[4].component_id == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id or r.fingerprint for r in got})
    alone = docs.where("doc_id IS NULL AND text IS NOT NULL")
    assert simhash.near_duplicates(alone).first().component_id is None and simhash.keep_one(alone.unionByName(alone)).count() == 1


def test_media(docs, nothing):
    got = media.read_media(media.with_media(docs)).toPandas()
    assert len(got) == len(ROWS) and set(got.loc[got["doc_id"].isin([2, 3]), "n_bytes"]) == {0} and got["payload_bytes"].min() == 64
    assert got.loc[got["doc_id"].isin([1, 7]), ["payload_sha256", "media_sha256", "feature"]].drop_duplicates().shape[0] == 1 and media.read_media(media.with_media(nothing)).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0]), (9, [0.0, 0.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"bucket": F.lit(1), "id": F.lit(2), "norm": F.lit(3)})
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()]
    assert sorted(r for r in got if r[0] == 0) == [(0, 1, 2, 4096), (0, 2, 2, 4096), (0, 3, 1, 2048)] and sorted(r for r in got if r[0] == 20)[0] == (20, 1, 9, 0)
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_small_tables_have_few_files(spark):
    rows = spark.range(0, 1000, 1, 200)
    few = written(rows, "few", rows=1000)
    assert few.count() == 1000 and 1 <= len(few.inputFiles()) <= parts(spark, 1000) < 200 == len(written(rows, "many").inputFiles())
    assert parts(spark, 10**10) == 20_000 and parts(spark, size=1 << 40) == 32_768 and parts(spark, 10**18) == 1_000_000


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, nothing, stage, tmp_path):
    name, function = corpus_pipeline.STAGES[stage]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, plain):
        out = function(spark, table, str(tmp_path))
        assert out.count() > 0 and (stage == 4 or out.columns == table.columns)
    assert function(spark, nothing, str(tmp_path)).count() == 0
