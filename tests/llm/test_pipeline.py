"""The pipeline's stages against plain versions of what they decide."""

import collections

import corpus_pipeline
from cellquill.llm import langid, linededup, mixing, packing, simhash
from cellquill.llm.common import table, written

from .test_operators import repeated_lines


def test_stages_decide_like_plain_versions(spark, sf_dir):
    docs, rows = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), name)
        rows[name] = before.collect(), docs.collect()
    given, kept = rows["language_id"]
    assert {r.doc_id for r in given if langid.has_letter(r.text)} - {r.doc_id for r in kept} == set() and len(kept) > 0.95 * len(given)
    given, kept = rows["line_dedup"]
    plain = dict(repeated_lines([(r.doc_id, r.text) for r in given], linededup.WINDOW_WORDS))
    assert {r.doc_id: r.text for r in kept} == {r.doc_id: plain[r.doc_id] for r in given if plain[r.doc_id].split() or plain[r.doc_id] == r.text}
    given, kept = rows["near_dedup"]
    prints = [(simhash.fingerprint(r.text), r.doc_id) for r in given]
    group = {d: d for _, d in prints}
    for _ in range(8):  # passes of the smallest id over links settle such small groups
        for f, d in prints:
            group[d] = min(group[e] for g, e in prints if (f ^ g).bit_count() <= simhash.THRESHOLD)
    assert sorted(r.doc_id for r in kept) == sorted(set(group.values()))
    given, kept = rows["mix_sources"]
    size = lambda rs: sum(len(r.text.encode().split()) for r in rs)
    times = collections.Counter(r.doc_id for r in kept)
    assert set(times) <= {r.doc_id for r in given} and max(times.values()) <= 2
    sizes = spark.createDataFrame([(s, float(size([r for r in given if r.source == s]))) for s in {r.source for r in given}], "source string, size double")
    for r in mixing.source_targets(sizes).collect():
        assert abs(size([x for x in kept if x.source == r.source]) - r.target) <= max(len(x.text.split()) for x in given if x.source == r.source)
    given, packed = rows["pack"]
    ids = collections.Counter()
    for r in packed:
        ids[r.doc_id] += r.length
    tokens = packing.tokenizer(packing_path())
    counted = collections.Counter()
    for r in given:
        counted[r.doc_id] += len(tokens([r.text])[0]) // 4 + 1
    assert ids == counted


def test_language_stage_rejects_what_is_like_no_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.where("lang = 'de' AND length(text) > 500").first().text
    new = [(-1, "日本語の文章は単語の間に空白を置かない書き方をする" * 4, None), (-2, "xqj vkz wqx zzj kqv jxw " * 20, None), (-3, text, "fr"), (-4, text, None), (-5, "Zx 4733-2211", "fr")]
    new = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in new], docs.schema)
    kept = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs.unionByName(new), sf_dir).collect()}
    assert not {-1, -2} & set(kept) and kept[-3].lang == kept[-4].lang == "de" and kept[-5].lang == "fr"
    assert {r.doc_id for r in docs.collect() if langid.has_letter(r.text)} <= set(kept)


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
