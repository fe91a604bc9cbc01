"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of a bounded, hash-chosen sample of the labelled rows of each language (``sample``
documents of a language, whole texts). A document's trigrams then have a likelihood under each language, and
expectation-maximisation finds the language proportions of the document. The set of languages starts from the best single
one and takes in another only while the penalised log likelihood grows, so that stray words don't make a text bilingual.
The prediction is the language of the largest proportion; its score is that proportion. Its fit is the log likelihood of the
text's trigrams of letters under the chosen mixture, less that of random ones: below 0 the text is like none of the languages.

Memory: the model is BUCKETS x languages floats, broadcast; languages are few by nature and no text is collected.

Nulls: a null text, or one without a letter, is ``und`` with score and fit 0; null languages aren't learned from; rows with a null id
are learned from and predicted. Without any labelled row everything is ``und``. Ties go to the language first by code point.
Repeated rows get repeated, equal predictions. Whole texts are read. Other columns are carried along by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name

BUCKETS = 1 << 16
SAMPLE = 3000  # training documents of a language
PENALTY = 0.01  # of log likelihood for each trigram and further language
MIN_SHARE = 0.02
ROUNDS = 25


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, white space as one space."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", np.uint8).astype(np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def lettered(text: str) -> np.ndarray:
    """Whether each of the text's trigrams is of letters and spaces only, so that numbers and marks are no evidence against a language."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b" ", np.uint8)
    ok = (raw == 32) | (raw >= 128) | ((raw >= 97) & (raw <= 122))
    return ok[:-2] & ok[1:-1] & ok[2:]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + 0.1
        self.logp = np.log(p / p.sum(axis=0)).astype(np.float32)  # (BUCKETS, languages)

    def proportions(self, text: str) -> tuple[np.ndarray, float]:
        """Shares of the languages in the text, 0 for those outside the chosen set, and the fit of that mixture."""
        grams, n = np.unique(trigrams(text).astype(np.int64) * 2 + lettered(text), return_counts=True)
        lettered_n = n * (grams & 1)
        logp = self.logp[grams >> 1].astype(np.float64)
        n = n.astype(np.float64)
        shares = np.zeros(len(self.langs))
        single = n @ logp
        chosen = [int(single.argmax())]
        shares[chosen] = 1
        best = single[chosen[0]]
        p = np.exp(logp - logp.max(axis=1, keepdims=True))
        floor = n @ logp.max(axis=1)
        total = n.sum()
        while len(chosen) < len(self.langs):
            tried = []
            for k in range(len(self.langs)):
                if k not in chosen:
                    pi, ll = self.expectation_maximisation(p[:, [*chosen, k]], n, total)
                    tried.append((ll + floor, k, pi))
            ll, k, pi = max(tried, key=lambda t: (t[0], -t[1]))
            if ll - best <= PENALTY * total + np.log(total + 1) or pi.min() < MIN_SHARE:
                break
            best, chosen = ll, [*chosen, k]
            shares[:] = 0
            shares[chosen] = pi
        return shares, float(lettered_n @ (np.log(p @ shares) + logp.max(axis=1) + np.log(BUCKETS)))

    @staticmethod
    def expectation_maximisation(p: np.ndarray, n: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        pi = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            mix = p @ pi
            new = pi * (p.T @ (n / mix)) / total
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, float(n @ np.log(p @ pi))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, 0.0
        shares, fit = self.proportions(text)
        k = int(shares.argmax())
        return self.langs[k], float(min(1.0, shares[k])), fit


def train(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the rows that aren't held out and have a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)))
    langs = sorted(counts, key=lambda x: x.encode())
    # the sample of a language is all rows whose hash is below its share: no sort, no group in one task
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / counts[k]))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("language sample")), F.lit(1_000_003)) / 1_000_003
    chosen = rows.where((draw < share[F.col("lang")]) | F.col("id").isNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(BUCKETS, np.int64) for k in langs}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], names=["lang", "gram", "n"])

    table = np.zeros((BUCKETS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    summed = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    table[summed["gram"].to_numpy(np.int64), summed["lang"].map(at).to_numpy(np.int64)] = summed["n"]
    return Model(langs, table)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with lang_pred, score and fit."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    pred, score, fit, text = (free_name(docs, n) for n in ("lang_pred", "score", "fit", "_text"))
    rows = docs.select(*keep, F.col(text_col).alias(text))
    schema = rows.drop(text).schema.add(pred, "string").add(score, "double").add(fit, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], pred, score, fit])

    return rows.mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs, held_out)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])
