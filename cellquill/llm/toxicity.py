"""Toxicity: a learned lexicon, matched through Levenshtein automata, weighed by context windows.

From a bounded, hash-chosen sample of labelled documents (``sample`` rows) the lexicon takes the words, and stems of 4 to 8
letters, that toxic documents use far more often than others: those with the best evidence (log-likelihood ratio), in any
number of documents from ``LEAST_DOCS``. Its trie is intersected with the terms' Levenshtein automata:
a state of the product is the set of (trie node, edits so far), made when first met, so a word costs one step a letter and
most words die after a few. Stems match exactly and first; words, those that begin with a stem too, match within one edit from
5 letters, two from 9, unless the word is an ordinary one: in ``ORDINARY_DOCS`` of the sample's clean documents or more, at a
rate of ``ORDINARY_RATE`` or more, and no rarer there than in toxic ones.

A token is matched by its runs of letters and as a whole, so that a digit or mark within a word is an edit like others.
Each hit is weighed in a window of ``WINDOW`` words to either side: in quotation marks, or next to a word of reporting, it
counts ``QUOTED``. The sums of exact and of misspelled hits, and the densest window, go into a logistic model that is fitted
on the same sample; labels are used for nothing else. Whole texts are scored, in one pass without a shuffle.

Memory: lexicon of ``TERMS`` entries at most and the automaton's states are kept in each worker; its word cache is cleared
when it has ``CACHE`` words.

Nulls: a null or empty text has no hits and gets the model's score for that; null ids are scored; null labels aren't learned
from; of several labels of an id the highest holds. Without both kinds of labels there is no lexicon and all score 0.
Repeated rows get repeated, equal scores. An empty table gives an empty result. Other columns are carried by ``score``.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, written

SAMPLE, TERMS, CACHE = 20_000, 512, 1_000_000
WINDOW, QUOTED = 8, 0.3
STEMS = (4, 5, 6, 7, 8)
ORDINARY = 20_000  # words of clean documents that are no misspellings
ORDINARY_DOCS, ORDINARY_RATE = 2, 1 / 5000
LEAST_DOCS, LEAST_LLR, LEAST_RATIO = 3, 16.0, 20.0
# Quotation marks and words of reporting.
QUOTES = "\"'“”„«»‹›‘’"
REPORTING = frozenset("said says saying quote quoted quotes reported wrote called sagte sagt zitat dit cite dijo dice cita".split())
LETTERS = re.compile(r"[^\W\d_]+")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def spellings(token: str) -> set[str]:
    """What of a token is matched: its runs of letters, and the whole of it without outer marks, as digits and marks may stand for letters."""
    core = token.strip(string.punctuation)
    if core.isalpha():  # nearly every token: both are the same
        return {core}
    return {*LETTERS.findall(token), OUTER.sub("", token)} - {""}


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """``match`` gives (term, edits) of the nearest entry, or None. Entries that end in * are stems."""

    def __init__(self, terms: list[str]):
        # trie nodes: children, the term that ends here, the stem that ends here, the most edits of any term below
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget = [0]
        for term in terms:
            node, name = 0, term.removesuffix("*")
            allowed = 0 if term.endswith("*") else edits(name)
            self.budget[0] = max(self.budget[0], allowed)
            for letter in name:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.word)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.budget.append(0)
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], allowed)
            if term.endswith("*"):
                self.stem[node] = term
            else:
                self.word[node] = term
        self.states: dict[frozenset, dict] = {}
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> dict:
        """The product state of trie nodes with their least edits: its transitions by letter, under "" what it accepts, under None its nodes."""
        todo = list(nodes)
        while todo:  # letters of the term that the text leaves out
            n = todo.pop()
            for child in self.children[n].values():
                e = nodes[n] + 1
                if e <= self.budget[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.states:
            ends = [(e, self.word[n]) for n, e in key if self.word[n] and e <= edits(self.word[n])]
            stems = [self.stem[n] for n, e in key if self.stem[n] and e == 0]
            self.states[key] = {None: dict(key), "": min(ends)[::-1] if ends else None, "stem": (min(stems), 0) if stems else None}
        return self.states[key]

    def step(self, state: dict, letter: str) -> dict | None:
        out: dict[int, int] = {}
        for n, e in state[None].items():
            for c, child in self.children[n].items():
                cost = e + (c != letter)
                if cost <= self.budget[child] and cost < out.get(child, 9):
                    out[child] = cost
            if e + 1 <= self.budget[n] and e + 1 < out.get(n, 9):
                out[n] = e + 1
        state[letter] = self.state(out) if out else None
        return state[letter]

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > 200_000:
            self.states.clear()
            self.start = self.state({0: 0})
        state, stem = self.start, None
        for letter in word:
            state = state[letter] if letter in state else self.step(state, letter)
            if state is None:
                return stem
            stem = stem or state["stem"]
        return stem or state[""]


class Model:
    """Entries of the lexicon with their weights, ordinary words that look like them, and the logistic weights."""

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset(), weights: np.ndarray | None = None):
        self.terms, self.ordinary, self.weights = terms, ordinary, np.zeros(0) if weights is None else weights


class Scorer:
    def __init__(self, model: Model):
        self.lexicon, self.terms, self.ordinary, self.weights = Lexicon(list(model.terms)), model.terms, model.ordinary, model.weights
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log(1 + exact hits), log(1 + misspelled hits), weight of the densest window; hits count by context."""
        tokens = (text or "").lower().split()
        distinct = set(tokens)
        for token in distinct - self.seen:
            for word in sorted(spellings(token)):
                found = self.lexicon.match(word)
                if found and not (found[1] and word in self.ordinary) and (token not in self.hits or found[1] < self.hits[token][1]):
                    self.hits[token] = found
        self.seen |= distinct
        if len(self.seen) > CACHE:
            self.seen.clear()
            self.hits = {t: self.hits[t] for t in distinct & self.hits.keys()}
        here = distinct & self.hits.keys()
        if not here:
            return 0.0, 0.0, 0.0
        at = [i for i, t in enumerate(tokens) if t in here]
        sums, weights = [0.0, 0.0], []
        for i in at:
            term, off = self.hits[tokens[i]]
            w, miss = (QUOTED if quoted(tokens, i) else 1.0) * self.terms[term], off > 0
            sums[miss] += w
            weights.append(w * (0.5 if miss else 1.0))
        dense, first, inside = 0.0, 0, 0.0
        for k, i in enumerate(at):
            inside += weights[k]
            while at[first] < i - WINDOW:
                inside -= weights[first]
                first += 1
            dense = max(dense, inside)
        return float(np.log1p(sums[0])), float(np.log1p(sums[1])), min(dense, 5.0)

    def score(self, text: str | None) -> float:
        if len(self.weights) == 0:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + np.dot(self.weights[1:], self.features(text)), -30, 30))))


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the window has a mark that opens before the word and one that closes after it, or a word of reporting."""
    before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
    opens = any(t[0] in QUOTES for t in before)
    closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") != "" for t in after)
    return (opens and closes) or any(t.strip(".,;:!?" + QUOTES) in REPORTING for t in before[:-1] + after[1:])


def _llr(a: Column, b: Column, na: int, nb: int) -> Column:
    """Log-likelihood ratio of a of na against b of nb."""
    p = (a + b) / (na + nb)
    part = lambda k, n, q: k * F.log(F.greatest(q, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))
    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Lexicon entries from ``sample`` (text, toxic) with weights: their log odds, over that of a word in a tenth of toxic and 1/1000 of other documents, at most 1.5."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = set(LETTERS.findall((text.as_py() or "").lower()))
                seen[toxic].update(ws | {w[:k] + "*" for w in ws for k in STEMS if len(w) > k})
        terms = list(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])
        terms = [t for t in seen[0] if t not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([0] * len(terms), pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])

    sums = sample.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = (F.col("a") / n1) / ((F.col("b") + 0.5) / n0)
    top = sums.withColumn("llr", _llr(F.col("a"), F.col("b"), n1, n0)).where((F.col("a") >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (F.col("llr") >= LEAST_LLR)).toPandas()  # of a bounded sample
    words = {t: a for t, a in zip(top["term"], top["a"]) if not t.endswith("*")}
    # a stem is kept if no single word makes up most of it, and no shorter stem does
    counted = {t[:-1]: a for t, a in zip(top["term"], top["a"]) if t.endswith("*")}
    stems: list[str] = []
    for t, a in sorted(counted.items(), key=lambda x: (len(x[0]), x[0])):
        if not any(s.startswith(t) or t.startswith(s) for s in stems) and not any(w.startswith(t) and n >= 0.9 * a for w, n in words.items()):
            # as specific as it can be: the longest stem that loses hardly any of its documents
            stems.append(max((s for s, n in counted.items() if s.startswith(t) and n >= 0.95 * a), key=lambda s: (len(s), counted[s], s)))
    odds = {t: np.log(((a + 0.5) / n1) / ((b + 0.5) / n0)) / np.log(100) for t, a, b in zip(top["term"], top["a"], top["b"])}
    evidence = dict(zip(top["term"], top["llr"]))
    chosen = sorted([*words, *(s + "*" for s in stems)], key=lambda t: (-evidence[t], t))[:TERMS]
    return {t: float(min(1.5, max(0.1, odds[t]))) for t in chosen}


def ordinary_words(sample: DataFrame, terms: dict[str, float]) -> frozenset[str]:
    """Words of ``sample`` (text, toxic) that only look like a term: clean documents use them at the rate of an ordinary word."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(list(terms)), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic].update(set().union(*map(spellings, set((text.as_py() or "").lower().split()))))
        near = [w for w in seen[0].keys() | seen[1].keys() if (m := lexicon.match(w)) and m[1]]
        yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array([seen[1][w] for w in near], pa.int64()), pa.array([seen[0][w] for w in near], pa.int64())], names=["word", "a", "b"])

    near = sample.mapInArrow(lookalikes, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    near = near.where((F.col("b") >= max(ORDINARY_DOCS, ORDINARY_RATE * n0)) & (F.col("b") * n1 >= F.col("a") * n0))
    return frozenset(r[0] for r in near.orderBy(F.desc("b"), "word").limit(ORDINARY).collect())


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, intercept first and unpenalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from the labelled rows for whose id ``held_out`` doesn't hold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("long").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity sample")), F.lit(1_000_003)) / 1_000_003
    known = known.where(draw < sample / max(n, 1))  # about ``sample`` rows, so this side of the join is small
    rows = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id").select("text", "toxic"), "labelled")
    terms = learn_terms(rows)
    if not terms:
        return Model({})

    ordinary = ordinary_words(rows, terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(terms, ordinary))
        for batch in batches:
            got = [scorer.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.float64()) for i in range(3)] + [batch.column(1)], names=["x1", "x2", "x3", "y"])

    seen: pd.DataFrame = rows.mapInArrow(measure, "x1 double, x2 double, x3 double, y long").groupBy("x1", "x2", "x3", "y").count().toPandas()  # at most ``sample`` rows
    seen = seen.loc[seen.index.repeat(seen["count"])]
    return Model(terms, ordinary, fit(seen[["x1", "x2", "x3"]].to_numpy(), seen["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the score of each row."""
    keep = docs.columns if keep is None else keep
    name, text = free_name(docs, "score"), free_name(docs, "_text")
    rows = docs.select(*keep, F.col(text_col).alias(text))
    schema = rows.drop(text).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = pa.array([scorer.score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")

    def held_out(key: Column) -> Column:
        return fold(key, 3) == 1

    model = train(docs, table(spark, sf_dir, "labels"), held_out)
    scored = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
