"""Language-model scoring by subword lattice likelihood.

The vocabulary is that of a public subword tokenizer, which is not trained. Its pieces get unigram probabilities by
expectation-maximisation over the distinct training words, from the tokenizer's own cuts on. The probability of
a word is the sum over all its segmentations, by a forward recursion in log space. Besides the paths of pieces, which share
the mass D * V / N that absolute discounting leaves over (V words among N training tokens), the lattice of a word that was
seen c times has one arc for the whole word, of weight (c - D) / N. Words start at the vocabulary's space mark, so a text's
segmentations are those of its words combined, and its log probability is the sum of theirs and of the end's.

Kinds of text (languages) have such a model each, of their own words' counts; what these give up goes to the words of all texts
by the model above. A text's kind is a hidden choice like its segmentation: the likelihoods under each kind, and under none,
are summed by the kinds' shares of the training rows. Each model's probabilities add up to one, and so do the texts'.

Every distinct word is scored once, in a distributed table of words. Documents then look up the most frequent words, ``HOT`` at
most, in a broadcast dictionary of that bounded size; their other words go through a join with the whole table, so nothing is left out.

Nulls: a null text is an empty one: its end is its one token. A null id falls in no fold, is learned from and scored. Repeated
rows count, and are scored, once each. An empty table gives an empty result; if all rows are held out the pieces are equally
likely, a word has half of their lattice's probability and the end the other half. A row whose kind is null, or none of the
most frequent, is learned from for all texts only. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, words, written

HOT = 100_000
FLUSH = 400_000  # distinct words a task gathers before it sends their counts
MARK = "▁"  # the vocabulary's space mark
SMOOTH = 0.1
KINDS = 16  # kinds of text with word counts of their own
LONG = 48  # letters from which a word is scored by itself
SLOTS = 1 << 19
ROUNDS = 6
AT_ONCE = 4000  # words whose lattices are made at once
NONE, PREFIX = -1, -2  # no piece; only the start of one
BETWEEN = 1 << 32  # no letter's code
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, text_col: str, training: Column, kind: Column | None = None, kinds: int = 0) -> DataFrame:
    """(word, c, c1 ...): every word of ``docs`` with its count in the training rows, which may be 0, and in those of each ``kind`` from 1 to ``kinds``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(kinds + 1)]
        for batch in batches:
            for text, train, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ws = words(text.as_py())
                seen[k if train else 0].update(ws if train else dict.fromkeys(ws, 0))
                if sum(map(len, seen)) > FLUSH:
                    yield from sent(seen)
        yield from sent(seen)

    def sent(seen: list[Counter]) -> Iterator[pa.RecordBatch]:
        for w in [w for w, c in seen[0].items() if c == 0 and any(w in counts for counts in seen[1:])]:
            del seen[0][w]
        for k, counts in enumerate(seen):
            cells = [pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array([k] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["word", "k", "c"])
            counts.clear()

    rows = docs.select(F.col(text_col), training, F.lit(0) if kind is None else kind).mapInArrow(count, "word string, k int, c long")
    of_kind = [F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(1, kinds + 1)]
    # a task has summed each word already: shuffled as they are, rows need no table of sums before
    return rows.repartition("word").groupBy("word").agg(F.sum("c").alias("c"), *of_kind)


class Vocabulary:
    """The pieces of a tokenizer that can stand in a marked word."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.pieces: dict[str, int] = {}
        for i in range(n):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i) or MARK in piece[1:]):
                self.pieces[piece] = i
        self.longest = max(map(len, self.pieces))
        self.size = n
        self.used = np.zeros(n, bool)
        self.used[list(self.pieces.values())] = True
        self.used[self.byte] = True


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def probabilities(vocab: Vocabulary, counts: np.ndarray) -> np.ndarray:
    p = np.where(vocab.used, counts + SMOOTH, 0.0)
    return np.log(np.maximum(p / p.sum(), 1e-300))


def fitted(counted: DataFrame, path: str) -> np.ndarray:
    """Log probability of each piece by expectation-maximisation over all distinct training words, in ``ROUNDS`` rounds and a last one.

    The rounds start from the tokenizer's own cuts, which also count letters that are no pieces.
    """
    vocab = vocabulary(path)
    cuts = piece_counts(counted, path)
    logp = probabilities(vocab, cuts)
    if not cuts.any():
        return logp
    for _ in range(ROUNDS + 1):
        sums = expected_counts(counted, path, logp)
        sums[vocab.byte] = cuts[vocab.byte]
        logp = probabilities(vocab, sums)
    return logp


def expected_counts(counted: DataFrame, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all distinct training words; as many rows as pieces come to the driver."""
    held = counted.sparkSession.sparkContext.broadcast(logp)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = weighed(path, held.value)
        sums, waiting = np.zeros(len(held.value)), []
        for batch in batches:
            waiting += batch.column(0).to_pylist()
            if len(waiting) >= AT_ONCE:
                sums += lattice.expected(waiting)
                waiting = []
        sums += lattice.expected(waiting)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["piece", "n"])

    got = counted.where("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(len(logp))
    sums[got["piece"].to_numpy(np.int64)] = got["n"]
    held.destroy()
    return sums


def piece_counts(counted: DataFrame, path: str) -> np.ndarray:
    """How often the tokenizer cuts each piece out of the distinct training words; as many rows as pieces come to the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sums = np.zeros(v.size, np.int64)
        for batch in batches:
            ids = v.processor.encode(batch.column(0).to_pylist(), num_threads=1)
            sums += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64), minlength=v.size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["piece", "n"])

    got = counted.where("c > 0").select("word").mapInArrow(cut, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary(path).size, np.int64)
    out[got["piece"].to_numpy(np.int64)] = got["n"]
    return out


class Lattice:
    """Natural-log probability of words over all their segmentations into pieces."""

    def __init__(self, vocab: Vocabulary, logp: np.ndarray):
        self.vocab = vocab
        # pieces by the hash of their letters, and what is only the start of a piece
        sizes = np.fromiter(map(len, vocab.pieces), np.int64, len(vocab.pieces))
        of, codes = np.fromiter(vocab.pieces.values(), np.int64, len(sizes)), np.frombuffer("".join(vocab.pieces).encode("utf-32-le"), np.uint32)
        first, key, found = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64), {}
        for n in range(1, vocab.longest + 1):
            key = np.where(sizes >= n, _mix(key, codes[np.minimum(first + n - 1, len(codes) - 1)].astype(np.uint64)), key)
            found |= dict.fromkeys((key[sizes > n]).tolist(), PREFIX)
        found |= zip(key.tolist(), of.tolist())
        keys, ids = np.fromiter(found, np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        self.bits, self.ids = np.zeros(SLOTS, np.uint64), np.full(SLOTS, NONE)
        slots = _slot(keys)
        first = np.unique(slots, return_index=True)[1]
        self.bits[slots[first]], self.ids[slots[first]] = keys[first], ids[first]
        # entries whose slot is taken are found in a sorted table
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_keys, self.rest_ids = keys[rest], ids[rest]
        self.weigh(logp)

    def weigh(self, logp: np.ndarray) -> None:
        self.logp = np.append(logp, -np.inf)  # the last is that of no piece, -1

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each hash; PREFIX for what only starts one, NONE for all else."""
        slot = _slot(keys)
        held = self.bits[slot]
        out = np.where(held == keys, self.ids[slot], NONE)
        other = np.flatnonzero((held != keys) & (held != 0))
        if len(self.rest_keys) and len(other):
            at = np.minimum(np.searchsorted(self.rest_keys, keys[other]), len(self.rest_keys) - 1)
            out[other] = np.where(self.rest_keys[at] == keys[other], self.rest_ids[at], NONE)
        return out

    def spelled(self, letter: str) -> np.ndarray:
        """A letter that is no piece is spelled in bytes: their ids."""
        return self.vocab.byte[list(letter.encode("utf-8", "replace"))]

    def one(self, word: str) -> float:
        text, longest = MARK + word, self.vocab.longest
        pieces, alpha = self.vocab.pieces, [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            terms = [alpha[i] + self.logp[k] for i in range(max(0, j - longest), j) if (k := pieces.get(text[i:j])) is not None]
            if text[j - 1] not in pieces:
                terms.append(alpha[j - 1] + self.logp[self.spelled(text[j - 1])].sum())
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        return float(alpha[-1])

    def many(self, batch: list[str]) -> np.ndarray:
        out = np.empty(len(batch))
        short = [i for i, w in enumerate(batch) if len(w) <= LONG]
        for at in range(0, len(short), AT_ONCE):
            some = short[at : at + AT_ONCE]
            arcs = Arcs(self, [batch[i] for i in some])
            out[some] = arcs.forward()[arcs.last]
        for i, w in enumerate(batch):
            if len(w) > LONG:
                out[i] = self.one(w)
        return out

    def expected(self, batch: list[str]) -> np.ndarray:
        """Expected number of times each piece is used in the words, over their segmentations."""
        sums = np.zeros(len(self.logp))
        short = [w for w in batch if len(w) <= LONG]
        for at in range(0, len(short), AT_ONCE):
            sums += Arcs(self, short[at : at + AT_ONCE]).uses()
        for w in batch:
            if len(w) > LONG:
                self.add_expected(w, sums)
        return sums[:-1]

    def add_expected(self, word: str, sums: np.ndarray) -> None:
        """Adds a long word's expected pieces to ``sums``; letters spelled in bytes add to its last, as in ``expected``."""
        text, longest, pieces = MARK + word, self.vocab.longest, self.vocab.pieces
        n = len(text)
        arcs = []
        for i in range(n):
            out = [(j, k, float(self.logp[k])) for j in range(i + 1, min(n, i + longest) + 1) if (k := pieces.get(text[i:j])) is not None]
            if text[i] not in pieces:
                out.append((i + 1, len(sums) - 1, float(self.logp[self.spelled(text[i])].sum())))
            arcs.append(out)
        alpha: list[list[float]] = [[] for _ in range(n + 1)]
        alpha[0] = [0.0]
        ahead = [-math.inf] * (n + 1)
        for i in range(n + 1):
            ahead[i] = _logsum1(alpha[i])
            for j, _, weight in arcs[i] if i < n else []:
                alpha[j].append(ahead[i] + weight)
        beta = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            beta[i] = _logsum1([weight + beta[j] for j, _, weight in arcs[i]])
        for i in range(n):
            for j, k, weight in arcs[i]:
                sums[k] += math.exp(ahead[i] + weight + beta[j] - ahead[n])


class Arcs:
    """The arcs of a batch of words: from node ``tail`` to node ``head``, with piece (NONE for a letter spelled in bytes) and weight.

    Each word has a node before each of its letters, the mark first, and one at its end, ``last``. Nodes are places in the words
    put one after another with a code between that no piece has.
    """

    def __init__(self, lattice: Lattice, batch: list[str]):
        self.sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 2
        self.last = np.cumsum(self.sizes) - 1
        codes = np.frombuffer("".join(f"{MARK}{w} " for w in batch).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[self.last] = BETWEEN
        at, key = np.flatnonzero(codes != BETWEEN), np.uint64(0)
        found = []
        for n in range(1, lattice.vocab.longest + 1):  # all starts grow by a letter at once, till no piece goes on
            key = _mix(key, codes[at + (n - 1)])
            ids = lattice.lookup(key)
            here = np.flatnonzero(ids >= 0) if n > 1 else slice(None)
            found.append((at[here], at[here] + n, np.maximum(ids[here], NONE)))
            on = np.flatnonzero(ids != NONE)
            at, key = at[on], key[on]
        self.tail, self.head, self.ids = map(np.concatenate, zip(*found))
        self.weights = lattice.logp[self.ids]
        byte = self.ids == NONE
        if byte.any():
            letters, inverse = np.unique(codes[self.tail[byte]], return_inverse=True)
            self.weights[byte] = np.array([lattice.logp[lattice.spelled(chr(c))].sum() for c in letters])[inverse]
        self.offset = np.arange(len(codes)) - np.repeat(self.last - self.sizes + 1, self.sizes)
        self.nodes, self.pieces = len(codes), len(lattice.logp)

    def sums(self, offset: np.ndarray, to: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log sums along the arcs ``of`` -> ``to``, in order of ``offset`` (from 0), over nodes that begin as 0."""
        order = np.argsort(offset * self.nodes + to)
        to, of, weights, out = to[order], of[order], self.weights[order], np.zeros(self.nodes)
        ends = np.cumsum(np.bincount(offset)).tolist()
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            nodes = to[a:b]
            cuts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            terms = out[of[a:b]] + weights[a:b]
            top = np.maximum.reduceat(terms, cuts)
            total = np.add.reduceat(np.exp(terms - np.repeat(top, np.diff(np.r_[cuts, b - a]))), cuts)
            out[nodes[cuts]] = top + np.log(total)
        return out

    def forward(self) -> np.ndarray:
        """Log probability of all ways from a word's start to each node."""
        return self.sums(self.offset[self.head], self.head, self.tail)

    def backward(self) -> np.ndarray:
        """Log probability of all ways from each node to its word's end."""
        return self.sums(self.offset.max() - self.offset[self.tail], self.tail, self.head)

    def uses(self) -> np.ndarray:
        alpha, beta = self.forward(), self.backward()
        share = np.exp(alpha[self.tail] + self.weights + beta[self.head] - np.repeat(alpha[self.last], self.sizes)[self.tail])
        return np.bincount(np.where(self.ids == NONE, self.pieces - 1, self.ids), share, self.pieces)


_lattices: dict[str, Lattice] = {}


def weighed(path: str, logp: np.ndarray) -> Lattice:
    """The process's lattice of the vocabulary, with these weights."""
    if path not in _lattices:
        _lattices[path] = Lattice(vocabulary(path), logp)
    _lattices[path].weigh(logp)
    return _lattices[path]


def _logsum1(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(45)).astype(np.int64)


def _mix(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    key = (key ^ (code + np.uint64(1))) * _MUL
    return key ^ (key >> np.uint64(29))


def frequent(table: DataFrame, most: int) -> list:
    """The most frequent words' rows: those down to a level of the count, in steps of a 16th of its logarithm, that at most ``most`` words reach.

    Levels are counted first, so no task sends a list of its own to the driver.
    """
    level = F.floor(16 * F.log2(F.col("c") + 1))
    sizes = table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows
    least, n = math.inf, 0
    for row in sizes:
        n += row["count"]
        if n > most:
            break
        least = row["level"]
    return table.where(level >= F.lit(least)).collect() if n and least < math.inf else []


class Discounted:
    """Absolute discounting: a word seen c times keeps (c - D) / N, as a logarithm; ``left`` is the share that all words give up, ``end`` that of texts' ends."""

    def __init__(self, n_words: int, types: int, once: int, twice: int, ends: int):
        self.types, self.ends, self.total = types, ends, n_words + ends
        self.discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.left = self.discount * types / self.total if self.total else 0.5
        self.end = ends / self.total if ends else 0.5

    def kept(self, c: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(c - self.discount, 0) / max(self.total, 1))


def measured(counted: DataFrame, ends: list[int]) -> list[Discounted]:
    """The models of all training rows and of each kind, from the counts of ``counted`` and of the texts."""
    names = ["c", *(f"c{k}" for k in range(1, len(ends)))]
    sums = [x for c in names for x in (F.sum(c), *(F.count(F.when(test, 1)) for test in (F.col(c) > 0, F.col(c) == 1, F.col(c) == 2)))]
    got = [int(x or 0) for x in counted.agg(*sums).first()]
    return [Discounted(*got[4 * k : 4 * k + 4], n) for k, n in enumerate(ends)]


def score(docs: DataFrame, vocabulary_path: str, training: Column, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None, kinds: int = KINDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row; ``training`` marks the rows to learn from.

    The ``kinds`` values of ``kind_col`` (a language, say) that most training rows have get word counts of their own; of a scored
    row the column is not read.
    """
    spark = docs.sparkSession
    ends, kind = [docs.where(training).count()], None
    if kind_col is not None:
        found = docs.where(training & F.col(kind_col).isNotNull()).groupBy(F.col(kind_col).cast("string").alias("kind")).count().orderBy(F.desc("count"), "kind").limit(kinds).collect()
        ends += [r["count"] for r in found]
        if found:
            kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(found, 1) for x in (r["kind"], k)]), F.col(kind_col).cast("string")), F.lit(0))
    counted = written(word_counts(docs, text_col, training, kind, len(ends) - 1), "words")
    models = measured(counted, ends)
    whole, of_kind = models[0], models[1:]
    logp = spark.sparkContext.broadcast(fitted(counted, vocabulary_path))
    distinct = whole.types + (whole.ends > 0)
    low = whole.total + SMOOTH * (distinct + 1)
    # a kind whose texts have no words has no model
    used = [k for k, m in enumerate(of_kind, 1) if m.types]
    columns = ["s0", *(f"s{k}" for k in used)]
    share = 1 - whole.end  # of words among tokens

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = weighed(vocabulary_path, logp.value)
        for batch in batches:
            counts = [batch.column(1 + k).to_numpy().astype(np.float64) for k in range(len(models))]
            pieces = lattice.many(batch.column(0).to_pylist()) + math.log(whole.left)
            logs = [np.logaddexp(pieces, whole.kept(counts[0]))]
            logs += [np.logaddexp(logs[0] + math.log(models[k].left / share), models[k].kept(counts[k])) for k in used]
            cells = [pa.array(np.log10((counts[0] + SMOOTH) / low)), *(pa.array(x / math.log(10)) for x in logs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=["word", "c", "base", *columns])

    table = written(counted.mapInArrow(weigh, f"word string, c long, base double, {', '.join(f'{c} double' for c in columns)}"), "scored")
    hot = frequent(table, HOT)
    sums = ["n_known", "base", *columns]
    held = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(hot)}, np.array([[r["c"] > 0, r["base"], *(r[c] for c in columns)] for r in hot], np.float64).reshape(-1, len(sums))))
    end = np.array([whole.ends > 0, math.log10((whole.ends + SMOOTH) / low), *(math.log10(models[k].end) for k in (0, *used))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, values), row = held.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, texts, rare = batch.slice(at, 500), [], ([], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    seen = Counter(words(text.as_py()))
                    place = np.fromiter(map(index.get, seen, repeat(-1)), np.int64, len(seen))
                    times = np.fromiter(seen.values(), np.int64, len(seen))
                    known = place >= 0
                    texts.append((row, doc, int(times.sum()) + 1, times[known] @ values[place[known]] + end))
                    others = np.flatnonzero(~known).tolist()
                    if others:
                        names = list(seen)
                        for column, cells in zip(rare, ([row] * len(others), [doc] * len(others), map(names.__getitem__, others), times[others].tolist())):
                            column.extend(cells)
                    row += 1
                n = len(texts)
                if n:
                    cells = list(zip(*texts))
                    yield rows(cells[0], cells[1], [None] * n, [0] * n, cells[2], [x.tolist() for x in cells[3]])
                n = len(rare[0])
                yield rows(*rare, [0] * n, [None] * n)

    kinds_of = [("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()), ("sums", pa.list_(pa.float64()))]

    def rows(*cells) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, (_, t) in zip(cells, kinds_of)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kinds_of])

    schema = "row long, doc_id long, word string, times long, n_tokens long, sums array<double>"
    looked = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(look, schema), "looked")
    rare = looked.where("word IS NOT NULL").select("row", "doc_id", "word", "times").join(table.withColumn("n_known", (F.col("c") > 0).cast("double")), "word")
    rare = rare.select("row", "doc_id", F.lit(0).cast("long").alias("n_tokens"), *[(F.col("times") * F.col(c)).alias(c) for c in sums])
    texts = looked.where("word IS NULL").select("row", "doc_id", "n_tokens", *[F.get("sums", F.lit(i)).alias(c) for i, c in enumerate(sums)])
    full = texts.unionByName(rare).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", *sums)])
    # the text's kind is unknown: the sum over the kinds, and over none, by their share of training rows
    prior = [ends[0] - sum(ends[k] for k in used), *(ends[k] for k in used)]
    logs = [F.col(c) + math.log10((n + 1) / (ends[0] + len(prior))) for c, n in zip(columns, prior)]
    top = F.greatest(*logs, logs[0])
    total = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in logs), F.lit(0.0)))
    return full.select("doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(whole.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), total.alias("score"))


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    held_out = lambda: fold(F.col("doc_id"), 10) == 0
    scored = score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ~held_out(), kind_col="lang")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
