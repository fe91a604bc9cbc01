"""Packing documents into sequences of a fixed length: bounded-space best fit with a fixed number of open windows.

Each input partition is one online packer. It tokenises its documents, cuts full windows off long ones, and puts the rest
into the open window that it fills best. When none of the open windows has room, the fullest is emitted: first filled up
with the head of the document if its gap is at least ``min_cut`` tokens, else with that gap as padding. At the end of the
partition its open windows are merged, cut at window borders, which leaves at most one window that isn't full; those last
windows of all partitions are merged whole, first-fit by falling size, in groups of a bounded number of partitions.

Memory: a batch of documents, ``open_windows`` windows and a bounded word cache. The table of pieces (no text, no ids) is
written to the shared folder once, so the merge never sees a packer run again.

Nulls: a null text is packed as an empty document, which has its end id only; null ids are carried. Repeated rows are packed
once each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
MERGED = 256  # partitions whose last windows one task merges
CACHE = 500_000  # words a worker remembers
MARKS = b'.,;:!?()"'  # that may stand around a word; none of them starts a contraction
DOCS = 100  # documents tokenised at once


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, put together from a cache of words.

    The vocabulary drops white space and lower-cases, and none of its tokens spans white space; so a text's ids are those of
    its words in turn. ASCII capitals are folded before the look-up, which keeps the cache small.
    """

    def __init__(self, path: str):
        # one thread: the cores belong to other tasks, and each thread would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        def encoder(tokenizer: Tokenizer):
            return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = encoder(self.tokenizer)
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.encode_plain = encoder(plain)
        self.known: dict[bytes, bytes] = {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def learn(self, new: list[bytes]) -> None:
        """Puts the ids of new words into the cache.

        A run of letters is one token group, and its last id alone is a word's end; so bare words are encoded as one text and
        cut there, those of plain letters without the vocabulary's normalising and splitting, which leave them as they are.
        Marks around a word are groups of their own. Other words are encoded one by one.
        """
        known, plain, bare, marked, rest = self.known, [], [], [], []
        for word in new:
            if word.isalpha():
                plain.append(word)
                continue
            core = word.strip(MARKS)
            if core.isalpha():
                marked.append((word, core))
                plain.append(core)
            elif not (core and core.decode().isalpha()):
                rest.append(word)
            else:
                bare.append(core)
                if len(core) != len(word):
                    marked.append((word, core))
        for words, encode in ((plain, self.encode_plain), (bare, self.encode)):
            words = list(set(words).difference(known))
            for at in range(0, len(words), 2000):
                some = words[at : at + 2000]
                ids = np.array(encode([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
                if len(cuts) == len(some) + 1:
                    raw = ids.tobytes()
                    known.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
                else:
                    rest += some
        around = [(w, w[: (at := w.index(c))], c, w[at + len(c) :]) for w, c in marked]
        rest += {m for _, head, _, tail in around for m in (head, tail)}.difference(known)
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            for word, got in zip(some, self.encode([w.decode() for w in some], add_special_tokens=False)):
                known[word] = np.array(got.ids, "<u4").tobytes()
        for word, head, core, tail in around:
            known[word] = known[head] + known[core] + known[tail]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # special tokens are found before lower-casing, so texts that could hold one keep their case
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.values.dictionary_encode()  # cut and numbered in Arrow: the cache is asked once for each distinct word
        raw, starts = words.dictionary.buffers()[2], np.frombuffer(words.dictionary.buffers()[1], np.int32)[: len(words.dictionary) + 1].tolist()
        distinct = list(map((raw.to_pybytes() if raw else b"").__getitem__, map(slice, starts, starts[1:])))
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[b""] = b""  # between a text's end and white space there
        ids = list(map(self.known.get, distinct))
        new = [i for i, got in enumerate(ids) if got is None]
        self.learn([distinct[i] for i in new])
        for i in new:
            ids[i] = self.known[distinct[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes, ids = words.indices.to_numpy(), np.frombuffer(b"".join(ids), "<u4")
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """The online packer of one partition. A piece is [doc_id, start, ids as bytes, doc_tokens]."""

    def __init__(self, window: int, open_windows: int, min_cut: int, first_id: int):
        self.window, self.most, self.min_cut, self.next_id = window, open_windows, min_cut, first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.out: list[tuple] = []

    def emit(self, pieces: list, is_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, is_open))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, start, full = len(ids) // 4, 0, self.window
        while total - start >= full:
            self.emit([[doc, start, ids[4 * start : 4 * (start + full)], total]])
            start += full
        while start < total:
            n = total - start
            fits = [i for i, (used, _) in enumerate(self.open) if used + n <= full]
            if fits:
                i = max(fits, key=lambda i: self.open[i][0])
            elif len(self.open) < self.most:
                self.open.append((0, []))
                i = len(self.open) - 1
            else:
                i = max(range(len(self.open)), key=lambda i: self.open[i][0])
                used, pieces = self.open.pop(i)
                gap = full - used
                if gap >= self.min_cut:
                    pieces.append([doc, start, ids[4 * start : 4 * (start + gap)], total])
                    start += gap
                self.emit(pieces)
                continue
            used, pieces = self.open[i]
            pieces.append([doc, start, ids[4 * start :], total])
            start = total
            if used + n == full:
                self.emit(pieces)
                self.open.pop(i)
            else:
                self.open[i] = (used + n, pieces)

    def close(self) -> None:
        """Merges the open windows; the last sequence is marked open unless it is full."""
        rest: list = []
        used = 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, total in pieces:
                while ids:
                    take = min(len(ids) // 4, self.window - used)
                    rest.append([doc, start, ids[: 4 * take], total])
                    ids, start, used = ids[4 * take :], start + take, used + take
                    if used == self.window:
                        self.emit(rest)
                        rest, used = [], 0
        if rest:
            self.emit(rest, True)
        self.open = []


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, open_windows: int = 64, min_cut: int = 64, end_id: int = 2) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        packer = Packer(window, open_windows, min_cut, part << 36)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), DOCS):
                for doc, got in zip(ids[at : at + DOCS], tokens(texts[at : at + DOCS])):
                    packer.add(doc, got + end)
                yield rows(packer, part)
        packer.close()
        yield rows(packer, part)

    def rows(packer: Packer, part: int) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*packer.out)] or [[] for _ in range(8)]
        packer.out = []
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays.insert(7, pa.array([part] * len(arrays[0]), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=[*OUT, "part", "open"])

    small_batches(docs.sparkSession)
    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA), "pieces")
    return pieces.where(~F.col("open")).select(*OUT).unionByName(merged(pieces.where("open"), window))


def merged(last: DataFrame, window: int) -> DataFrame:
    """The partitions' last windows put together whole: at most MERGED of them in a task, by first fit from the largest."""

    def merge(key, pdf):
        pdf = pdf.sort_values(["sequence_id", "offset"])
        loads = pdf.groupby("sequence_id", sort=True)["length"].sum().sort_values(ascending=False, kind="stable")
        bins: list[list[int]] = []  # used, id
        moved = {}
        for sequence, n in loads.items():
            slot = next((b for b in bins if b[0] + n <= window), None)
            if slot is None:
                bins.append(slot := [0, int(sequence)])
            moved[sequence] = (slot[1], slot[0])
            slot[0] += int(n)
        pdf["offset"] += pdf["sequence_id"].map(lambda s: moved[s][1])
        pdf["sequence_id"] = pdf["sequence_id"].map(lambda s: moved[s][0])
        return pdf[OUT]

    kept = last.withColumn("grp", F.floor(F.col("part") / MERGED))
    return kept.groupBy("grp").applyInPandas(merge, ", ".join(SCHEMA.split(", ")[:7]))


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
