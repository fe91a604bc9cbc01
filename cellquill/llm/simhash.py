"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into ``PARTS``; if two fingerprints differ in at most 4 bits, then in at most one bit in
one of the three parts. In each part the anchors are a covering code: the [15, 11] Hamming code on its first 15 bits, of
covering radius 1, times all settings of its other bits. A fingerprint belongs to its nearest anchor and is also sent to every
anchor within covering radius plus threshold that a fingerprint one bit away may belong to: at most 8 code words, and the own
code word with one of the other bits flipped. So each linked pair meets at the anchor that either of the two belongs to.

Only distinct fingerprints are compared: exact copies share one. An anchor of more than ``TILE`` fingerprints is cut into tiles
of salted rows and salted columns, so that no task holds it. What leaves a tile is a spanning forest of its links, never all
pairs; components come from alternating star steps over written tables.

Nulls: a null or empty text has no words and fingerprint zero, linked like any other. Null ids take part; a component's id is
the smallest id that isn't null (null if there is none). Repeated rows give repeated rows. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written
from .components import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
PARTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
CODE = 15  # length of the Hamming code
TILE = 4096


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the text's shingles."""
    from xxhash import xxh64_intdigest

    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return 0
    whole = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(SHINGLE, len(ws))
    counts = np.zeros(64, np.int64)
    starts, ends = starts[: len(ws) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    for at in range(0, len(starts), 65536):
        cuts = map(whole.__getitem__, map(slice, starts[at : at + 65536], ends[at : at + 65536]))
        h = np.fromiter(map(xxh64_intdigest, cuts, repeat(SEED)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    return with_fingerprint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "fp").drop("text")


def with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` and the fingerprint of each row's text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def syndrome(x: np.ndarray) -> np.ndarray:
    """0 for a code word of the Hamming code, else 1 plus the bit whose flip leads to the nearest one."""
    s = np.zeros_like(x)
    for bit in range(CODE):
        s ^= ((x >> bit) & 1) * (bit + 1)
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint and part: anchor, index of the fingerprint, whether it belongs there."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = np.arange(len(fps))
    bits = fps.view(np.uint64)
    for p, (first, n) in enumerate(PARTS):
        x = ((bits >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)
        low, high = x & ((1 << CODE) - 1), x >> CODE
        s = syndrome(low)
        own = low ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)

        def put(code, high=high, p=p, who=index, belongs=False):
            out.append(((np.int64(p) << 40) | (high << CODE) | code, who, np.full(len(who), belongs)))

        put(own, belongs=True)
        for bit in range(n - CODE):
            put(own, high ^ (1 << bit))
        # code words two flips away: the pairs of bits whose numbers xor to the syndrome
        off = s > 0
        for i in range(1, CODE + 1):
            j = s ^ i
            pair = off & (j > i)
            put((low ^ (1 << (i - 1)) ^ (1 << np.maximum(j - 1, 0)))[pair], high[pair], who=index[pair])
    return tuple(np.concatenate(c) for c in zip(*out))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a[i], b[i])."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            keep.append(i)
    return a[keep], b[keep]


def tile_links(own: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a large tile's own and sent fingerprints."""
    nodes, inverse = np.unique(np.concatenate([own, sent]), return_inverse=True)
    label, columns = np.arange(len(nodes)), inverse[len(own) :]
    a, b = [], []
    for x, value in zip(inverse[: len(own)], own):
        near = columns[np.bitwise_count(sent ^ value) <= THRESHOLD]
        other = np.unique(label[near])
        other = other[other != label[x]]
        if len(other):
            first = near[np.unique(label[near], return_index=True)[1]]
            first = first[label[first] != label[x]]
            a.append(np.full(len(first), x))
            b.append(first)
            label[np.isin(label, np.append(other, label[x]))] = min(other.min(), label[x])
    if not a:
        return own[:0], own[:0]
    return nodes[np.concatenate(a)], nodes[np.concatenate(b)]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each tile of the partition, whose rows (tile, fp, own) come in any order."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not got:
        return
    tile, fp, own = (np.concatenate(c) for c in zip(*got))
    order = np.lexsort((~own, tile))
    tile, fp, own = tile[order], fp[order].view(np.uint64), own[order]
    cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    sizes = np.diff(np.r_[cuts, len(tile)])
    owns = np.add.reduceat(own.astype(np.int64), cuts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    big = owns * sizes > 16384
    for at, n, m in zip(cuts[big], sizes[big], owns[big]):
        found.append(tile_links(fp[at : at + m], fp[at : at + n]))
    cuts, sizes, owns = cuts[~big], sizes[~big], owns[~big]
    # the small tiles: all (own, sent) pairs of many tiles at once
    pairs = owns * sizes
    batch = np.cumsum(pairs) // 4_000_000
    for k in np.unique(batch[pairs > 0]):
        at, n, p = (x[(batch == k) & (pairs > 0)] for x in (cuts, sizes, pairs))
        start = np.repeat(np.cumsum(p) - p, p)
        inner, width, base = np.arange(p.sum()) - start, np.repeat(n, p), np.repeat(at, p)
        x, y = fp[base + inner // width], fp[base + inner % width]
        near = (np.bitwise_count(x ^ y) <= THRESHOLD) & (x != y)
        found.append((x[near], y[near]))
    a, b = forest(*(np.concatenate(c).view(np.int64) for c in zip(*found)))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp) to links (a, b) that connect just what differs in at most THRESHOLD bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                anchor, who, own = anchors(fps[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[at : at + 20_000][who]), pa.array(own)], names=["anchor", "fp", "own"])

    sent = distinct.mapInArrow(send, "anchor long, fp long, own boolean")
    hot = written(sent.groupBy("anchor").count().where(F.col("count") > TILE).select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("cuts")), "hot")
    sent = sent.join(small(hot), "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    salt = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("long")
    every = F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1)
    own, others = F.col("own"), F.transform(every, lambda j: F.struct(j.alias("row"), salt.alias("col"), F.lit(False).alias("own")))
    as_own = F.transform(every, lambda j: F.struct(salt.alias("row"), j.alias("col"), F.lit(True).alias("own")))
    # at its own anchor a fingerprint is in a row of tiles, and at each of its anchors in a column
    placed = sent.select("anchor", "fp", F.explode(F.when(own, F.concat(as_own, others)).otherwise(others)).alias("t"))
    tile = F.when(F.col("t.row") + F.col("t.col") == 0, F.col("anchor")).otherwise(F.xxhash64("anchor", "t.row", "t.col"))
    placed = placed.select(tile.alias("tile"), "fp", F.col("t.own").alias("own"))
    return placed.repartition("tile").mapInArrow(compare, "a long, b long")


def classes(fps: DataFrame, least: Column) -> DataFrame:
    """``fps`` (fp, a row for each document) to (fp, least, root): each distinct fingerprint with an aggregate of its rows and its component."""
    distinct = written(fps.groupBy("fp").agg(least.alias("least")), "distinct", fps.count())
    n = distinct.count()
    roots = written(components(links(distinct.select("fp")), n), "roots", n)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    placed = classes(fps, F.min("doc_id"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (null last; of several such rows that of one text, and any one of these)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    fps = written(with_fingerprint(keyed, "text", "fp").drop("text"), "fingerprints")
    placed = classes(fps, F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")))
    kept = placed.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    kept = kept.withColumn("kept", F.xxhash64("kept_id", "kept_h"))
    # the row travels as one value; one plain key, so that rows without an id join too
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = rows.withColumn("key", F.xxhash64("id", "h"))
    joined = rows.join(kept, (F.col("key") == F.col("kept")) & (F.col("h") == F.col("kept_h")) & F.col("id").eqNullSafe(F.col("kept_id")))
    order = Window.partitionBy("key").orderBy(F.lit(0))
    return joined.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
