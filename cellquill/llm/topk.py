"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers and grouped by length into buckets of falling norm, each cut into blocks of a bounded
number of rows. The longest vectors give each query a first lower bound of its k-th score. A bucket whose longest vector
can't reach that bound is left out for the query before anything is shipped; for the others the bound divided by both lengths
is the local cosine threshold. Where that is high a task prunes by coordinates: exact products over the query's few largest
coordinates, plus the product of the remaining lengths, bound every score of the block. Where it is low it prunes by length
alone. What remains is verified by whole integer products, and only the best k of a block leave it.

Queries and candidate blocks meet in tiles: candidates are sent once for each group of ``QUERIES`` queries, queries once for
each block that they can't rule out. No task holds more than a block and a group; nothing is broadcast.

Nulls: a vector that is null, empty, or holds a null or non-finite component takes no part, as query or candidate; nor does a
row with a null id, or one whose length isn't its query's. Rows with the query's own id are no candidates for it; other
repeated rows all count. Ties go to the smaller id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, QUERIES = 8192, 2048
FOCUS = 8  # coordinates that bound a score
HIGH = 0.6  # from this local cosine threshold on, coordinates prune
BUCKET = 0.05  # width of a norm bucket, as a share of the norm


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def best(query: np.ndarray, q_norm: float, bound: float, rows: np.ndarray, norms: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's best k for one query, of those of at least ``bound``; the block is in order of falling norm."""
    n = len(rows) if q_norm == 0 or bound <= 0 else int(np.searchsorted(-norms, -(bound / q_norm) * (1 - 1e-9), side="right"))
    at = np.arange(n)
    if n and bound > 0 and bound / (q_norm * norms[0]) >= HIGH and query.size > FOCUS:
        focus = np.argpartition(-np.abs(query), FOCUS)[:FOCUS]
        part = rows[:n, focus]
        rest = np.sqrt(np.maximum(norms[:n] ** 2 - np.einsum("ij,ij->i", part, part), 0)) * np.sqrt(max(q_norm**2 - query[focus] @ query[focus], 0))
        at = np.flatnonzero(part @ query[focus] + rest >= bound * (1 - 1e-9) - 1e-6)
    scores = np.rint(rows[at] @ query).astype(np.int64)
    ok = (ids[at] != own) & (scores >= bound)
    at, scores = ids[at][ok], scores[ok]
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at, scores = at[scores >= least], scores[scores >= least]
    order = np.lexsort((at, -scores))[:k]
    return at[order], scores[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row where ``is_query`` holds."""
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & sound).select("id", quantised(F.col("v"), scale).alias("v"), "is_query")
    norm = F.sqrt(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double"))
    rows = rows.withColumn("norm", norm).withColumn("dim", F.size("v"))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / float(np.log1p(BUCKET)))).otherwise(-1)
    rows = written(rows.withColumn("bucket", bucket.cast("long")), "vectors")
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    # blocks: a hash deals a bucket's rows out; its smallest block number is 0, so the first blocks are the longest buckets'
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")), "buckets")
    queries = rows.where("is_query").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"), "dim", F.xxhash64("id").alias("h"))
    groups = max(1, -(-queries.count() // QUERIES))
    queries = written(queries.withColumn("grp", F.pmod("h", F.lit(groups))).drop("h"), "queries")
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    placed = rows.join(sizes.select("dim", "bucket", "blocks"), ["dim", "bucket"]).select("dim", "bucket", block.alias("block"), "id", "v", "norm")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("norm", ascending=False, kind="stable")
            ids, norms, matrix = right["id"].to_numpy(), right["norm"].to_numpy(), np.vstack(right["v"].to_numpy()).astype(np.float64)
            for q in left.itertuples():
                got, scores = best(np.asarray(q.qv, np.float64), q.qnorm, q.bound, matrix, norms, ids, q.qid, k)
                out.append(pd.DataFrame({"query_id": q.qid, "vec_id": got, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def searched(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        """``asked``: queries with their bound, group and the block they ask; ``candidates``: rows with block and group."""
        keys = ["dim", "bucket", "block", "grp"]
        return asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    all_groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    # first: one block of the longest bucket that can hold enough candidates
    lead = sizes.where(F.col("n") > k).withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("bucket")))).where("r = 1").select("dim", F.col("bucket").alias("lead"))
    asked = queries.join(lead, "dim").select("qid", "qv", "qnorm", F.lit(-float("inf")).alias("bound"), "dim", F.col("lead").alias("bucket"), F.lit(0).cast("long").alias("block"), "grp")
    first = placed.join(lead, "dim").where((F.col("bucket") == F.col("lead")) & (F.col("block") == 0)).drop("lead").withColumn("grp", all_groups)
    bounds = searched(asked, first).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounds = written(bounds.select(F.col("query_id").alias("qid"), F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(-float("inf")).alias("bound")), "bounds")
    # then: every block that the bound doesn't rule out
    asked = queries.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(-float("inf"))))
    asked = asked.join(sizes, "dim").where(F.col("qnorm") * F.col("longest") * (1 + 1e-9) >= F.col("bound"))
    asked = asked.select("qid", "qv", "qnorm", "bound", "dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "grp")
    found = searched(asked, placed.withColumn("grp", all_groups))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
