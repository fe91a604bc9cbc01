"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target/size times in the mix. Within its source the documents stand in a fixed
order (by size, then by a hash of the id); the expected copies are summed in that order, one offset for each source is
added, and a document is emitted once for every integer that its part of the sum crosses. As neighbours in that order have
nearly equal sizes, the words taken miss the target by little more than one document.

The rank in that order comes from counts at three levels, (source, size class), (source, size class, bucket) and the
documents of one bucket, so that no task holds a source; a source of a third of all rows falls into thousands of buckets.

Nulls: a null source is a source of its own, after all others; a null text has size 0; a null id is placed by its size.
Sources of size 0 have target 0. Rows that are equal in source, size and id share their copies in any order. An empty table
gives an empty result. Other columns are carried along; clashing names of work columns are avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, table_bytes, written

BUCKET_HEX = 2  # 256 buckets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, size) has a row for each source; adds weight and target: ``share`` of all sizes by weight, no target above ``most`` times its source's size, the excess reshared.

    A source is capped if its cap is at most its share by weight of what those with a lower cap/weight leave; the others get the one level at which that ends.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(*order)) - 1) % len(weights) + 1).cast("int")).cast("double")
    t = sizes.select("source", "size", weight.alias("weight"), (F.lit(most) * F.col("size")).alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), *order)
    every = Window.partitionBy(F.lit(0))
    t = t.withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.lit(share) * F.sum("size").over(every) - F.col("below")) / F.col("open"))
    t = t.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return t.select("source", "size", "weight", F.least(F.col("cap"), F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row); see ``names``."""
    kept = docs.columns if keep is None else keep
    # the row travels as one value, so that its columns' names clash with none here
    row = F.struct(*kept).alias("row")
    # the prefix keeps a null source apart from every other one, and makes all keys plain equalities
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src")
    rows = docs.select(row, F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), source)
    rows = rows.withColumn("bin", F.floor(F.sqrt(F.col("size").cast("double"))))
    rows = rows.withColumn("bucket", F.substring(F.md5(F.coalesce("id", "size").cast("string").cast("binary")), 1, BUCKET_HEX))
    # written, since three steps need these few sums: else each would read and count all texts
    counts = written(rows.groupBy("src", "bin", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")), "buckets", size=table_bytes(docs))
    before, zero = (Window.unboundedPreceding, -1), F.lit(0)
    bins = counts.groupBy("src", "bin").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    bins = bins.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bin").rowsBetween(*before)), zero))
    sizes = bins.groupBy("src").agg(F.sum("w").alias("size")).select(F.when(F.col("src") != "", F.expr("substring(src, 2)")).alias("source"), F.col("size").cast("double").alias("size"))
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(most))).otherwise(F.lit(0.0))
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), F.col("size").cast("long").alias("source_size"), "target", ratio.alias("ratio"), offset(F.col("source"), seed).alias("offset"))
    bins = bins.select("src", "bin", "base").join(targets, "src")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("src", "bin").orderBy("bucket").rowsBetween(*before)), zero)
    blocks = counts.select("src", "bin", "bucket", inner.alias("inner")).join(bins, ["src", "bin"])
    place = Window.partitionBy("src", "bin", "bucket").orderBy("size", F.col("id").asc_nulls_last())
    joined = rows.join(blocks, ["src", "bin", "bucket"]).withColumn("rank", (F.col("base") + F.col("inner") + F.row_number().over(place)).cast("double"))
    crossed = F.floor(F.col("ratio") * F.col("rank") + F.col("offset")) - F.floor(F.col("ratio") * (F.col("rank") - 1) + F.col("offset"))
    out = (F.col("size"), F.col("source_size"), F.col("target"), crossed.cast("long"))
    return joined.select("row.*", *[c.alias(n) for c, n in zip(out, names(docs))])


def names(docs: DataFrame) -> list[str]:
    """What ``mix`` calls its columns: underlined if ``docs`` has such a name itself."""
    return [free_name(docs, n) for n in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]


def emitted(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; ``options`` go to ``mix``."""
    copies = names(docs)[-1]
    taken = mix(docs, **options).where(F.col(copies) > 0)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(copies)).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    m = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 2 * ss AS cap, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM s),
l AS (SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, ss, least(cap, CASE WHEN cap <= level * weight THEN cap ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.ss, t.target, CASE WHEN t.ss > 0 THEN least(t.target / t.ss, 2.0) ELSE 0.0 END AS r,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(CAST(d.size AS DOUBLE))), substr(md5(CAST(coalesce(d.doc_id, d.size) AS VARCHAR)), 1, 2), d.size, d.doc_id NULLS LAST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target, CAST(floor(r * k + u) - floor(r * (k - 1) + u) AS BIGINT) * size AS taken FROM r
"""
