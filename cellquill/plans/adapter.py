"""The driver's star-schema tables as sequencing records: 8-base barcodes, 5-base UMIs, 500 classes, 200 transcripts, 25 genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BCLEN, UMILEN = 8, 5

SQL = """
bus AS (SELECT xor((l_suppkey * 7919 + 104729) % 65536, CASE WHEN l_orderkey % 20 = 0 THEN CAST(1 + l_partkey % 3 AS BIGINT) << CAST(2 * (l_linenumber % 8) AS BIGINT) ELSE 0 END) AS barcode,
  (l_orderkey * 31 + l_partkey % 7) % 1024 AS umi, CAST(l_partkey % 500 AS INT) AS ec, CAST(l_quantity AS BIGINT) AS cnt, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS flags, CAST(0 AS BIGINT) AS pad FROM lineitem),
tx AS (SELECT CAST(p_partkey AS INT) AS tx, p_brand AS gene FROM part WHERE p_partkey < 200),
ec_tx AS (SELECT tx AS ec, tx FROM tx UNION SELECT tx + 200, tx FROM tx UNION SELECT tx + 200, (7 * tx + 1) % 200 FROM tx UNION SELECT tx % 100 + 400, tx FROM tx),
ec_gene AS (SELECT DISTINCT ec, gene FROM ec_tx JOIN tx USING (tx)),
onlist AS (SELECT DISTINCT (l_suppkey * 7919 + 104729) % 65536 AS barcode FROM lineitem),
clusters AS (SELECT (s_suppkey * 7919 + 104729) % 65536 AS barcode, 'c' || min(s_nationkey) AS cluster FROM supplier GROUP BY 1)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _barcode(key: str):
    return (F.col(key).cast("long") * 7919 + 104729) % 65536


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    flip = F.when(F.col("l_orderkey") % 20 == 0, F.call_function("shiftleft", (1 + F.col("l_partkey") % 3).cast("long"), (2 * (F.col("l_linenumber") % 8)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return t.select(
        _barcode("l_suppkey").bitwiseXOR(flip).alias("barcode"), ((F.col("l_orderkey") * 31 + F.col("l_partkey") % 7) % 1024).cast("long").alias("umi"), (F.col("l_partkey") % 500).cast("int").alias("ec"),
        F.col("l_quantity").cast("long").alias("count"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("flags"), F.lit(0).cast("long").alias("pad"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").cast("int").alias("tx"), F.col("p_brand").alias("gene"))


def ec_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array(F.struct(F.col("tx").alias("ec"), F.col("tx")), F.struct((F.col("tx") + 200).alias("ec"), F.col("tx")), F.struct((F.col("tx") + 200).alias("ec"), ((7 * F.col("tx") + 1) % 200).alias("tx")), F.struct((F.col("tx") % 100 + 400).alias("ec"), F.col("tx")))
    return transcripts(spark, sf_dir).select(F.inline(sets)).distinct()


def ec_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ec_tx(spark, sf_dir).join(F.broadcast(transcripts(spark, sf_dir)), "tx").select("ec", "gene").distinct()  # 200 transcripts by definition


def onlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(_barcode("l_suppkey").alias("barcode")).distinct()


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").groupBy(_barcode("s_suppkey").alias("barcode")).agg(F.concat(F.lit("c"), F.min("s_nationkey").cast("string")).alias("cluster"))
