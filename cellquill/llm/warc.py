"""WARC files: written by Spark's text sink, read back by boundary-chain verification.

Writing: a record for each page; of pages with equal payloads the one with the smallest id is a response, the others are
revisits of it, without the payload. Records are made of SQL functions and written with CR LF as line end, so Spark's
committer handles lost tasks and the files may lie in any store that Spark writes.

Reading: Spark's text source cuts the files at the magic line, in splits of any size. A task turns each piece that parses as a
record head into a candidate: its offset, its successor's offset (from the declared length), and where the chain through
it leaves the split. Entry points of splits are then joined to the entry points they lead to, and those pointers are doubled
from each file's start; a record counts only if the chain from the start of its file reaches it, so a magic line inside a
payload is rejected. Records whose payload holds a magic line, or runs over a split's end, are put together from their pieces
in a second scan.

Memory: a task holds the metadata of one split; a record's payload must fit in memory. Joins use narrow rows only, but for
the join that marks copies where more than a set number of payloads repeat.

Nulls: a null html is an empty payload, a null url an empty URI; a null page id is carried and never the smallest. Pages that
repeat the smallest id of their payload are all responses. An empty table writes no record and reads none.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, small, written

MAGIC = b"WARC/1.1\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # base32
URN = "urn:cellquill:page:"
FILE_RECORDS = 1_000_000
FIELDS = "file string, block long, rel long, len long, delta long, exit long, page_id long, kind string, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    digits = [F.shiftright(g, shift).bitwiseAND(31) + 1 for g in groups for shift in (15, 10, 5, 0)]
    return F.concat(*[F.substring(F.lit(ALPHABET), d, F.lit(1)) for d in digits])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Writes ``pages`` under ``path``; payloads of fewer than ``least_bytes`` bytes are all responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "%0A").alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha1(html.cast("binary")).alias("key"))
    copies = rows.where(F.col("n") >= least_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
    copies = written(copies.where("times > 1 AND first IS NOT NULL").select("key", "first"), "copies")
    rows = rows.join(small(copies), "key", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat(F.col("http"), F.col("html")))
    rows = rows.withColumn("http", http).withColumn("block", block)
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise("")
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: "), name(F.col("id")), refers,
        F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), sha1_base32(F.col("html")), F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(head: str, name: str) -> str | None:
    found = re.search(rf"^{name}:[ \t]*(.*?)[ \t]*\r?$", head, re.I | re.M)
    return found[1] if found else None


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse(piece: bytes) -> tuple | None:
    """(length from the magic to the successor, page_id, type, refers_to, payload bytes, digest, whole) of what follows a magic line; None if it is no record's head."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = piece[: end + 2].decode("utf-8", "replace")
    length, kind = _field(head, "Content-Length"), _field(head, "WARC-Type")
    if not kind or not re.fullmatch(r"\d{1,18}", length or ""):
        return None
    n = int(length)
    delta = len(MAGIC) + end + 4 + n + 4
    block = piece[end + 4 : end + 4 + n]
    page, refers = _page(_field(head, "WARC-Record-ID")), _page(_field(head, "WARC-Refers-To"))
    if len(piece) < end + 4 + n:
        return delta, page, kind, refers, None, None, False
    cut = block.find(b"\r\n\r\n")
    http, payload = block[: cut + 2].decode("utf-8", "replace"), block[cut + 4 :] if cut >= 0 else block
    if kind == "revisit":
        stated = _field(http, "Content-Length")
        digest = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:") or None
        return delta, page, kind, refers, int(stated) if stated and stated.isdigit() else None, digest, True
    return delta, page, kind, refers, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), True


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of FIELDS for each piece; ``rel``: offset within the split's pieces, ``exit``: where the chain leaves them."""
    now, rows, at = None, [], 0

    def flush() -> pa.RecordBatch:
        leaves: dict[int, int | None] = {}
        for row in reversed(rows):
            if row[4] is not None:
                to = row[2] - len(MAGIC) + row[4]
                row[5] = leaves.get(to) if to < at - len(MAGIC) else to
                leaves[row[2] - len(MAGIC)] = row[5]
        kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (file, block) != now:
                if rows:
                    yield flush()
                now, rows, at = (file, block), [], 0
            piece = value.as_py()
            got = parse(piece) or (None,) * 7
            rows.append([file, block, at, len(piece), got[0], None, *got[1:]])
            at += len(piece) + len(MAGIC)
    if rows:
        yield flush()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record that the chain from its file's start reaches."""
    pieces = written(_pieces(spark, path).mapInArrow(_scan, FIELDS), "pieces")
    blocks = pieces.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("len") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel") - len(MAGIC))
    # the piece before a file's first magic line starts at -len(MAGIC)
    placed = written(placed.where("at >= 0").withColumn("exit_at", F.col("base") + F.col("exit")).drop("exit"), "placed")
    heads = placed.where("delta IS NOT NULL")
    nodes = heads.where("exit_at IS NOT NULL").select("file", F.col("exit_at").alias("at")).unionByName(heads.where("at = 0").select("file", "at")).distinct()
    jumps = written(nodes.join(heads, ["file", "at"]).select("file", "at", F.col("exit_at").alias("to")).distinct(), "jumps")
    reached = written(jumps.where("at = 0").select("file", "at"), "reached")
    longest = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) + 1):
        further = reached.join(jumps, ["file", "at"]).where("to IS NOT NULL").select("file", F.col("to").alias("at"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        again = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = written(jumps.join(again, ["file", "to"], "left").select("file", "at", F.col("next").alias("to")), "jumps")
    entry = reached.join(heads, ["file", "at"]).select("file", "block", F.col("at").alias("entry"))

    def walk(pdf):
        follow = dict(zip(pdf["at"], pdf["at"] + pdf["delta"].astype("int64")))
        on, at = set(), int(pdf["entry"].iloc[0])
        while at in follow:
            on.add(at)
            at = follow[at]
        return pdf[pdf["at"].isin(on)][["file", "at"]]

    chained = heads.join(entry, ["file", "block"]).select("file", "block", "at", "delta", "entry").groupBy("file", "block").applyInPandas(walk, "file string, at long")
    records = written(heads.join(chained, ["file", "at"]).select("file", "at", "delta", "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "whole"), "records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = records.where("whole").select(*out)
    cut = records.where("NOT whole")
    return whole if cut.isEmpty() else whole.unionByName(_assembled(spark, path, placed, records).select(*out))


def _assembled(spark: SparkSession, path: str, placed: DataFrame, records: DataFrame) -> DataFrame:
    """The records that span several pieces, from a second scan of the files."""
    marked = placed.join(records.select("file", "at", F.col("whole").alias("is_whole")), ["file", "at"], "left")
    owner = F.last(F.when(F.col("is_whole").isNotNull(), F.struct(F.col("at").alias("owner"), F.col("is_whole"))), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    wanted = marked.withColumn("o", owner).where("o.is_whole = false").select("file", "block", "rel", F.col("o.owner").alias("owner"), "at")
    wanted = written(wanted, "wanted")

    def numbered(batches):
        now, at = None, 0
        for batch in batches:
            rel = []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (file, block) != now:
                    now, at = (file, block), 0
                rel.append(at)
                at += len(value.as_py()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], names=["file", "block", "value", "rel"])

    def join(pdf):
        import pandas as pd

        got = parse(MAGIC.join(bytes(v) for v in pdf.sort_values("at")["value"]))
        return pd.DataFrame([[got[1], got[4], got[5], got[2], got[3]]], columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    bytes_of = _pieces(spark, path).mapInArrow(numbered, "file string, block long, value binary, rel long")
    return bytes_of.join(small(wanted), ["file", "block", "rel"]).groupBy("file", "owner").applyInPandas(join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = fresh(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM p
"""
