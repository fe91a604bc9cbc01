"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Units are a document's lines that hold a word, compared without surrounding blanks. A gram is a shortest run of lines with at
least ``gram_words`` words. A window is a line and what follows it up to ``window_words`` words; the gram of the least hash in
it (of equal ones the first) is a fingerprint. A run of ``window_words`` words holds its first line's whole window, so every
copy of it has the same fingerprint at the same place: fingerprints are guaranteed, not just likely, to meet.

Matches: positions that share a fingerprint are joined, and each is extended both ways, back to the lines whose windows chose
it and ahead as far as ``window_words`` words need: its extents are the shortest runs of that many words from such a line on,
or up to a line. An extent that agrees in all its lines with one that stands earlier, in any document ahead or further ahead
in its own, is a match. Extents that overlap make up the whole run that repeats, however long it is and whichever earlier
documents have parts of it, so a line is deleted just if a run of ``window_words`` words or more around it occurs before.

Documents stand in order of id (null last), then of a hash of their text; the first copy of a run stays. Runs are compared by
two independent 64-bit hashes, of the fingerprint's lines and of the extent's.

Scale: all windows are over one document's lines, and their frames hold ``window_words`` lines at most. A row for each
extent is shuffled by a hash of both. All joins are equi-joins with a table that has one pre-aggregated row for each key, so that
Spark can split them where one passage is in a third of all documents; no pairs of copies are made. Texts are shuffled once, to
be joined with their deletions. What steps hand on is written to the shared folder, so a lost executor costs one step. Both
that and the result are in as many partitions as the size of ``docs`` is worth, two for each core at least.

Nulls: a null text stays null and an empty one empty; a null id comes last in order. Rows equal in id and text count as one
document and are treated alike. An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, parts, table_bytes, written

GRAM_WORDS, WINDOW_WORDS = 12, 25
LAST = 2**63 - 1


def fingerprints(units: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """``units`` (a, b: the document; pos; h, k: two hashes; w: words) to (g, a, b, at, extents): a row for each fingerprint.

    ``extents`` are its runs of ``window_words`` words as (r: hash, pos, last), by the positions of their first and last line.
    """
    doc = Window.partitionBy("a", "b")
    u = units.withColumn("end", F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    u = u.withColumn("start", F.col("end") - F.col("w"))
    ahead, back = doc.orderBy("start").rangeBetween(0, window_words - 1), doc.orderBy("end").rangeBetween(1 - window_words, 0)
    u = u.withColumn("ahead", F.collect_list(F.struct("start", "end", "pos", "h", "k")).over(ahead))
    lines = F.filter("ahead", lambda x: x["start"] < F.col("start") + gram_words)
    gram = F.struct(F.xxhash64(F.transform("lines", lambda x: x["h"])).alias("g"), "start", F.col("pos").alias("at"), F.get("lines", F.size("lines") - 1)["end"].alias("end"))
    u = u.withColumn("lines", lines).withColumn("gram", gram).withColumn("gram", F.when(F.col("gram.end") >= F.col("start") + gram_words, F.col("gram")))
    # the grams that end in the window; its first may be longer
    u = u.withColumn("grams", F.collect_list("gram").over(ahead))
    inside = F.filter("grams", lambda x: (x["end"] <= F.col("start") + window_words) | (x["start"] == F.col("start")))
    u = u.withColumn("print", F.array_min(inside)).withColumn("final", F.get("ahead", F.size("ahead") - 1))
    extent = lambda chosen, ks, pos, last: F.struct(chosen["g"].alias("g"), chosen["at"].alias("at"), F.xxhash64(ks).alias("r"), pos.alias("pos"), last.alias("last"))
    on = F.when(F.col("final.end") >= F.col("start") + window_words, extent(F.col("print"), F.transform("ahead", lambda x: x["k"]), F.col("pos"), F.col("final.pos")))
    u = u.select("a", "b", "pos", "start", "end", "k", "print", on.alias("on"))
    # the shortest run up to a line has its first line's window
    u = u.select("a", "b", "pos", "end", "on", F.collect_list("k").over(back).alias("ks"), F.first(F.struct("pos", "start", "print")).over(back).alias("first"))
    up_to = F.when(F.col("end") >= F.col("first.start") + window_words, extent(F.col("first.print"), F.col("ks"), F.col("first.pos"), F.col("pos")))
    u = u.select("a", "b", F.inline(F.array_compact(F.array("on", up_to))))
    return u.groupBy("a", "b", "at").agg(F.first("g").alias("g"), F.collect_set(F.struct("r", "pos", "last")).alias("extents"))


def deletions(prints: DataFrame) -> DataFrame:
    """(a, b, gone): for each document the positions that repeat an earlier run, with those of lines without a word between them."""
    n = prints.count()
    # keyed by a hash of both, so that what one fingerprint has isn't held together; few fingerprints have more than one extent
    runs = prints.select("a", "b", "g", F.inline("extents")).withColumn("g", F.xxhash64("g", "r"))
    first = runs.groupBy("g", "r").agg(F.min(F.struct("a", "b", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "r", "f")
    later = runs.join(written(first, "first", n), ["g", "r"]).where(F.struct("a", "b", "pos") != F.col("f"))
    matches = later.groupBy("a", "b").agg(F.collect_set(F.struct("pos", "last")).alias("runs"))
    return written(matches.select("a", "b", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["last"])))).alias("gone")), "gone", n)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of ``window_words`` words or more deleted from the text, and n_lines and removed_lines for each row.

    ``gram_words`` is the length of a fingerprint, at most ``window_words``; it decides how many there are, not what is deleted.
    """
    if not 0 < gram_words <= window_words:
        raise ValueError("gram_words must be from 1 to window_words")
    n_lines, removed, a, b, lines, gone, ga, gb = (free_name(docs, n) for n in ("n_lines", "removed_lines", "_a", "_b", "_lines", "_gone", "_ga", "_gb"))
    text = F.col(text_col)
    # the text travels as its lines: they are cut once, before the join
    keyed = docs.withColumn(a, F.coalesce(F.col(id_col), F.lit(LAST))).withColumn(b, F.xxhash64(text)).withColumn(lines, F.split(text, "\n", -1))
    keyed = keyed.select(*[c for c in keyed.columns if c != text_col])
    line = F.trim(F.col("line"), F.lit(" \t\n\v\f\r"))
    units = keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), F.posexplode(lines).alias("pos", "line"))
    units = units.select("a", "b", "pos", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("k"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("w")).where("w > 0")
    units = units.repartition("a", "b").dropDuplicates(["a", "b", "pos"])
    size = table_bytes(docs)
    prints = written(fingerprints(units, gram_words, window_words), "prints", size=size)
    # the same join at every size: there are as many deletions as documents with copies
    found = deletions(prints).select(F.col("a").alias(ga), F.col("b").alias(gb), F.col("gone").alias(gone)).hint("merge")
    joined = keyed.join(found, (F.col(a) == F.col(ga)) & (F.col(b) == F.col(gb)), "left")
    joined = joined.withColumn(gone, F.filter(gone, lambda i: F.get(lines, i).rlike(WORD)))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.when(F.col(gone).isNull(), F.col(lines)).otherwise(F.transform(F.array_except(every, F.col(gone)), lambda i: F.get(lines, i)))
    out = [F.array_join(left, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    n = F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines))
    cleaned = joined.select(*out, n.cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))
    # the join's partitions are no measure of the result: who writes it makes a file, and processes for that, of each
    return cleaned.coalesce(parts(docs.sparkSession, size=size))


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
