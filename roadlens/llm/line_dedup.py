"""Line dedup (operator 2), with DataFrame functions only.

Lines are moved as 128-bit hashes of their keys, never as text, and written once. The hashes are range-partitioned, with
the documents of one key dealt over slots, and sorted by descending document and position; a stream over
each slot tells the first line of each document, and the counts of all slots meet pre-aggregated. Keys
with enough documents mark their lines in all but the last document: the join deals lines by key and slot too, and
each common key goes to the slots it stands in. A document's keep bitmap is returned
compressed, as its runs of dropped lines, and only joined to the text at the end.

Defined results: null text counts as one empty line. A null doc_id counts as the smallest id. Rows of
one doc_id are one document for the counts, and each row is judged by its own lines. Extra columns are
ignored. Empty tables give empty results. Code points are counted, so any script works.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

TRIM = " \t\n\x0b\x0c\r"


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each document that loses lines: id, text_hash, dropped (array of runs first..last of line numbers)."""
    p = C.partitions(docs.sparkSession)
    t = _rows(docs, id_col, text_col)
    lines = t.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim(C.lower_ascii(F.col("line")), F.lit(TRIM))).filter(F.char_length("key") >= min_chars)
    lines = lines.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("id"), F.lit(p)).cast("int").alias("slot"))
    lines = C.materialise(lines)  # else the sampling of splitters and each use below would split the texts again
    stream = Window.partitionBy("h1", "h2", "slot").orderBy(F.col("id").desc(), "text_hash", "pos")
    ordered = lines.repartitionByRange(p, "h1", "h2", "slot")
    firsts = ordered.select("h1", "h2", "slot", "id", F.lag("id").over(stream).alias("before")).filter(~F.col("id").eqNullSafe(F.col("before")))
    slots = C.materialise(firsts.groupBy("h1", "h2", "slot").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last")))
    keys = slots.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last")).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "last")
    common = slots.select("h1", "h2", "slot").join(keys, ["h1", "h2"])
    doomed = lines.join(common, ["h1", "h2", "slot"]).filter(F.col("id") < F.col("last"))
    drops = doomed.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    first = F.array_except("pos", F.transform("pos", lambda x: x + 1))
    last = F.array_except("pos", F.transform("pos", lambda x: x - 1))
    return drops.select("id", "text_hash", F.arrays_zip(first.alias("first"), last.alias("last")).alias("dropped"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), least).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (the compressed bitmap; null: nothing) and the kept text."""
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    t = _rows(docs, id_col, text_col).join(bitmaps, ["id", "text_hash"], "left")
    t = t.select("doc_id", "dropped", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    gone = F.flatten(F.transform("dropped", lambda r: F.sequence(r["first"], r["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), gone)
    kept = F.expr("array_join(transform(left, p -> lines[p]), '\n')")
    n_dropped = F.aggregate("dropped", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    t = t.withColumn("lines", F.when(F.col("dropped").isNotNull(), F.split("text", "\n"))).withColumn("left", F.when(F.col("dropped").isNotNull(), left))
    return t.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"), "dropped", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"))


def query(spark, sf_dir):
    return drop_lines(C.read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, last_id IS NOT NULL AND doc_id < last_id AS dropped
  FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
