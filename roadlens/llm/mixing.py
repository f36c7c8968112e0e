"""Mixing sources to target weights (operator 6).

Weighted fair queueing: the documents of each source stand in a shuffled queue, as often as a document may
repeat; a copy's virtual finish time is the source's words up to its end divided by the source's target. The copy
during which a source reaches its target is cut there into two, the first of which finishes at time 1. All copies of all
sources are sorted by finish time, over ranges of it; totals of the ranges tell in which one the total budget, the sum of all
targets in whole words, is used up, and running sums in that range give the last copy that is in. What stands up to it is taken.

A queue is split by ranges of the shuffle key, so a source with a third of all rows is spread over as many
groups as any other set of rows: totals of the ranges give each range its start, and running sums are
taken within ranges. Only sums over sources, totals of ranges and the last copy's place in the order reach the driver.

Defined results: null text has size 0; a null source is a source of its own, the last one. Documents
without words take nothing. Repeated rows are documents of their own. The shuffle key is a hash of seed, id
and size, so reruns agree. If no text has words all targets are 0. Extra columns are ignored, whatever their names.
A text of any length is one document of its queue. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (skey, source, source_size) with weight and target; what a source can't take is shared again by weight among the others."""
    spark = sources.sparkSession
    p = C.partitions(spark)
    ordered = sources.repartitionByRange(p, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = C.materialise(ordered)
    before, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy("part").count().collect()):  # one row for each partition
        starts += [part, before]
        before += n
    start = F.lit(0) if not starts else F.element_at(F.create_map(*[F.lit(x) for x in starts]), F.col("part"))
    place = start + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ordered = C.materialise(ordered.withColumn("weight", weight).drop("part"))
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while total:
        is_full = F.col("weight") * level >= most * F.col("source_size")
        n, taken, rest = ordered.agg(F.count_if(is_full), F.sum(F.when(is_full, most * F.col("source_size"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if full == n or not rest:
            break
        level, full = (budget * total - (taken or 0.0)) / rest, n
    return ordered.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")))


def shuffle_key(seed: int, doc_id: Column, size: Column) -> Column:
    """40 bits of the MD5 of seed, id and size."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), size.cast("string")))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """Each document (its columns in `carry`, or all) as the struct `row`, with size, source_size, target, taken (words, repeats counted) and copies (array of finish, words: its copies that are taken, whole or in part)."""
    p = C.partitions(docs.sparkSession)
    row = C.whole_row(docs.select(*[F.col(f"`{c}`") for c in carry]) if carry else docs)
    t = docs.select(
        row.alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("skey"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.col(id_col).alias("id"),
    )
    t = t.withColumn("key", shuffle_key(seed, F.col("id"), F.col("size"))).withColumn("range", F.floor(F.col("key") * p / float(1 << 40)))
    slim = C.materialise(t.select("skey", "size", "id", "key", "range"))
    ranges = slim.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    ranges = C.materialise(ranges)
    source = F.when(F.col("skey") != "", F.expr("substring(skey, 2)"))
    sources = ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")).withColumn("source", source)
    targets = C.materialise(source_targets(sources, weights, budget, most).select("skey", "source_size", "target"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = C.materialise(ranges.withColumn("range_start", before).join(targets, "skey").drop("range_size"))
    n = int(-(-most // 1))
    total = int(targets.agg(F.sum(F.floor("target"))).first()[0] or 0)
    last = _last_copy(_queued(slim, starts, n).select("skey", "key", "id", F.explode("copies").alias("c")).select("skey", "key", "id", "c.*"), total, p)
    is_in = lambda c: F.struct(c["finish"], F.col("skey"), F.col("key"), c["turn"]) <= last if last is not None else F.lit(False)
    t = _queued(t, starts, n).withColumn("copies", F.filter("copies", is_in))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return t.select("row", "size", "source_size", "target", taken.alias("taken"), "copies")


def _queued(t: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """Each document with its copies: turn, finish and words. The one in which its source reaches its target comes in two parts."""
    queue = Window.partitionBy("skey", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(starts, ["skey", "range"]).withColumn("end", F.col("range_start") + F.sum("size").over(queue))
    limit, copies = F.floor("target"), []
    for k in range(n):
        end = F.col("source_size") * k + F.col("end")
        inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), limit - end + F.col("size")))
        for part, (words, until) in enumerate(((inside, F.least(end, limit)), (F.col("size") - inside, end))):
            finish = F.when(words == inside, until / F.nullif(limit, F.lit(0))) if part == 0 else until / F.nullif(limit, F.lit(0))
            copies.append(F.struct(F.lit(2 * k + part).alias("turn"), F.coalesce(finish, F.lit(float("inf"))).alias("finish"), words.cast("long").alias("words")))
    return t.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))


def _last_copy(copies: DataFrame, total: int, p: int) -> Column | None:
    """Place in the order (finish, skey, key, turn) of the last copy with which all before it have at most `total` words; None if there is none."""
    order = ["finish", "skey", "key", "turn", "id"]
    t = C.materialise(copies.repartitionByRange(p, *order).withColumn("part", F.spark_partition_id()))
    before = 0
    for part, words in sorted((r[0], r[1]) for r in t.groupBy("part").agg(F.sum("words")).collect()):  # one row for each partition
        if before + words >= total:
            break
        before += words
    else:
        part = None
    if not total or part is None and not before:
        return None
    if part is None:
        return F.struct(F.lit(float("inf")), F.lit("\U0010ffff"), F.lit(1 << 62), F.lit(1 << 30))
    run = t.filter(F.col("part") == part).withColumn("run", before + F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    r = run.filter(F.col("run") <= total).orderBy(*[F.desc(c) for c in order]).limit(1).select(*order).collect()
    if r:
        return F.struct(*[F.lit(r[0][c]) for c in order[:4]])
    r = t.filter(F.col("part") < part).orderBy(*[F.desc(c) for c in order]).limit(1).select(*order).collect()
    return F.struct(*[F.lit(r[0][c]) for c in order[:4]]) if r else None


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in order of finish time: a copy is in when at least half of it is taken. Columns unchanged."""
    p = C.partitions(docs.sparkSession)
    t = mix(docs, **options)
    t = t.select("row", F.explode(F.filter("copies", lambda c: 2 * c["words"] >= F.col("size"))).alias("c"))
    return t.repartitionByRange(p, "c.finish").sortWithinPartitions("c.finish").select("row.*")


def query(spark, sf_dir):
    mixed = mix(C.read(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


#: The level at which sources share is found from the sources in the order in which they fill up; what a document gives follows from sums in its queue.
SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '42', doc_id, size)), 1, 10) AS BIGINT) AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM keyed GROUP BY source),
filling AS (
  SELECT *, row_number() OVER w AS place, 2e0 * source_size / weight AS full_at, coalesce(sum(2e0 * source_size) OVER b, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest
  FROM sources WINDOW w AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST),
    b AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT first(level ORDER BY place) AS level FROM (SELECT place, full_at, (15e-1 * (SELECT sum(source_size) FROM sources) - given) / rest AS level FROM filling) WHERE full_at > level),
targets AS (SELECT source, source_size, least(weight * coalesce(level, 0), 2e0 * source_size) AS target FROM sources, level),
queued AS (
  SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - upto + size)) + greatest(0, least(size, floor(target) - source_size - upto + size)) AS BIGINT) AS taken
FROM queued
"""
