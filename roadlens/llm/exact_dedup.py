"""Exact dedup by content sort (operator 8), with DataFrame functions only.

Rows are sorted by (first characters of the normalised text, digest, id), the largest id first. A sample gives splitters, about one for
each partition, which cut the order into ranges; a binary search tells each row its range, and one shuffle moves it there. In a range equal texts stand
next to each other, and each row's text is compared in full with its neighbour's; equal neighbours form runs. The first row of
a run has its largest id. Splitters hold few characters, however long the texts are, and an id, so a text with very many copies
is cut into several ranges like any other stretch of the order.

Only a run at the edge of its range can go on in the next one: the texts at both sides of each splitter are compared in full as well, and
the runs of a text that spans ranges are added up. That table has two rows for each range at most, and is broadcast; all other runs are whole as they stand.

Defined results: null text counts as empty; a null id loses against any other; of several rows with the
largest id one stays; groups whose ids are all null keep one row and have a null keep_id (rows of equal text and id are dealt
by the partition they are read in). Extra columns travel in the struct `row`, so that their names can't clash.
Texts may be of any length. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

SPLITTER_CHARS = 32
#: Sampled rows for each range, on average.
SAMPLED = 40
#: The order of rows: ids are turned round by their bits, which can't overflow.
ORDER = "start string, text_sha256 string, no_id boolean, down long, read_in int"
KEY = [c.split()[0] for c in ORDER.split(", ")]


def _same(text: Column) -> Column:
    return text


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], carry: list[str] | None) -> DataFrame:
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    row = C.whole_row(docs.select(*[F.col(f"`{c}`") for c in carry]) if carry else docs)
    t = docs.select(row.alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    number = F.col("id").cast("long")
    return t.select("row", "id", "text", F.substring("text", 1, SPLITTER_CHARS).alias("start"), F.sha2("text", 256).alias("text_sha256"), number.isNull().alias("no_id"), F.coalesce(F.bitwise_not(number), F.lit(0).cast("long")).alias("down"), F.spark_partition_id().alias("read_in"))


def _splitters(rows: DataFrame, n_ranges: int) -> list:
    """Keys at equal steps of a sorted sample, none twice."""
    n = rows.count()
    if not n or n_ranges < 2:
        return []
    sample = rows.select(*KEY).sample(min(1.0, SAMPLED * n_ranges / n), seed=7).collect()
    keys = sorted({(r[0].encode(), *r[1:]) for r in sample})
    return [(k[0].decode(), *k[1:]) for k in dict.fromkeys(keys[len(keys) * i // n_ranges] for i in range(1, n_ranges))] if keys else []


def _range_of(splitters: list) -> Column:
    """How many splitters are not after a row's key: steps of halved length through the splitters."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    kinds = [c.split()[1] for c in ORDER.split(", ")]
    held = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(c) for v, c, kind in zip(s, KEY, kinds, strict=True)]) for s in splitters])
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    key = F.struct(*KEY)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at))


def _runs(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], carry: list[str] | None) -> DataFrame:
    """Each row with its range, its run, the run's length (n) and largest id (top), first (the row holds it), and its text where it stands at an edge of the range."""
    p = C.partitions(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col, normalise, carry)
    t = rows.withColumn("range", _range_of(_splitters(rows, p))).repartitionById(p, F.col("range"))
    order = Window.partitionBy("range").orderBy("start", "text_sha256", "text", "no_id", "down", "read_in")
    first = ~F.coalesce(F.col("text") == F.lag("text").over(order), F.lit(False))
    edge = F.lag(F.lit(1)).over(order).isNull() | F.lead(F.lit(1)).over(order).isNull()
    t = t.select("row", "id", "text_sha256", "range", first.alias("first"), F.when(edge, F.col("text")).alias("edge_text"), F.row_number().over(order).alias("at"))
    t = t.withColumn("run", F.sum(F.col("first").cast("int")).over(Window.partitionBy("range").orderBy("at")))
    run = Window.partitionBy("range", "run")
    return t.select("row", "text_sha256", "range", "run", "first", "at", "edge_text", F.count(F.lit(1)).over(run).alias("n"), F.max(F.when(F.col("first"), F.col("id"))).over(run).alias("top"))


def _edges(runs: DataFrame) -> DataFrame:
    """edge_range, edge_run, keep_id, size, best (range and run of the row to keep) of the runs at the edges of ranges, with what they are in other ranges."""
    e = C.materialise(runs.filter("edge_text is not null").select("range", "run", "at", "edge_text", "n", "top"))  # two rows for each range at most
    own = F.struct("at", "run", F.col("edge_text").alias("text"))
    ends = e.groupBy("range").agg(F.min_by(own, "at").alias("a"), F.max_by(own, "at").alias("z"))
    by_range = Window.orderBy("range")  # a row for each range
    previous = ends.select("range", F.lag("range").over(by_range).alias("before"))
    before = ends.select(F.col("range").alias("before"), F.col("z.text").alias("text_before"), F.col("z.run").alias("last_before"))
    # the first run of a range goes on with the last of the one before; a whole chain is named by where it begins
    t = ends.join(previous, "range").join(before, "before", "left").withColumn("joined", F.coalesce(F.col("a.text") == F.col("text_before"), F.lit(False)))
    head = F.when(~F.col("joined"), F.struct("range", F.col("a.run").alias("run"))).when(F.col("last_before") > 1, F.struct(F.col("before").alias("range"), F.col("last_before").alias("run")))
    t = t.select("range", F.last(head, ignorenulls=True).over(by_range).alias("head"))
    names = e.select("range", "run", "n", "top").distinct().join(t, "range")
    names = names.withColumn("head", F.when(F.col("run") == 1, F.col("head")).otherwise(F.struct("range", "run")))
    best = F.max(F.struct(F.col("top").isNotNull().alias("has_id"), "top", "range", "run")).alias("best")
    whole = names.groupBy("head").agg(F.sum("n").alias("size"), best)
    return names.join(whole, "head").select(F.col("range").alias("edge_range"), F.col("run").alias("edge_run"), F.col("best.top").alias("keep_id"), "size", F.struct("best.range", "best.run").alias("best"))


def _told(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], carry: list[str] | None, firsts_only: bool = False) -> DataFrame:
    t = _runs(docs, id_col, text_col, normalise, carry)
    t = C.materialise(t.filter("first or edge_text is not null") if firsts_only else t)
    t = t.join(F.broadcast(_edges(t)), (F.col("range") == F.col("edge_range")) & (F.col("run") == F.col("edge_run")), "left")
    kept = F.col("first") & F.coalesce(F.struct("range", "run") == F.col("best"), F.lit(True))
    inner = F.col("edge_range").isNull()
    return t.select("row", F.when(inner, F.col("top")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", "n").alias("group_size"), kept.alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = _same, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (its columns in `carry`, or all) as the struct `row`, with keep_id, group_size, kept and text_sha256."""
    return _told(docs, id_col, text_col, normalise, carry)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """docs with one row of each group of equal texts, columns unchanged."""
    return _told(docs, id_col, text_col, normalise, None, firsts_only=True).filter("kept").select("row.*")


def query(spark, sf_dir):
    return exact_groups(C.read(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
