"""The road graph as two tables: nodes and directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.sources.shared import saved


def _key() -> F.Column:
    return F.concat_ws("::", "segment_id", F.col("segment_seq").cast("string"))


def nodes(events: DataFrame) -> DataFrame:
    """One node per (segment, position); of points with one key the last in source order counts."""
    columns = ["segment_id", "segment_seq", "lat", "lon", "tipo_evento", "velocidad_kmh", "duracion_hrs", "via", "comuna", "penalty_factor", "dia_semana", "franja_horaria"]
    t = events.withColumn("node_id", _key()).groupBy("node_id").agg(F.max_by(F.struct(*columns), F.struct("src_rank", "row_no")).alias("n")).select("node_id", "n.*")
    return t.na.fill(0.0, ["velocidad_kmh", "duracion_hrs"]).na.fill("", ["dia_semana", "franja_horaria"]).withColumn("penalty_factor", F.when(F.coalesce("penalty_factor", F.lit(0.0)) == 0, 1.0).otherwise(F.col("penalty_factor")))


def _measured(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """src, dst with the length between their nodes, times the share of each pair."""
    at = lambda end: node.select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    t = pairs.join(at("src"), "src").join(at("dst"), "dst")
    return t.select("src", "dst", (S.base_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")) * F.col("share")).alias("base_km"))


def segment_pairs(events: DataFrame) -> DataFrame:
    """Consecutive points of a segment; both directions unless its first point is one-way. A pair can occur more than once."""
    order = Window.partitionBy("segment_id").orderBy("segment_seq", "src_rank", "row_no")
    t = events.select("segment_id", _key().alias("src"), F.lead(_key()).over(order).alias("dst"), F.first_value("oneway").over(order).alias("one_way"))
    t = t.filter("dst is not null and src <> dst")
    there = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))
    ways = F.when(F.col("one_way"), F.array(there)).otherwise(F.array(there, back))
    return t.select(F.explode(ways).alias("p")).select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), F.lit(1.0).alias("share"))


def junction_pairs(events: DataFrame) -> DataFrame:
    """Points at equal coordinates (five decimals), both directions. Pairs of one place are the semantics asked for; AQE splits crowded places. A pair can occur more than once."""
    t = events.filter("lat is not null and lon is not null").select(_key().alias("node"), F.round("lat", 5).alias("y"), F.round("lon", 5).alias("x")).distinct()
    pairs = t.alias("p").join(t.alias("q"), ["y", "x"]).filter("p.node <> q.node")
    return pairs.select(F.col("p.node").alias("src"), F.col("q.node").alias("dst"), F.lit(0.25).alias("share"))


def segment_edges(events: DataFrame, node: DataFrame) -> DataFrame:
    return _measured(segment_pairs(events).distinct(), node)


def junction_edges(events: DataFrame, node: DataFrame) -> DataFrame:
    return _measured(junction_pairs(events).distinct(), node)


def build(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges(src, dst, base_km); of parallel edges the shortest counts. All pairs are measured together, and points are written once."""
    events = saved(events.select("segment_id", "segment_seq", "lat", "lon", "tipo_evento", "velocidad_kmh", "duracion_hrs", "via", "comuna", "penalty_factor", "dia_semana", "franja_horaria", "oneway", "src_rank", "row_no"))
    n = saved(nodes(events))
    pairs = segment_pairs(events).unionByName(junction_pairs(events)).groupBy("src", "dst").agg(F.min("share").alias("share"))
    return n, _measured(pairs, n)


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    return n.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("segment_id").alias("segments")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each
