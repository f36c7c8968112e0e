"""Congestion hotspots and the heat-layer filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import scalars as S


def hotspots(events: DataFrame) -> DataFrame:
    t = events.filter("tipo_evento = 'Congestión' and lat is not null and lon is not null")
    return t.select(
        "segment_id",
        "segment_seq",
        "lat",
        "lon",
        S.hotspot_weight(F.col("velocidad_kmh")).alias("weight"),
        F.col("dia_semana").alias("day"),
        F.col("dia_semana").isNull().alias("day_missing"),
        F.col("franja_horaria").alias("bucket"),
        S.decimal_hour(F.col("hora_inicio")).alias("start_hour"),
        S.decimal_hour(F.col("hora_fin")).alias("end_hour"),
    )


def limited(spots: DataFrame, n: int = 2000) -> DataFrame:
    """The first points in segment order; n is held between 200 and 10,000."""
    return spots.orderBy("segment_id", "segment_seq", "lat", "lon").limit(max(200, min(n, 10_000)))


def _matched(spots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, points that match a request's day, hour and bucket)."""
    r = requests.select("request_id", F.col("day").alias("want_day"), "hour", S.hour_bucket(F.col("hour")).alias("want_bucket"))
    inside = F.when(F.col("start_hour") <= F.col("end_hour"), F.col("hour").between(F.col("start_hour"), F.col("end_hour"))).otherwise((F.col("hour") >= F.col("start_hour")) | (F.col("hour") <= F.col("end_hour")))
    match = (F.col("day") == F.col("want_day")) & ~F.col("day_missing") & ((F.col("bucket") == "") | (F.col("bucket") == F.col("want_bucket"))) & F.coalesce(inside, F.lit(True))
    return r, spots.join(r, (F.col("day") == F.col("want_day")) & match)


def heat(spots: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id with the points that match its day, hour and bucket; all points for a request that matches none.

    requests: request_id, day, hour. spots: what limited() leaves.
    """
    r, matched = _matched(spots, requests)
    none = r.join(matched.select("request_id").distinct(), "request_id", "left_anti")
    rest = none.crossJoin(F.broadcast(spots))  # limited() leaves 10,000 spots at most
    keep = ["request_id", *spots.columns]
    return matched.select(*keep).unionByName(rest.select(*keep))


def heat_totals(spots: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, points, weight: the number and weight of heat()'s points. All points are counted once, for all requests that match none.

    Requests that ask for the same day and hour are answered once.
    """
    asked = requests.select("day", "hour").distinct().withColumn("request_id", F.struct("day", "hour"))
    _, matched = _matched(spots, asked)
    totals = lambda t: t.agg(F.count(F.lit(1)).alias("points"), F.sum("weight").alias("weight"))
    own = totals(matched.groupBy("request_id")).select(F.col("request_id.day").alias("own_day"), F.col("request_id.hour").alias("own_hour"), "points", "weight")
    every = F.broadcast(totals(spots).select(F.col("points").alias("all_points"), F.col("weight").alias("all_weight")))  # one row
    t = requests.join(own, F.col("day").eqNullSafe(F.col("own_day")) & F.col("hour").eqNullSafe(F.col("own_hour")), "left").crossJoin(every)
    t = t.select("request_id", F.coalesce("points", "all_points").alias("points"), F.when(F.col("points").isNull(), F.col("all_weight")).otherwise(F.col("weight")).alias("weight"))
    return t.filter("points > 0")  # no points at all: no rows, as in heat()
