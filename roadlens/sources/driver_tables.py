"""Domain tables derived from the generic tables events, orders and lineitem: each user of events is a street on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    even = F.col("user_id") % 2 == 0
    street = F.floor(F.col("user_id") / 2)
    gy, gx = F.when(even, street).otherwise(F.col("pos")), F.when(even, F.col("pos")).otherwise(street)
    keep = lambda c, m: F.when(F.col("event_id") % m != 0, c)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    start = F.concat(two(F.hour("ts")), F.lit(":"), two(F.minute("ts")))
    end = F.concat(two((F.hour("ts") + 1) % 24), F.lit(":"), two(F.minute("ts")))
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("pos").alias("indice_coord"),
        (gy * 5e-4 - 36.95).alias("lat"),
        (gx * 5e-4 - 73.2).alias("lon"),
        keep(F.col("value") / 1e2, 17).alias("duracion_hrs"),
        keep((5 + F.col("event_id") % 60).cast("double"), 19).alias("velocidad_kmh"),
        F.lit(5e-2).alias("distancia_km"),
        F.to_date("ts").alias("fecha"),
        F.when(F.col("event_id") % 23 == 0, "").otherwise(start).alias("hora_inicio"),
        keep(end, 29).alias("hora_fin"),
        F.concat(F.lit("comuna "), F.col("user_id") % 25).alias("comuna"),
        F.concat(F.lit("via "), F.col("user_id") % 40).alias("via"),
        (F.col("user_id") % 5 == 0).alias("oneway"),
        F.col("event_id").alias("row_no"),
    )


def _named(p: DataFrame, prefix: str) -> DataFrame:
    return p.withColumn("segment_id", F.concat(F.lit(prefix), "user_id")).drop("event_id", "user_id", "event_type")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(points(spark, sf_dir), "osm::")


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(points(spark, sf_dir).filter("event_type = 'error'"), "inc::").drop("oneway")


def congestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(points(spark, sf_dir).filter("event_type in ('click', 'view')"), "inc::").drop("oneway")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate the parts they have ordered."""
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.avg(1 + F.col("l_quantity") % 5).alias("rating"))
    return j.select(F.concat(F.lit("u"), "o_custkey").alias("user_id"), F.concat(F.lit("Via "), "l_partkey").alias("via"), "rating")


def recommendation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each customer, some without orders: user_id, known_vias (one), limit, strategies."""
    u = F.col("c_custkey")
    none = F.array().cast("array<string>")
    strategies = F.when(u % 3 == 0, F.array(F.lit("ibcf"), F.lit("ibcf"), F.lit("other"))).when(u % 3 == 1, F.array(F.lit("ibcf"), F.lit("ubcf"))).otherwise(none)
    known = F.array(F.concat(F.lit("Via "), u))
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), u).alias("user_id"), known.alias("known_vias"), F.lit(5).alias("limit"), strategies.alias("strategies"))


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each street: a few blocks on from its third point, or its last one if it is shorter.

    Every tenth street starts at its last point. Such streets are one-way, so where no other points lie there, there is no way on.
    """
    p = points(spark, sf_dir).groupBy("user_id").agg(
        F.max_by(F.struct("lat", "lon"), "indice_coord").alias("last"),
        F.max_by(F.when(F.col("indice_coord") <= 2, F.struct("lat", "lon")), F.when(F.col("indice_coord") <= 2, F.col("indice_coord"))).alias("third"),
    )
    p = p.withColumn("p", F.when(F.col("user_id") % 10 == 0, F.col("last")).otherwise(F.col("third"))).select("user_id", "p.lat", "p.lon")
    own = F.col("user_id") % 3
    weight = lambda k: F.struct(F.concat(F.lit("Via "), (F.col("user_id") + k) % 40).alias("via"), ((F.col("user_id") + 3 * k) % 10 / 10.0).alias("weight"))
    none = F.array().cast("array<struct<via:string,weight:double>>")
    return p.select(
        F.col("user_id").alias("request_id"),
        F.struct("lat", "lon").alias("origin"),
        F.struct((F.col("lat") + 1.1e-3).alias("lat"), (F.col("lon") + 1.6e-3).alias("lon")).alias("destination"),
        F.when(own != 0, F.array(weight(0), weight(1), weight(2))).otherwise(none).alias("ubcf_preferences"),
        F.when(own == 2, F.array(weight(1), weight(3))).otherwise(none).alias("ibcf_preferences"),
        F.lit("lunes").alias("day_of_week"),
        F.lit(8.0).alias("departure_hour"),
        (F.col("user_id") % 4 == 0).alias("avoid_congestion"),
        (F.col("user_id") % 6 == 0).alias("avoid_accidents"),
    )


def delivery_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip for each supplier, from a point of its nation's street to a point of a street of its own, at the nation's day and hour.

    Suppliers of a nation share where, when and how they start, and their ways are of all lengths.
    """
    p = points(spark, sf_dir)
    rank = F.row_number().over(Window.orderBy("user_id")) - 1  # a row for each street
    street = p.select("user_id").distinct().withColumn("r", rank)
    n = street.count()
    place = street.join(p.select("user_id", "indice_coord", "lat", "lon"), "user_id")
    at = lambda end: place.select(F.col("r").alias(f"{end}_r"), F.col("indice_coord").alias(f"{end}_at"), F.struct("lat", "lon").alias(end))
    k, own = F.col("s_nationkey"), F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(own, k, (k * 7 % n).alias("origin_r"), (k % 40).alias("origin_at"), (own * 37 % n).alias("destination_r"), (own % 40).alias("destination_at"))
    none = F.array().cast("array<struct<via:string,weight:double>>")
    days = F.array(*[F.lit(x) for x in ("lunes", "martes", "miércoles", "jueves", "viernes", "sabado", "domingo")])
    return s.join(at("origin"), ["origin_r", "origin_at"]).join(at("destination"), ["destination_r", "destination_at"]).select(
        own.alias("request_id"),
        "origin",
        "destination",
        none.alias("ubcf_preferences"),
        none.alias("ibcf_preferences"),
        F.element_at(days, (k % 7 + 1).cast("int")).alias("day_of_week"),
        (k * 5 % 24).cast("double").alias("departure_hour"),
        (k % 2 == 0).alias("avoid_congestion"),
        (k % 3 == 0).alias("avoid_accidents"),
    )


def doubtful_route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with hours from 0 to 26, origins a degree off for every 11th and weights over 1 for every 13th street."""
    t, u = route_requests(spark, sf_dir), F.col("request_id")
    off = F.struct((F.col("origin.lat") + 1).alias("lat"), F.col("origin.lon").alias("lon"))
    much = F.array(F.struct(F.lit("Via 1").alias("via"), F.lit(1.5).alias("weight")))
    return t.withColumns({"departure_hour": (u % 27).cast("double"), "origin": F.when(u % 11 == 0, off).otherwise(F.col("origin")), "ubcf_preferences": F.when(u % 13 == 0, much).otherwise(F.col("ubcf_preferences"))})


def doubtful_recommendation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with limits from -4 to 245, and without a user for every 17th customer."""
    c = F.expr("substring(user_id, 2)").cast("long")
    t = recommendation_requests(spark, sf_dir).withColumn("request_id", c)
    return t.withColumns({"limit": (c % 250 - 4).cast("int"), "user_id": F.when(c % 17 != 0, F.col("user_id"))})
