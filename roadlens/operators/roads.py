"""Flattening of road edges into one row per coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import scalars as S


def road_rows(edges: DataFrame, place: str) -> DataFrame:
    """edges: u, v, osmid array, name, name_es, addr_city, ref, length_m, maxspeed array, oneway, geometry array<array<struct<lon,lat>>>, u_node, v_node."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    way = S.one_way(F.col("oneway"))
    coords = F.flatten("geometry")
    ends = F.array(*[F.struct(F.col(f"{n}.x").alias("lon"), F.col(f"{n}.y").alias("lat")) for n in ("u_node", "v_node")])
    coords = F.when(F.size(coords) > 0, coords).otherwise(ends)
    km = F.coalesce(F.col("length_m"), F.lit(0.0)) / 1000
    city = F.coalesce(*[text(c) for c in ("addr_city", "name_es", "ref")], *[text(f"{n}.{c}") for n in ("u_node", "v_node") for c in ("addr_city", "city", "name")])
    osmid = F.coalesce(F.get("osmid", F.lit(0)), F.concat_ws("-", "u", "v"))
    t = edges.withColumn("way", way).withColumn("coords", F.when(way["direction"] == "reverse", F.reverse(coords)).otherwise(coords))
    t = t.withColumn("velocidad_kmh", S.max_speed(F.col("maxspeed"))).withColumn("distancia_km", km)
    t = t.select(
        "*",
        F.posexplode("coords").alias("row_idx", "point"),
        F.when(km > 0, km / F.greatest(F.col("velocidad_kmh"), F.lit(5.0))).otherwise(0.0).alias("duracion_hrs"),
        F.coalesce(S.title(city), F.lit(place)).alias("comuna"),
        F.coalesce(F.nullif("name", F.lit("")), F.nullif("name_es", F.lit("")), F.lit("Sin nombre")).alias("via"),
        F.concat(F.lit("osm::"), osmid, F.lit("::"), "u", F.lit("->"), "v").alias("segment_id"),
    )
    return t.select(
        "row_idx",
        F.lit(f"osm::{place}").alias("archivo_origen"),
        "duracion_hrs",
        "distancia_km",
        "velocidad_kmh",
        F.lit("00:00").alias("hora_inicio"),
        F.lit("00:00").alias("hora_fin"),
        "comuna",
        "via",
        F.col("row_idx").alias("indice_coord"),
        "point.lon",
        "point.lat",
        F.lit(0.0).alias("alt"),
        F.lit("2025-01-01").alias("fecha"),
        "segment_id",
        F.col("way.flag").alias("oneway"),
    )
