"""Event normalisation, the union of all points, segment summaries, tokens and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.operators import spatial

RANKS = {"Accidente": 0, "Congestión": 1, "Referencia": 2}
OTHER_VIAS = "Otras vías"


def prepare(df: DataFrame, label: str) -> DataFrame:
    """All derived columns of an incident or road table, in one projection and one window."""
    kind = S.EVENT_TYPES.get(label, label.title())
    index = F.coalesce(F.col("indice_coord").try_cast("int"), F.lit(0)) if "indice_coord" in df.columns else F.lit(0)
    oneway = F.coalesce(F.col("oneway").try_cast("boolean"), F.lit(False)) if "oneway" in df.columns else F.lit(False)
    t = df.select(
        "segment_id",
        index.alias("indice_coord"),
        *[S.number(c).alias(c) for c in ("lat", "lon", "duracion_hrs", "distancia_km", "velocidad_kmh")],
        F.col("fecha").try_cast("date").alias("fecha"),
        "hora_inicio",
        "hora_fin",
        S.safe_title(F.col("comuna")).alias("comuna"),
        S.safe_title(F.col("via"), "Sin vía").alias("via"),
        oneway.alias("oneway"),
        F.lit(kind).alias("tipo_evento"),
        F.lit(S.PENALTIES.get(kind, 1.0)).alias("penalty_factor"),
        S.clock_hour(F.col("hora_inicio")).alias("hora_num"),
        F.lit(RANKS.get(kind, 3)).alias("src_rank"),
        F.col("row_no").cast("long").alias("row_no"),
    )
    seq = F.row_number().over(Window.partitionBy("segment_id").orderBy("indice_coord", "row_no")) - 1
    return t.select(
        "*",
        S.hour_bucket(F.col("hora_num")).alias("franja_horaria"),
        S.weekday(F.col("fecha")).alias("dia_semana"),
        S.duration_bucket(F.col("duracion_hrs")).alias("duracion_categoria"),
        S.speed_bucket(F.col("velocidad_kmh")).alias("velocidad_categoria"),
        seq.alias("segment_seq"),
    )


def raw_events(accidents: DataFrame, congestions: DataFrame, roads: DataFrame) -> DataFrame:
    """Prepared incidents, then roads with the penalties of incidents nearby. Order is left to the sink."""
    incidents = prepare(accidents, "accidente").unionByName(prepare(congestions, "congestion"))
    return incidents.unionByName(spatial.apply_penalties(prepare(roads, "referencia"), incidents, ["segment_id", "segment_seq"]))


def top_vias(segments: DataFrame, n: int = 30) -> DataFrame:
    return segments.filter(F.col("via").isNotNull()).groupBy("via").agg(F.count(F.lit(1)).alias("segments")).orderBy(F.desc("segments"), "via").limit(n)


def segment_summary(events: DataFrame) -> DataFrame:
    """One row per incident segment: first known values in point order, means, via category."""
    incidents = events.filter("tipo_evento <> 'Referencia'")
    firsts = ["tipo_evento", "comuna", "via", "franja_horaria", "duracion_categoria", "velocidad_categoria", "dia_semana"]
    first = lambda c: F.expr(f"min_by({c}, struct(segment_seq, src_rank, row_no)) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    s = incidents.groupBy("segment_id").agg(*[first(c) for c in firsts], *[F.avg(c).alias(c) for c in ("duracion_hrs", "velocidad_kmh", "lat", "lon")])
    top = F.broadcast(top_vias(s).select(F.col("via").alias("top_via")))  # 30 rows
    s = s.join(top, F.col("via") == F.col("top_via"), "left")
    return s.withColumn("via_categoria", F.when(F.col("top_via").isNotNull(), F.col("via")).otherwise(OTHER_VIAS)).drop("top_via")


def with_tokens(segments: DataFrame) -> DataFrame:
    """Sorted different tokens of each segment; tokens that contain "nan" are dropped."""
    value = lambda c, fallback: F.coalesce(S.clean(F.col(c)), F.lit(fallback))
    day = F.when(value("dia_semana", "Monday").isin("Saturday", "Sunday"), "Fin de semana").otherwise("Día laboral")
    tokens = F.array(
        F.concat(F.lit("evento="), value("tipo_evento", "Sin evento")),
        F.concat(F.lit("comuna="), value("comuna", "Sin comuna")),
        F.concat(F.lit("franja="), value("franja_horaria", S.NO_BUCKET)),
        F.concat(F.lit("duracion="), value("duracion_categoria", S.NO_DURATION)),
        F.concat(F.lit("velocidad="), value("velocidad_categoria", S.NO_SPEED)),
        F.concat(F.lit("dia="), day),
        F.concat(F.lit("via="), value("via_categoria", OTHER_VIAS)),
    )
    return segments.withColumn("tokens", F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.lower(t).contains("nan")))))


def transactions(segments: DataFrame) -> DataFrame:
    """Long form: segment_id, token."""
    return with_tokens(segments).select("segment_id", F.explode("tokens").alias("token"))


def one_hot(segments: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Wide form: one 0/1 column per token, those of the vocabulary or all in order (a few labels for each attribute)."""
    return transactions(segments).groupBy("segment_id").pivot("token", vocabulary).agg(F.lit(1).cast("long")).na.fill(0)


def options(segments: DataFrame, events: DataFrame) -> DataFrame:
    """One row: distinct labels, counts and bounds."""
    lists = {"event_types": "tipo_evento", "communes": "comuna", "franjas": "franja_horaria", "durations": "duracion_categoria", "velocities": "velocidad_categoria", "vias": "via_categoria"}
    s = segments.agg(
        *[F.array_sort(F.collect_set(c)).alias(name) for name, c in lists.items()],
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("via_categoria").alias("total_vias"),
        F.round(F.avg(F.when(F.col("tipo_evento") == "Accidente", 1.0).otherwise(0.0)), 4).alias("accident_ratio"),
    )
    return s.crossJoin(spatial.bounds(events))  # one row each
