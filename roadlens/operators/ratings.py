"""Via danger and rating builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.operators import selection, spatial
from roadlens.sources.shared import saved


def in_region(df: DataFrame, region: str) -> DataFrame:
    return df.filter(spatial.in_box(F.col("lat"), F.col("lon"))) if region == "concepcion" else df


def region_roads(roads: DataFrame, region: str) -> DataFrame:
    """Roads of a region; fails when there are none."""
    out = in_region(roads, region)
    if region == "concepcion" and out.isEmpty():
        raise ValueError("no roads inside the region")
    return out


def via_danger(incidents: DataFrame, region: str = "regional") -> DataFrame:
    t = in_region(incidents, region).groupBy("via").agg(
        F.count(F.lit(1)).alias("incident_count"),
        F.coalesce(F.avg("duracion_hrs"), F.lit(0.0)).alias("avg_duration"),
        F.count_if(F.col("tipo_evento") == "Accidente").alias("accident_count"),
        F.count_if(F.col("tipo_evento") == "Congestión").alias("congestion_count"),
    )
    return t.withColumn("danger_score", F.col("accident_count") * 3.0 + F.col("congestion_count") * 1.0 + F.col("avg_duration") * 10.0)


def _min_max(df: DataFrame, *columns: str) -> DataFrame:
    """One row of min_ and max_ of each column."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def safety_ratings(danger: DataFrame) -> DataFrame:
    t = danger.crossJoin(F.broadcast(_min_max(danger, "danger_score")))  # one row
    span = F.col("max_danger_score") - F.col("min_danger_score")
    norm = F.when(span == 0, 0.5).otherwise(F.try_divide(F.col("danger_score") - F.col("min_danger_score"), span))
    return t.withColumn("normalized_danger", norm).withColumn("safety_rating", S.to_rating(1 - norm)).drop("min_danger_score", "max_danger_score")


def danger_report(safety: DataFrame) -> DataFrame:
    return safety.agg(
        F.expr("max_by(via, struct(danger_score, via))").alias("most_dangerous"),
        F.expr("min_by(via, struct(danger_score, via))").alias("least_dangerous"),
        F.avg("safety_rating").alias("mean_rating"),
        F.min("safety_rating").alias("min_rating"),
        F.max("safety_rating").alias("max_rating"),
    )


def road_attributes(roads: DataFrame, region: str = "regional", fill: bool = False) -> DataFrame:
    """Mean speed, distance and duration by via; fill: missing speeds count as 40, distances as 1."""
    t = in_region(roads, region).filter(F.trim("via") != "")
    speed, km = F.col("velocidad_kmh"), F.col("distancia_km")
    if fill:
        speed, km = F.coalesce(speed, F.lit(40.0)), F.coalesce(km, F.lit(1.0))
    return t.groupBy("via").agg(F.avg(speed).alias("velocidad_kmh"), F.avg(km).alias("distancia_km"), F.avg("duracion_hrs").alias("duracion_hrs"))


def road_profiles(roads: DataFrame, region: str = "regional") -> DataFrame:
    """Ratings of four users who look at road attributes only."""
    a = road_attributes(region_roads(roads, region), region)
    columns = ["velocidad_kmh", "distancia_km", "duracion_hrs"]
    a = saved(a)
    middle = selection.quantiles(a, {c: [0.5] for c in columns})
    a = a.select("via", *[F.coalesce(F.col(c), F.lit(middle[c, 0.5] or 0.0)).alias(c) for c in columns])
    a = a.crossJoin(F.broadcast(_min_max(a, *columns)))
    norm = lambda c: F.when(F.col(f"max_{c}") == F.col(f"min_{c}"), 0.5).otherwise(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")))
    speed, short, quick = S.to_rating(norm(columns[0])), S.to_rating(1 - norm(columns[1])), S.to_rating(1 - norm(columns[2]))
    users = {"speed_hunter": speed, "short_trip": short, "time_saver": quick, "balanced_traveler": F.greatest(F.lit(1.0), F.least(F.lit(5.0), (speed + short + quick) / 3))}
    rows = F.explode(F.array(*[F.struct(F.lit(u).alias("user_id"), F.round(r, 2).alias("rating")) for u, r in users.items()]))
    return a.select("via", rows.alias("x")).select("x.user_id", "via", "x.rating")


def draw(*parts: Column) -> Column:
    """A number between 0 and 1 from 52 bits of the MD5 of the parts, so that partitioning has no influence."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)


def noise(via: Column, profile: str, seed: int) -> Column:
    """Standard normal noise of a via for a profile (Box-Muller)."""
    u = lambda k: draw(via, F.lit(profile), F.lit(str(seed)), F.lit(str(k)))
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))


def incident_profiles(danger: DataFrame, roads: DataFrame, region: str = "regional", noise_scale: float = 1.0, seed: int = 42) -> DataFrame:
    """user_id, via, rating (unrounded), danger_score, velocidad_kmh of four users with opposed views of danger."""
    a = road_attributes(roads, region, fill=True).select("via", "velocidad_kmh", "distancia_km")
    t = a.join(danger.select("via", "danger_score", "accident_count", "congestion_count"), "via", "left").na.fill(0, ["danger_score", "accident_count", "congestion_count"])
    t = saved(t)
    stats = t.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("velocidad_kmh", "danger_score") for n, f in (("min", F.min), ("max", F.max))],
    )
    marks = selection.quantiles(t, {"danger_score": [0.33, 0.66], "velocidad_kmh": [0.5]})
    marks = {"p33": marks["danger_score", 0.33], "p66": marks["danger_score", 0.66], "p50": marks["velocidad_kmh", 0.5]}
    t = t.crossJoin(F.broadcast(stats)).withColumns({n: F.lit(x).cast("double") for n, x in marks.items()})  # one row
    norm = lambda c: (F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}") + 0.01)
    speed, danger_norm = norm("velocidad_kmh"), norm("danger_score")
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    d, v = F.col("danger_score"), F.col("velocidad_kmh")
    users = {
        "safety_focused": (5.0 - danger_norm * 3.5, 0.4),
        "risk_taker": (2.5 + speed * 2.5 + (1 - danger_norm) * 0.5, 0.5),
        "moderate_risk": (3.0 + flag(d.between(F.col("p33"), F.col("p66")), 1.0) - flag(d > F.col("p66"), 0.8) + flag(v > F.col("p50"), 0.5), 0.6),
        "usuario_demo": (3.0 + flag((speed > 0.6) & (danger_norm < 0.3), 1.5) - flag((speed < 0.4) | (danger_norm > 0.7), 1.0) - flag(F.col("accident_count") > 0, 0.8), 0.7),
    }
    bound = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(5.0), x))
    rated = [F.struct(F.lit(u).alias("user_id"), bound(x + (noise(F.col("via"), u, seed) * (sd * noise_scale) if noise_scale else F.lit(0.0))).alias("rating")) for u, (x, sd) in users.items()]
    return t.select("via", "danger_score", "velocidad_kmh", F.explode(F.array(*rated)).alias("x")).select("x.user_id", "via", "x.rating", "danger_score", "velocidad_kmh")


def sampled_profiles(profiles: DataFrame, seed: int = 42) -> DataFrame:
    """An exact share of each profile's vias of interest, by hash order; ratings rounded. The last draw that is in is found by counting, not by ranking."""
    r = F.col("rating")
    rules = {"safety_focused": ((r >= 4.5) | (r <= 2.5), 0.6), "risk_taker": ((F.col("velocidad_kmh") > 50) | (r >= 4.0), 0.5), "moderate_risk": (F.lit(True), 0.4), "usuario_demo": ((r >= 3.5) | (r <= 1.5), 0.45)}
    wanted, share = F.lit(False), F.lit(0.0)
    for user, (mask, fraction) in rules.items():
        wanted, share = F.when(F.col("user_id") == user, mask).otherwise(wanted), F.when(F.col("user_id") == user, fraction).otherwise(share)
    t = profiles.withColumn("share", share).filter(wanted).withColumn("drawn", draw(F.col("via"), F.lit(str(seed))))
    t = saved(t)
    counts = {r["user_id"]: r["n"] for r in t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each profile
    take = {u: int(rules[u][1] * n + 0.5) for u, n in counts.items() if u in rules}
    last = selection.at_ranks(t, "drawn", {u: [k - 1] for u, k in take.items() if k}, "user_id")
    marks = t.sparkSession.createDataFrame([(u, k, last[u, k - 1]) for u, k in take.items() if k], "user_id string, take long, mark double")
    t = t.join(F.broadcast(marks), "user_id").filter("drawn <= mark")
    # all draws below the mark are in; of those equal to it the first vias, as many as are left
    below = t.groupBy("user_id").agg(F.count_if(F.col("drawn") < F.col("mark")).alias("below"))
    tied = F.row_number().over(Window.partitionBy("user_id", "equal").orderBy("via"))
    t = t.join(F.broadcast(below), "user_id").withColumn("equal", F.when(F.col("drawn") == F.col("mark"), F.lit("")).otherwise(F.col("via"))).withColumn("place", tied)
    return t.filter((F.col("equal") != "") | (F.col("place") <= F.col("take") - F.col("below"))).select("user_id", "via", F.round("rating", 2).alias("rating"))
