"""Scalar rules of the traffic domain as Column functions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, thresholds and factors that results must equal.
HOUR_BUCKETS = ((0, 6, "Madrugada (00-05h)"), (6, 10, "Punta AM (06-09h)"), (10, 16, "Horario Medio (10-15h)"), (16, 21, "Punta PM (16-20h)"), (21, 24, "Nocturno (21-23h)"))
NO_BUCKET = "No definido"
DURATION_BUCKETS = ((0.25, "Duración muy corta"), (0.5, "Duración corta"), (1.0, "Duración media"), (2.0, "Duración prolongada"))
LONGEST, NO_DURATION = "Duración crítica", "Desconocida"
SPEED_BUCKETS = ((15.0, "Velocidad crítica"), (25.0, "Velocidad lenta"), (40.0, "Velocidad moderada"))
FASTEST, NO_SPEED = "Velocidad fluida", "Velocidad desconocida"
EVENT_TYPES = {"accidente": "Accidente", "congestion": "Congestión", "referencia": "Referencia"}
PENALTIES = {"Accidente": 1.75, "Congestión": 1.35}
DAYS = {"lunes": "Monday", "martes": "Tuesday", "miércoles": "Wednesday", "miercoles": "Wednesday", "jueves": "Thursday", "viernes": "Friday", "sábado": "Saturday", "sabado": "Saturday", "domingo": "Sunday"}
EARTH_KM = 6371.0
BOX = (-36.95, -36.7, -73.2, -72.9)


def number(c: Column | str) -> Column:
    """Double, with NaN and bad input as NULL."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def clean(c: Column) -> Column:
    """Trimmed text; blank and "nan" become NULL."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def title(c: Column) -> Column:
    """Upper case after anything that is no letter, lower case elsewhere."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def safe_title(c: Column, fallback: str = "Sin dato") -> Column:
    return F.coalesce(title(clean(c)), F.lit(fallback))


def hour_bucket(hour: Column, overflow: str = NO_BUCKET) -> Column:
    h = F.coalesce(hour.cast("double"), F.lit(0.0))
    out = F.lit(overflow)
    for start, end, label in HOUR_BUCKETS[::-1]:
        out = F.when((h >= start) & (h < end), label).otherwise(out)
    return out


def duration_bucket(hours: Column) -> Column:
    out = F.when(hours.isNull(), NO_DURATION)
    for limit, label in DURATION_BUCKETS:
        out = out.when(hours < limit, label)
    return out.otherwise(LONGEST)


def speed_bucket(speed: Column) -> Column:
    out = F.when(speed.isNull(), NO_SPEED)
    for limit, label in SPEED_BUCKETS:
        out = out.when(speed <= limit, label)
    return out.otherwise(FASTEST)


def clock(c: Column) -> Column:
    """Timestamp of an HH:MM text, or NULL."""
    return F.try_to_timestamp(c, F.lit("H:m"))


def clock_hour(c: Column) -> Column:
    return F.coalesce(F.hour(clock(c)), F.lit(0))


def decimal_hour(c: Column) -> Column:
    t = clock(c)
    return F.hour(t) + F.minute(t) / F.lit(60.0)


def weekday(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def normal_day(c: Column) -> Column:
    """English weekday of an English or Spanish name; blank is Monday."""
    t = F.trim(c)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv]), F.lower(t))
    return F.when(t.isNull() | (t == ""), "Monday").otherwise(F.coalesce(known, title(t)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # NULL stays NULL


def base_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of an edge; unknown and zero lengths count as 50 m."""
    d = haversine_km(lat1, lon1, lat2, lon2)
    return F.when(d > 0, d).otherwise(0.05)


def hotspot_weight(speed: Column) -> Column:
    return F.when(speed > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.1), 1 / F.greatest(speed, F.lit(5.0))))).otherwise(0.5)


def edge_factor(penalty_a: Column, penalty_b: Column, speed_a: Column, speed_b: Column) -> Column:
    """Static cost factor of an edge from the penalties and speeds of its ends."""
    speed = (F.coalesce(speed_a, F.lit(0.0)) + F.coalesce(speed_b, F.lit(0.0))) / 2
    return F.greatest((penalty_a + penalty_b) / 2, F.lit(1.0)) * F.greatest(F.lit(0.3), 40 / F.greatest(speed, F.lit(5.0)))


def incident_factor(kind: Column, penalty: Column, node_day: Column, node_bucket: Column, day: Column, bucket: Column, avoid_congestion: Column, avoid_accidents: Column) -> Column:
    """Extra cost of a node for a trip's context."""
    same_day = F.coalesce((day != "") & (F.lower(node_day) == F.lower(day)), F.lit(False))
    same_hour = F.coalesce((bucket != "") & (node_bucket == bucket), F.lit(False))
    penalised = F.coalesce(penalty > 1, F.lit(False))
    base = F.when(penalised, penalty).otherwise(1.0)
    scale = lambda exact, partial: F.when(same_day & same_hour, base * exact).when(same_day | same_hour | penalised, base * partial).otherwise(base)
    factor = F.when(avoid_congestion & (kind == "Congestión"), scale(400.0, 4.0)).when(avoid_accidents & (kind == "Accidente"), scale(200.0, 2.0)).otherwise(base)
    return F.when(avoid_congestion | avoid_accidents, factor).otherwise(1.0)


def via_factor(weight: Column) -> Column:
    """Cost factor of a preference between 0 and 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight.cast("double")))
    raw = F.when(s > 0.7, 0.1 + F.pow(1 - s, 2) * 1.33).when(s >= 0.4, 0.5 + (0.7 - s) * 3.33).otherwise(1.5 + F.sqrt(0.4 - s) * 5.53)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(5.0), raw)), 3)


def to_rating(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 4 + 1


def max_speed(values: Column) -> Column:
    """Speed of the first of an edge's speed texts; units are stripped, bad ones count as 40."""
    t = F.trim(F.regexp_replace(F.get(values, F.lit(0)), "km/h|mph", ""))
    return F.coalesce(number(t), F.lit(40.0))


def one_way(value: Column) -> Column:
    """Struct of flag and direction."""
    t = F.lower(F.trim(value))
    flag = F.when(t.isNull() | t.isin("false", "no", "0", ""), False).otherwise(True)
    direction = F.when(t == "-1", "reverse").when(t.isin("1", "true", "yes"), "forward").otherwise("both")
    return F.struct(flag.alias("flag"), direction.alias("direction"))


def clean_polyline(points: Column, origin: Column, destination: Column) -> Column:
    """Complete points only; a single one becomes the straight line between the ends, and none stays none."""
    good = F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.when(F.size(good) == 1, F.array(origin, destination)).otherwise(good)
