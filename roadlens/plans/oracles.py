"""SQL for DuckDB with the results of the registered queries, on the same derived tables."""

from __future__ import annotations

from roadlens.functions import scalars as S
from roadlens.plans.queries import ONE_HOT


def _case(value: str, rows, otherwise: str, op: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {limit!r} THEN '{label}'" for limit, label in rows) + f" ELSE '{otherwise}' END"


HOUR = "CASE " + " ".join(f"WHEN {{h}} >= {a} AND {{h}} < {b} THEN '{label}'" for a, b, label in S.HOUR_BUCKETS) + f" ELSE '{S.NO_BUCKET}' END"
HAVERSINE = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"

BASE = f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
points AS (
  SELECT event_id, user_id, event_type, pos AS indice_coord,
    (CASE WHEN user_id % 2 = 0 THEN user_id // 2 ELSE pos END) * 5e-4 - 36.95e0 AS lat,
    (CASE WHEN user_id % 2 = 0 THEN pos ELSE user_id // 2 END) * 5e-4 - 73.2e0 AS lon,
    CASE WHEN event_id % 17 <> 0 THEN value / 1e2 END AS duracion_hrs,
    CASE WHEN event_id % 19 <> 0 THEN CAST(5 + event_id % 60 AS DOUBLE) END AS velocidad_kmh,
    5e-2 AS distancia_km, CAST(ts AS DATE) AS fecha,
    CASE WHEN event_id % 23 = 0 THEN '' ELSE lpad(CAST(extract(hour FROM ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(extract(minute FROM ts) AS VARCHAR), 2, '0') END AS hora_inicio,
    CASE WHEN event_id % 29 <> 0 THEN lpad(CAST((extract(hour FROM ts) + 1) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(extract(minute FROM ts) AS VARCHAR), 2, '0') END AS hora_fin,
    'Comuna ' || (user_id % 25) AS comuna, 'Via ' || (user_id % 40) AS via, user_id % 5 = 0 AS oneway, event_id AS row_no
  FROM numbered),
kinds AS (
  SELECT 'Accidente' AS tipo_evento, 1.75e0 AS penalty_factor, 0 AS src_rank, 'inc::' || user_id AS segment_id, * REPLACE (false AS oneway) FROM points WHERE event_type = 'error'
  UNION ALL SELECT 'Congestión', 1.35e0, 1, 'inc::' || user_id, * REPLACE (false AS oneway) FROM points WHERE event_type IN ('click', 'view')
  UNION ALL SELECT 'Referencia', 1e0, 2, 'osm::' || user_id, * FROM points),
prepared AS (
  SELECT *, coalesce(extract(hour FROM try_strptime(hora_inicio, '%H:%M')), 0) AS hora_num, dayname(fecha) AS dia_semana,
    CASE WHEN duracion_hrs IS NULL THEN '{S.NO_DURATION}' ELSE {_case('duracion_hrs', S.DURATION_BUCKETS, S.LONGEST, '<')} END AS duracion_categoria,
    CASE WHEN velocidad_kmh IS NULL THEN '{S.NO_SPEED}' ELSE {_case('velocidad_kmh', S.SPEED_BUCKETS, S.FASTEST, '<=')} END AS velocidad_categoria,
    row_number() OVER (PARTITION BY src_rank, segment_id ORDER BY indice_coord, row_no) - 1 AS segment_seq
  FROM kinds),
ev AS (SELECT *, {HOUR.format(h='hora_num')} AS franja_horaria FROM prepared),
"""
_FIRSTS = ", ".join(f"first({c} ORDER BY segment_seq, src_rank, row_no) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("tipo_evento", "comuna", "via", "franja_horaria", "duracion_categoria", "velocidad_categoria", "dia_semana"))
SUMMARY = BASE + f"""
seg AS (
  SELECT segment_id, {_FIRSTS}, avg(duracion_hrs) AS duracion_hrs, avg(velocidad_kmh) AS velocidad_kmh, avg(lat) AS lat, avg(lon) AS lon
  FROM ev WHERE src_rank < 2 GROUP BY segment_id),
top AS (SELECT via, count(*) AS segments FROM seg GROUP BY via ORDER BY segments DESC, via LIMIT 30),
summ AS (SELECT seg.*, CASE WHEN top.via IS NOT NULL THEN seg.via ELSE 'Otras vías' END AS via_categoria FROM seg LEFT JOIN top ON seg.via = top.via),
tok AS (
  SELECT segment_id, unnest(list_distinct(list_filter([
    'evento=' || tipo_evento, 'comuna=' || comuna, 'franja=' || franja_horaria, 'duracion=' || duracion_categoria, 'velocidad=' || velocidad_categoria,
    'dia=' || CASE WHEN dia_semana IN ('Saturday', 'Sunday') THEN 'Fin de semana' ELSE 'Día laboral' END, 'via=' || via_categoria],
    lambda t: NOT contains(lower(t), 'nan')))) AS token FROM summ)
"""
HOT = BASE + """
hot AS (
  SELECT segment_id, segment_seq, lat, lon, CASE WHEN velocidad_kmh > 0 THEN least(2e0, greatest(1e-1, 1 / greatest(velocidad_kmh, 5e0))) ELSE 5e-1 END AS weight,
    dia_semana AS day, dia_semana IS NULL AS day_missing, franja_horaria AS bucket,
    extract(hour FROM try_strptime(hora_inicio, '%H:%M')) + extract(minute FROM try_strptime(hora_inicio, '%H:%M')) / 6e1 AS start_hour,
    extract(hour FROM try_strptime(hora_fin, '%H:%M')) + extract(minute FROM try_strptime(hora_fin, '%H:%M')) / 6e1 AS end_hour
  FROM ev WHERE src_rank = 1)
"""
_HOT = "SELECT segment_id, segment_seq, round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight, 6) AS weight, day, day_missing, bucket, round(start_hour, 6) AS start_hour, round(end_hour, 6) AS end_hour FROM hot"
RATED = """
WITH r AS (
  SELECT 'u' || o_custkey AS user_id, 'Via ' || l_partkey AS via, avg(1 + l_quantity % 5) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
"""


def _sim(of: str, over: str, name: str) -> str:
    return f"""
{name}_norm AS (SELECT {of} AS k, sqrt(sum(rating * rating)) AS norm FROM r GROUP BY {of}),
{name} AS (
  SELECT a, b, coalesce(dot / nullif(x.norm * y.norm, 0), 0) AS sim FROM (
    SELECT p.{of} AS a, q.{of} AS b, sum(p.rating * q.rating) AS dot FROM r p JOIN r q USING ({over}) WHERE p.{of} <> q.{of} GROUP BY 1, 2)
  JOIN {name}_norm x ON a = x.k JOIN {name}_norm y ON b = y.k)"""


USER_SIM, ITEM_SIM = _sim("user_id", "via", "usim"), _sim("via", "user_id", "isim")
UBCF = f"""{USER_SIM},
us AS (
  SELECT s.a AS user_id, r.via, coalesce(sum(s.sim * r.rating) / nullif(sum(CASE WHEN r.rating > 0 THEN s.sim END), 0), 0) AS score
  FROM usim s JOIN r ON s.b = r.user_id WHERE NOT EXISTS (SELECT 1 FROM r h WHERE h.user_id = s.a AND h.via = r.via) GROUP BY 1, 2)"""
IBCF = f"""{ITEM_SIM},
isc AS (
  SELECT r.user_id, s.a AS via, coalesce(sum(s.sim * r.rating) / nullif(count(*) FILTER (WHERE s.sim > 0 AND r.rating > 0), 0), 0) AS score
  FROM isim s JOIN r ON s.b = r.via WHERE NOT EXISTS (SELECT 1 FROM r h WHERE h.user_id = r.user_id AND h.via = s.a) GROUP BY 1, 2)"""
REQUESTS = "req AS (SELECT 'u' || c_custkey AS user_id, 'Via ' || c_custkey AS known FROM customer)"
POPULAR = "pop AS (SELECT via, round(avg(rating), 9) AS rating FROM r GROUP BY via)"


def _topn(scores: str, name: str, strategy: str) -> str:
    """All vias outside history and known are candidates, at 0 if they have no score; no candidates: the popular ones."""
    return f"""{scores}, {REQUESTS}, {POPULAR},
cand AS (
  SELECT req.user_id, pop.via, round(coalesce(s.score, 0), 9) AS score FROM req JOIN pop ON pop.via <> req.known
  LEFT JOIN {name} s ON s.user_id = req.user_id AND s.via = pop.via
  WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = req.user_id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = req.user_id AND r.via = pop.via)),
ranked AS (
  SELECT user_id, '{strategy}' AS strategy, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, via) AS rank, via, score FROM cand
  UNION ALL SELECT req.user_id, 'popular', row_number() OVER (PARTITION BY req.user_id ORDER BY pop.rating DESC, pop.via), pop.via, pop.rating
  FROM req JOIN pop ON pop.via <> req.known WHERE req.user_id NOT IN (SELECT user_id FROM cand))"""


DANGER = BASE + """
inc AS (SELECT replace(via, 'Via', 'via') AS via, tipo_evento, coalesce(duracion_hrs, 0) AS duracion_hrs FROM ev WHERE src_rank < 2),
danger AS (
  SELECT *, accident_count * 3e0 + congestion_count * 1e0 + avg_duration * 1e1 AS danger_score FROM (
    SELECT via, count(*) AS incident_count, avg(duracion_hrs) AS avg_duration, count(*) FILTER (WHERE tipo_evento = 'Accidente') AS accident_count,
      count(*) FILTER (WHERE tipo_evento = 'Congestión') AS congestion_count FROM inc GROUP BY via)),
norm AS (
  SELECT *, CASE WHEN max(danger_score) OVER () = min(danger_score) OVER () THEN 5e-1
    ELSE (danger_score - min(danger_score) OVER ()) / (max(danger_score) OVER () - min(danger_score) OVER ()) END AS nd FROM danger),
safety AS (SELECT *, least(1e0, greatest(0e0, 1 - nd)) * 4 + 1 AS safety_rating FROM norm)
"""
NODES = BASE + """
node AS (
  SELECT segment_id || '::' || segment_seq AS node_id, segment_id, segment_seq, lat, lon, tipo_evento, coalesce(velocidad_kmh, 0) AS velocidad_kmh,
    coalesce(duracion_hrs, 0) AS duracion_hrs, via, comuna, penalty_factor, coalesce(dia_semana, '') AS dia_semana, franja_horaria
  FROM ev QUALIFY row_number() OVER (PARTITION BY segment_id, segment_seq ORDER BY src_rank DESC, row_no DESC) = 1)
"""
_LENGTH = "coalesce(nullif(" + HAVERSINE.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon") + ", 0), 5e-2)"
EDGES = NODES + f""",
seqs AS (
  SELECT segment_id || '::' || segment_seq AS src, lead(segment_id || '::' || segment_seq) OVER w AS dst, first_value(oneway) OVER w AS one_way
  FROM ev WINDOW w AS (PARTITION BY segment_id ORDER BY segment_seq, src_rank, row_no)),
directed AS (
  SELECT src, dst FROM seqs WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM seqs WHERE dst IS NOT NULL AND src <> dst AND NOT one_way),
seg_edges AS (SELECT src, dst, {_LENGTH} AS base_km FROM directed JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst),
places AS (SELECT DISTINCT segment_id || '::' || segment_seq AS node_id, round(lat, 5) AS y, round(lon, 5) AS x FROM ev),
met AS (SELECT DISTINCT p.node_id AS src, q.node_id AS dst FROM places p JOIN places q USING (y, x) WHERE p.node_id <> q.node_id),
jun_edges AS (SELECT src, dst, {_LENGTH} * 25e-2 AS base_km FROM met JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst),
edge AS (SELECT src, dst, min(base_km) AS base_km FROM (SELECT * FROM seg_edges UNION ALL SELECT * FROM jun_edges) GROUP BY src, dst)
"""
_FACTOR = "CASE WHEN s > 7e-1 THEN 1e-1 + pow(1 - s, 2) * 1.33e0 WHEN s >= 4e-1 THEN 5e-1 + (7e-1 - s) * 3.33e0 ELSE 1.5e0 + sqrt(4e-1 - s) * 5.53e0 END"
TRIPS = BASE + f"""
trip AS (SELECT DISTINCT user_id FROM points),
pref AS (
  SELECT user_id AS request_id, 'ubcf' AS strategy, 'Via ' || ((user_id + k) % 40) AS via, ((user_id + 3 * k) % 10) / 1e1 AS s FROM trip, unnest([0, 1, 2]) AS t(k) WHERE user_id % 3 <> 0
  UNION ALL SELECT user_id, 'ibcf', 'Via ' || ((user_id + k) % 40), ((user_id + 3 * k) % 10) / 1e1 FROM trip, unnest([1, 3]) AS t(k) WHERE user_id % 3 = 2),
fac AS (SELECT request_id, strategy, via, round(greatest(1e-1, least(5e0, {_FACTOR})), 3) AS factor FROM pref)
"""


def _list(scores: str, name: str, strategy: str, n: int) -> str:
    """The first n recommendations of each request, unrounded."""
    return f"({RATED}{_topn(scores, name, strategy)} SELECT user_id, strategy, rank, via, score FROM ranked WHERE rank <= {n})"


LISTS = f"WITH ub AS {_list(UBCF, 'us', 'ubcf', 5)}, ib AS {_list(IBCF, 'isc', 'ibcf', 5)}\n"
HEAT = f"""
lim AS (SELECT * FROM hot ORDER BY segment_id, segment_seq, lat, lon LIMIT 2000),
asked AS (SELECT user_id AS request_id, dayname(fecha) AS want_day, CAST(user_id % 24 AS DOUBLE) AS h FROM points WHERE indice_coord = 0),
matched AS (
  SELECT request_id, weight FROM lim JOIN asked ON day = want_day AND (bucket = '' OR bucket = {HOUR.format(h='h')})
    AND coalesce(CASE WHEN start_hour <= end_hour THEN h BETWEEN start_hour AND end_hour ELSE h >= start_hour OR h <= end_hour END, true)),
shown AS (
  SELECT * FROM matched
  UNION ALL SELECT request_id, weight FROM lim, asked WHERE request_id NOT IN (SELECT request_id FROM matched))
SELECT request_id, count(*) AS points, round(sum(weight), 6) AS weight FROM shown GROUP BY request_id
"""


def _norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 5e-1 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


ROAD_PROFILES = f"""
attr AS (
  SELECT via, avg(velocidad_kmh) AS s, avg(distancia_km * (1 + row_no % 8)) AS k, avg(duracion_hrs) AS t FROM points
  WHERE lat BETWEEN -36.95e0 AND -36.7e0 AND lon BETWEEN -73.2e0 AND -72.9e0 GROUP BY via),
filled AS (SELECT via, coalesce(s, median(s) OVER (), 0) AS s, coalesce(k, median(k) OVER (), 0) AS k, coalesce(t, median(t) OVER (), 0) AS t FROM attr),
rated AS (SELECT replace(via, 'Via', 'via') AS via, ({_norm('s')}) * 4 + 1 AS s, (1 - ({_norm('k')})) * 4 + 1 AS k, (1 - ({_norm('t')})) * 4 + 1 AS t FROM filled)
SELECT 'speed_hunter' AS user_id, via, round(s, 2) AS rating FROM rated
UNION ALL SELECT 'short_trip', via, round(k, 2) FROM rated
UNION ALL SELECT 'time_saver', via, round(t, 2) FROM rated
UNION ALL SELECT 'balanced_traveler', via, round((s + k + t) / 3, 2) FROM rated
"""
INCIDENT_PROFILES = """,
speeds AS (SELECT replace(via, 'Via', 'via') AS via, avg(coalesce(velocidad_kmh, 4e1)) AS v FROM points GROUP BY 1),
joined AS (
  SELECT via, v, coalesce(danger_score, 0) AS d, coalesce(accident_count, 0) AS n FROM speeds LEFT JOIN danger USING (via)),
marks AS (
  SELECT min(v) AS v0, max(v) AS v1, min(d) AS d0, max(d) AS d1, quantile_cont(d, 0.33) AS p33, quantile_cont(d, 0.66) AS p66, quantile_cont(v, 0.5) AS p50 FROM joined),
scaled AS (SELECT *, (v - v0) / (v1 - v0 + 1e-2) AS fast, (d - d0) / (d1 - d0 + 1e-2) AS risk FROM joined, marks),
rated AS (
  SELECT 'safety_focused' AS user_id, via, 5 - risk * 3.5e0 AS r FROM scaled
  UNION ALL SELECT 'risk_taker', via, 2.5e0 + fast * 2.5e0 + (1 - risk) * 5e-1 FROM scaled
  UNION ALL SELECT 'moderate_risk', via, 3 + CASE WHEN d BETWEEN p33 AND p66 THEN 1e0 ELSE 0e0 END - CASE WHEN d > p66 THEN 8e-1 ELSE 0e0 END + CASE WHEN v > p50 THEN 5e-1 ELSE 0e0 END FROM scaled
  UNION ALL SELECT 'usuario_demo', via, 3 + CASE WHEN fast > 6e-1 AND risk < 3e-1 THEN 1.5e0 ELSE 0e0 END - CASE WHEN fast < 4e-1 OR risk > 7e-1 THEN 1e0 ELSE 0e0 END - CASE WHEN n > 0 THEN 8e-1 ELSE 0e0 END FROM scaled)
SELECT user_id, via, round(least(5e0, greatest(1e0, r)), 4) AS rating FROM rated
"""
ROAD_ROWS = """,
edge AS (
  SELECT *, (event_id % 9) * 1e1 / 1000 AS km, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 90 AS DOUBLE) ELSE 4e1 END AS speed,
    CASE WHEN event_id % 2 = 0 THEN [0e0, 1e-4, 2e-4] WHEN event_id % 4 = 1 THEN [5e-4, 0e0] ELSE [0e0, 5e-4] END AS shift FROM points),
flat AS (SELECT *, unnest(shift) AS dx, generate_subscripts(shift, 1) - 1 AS k FROM edge)
SELECT k AS row_idx, 'osm::Region' AS archivo_origen, round(CASE WHEN km > 0 THEN km / greatest(speed, 5e0) ELSE 0e0 END, 6) AS duracion_hrs, round(km, 6) AS distancia_km, speed AS velocidad_kmh,
  '00:00' AS hora_inicio, '00:00' AS hora_fin, CASE WHEN event_id % 4 = 0 THEN comuna ELSE 'Region' END AS comuna,
  CASE WHEN event_id % 5 <> 0 THEN replace(via, 'Via', 'via') ELSE 'Sin nombre' END AS via, k AS indice_coord, round(lon + dx, 6) AS lon, round(lat, 6) AS lat, 0e0 AS alt,
  '2025-01-01' AS fecha, 'osm::' || CASE WHEN event_id % 3 <> 0 THEN 'w' || user_id ELSE event_id || '-' || (event_id + 1) END || '::' || event_id || '->' || (event_id + 1) AS segment_id,
  event_id % 4 <> 0 AS oneway FROM flat
"""
#: The graph with the roads' penalties, the requests, and each solve's least costs by relaxing edges until nothing improves.
_BUCKET = S.HOUR_BUCKETS[1][2]
_PENALISED = f"""
spots AS (SELECT lat, lon, max(penalty_factor) AS p FROM ev WHERE src_rank < 2 GROUP BY lat, lon),
worst AS (
  SELECT a.segment_id, a.segment_seq, max(b.p) AS p FROM (SELECT * FROM ev WHERE src_rank = 2) a JOIN spots b
    ON b.lat BETWEEN a.lat - 1e-3 AND a.lat + 1e-3 AND b.lon BETWEEN a.lon - 1e-3 AND a.lon + 1e-3
    AND {HAVERSINE.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} * 1000 <= 60 GROUP BY 1, 2),
evp AS (
  SELECT ev.* REPLACE (CASE WHEN src_rank = 2 THEN greatest(ev.penalty_factor, coalesce(worst.p, 1e0)) ELSE ev.penalty_factor END AS penalty_factor)
  FROM ev LEFT JOIN worst USING (segment_id, segment_seq)),
"""
_SCALE = lambda exact, partial: f"(CASE WHEN same_day AND same_hour THEN pen * {exact} WHEN same_day OR same_hour OR pen > 1 THEN pen * {partial} ELSE pen END)"
ROUTES = (BASE + _PENALISED + (EDGES[len(BASE) :]).replace("FROM ev ", "FROM evp ")).replace("WITH numbered", "WITH RECURSIVE numbered", 1).replace("node AS (", "node AS MATERIALIZED (", 1) + f""",
priced AS MATERIALIZED (
  SELECT src, dst, round(base_km, 9) AS base_km, b.via, b.tipo_evento, greatest(b.penalty_factor, 1e0) AS pen,
    lower(b.dia_semana) = 'monday' AS same_day, b.franja_horaria = '{_BUCKET}' AS same_hour,
    greatest((a.penalty_factor + b.penalty_factor) / 2, 1e0) * greatest(3e-1, 40 / greatest((a.velocidad_kmh + b.velocidad_kmh) / 2, 5e0)) AS static
  FROM edge JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst),
box AS (SELECT min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM ev),
start AS (
  SELECT user_id, CASE WHEN user_id % 10 = 0 THEN max_by(lat, indice_coord) ELSE max_by(lat, indice_coord) FILTER (WHERE indice_coord <= 2) END AS lat,
    CASE WHEN user_id % 10 = 0 THEN max_by(lon, indice_coord) ELSE max_by(lon, indice_coord) FILTER (WHERE indice_coord <= 2) END AS lon FROM points GROUP BY user_id),
request AS (
  SELECT user_id AS request_id, lat, lon, lat + 1.1e-3 AS to_lat, lon + 1.6e-3 AS to_lon, user_id % 4 = 0 AS avoid_c, user_id % 6 = 0 AS avoid_a
  FROM start, box WHERE lat + 1.1e-3 BETWEEN y0 AND y1 AND lon + 1.6e-3 BETWEEN x0 AND x1),
origin AS (
  SELECT request_id, first(b.node_id ORDER BY {HAVERSINE.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')}, b.node_id) AS src
  FROM request a JOIN node b ON b.lat BETWEEN a.lat - 1e-3 AND a.lat + 1e-3 AND b.lon BETWEEN a.lon - 1e-3 AND a.lon + 1e-3 GROUP BY request_id),
target AS (
  SELECT request_id, first(b.node_id ORDER BY {HAVERSINE.format(lat1='a.to_lat', lon1='a.to_lon', lat2='b.lat', lon2='b.lon')}, b.node_id) AS dst
  FROM (SELECT * FROM request JOIN origin USING (request_id)) a JOIN node b ON b.node_id <> a.src GROUP BY request_id),
pref AS (
  SELECT request_id, 'ubcf' AS strategy, 'Via ' || ((request_id + k) % 40) AS via, ((request_id + 3 * k) % 10) / 1e1 AS s FROM request, unnest([0, 1, 2]) AS t(k) WHERE request_id % 3 <> 0
  UNION ALL SELECT request_id, 'ibcf', 'Via ' || ((request_id + k) % 40), ((request_id + 3 * k) % 10) / 1e1 FROM request, unnest([1, 3]) AS t(k) WHERE request_id % 3 = 2),
fac AS MATERIALIZED (SELECT request_id || '/' || strategy AS solve_id, via, round(greatest(1e-1, least(5e0, {_FACTOR})), 3) AS factor FROM pref),
wanted AS (
  SELECT *, CASE WHEN variant = 'ubcf' AND request_id % 3 <> 0 THEN 'ubcf' WHEN variant = 'ibcf' AND request_id % 3 = 2 THEN 'ibcf'
    WHEN variant <> 'baseline' AND (avoid_c OR avoid_a) THEN 'incidents' ELSE 'baseline' END AS kind
  FROM request JOIN origin USING (request_id) JOIN target USING (request_id), unnest(['baseline', 'ubcf', 'ibcf']) AS t(variant)),
solve AS MATERIALIZED (
  SELECT DISTINCT request_id || '/' || kind AS solve_id, src, dst, kind <> 'baseline' AS penalties, kind <> 'baseline' AND avoid_c AS avoid_c, kind <> 'baseline' AND avoid_a AS avoid_a FROM wanted),
sp(solve_id, node, dist) USING KEY (solve_id, node) AS (
  SELECT solve_id, src, 0e0 FROM solve
  UNION
  SELECT solve_id, node, dist FROM (
    SELECT c.solve_id, c.node, min(c.dist) AS dist FROM (
      SELECT t.solve_id, e.dst AS node, v.dst AS goal, t.dist + e.base_km * (CASE WHEN v.penalties THEN e.static * coalesce(f.factor, 1e0)
        * (CASE WHEN NOT v.avoid_c AND NOT v.avoid_a THEN 1e0 WHEN v.avoid_c AND e.tipo_evento = 'Congestión' THEN {_SCALE('4e2', '4e0')}
          WHEN v.avoid_a AND e.tipo_evento = 'Accidente' THEN {_SCALE('2e2', '2e0')} ELSE e.pen END) ELSE coalesce(f.factor, 1e0) END) AS dist
      FROM sp t JOIN solve v ON v.solve_id = t.solve_id JOIN priced e ON e.src = t.node LEFT JOIN fac f ON f.solve_id = t.solve_id AND f.via = e.via) c
    LEFT JOIN recurring.sp old ON old.solve_id = c.solve_id AND old.node = c.node
    LEFT JOIN recurring.sp goal ON goal.solve_id = c.solve_id AND goal.node = c.goal
    WHERE (old.dist IS NULL OR c.dist < old.dist) AND (goal.dist IS NULL OR c.dist <= goal.dist)
    GROUP BY c.solve_id, c.node)),
reach AS MATERIALIZED (
  SELECT sp.* FROM sp JOIN (SELECT solve_id, sp.dist AS goal FROM sp JOIN solve USING (solve_id) WHERE sp.node = solve.dst) USING (solve_id) WHERE dist <= goal),
previous AS MATERIALIZED (
  SELECT t.solve_id, e.dst AS node, first(t.node ORDER BY t.dist, t.node) AS before
  FROM reach t JOIN solve v ON v.solve_id = t.solve_id JOIN priced e ON e.src = t.node LEFT JOIN fac f ON f.solve_id = t.solve_id AND f.via = e.via
  JOIN reach h ON h.solve_id = t.solve_id AND h.node = e.dst
  WHERE t.dist + e.base_km * (CASE WHEN v.penalties THEN e.static * coalesce(f.factor, 1e0)
        * (CASE WHEN NOT v.avoid_c AND NOT v.avoid_a THEN 1e0 WHEN v.avoid_c AND e.tipo_evento = 'Congestión' THEN {_SCALE('4e2', '4e0')}
          WHEN v.avoid_a AND e.tipo_evento = 'Accidente' THEN {_SCALE('2e2', '2e0')} ELSE e.pen END) ELSE coalesce(f.factor, 1e0) END) = h.dist AND t.node <> e.dst
  GROUP BY 1, 2),
walk(solve_id, node, step) AS (
  SELECT solve_id, dst, 0 FROM solve WHERE solve_id IN (SELECT solve_id FROM reach)
  UNION ALL
  SELECT w.solve_id, p.before, w.step + 1 FROM walk w JOIN solve v ON v.solve_id = w.solve_id JOIN previous p ON p.solve_id = w.solve_id AND p.node = w.node WHERE w.node <> v.src),
path AS MATERIALIZED (
  SELECT solve_id, row_number() OVER (PARTITION BY solve_id ORDER BY step DESC) - 1 AS position, node AS node_id, dist AS peso FROM walk JOIN reach USING (solve_id, node)),
planned AS (
  SELECT *, CASE WHEN request_id || '/' || kind IN (SELECT solve_id FROM path) THEN request_id || '/' || kind ELSE request_id || '/baseline' END AS solve_id FROM wanted)
"""


def _deliveries() -> str:
    """The solver's SQL for the suppliers' trips: without preferences, and with a day and an hour for each solve."""
    head, tail = ROUTES[: ROUTES.index("start AS (")], ROUTES[ROUTES.index("origin AS (") :]
    trips = f"""street AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM points)),
request AS (
  SELECT s_suppkey AS request_id, a.lat, a.lon, b.lat AS to_lat, b.lon AS to_lon, s_nationkey % 2 = 0 AS avoid_c, s_nationkey % 3 = 0 AS avoid_a,
    ['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'][s_nationkey % 7 + 1] AS day, {HOUR.format(h='(s_nationkey * 5 % 24)')} AS hour
  FROM supplier JOIN street x ON x.r = s_nationkey * 7 % x.n JOIN street y ON y.r = s_suppkey * 37 % y.n
  JOIN points a ON a.user_id = x.user_id AND a.indice_coord = s_nationkey % 40 JOIN points b ON b.user_id = y.user_id AND b.indice_coord = s_suppkey % 40),
"""
    t = head + trips + tail
    for old, new in (
        (f"lower(b.dia_semana) = 'monday' AS same_day, b.franja_horaria = '{_BUCKET}' AS same_hour", "lower(b.dia_semana) AS day, b.franja_horaria AS hour"),
        ("variant = 'ubcf' AND request_id % 3 <> 0", "false"),
        ("variant = 'ibcf' AND request_id % 3 = 2", "false"),
        ("src, dst, kind <> 'baseline' AS penalties", "src, dst, day, hour, kind <> 'baseline' AS penalties"),
        ("same_day", "e.day = v.day"),
        ("same_hour", "e.hour = v.hour"),
    ):
        assert old in t, old
        t = t.replace(old, new)
    return t


STEPS = ROUTES.rstrip() + f""",
inner_step AS (
  SELECT request_id, variant, position, node_id, segment_id, segment_seq, n.lat, n.lon, via, comuna, tipo_evento, duracion_hrs, dia_semana, franja_horaria, peso,
    w.lat AS o_lat, w.lon AS o_lon, to_lat, to_lon
  FROM planned w JOIN path USING (solve_id) JOIN node n USING (node_id)),
last AS (SELECT request_id, variant, max(position) AS last FROM inner_step GROUP BY 1, 2),
full_step AS (
  SELECT * EXCLUDE (o_lat, o_lon, to_lat, to_lon) FROM inner_step
  UNION ALL SELECT request_id, variant, -1, 'user_origin', segment_id, segment_seq, o_lat, o_lon, via, comuna, 'Usuario', 0e0, 'Monday', '{_BUCKET}', 0e0 FROM inner_step WHERE position = 0
  UNION ALL SELECT request_id, variant, position + 1, 'user_destination', segment_id, segment_seq, to_lat, to_lon, via, comuna, 'Usuario', 0e0, 'Monday', '{_BUCKET}', peso FROM inner_step JOIN last USING (request_id, variant) WHERE position = last),
moved AS (SELECT *, lag(lat) OVER w AS from_lat, lag(lon) OVER w AS from_lon FROM full_step WINDOW w AS (PARTITION BY request_id, variant ORDER BY position)),
step AS MATERIALIZED (SELECT *, CASE WHEN from_lat IS NULL THEN 0 ELSE {HAVERSINE.format(lat1='from_lat', lon1='from_lon', lat2='lat', lon2='lon')} END AS km FROM moved),
incident AS (
  SELECT request_id, variant, avg(greatest(duracion_hrs, 1e-1) * 60) + CASE WHEN tipo_evento = 'Congestión' THEN 5 ELSE 0 END AS minutes FROM step
  WHERE tipo_evento IN ('Congestión', 'Accidente') AND lower(dia_semana) = 'monday' AND franja_horaria = '{_BUCKET}' GROUP BY request_id, variant, segment_id, tipo_evento),
delay AS (SELECT request_id, variant, round(sum(minutes), 1) AS extra_delay_min FROM incident GROUP BY 1, 2),
variants AS (
  SELECT request_id, variant, round(sum(km), 2) AS distance_km, round(sum(km) / 35 * 60, 1) AS estimated_duration_min, coalesce(any_value(extra_delay_min), 0) AS extra_delay_min, max(peso) AS cost
  FROM step LEFT JOIN delay USING (request_id, variant) GROUP BY request_id, variant)
"""
GEOMETRY = STEPS.rstrip() + """,
ahead AS (SELECT *, lead(segment_id) OVER w AS to_segment, lead(segment_seq) OVER w AS to_seq FROM step WINDOW w AS (PARTITION BY request_id, variant ORDER BY position)),
gap AS (
  SELECT request_id, variant, position, segment_id, sign(to_seq - segment_seq) AS s, segment_seq AS a, unnest(range(1, abs(to_seq - segment_seq))) AS sub
  FROM ahead WHERE segment_id = to_segment AND abs(to_seq - segment_seq) > 1),
spot AS (SELECT segment_id, segment_seq, last(lat ORDER BY src_rank, row_no) AS lat, last(lon ORDER BY src_rank, row_no) AS lon FROM ev GROUP BY 1, 2),
line AS (
  SELECT request_id, variant, position, 0 AS sub, lat, lon FROM step
  UNION ALL SELECT request_id, variant, position, sub, p.lat, p.lon FROM gap g JOIN spot p ON p.segment_id = g.segment_id AND p.segment_seq = g.a + g.s * g.sub),
marked AS (
  SELECT *, row_number() OVER w > 1 AND lat IS NOT DISTINCT FROM lag(lat) OVER w AND lon IS NOT DISTINCT FROM lag(lon) OVER w AS same
  FROM line WINDOW w AS (PARTITION BY request_id, variant ORDER BY position, sub))
SELECT request_id, variant, position, sub, round(lat, 6) AS lat, round(lon, 6) AS lon FROM marked WHERE NOT same
"""
ROUTE_SUMMARY = STEPS.rstrip() + """,
total AS (SELECT *, estimated_duration_min + extra_delay_min AS total, list_position(['baseline', 'ubcf', 'ibcf'], variant) AS turn FROM variants),
wide AS (
  SELECT request_id, first(variant ORDER BY total, turn) AS best,
    """ + ",\n    ".join(f"max({x}) FILTER (WHERE variant = '{v}') AS {n}_{v}" for v in ("baseline", "ubcf", "ibcf") for n, x in (("total", "total"), ("km", "distance_km"), ("delay", "extra_delay_min"))) + """ FROM total GROUP BY request_id)
SELECT request_id, best, total_baseline, total_ubcf, total_ibcf, """ + ", ".join(f"round(km_{v} - km_baseline, 6) AS delta_km_{v}, round(delay_baseline - delay_{v}, 6) AS delay_saved_{v}, round(total_{v} - total_baseline, 6) AS delta_min_{v}" for v in ("ubcf", "ibcf")) + """ FROM wide
"""
COVERAGE = STEPS.rstrip() + """,
seen AS (SELECT DISTINCT request_id, via FROM step WHERE variant = 'baseline' AND via IS NOT NULL),
told AS (SELECT DISTINCT request_id, strategy, via FROM pref),
counted AS (
  SELECT request_id, count(*) AS vias, count(u.via) AS by_ubcf, count(i.via) AS by_ibcf, count(*) FILTER (WHERE u.via IS NOT NULL AND i.via IS NOT NULL) AS by_both
  FROM seen LEFT JOIN (SELECT request_id, via FROM told WHERE strategy = 'ubcf') u USING (request_id, via)
  LEFT JOIN (SELECT request_id, via FROM told WHERE strategy = 'ibcf') i USING (request_id, via) GROUP BY request_id)
SELECT *, CASE WHEN by_ubcf * 10 < vias AND by_ibcf * 10 < vias THEN 'not covered' WHEN by_both * 2 > vias THEN 'same vias' ELSE 'ok' END AS verdict FROM counted
"""


def _draw(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) + 5e-1) / 4503599627370496e0"


_NOISE = lambda user: f"sqrt(-2 * ln({_draw('via', user, chr(39) + '42' + chr(39), chr(39) + '0' + chr(39))})) * cos(2 * pi() * {_draw('via', user, chr(39) + '42' + chr(39), chr(39) + '1' + chr(39))})"
INCIDENT_NOISE = """,
noisy AS (
  SELECT user_id, via, least(5e0, greatest(1e0, r + (""" + _NOISE("user_id") + """) * CASE user_id WHEN 'safety_focused' THEN 4e-1 WHEN 'risk_taker' THEN 5e-1 WHEN 'moderate_risk' THEN 6e-1 ELSE 7e-1 END)) AS r, v FROM rated JOIN scaled USING (via)),
picked AS (
  SELECT *, CASE user_id WHEN 'safety_focused' THEN 6e-1 WHEN 'risk_taker' THEN 5e-1 WHEN 'moderate_risk' THEN 4e-1 ELSE 45e-2 END AS share,
    count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY """ + _draw("via", "'42'") + """, via) AS place FROM noisy
  WHERE CASE user_id WHEN 'safety_focused' THEN r >= 4.5e0 OR r <= 2.5e0 WHEN 'risk_taker' THEN v > 50 OR r >= 4e0 WHEN 'moderate_risk' THEN true ELSE r >= 3.5e0 OR r <= 1.5e0 END)
SELECT user_id, via, round(r, 2) AS rating FROM picked WHERE place <= round(share * n)
"""
_PREPARED = "segment_id, indice_coord, lat, lon, duracion_hrs, distancia_km, velocidad_kmh, hora_inicio, hora_fin, comuna, via, oneway, tipo_evento, penalty_factor, hora_num, src_rank, row_no, franja_horaria, dia_semana, duracion_categoria, velocidad_categoria, segment_seq"
_SAME = "lower(dia_semana) = 'monday'"
_HOUR = f"franja_horaria = '{S.HOUR_BUCKETS[1][2]}'"
_ROUNDED = "round(duracion_hrs, 6) AS duracion_hrs, round(velocidad_kmh, 6) AS velocidad_kmh, round(lat, 6) AS lat, round(lon, 6) AS lon"
_LISTS = {"event_types": "tipo_evento", "communes": "comuna", "franjas": "franja_horaria", "durations": "duracion_categoria", "velocities": "velocidad_categoria", "vias": "via_categoria"}


def _plain(sql: str) -> str:
    """A chain of common tables that ends with a comma gets its query."""
    return sql.rstrip().rstrip(",") + "\n"


SQL = {
    "events_prepared": _plain(BASE) + f"SELECT {_PREPARED} FROM ev WHERE src_rank = 0",
    "segment_seq": _plain(BASE) + "SELECT segment_id, row_no, segment_seq FROM ev WHERE src_rank = 2",
    "raw_events_union": _plain(BASE) + "SELECT tipo_evento, franja_horaria, count(*) AS points, count(DISTINCT segment_id) AS segments FROM ev GROUP BY 1, 2",
    "road_penalties": BASE + f"""
jit AS (SELECT segment_id, segment_seq, src_rank, penalty_factor, lat + (row_no % 7) * 3e-5 AS lat, lon + (row_no % 11) * 3e-5 AS lon FROM ev)
SELECT a.segment_id, a.segment_seq, greatest(1e0, coalesce(max(b.penalty_factor), 1e0)) AS penalty_factor
FROM (SELECT * FROM jit WHERE src_rank = 2) a LEFT JOIN (SELECT * FROM jit WHERE src_rank < 2) b
  ON b.lat BETWEEN a.lat - 1e-3 AND a.lat + 1e-3 AND {HAVERSINE.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} * 1000 <= 60 GROUP BY 1, 2""",
    "segment_summary": SUMMARY + f"SELECT segment_id, tipo_evento, comuna, via, franja_horaria, duracion_categoria, velocidad_categoria, dia_semana, {_ROUNDED}, via_categoria FROM summ",
    "via_top30": SUMMARY + "SELECT via, segments FROM top",
    "metadata_options": SUMMARY + "SELECT " + ", ".join(f"array_to_string(list_sort(list(DISTINCT {c})), '|') AS {n}" for n, c in _LISTS.items()) + """, count(*) AS total_events, count(DISTINCT via_categoria) AS total_vias,
  round(avg(CASE WHEN tipo_evento = 'Accidente' THEN 1e0 ELSE 0e0 END), 4) AS accident_ratio, (SELECT round(min(lat), 6) FROM ev) AS lat_min, (SELECT round(max(lat), 6) FROM ev) AS lat_max,
  (SELECT round(min(lon), 6) FROM ev) AS lon_min, (SELECT round(max(lon), 6) FROM ev) AS lon_max FROM summ""",
    "segment_tokens": SUMMARY + "SELECT segment_id, string_agg(token, '|' ORDER BY token) AS tokens FROM tok GROUP BY segment_id",
    "transactions_long": SUMMARY + "SELECT segment_id, token FROM tok",
    "congestion_hotspots": HOT + _HOT,
    "hotspots_limited": HOT + _HOT.replace("FROM hot", "FROM (SELECT * FROM hot ORDER BY segment_id, segment_seq, lat, lon LIMIT 2000)"),
    "ratings_clean": _plain(RATED) + "SELECT user_id, via, round(rating, 6) AS rating FROM r",
    "popularity": _plain(RATED) + "SELECT via, round(avg(rating), 6) AS rating FROM r GROUP BY via",
    "user_similarity": RATED + USER_SIM + "SELECT a, b, round(sim, 6) AS sim FROM usim",
    "item_similarity": RATED + ITEM_SIM + "SELECT a, b, round(sim, 6) AS sim FROM isim",
    "ubcf_scores": RATED + UBCF + "SELECT user_id, via, round(score, 6) AS score FROM us",
    "ibcf_scores": RATED + IBCF + "SELECT user_id, via, round(score, 6) AS score FROM isc",
    "ubcf_topn": RATED + _topn(UBCF, "us", "ubcf") + "SELECT user_id, strategy, rank, via, score AS estimated_rating FROM ranked WHERE rank <= 5",
    "ibcf_topn": RATED + _topn(IBCF, "isc", "ibcf") + "SELECT user_id, strategy, rank, via, score AS estimated_rating FROM ranked WHERE rank <= 5",
    "popular_fallback": RATED + f"{REQUESTS}, {POPULAR} SELECT user_id, 'popular' AS strategy, rank, via, score FROM (SELECT req.user_id, pop.via, pop.rating AS score, row_number() OVER (PARTITION BY req.user_id ORDER BY pop.rating DESC, pop.via) AS rank FROM req JOIN pop ON pop.via <> req.known) WHERE rank <= 5",
    "heat_filter": HOT.rstrip() + "," + HEAT,
    "playground": LISTS + "SELECT user_id, strategy, rank, via, score AS estimated_rating, asked FROM (SELECT *, 'ubcf' AS asked FROM ub WHERE CAST(substr(user_id, 2) AS INT) % 3 <> 0 UNION ALL SELECT *, 'ibcf' FROM ib)",
    "strategy_overlap": LISTS + """SELECT user_id, count(*) FILTER (WHERE ub.rank IS NOT NULL AND ib.rank IS NOT NULL) AS common, count(*) FILTER (WHERE ib.rank IS NULL) AS only_a, count(*) FILTER (WHERE ub.rank IS NULL) AS only_b,
  round(avg(ub.score), 6) AS mean_a, round(avg(ib.score), 6) AS mean_b, round(abs(avg(ub.score) - avg(ib.score)), 6) AS mean_difference FROM ub FULL JOIN ib USING (user_id, via) GROUP BY user_id""",
    "preference_extremes": f"WITH ub AS {_list(UBCF, 'us', 'ubcf', 200)}, " + """placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, strategy ORDER BY score DESC, via) AS top, count(*) OVER (PARTITION BY user_id, strategy) AS n FROM ub)
SELECT user_id, strategy, rank, via, score AS estimated_rating, round(score / 5, 3) AS weight FROM placed WHERE top <= 20 OR top > n - 20""",
    "road_profiles": BASE + ROAD_PROFILES,
    "incident_profiles": DANGER.rstrip() + INCIDENT_PROFILES,
    "road_rows": _plain(BASE).rstrip() + ROAD_ROWS,
    "ratings_by_user": _plain(RATED) + "SELECT user_id, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS std, count(*) AS count FROM r GROUP BY user_id",
    "rating_counts": _plain(RATED) + "SELECT count(DISTINCT user_id) AS users, count(DISTINCT via) AS vias, count(*) AS ratings FROM r",
    "via_danger": DANGER + "SELECT via, incident_count, round(avg_duration, 6) AS avg_duration, accident_count, congestion_count, round(danger_score, 6) AS danger_score FROM danger",
    "via_safety_rating": DANGER + "SELECT via, incident_count, round(avg_duration, 6) AS avg_duration, accident_count, congestion_count, round(danger_score, 6) AS danger_score, round(nd, 6) AS normalized_danger, round(safety_rating, 6) AS safety_rating FROM safety",
    "danger_report": DANGER + "SELECT last(via ORDER BY danger_score, via) AS most_dangerous, first(via ORDER BY danger_score, via) AS least_dangerous, round(avg(safety_rating), 6) AS mean_rating, round(min(safety_rating), 6) AS min_rating, round(max(safety_rating), 6) AS max_rating FROM safety",
    "graph_nodes": NODES + "SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM node",
    "graph_segment_edges": EDGES + "SELECT src, dst, round(base_km, 6) AS base_km FROM seg_edges",
    "graph_junction_edges": EDGES + "SELECT src, dst, round(base_km, 6) AS base_km FROM jun_edges",
    "graph_stats": EDGES + "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(DISTINCT segment_id) FROM node) AS segments, (SELECT count(*) FROM edge) AS edges",
    "edge_costs": EDGES + "SELECT src, dst, round(base_km, 6) AS base_km, round(greatest((a.penalty_factor + b.penalty_factor) / 2, 1e0) * greatest(3e-1, 40 / greatest((a.velocidad_kmh + b.velocidad_kmh) / 2, 5e0)), 6) AS static_factor FROM edge JOIN node a ON a.node_id = src JOIN node b ON b.node_id = dst",
    "incident_factors": NODES + f"SELECT node_id, round(CASE WHEN tipo_evento = 'Referencia' THEN 1e0 WHEN {_SAME} AND {_HOUR} THEN penalty_factor * CASE tipo_evento WHEN 'Accidente' THEN 200 ELSE 400 END ELSE penalty_factor * CASE tipo_evento WHEN 'Accidente' THEN 2 ELSE 4 END END, 6) AS factor FROM node",
    # a point has its own street's node within 20 m, so its nearest one is at most one cell of 0.001 degrees away
    "nearest_node": NODES + f""", pt AS (SELECT event_id AS point_id, lat + 1.1e-4 AS lat, lon + 0.7e-4 AS lon FROM points),
around AS (SELECT point_id, lat, lon, floor(lat * 1e3) + dy AS y, floor(lon * 1e3) + dx AS x FROM pt, unnest([-1, 0, 1]) AS a(dy), unnest([-1, 0, 1]) AS b(dx)),
celled AS (SELECT node_id, lat, lon, floor(lat * 1e3) AS y, floor(lon * 1e3) AS x FROM node),
near AS (SELECT a.point_id, b.node_id, {HAVERSINE.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} AS km FROM around a JOIN celled b USING (y, x))
SELECT point_id, first(node_id ORDER BY km, node_id) AS node_id, round(min(km), 6) AS km FROM near GROUP BY point_id""",
    "via_factors": TRIPS + "SELECT request_id, via, factor FROM fac WHERE strategy = 'ubcf'",
    "factor_compare": TRIPS + "SELECT request_id, count(*) AS common, count(*) FILTER (WHERE abs(u.factor - i.factor) > 1e-1) AS different, round(count(*) FILTER (WHERE abs(u.factor - i.factor) > 1e-1) / count(*), 6) AS share FROM (SELECT * FROM fac WHERE strategy = 'ubcf') u JOIN (SELECT * FROM fac WHERE strategy = 'ibcf') i USING (request_id, via) GROUP BY request_id",
    "transactions_onehot": SUMMARY + "SELECT segment_id, " + ", ".join(f"""max(CASE WHEN token = '{t}' THEN 1 ELSE 0 END) AS "{t}\"""" for t in ONE_HOT) + " FROM tok GROUP BY segment_id",
    "incident_profiles_noisy": DANGER.rstrip() + INCIDENT_PROFILES[: INCIDENT_PROFILES.rindex("SELECT user_id, via, round(least")].rstrip() + INCIDENT_NOISE,
    "shortest_paths": ROUTES + "SELECT solve_id, position, node_id, round(peso, 6) AS peso FROM path",
    "delivery_routes": _deliveries() + "SELECT solve_id, position, node_id, round(peso, 6) AS peso FROM path",
    "unroutable_requests": ROUTES + "SELECT request_id, src, dst FROM wanted WHERE variant = 'baseline' AND request_id || '/baseline' NOT IN (SELECT solve_id FROM path)",
    "route_steps": STEPS + "SELECT request_id, variant, position, node_id, round(lat, 6) AS lat, round(lon, 6) AS lon, tipo_evento, dia_semana, franja_horaria, round(peso, 6) AS peso, round(sum(km) OVER (PARTITION BY request_id, variant ORDER BY position), 3) AS cumulative_km FROM step",
    "route_variants": STEPS + "SELECT request_id, variant, distance_km, estimated_duration_min, extra_delay_min, round(cost, 6) AS cost FROM variants",
    "route_delay": STEPS + "SELECT request_id, variant, extra_delay_min FROM delay",
    "route_geometry": GEOMETRY,
    "route_summary": ROUTE_SUMMARY,
    "penalty_scenarios": STEPS + "SELECT request_id, variant, count(*) FILTER (WHERE tipo_evento = 'Accidente') AS accidents, count(*) FILTER (WHERE tipo_evento = 'Congestión') AS congestions, count(*) AS steps, round(sum(peso), 6) AS sum_peso, round(max(peso), 6) AS cost FROM step WHERE position >= 0 AND tipo_evento <> 'Usuario' GROUP BY request_id, variant",
    "route_coverage": COVERAGE,
    "route_request_rejects": _plain(BASE).rstrip() + """, box AS (SELECT min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM points),
start AS (
  SELECT user_id, CASE WHEN user_id % 10 = 0 THEN max_by(lat, indice_coord) ELSE max_by(lat, indice_coord) FILTER (WHERE indice_coord <= 2) END AS lat,
    CASE WHEN user_id % 10 = 0 THEN max_by(lon, indice_coord) ELSE max_by(lon, indice_coord) FILTER (WHERE indice_coord <= 2) END AS lon FROM points GROUP BY user_id)
SELECT user_id AS request_id, CAST(user_id % 27 AS DOUBLE) AS departure_hour FROM start, box
WHERE NOT (user_id % 27 <= 24 AND user_id % 13 <> 0 AND lat + CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END BETWEEN y0 AND y1 AND lon BETWEEN x0 AND x1 AND lat + 1.1e-3 BETWEEN y0 AND y1 AND lon + 1.6e-3 BETWEEN x0 AND x1)""",
    "recommendation_request_rejects": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 17 <> 0 THEN 'u' || c_custkey END AS user_id, CAST(c_custkey % 250 - 4 AS INT) AS "limit" FROM customer
WHERE c_custkey % 17 = 0 OR c_custkey % 250 - 4 NOT BETWEEN 1 AND 200""",
    "polylines": _plain(BASE) + """SELECT user_id, CAST(CASE WHEN len(l) = 1 THEN 2 ELSE len(l) END AS INT) AS points, CASE WHEN len(l) = 1 THEN 0 ELSE round(l[1].lat, 6) END AS lat, CASE WHEN len(l) = 1 THEN 1 ELSE round(l[-1].lon, 6) END AS lon
FROM (SELECT user_id, coalesce(list({'lat': lat, 'lon': lon} ORDER BY indice_coord) FILTER (WHERE event_id % 3 <> 0), []) AS l FROM points GROUP BY user_id)""",
    "accidents_from_csv": _plain(BASE) + "SELECT segment_id, segment_seq, row_number() OVER (ORDER BY row_no) - 1 AS row_no, duracion_hrs, velocidad_kmh, via, hora_num, tipo_evento, oneway FROM ev WHERE src_rank = 0",
    "roads_from_csv": _plain(BASE) + "SELECT segment_id, segment_seq, row_number() OVER (ORDER BY row_no) - 1 AS row_no, false AS oneway, via FROM ev WHERE src_rank = 2",
    "ratings_csv": _plain(RATED) + "SELECT user_id, via, round(rating, 6) AS rating, row_number() OVER (ORDER BY user_id, via) - 1 AS row_no, 'Solo Concepción' AS profile FROM r",
    "road_rows_csv": "SELECT segment_id, row_idx, velocidad_kmh, via, row_number() OVER (ORDER BY segment_id, row_idx) - 1 AS row_no FROM (" + _plain(BASE).rstrip() + ROAD_ROWS + ")",
    "derived_table": _plain(BASE) + "SELECT segment_id, segment_seq, tipo_evento, segment_seq AS row FROM ev WHERE src_rank < 2",
}
