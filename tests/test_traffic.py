"""Golden values, quirks and properties of the traffic operators."""

import collections
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.operators import cf, events, graph, hotspots, paths, ratings, routes, spatial
from roadlens.sources import driver_tables, shared, tables

R8 = [("alice", "Ruta Azul", 5.0), ("alice", "Ruta Roja", 2.0), ("bob", "Ruta Azul", 4.0), ("bob", "Ruta Verde", 5.0), ("carla", "Ruta Roja", 4.0), ("carla", "Ruta Verde", 1.0), ("david", "Ruta Roja", 5.0), ("david", "Ruta Verde", 4.0)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_title(spark):
    assert one(spark, S.title(F.lit("o'higgins ruta-160a SAN pedro 5ta ñuble"))) == "O'Higgins Ruta-160A San Pedro 5Ta Ñuble"
    assert one(spark, S.safe_title(F.lit(" NaN "))) == "Sin dato"


@pytest.mark.parametrize(("score", "factor"), [(1.0, 0.1), (0.9, 0.113), (0.8, 0.153), (0.71, 0.212), (0.7, 0.5), (0.55, 0.999), (0.4, 1.499), (0.399, 1.675), (0.3, 3.249), (0.2, 3.973), (0.1, 4.529), (0.0, 4.997)])
def test_via_factor(spark, score, factor):
    assert abs(one(spark, S.via_factor(F.lit(score))) - factor) <= 1.1e-3  # halves may round either way


@pytest.mark.parametrize(("speed", "weight"), [(1.0, 0.2), (5.0, 0.2), (8.0, 0.125), (10.0, 0.1), (60.0, 0.1), (None, 0.5), (0.0, 0.5)])
def test_hotspot_weight(spark, speed, weight):
    assert one(spark, S.hotspot_weight(F.lit(speed).cast("double"))) == pytest.approx(weight)


def test_hours_and_days(spark):
    assert one(spark, S.clock_hour(F.lit("08:05:00"))) == 0
    assert one(spark, S.hour_bucket(F.lit(24.0))) == S.NO_BUCKET
    assert one(spark, S.normal_day(F.lit(" miercoles "))) == "Wednesday"
    assert one(spark, S.normal_day(F.lit(""))) == "Monday"
    assert one(spark, S.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))) is None


def points(spark, rows, label):
    columns = "segment_id string, indice_coord string, lat string, lon string, hora_inicio string, oneway string, row_no long"
    df = spark.createDataFrame(rows, columns)
    extra = {"duracion_hrs": "0.25", "distancia_km": "0.8", "velocidad_kmh": "20", "fecha": "2025-01-01", "hora_fin": "08:05", "comuna": "Concepción", "via": "Barros Arana"}
    return events.prepare(df.withColumns({k: F.lit(v) for k, v in extra.items()}), label)


E5 = [("segA", i, "-36.82", "-73.05", "08:00", o, n) for n, (i, o) in enumerate([("2", "true"), ("0", "true"), ("x", "true")])] + [("segB", i, "-36.82", "-73.05", "", "false", 3 + n) for n, i in enumerate(["5", "1"])]


def test_prepare_and_penalties(spark):
    t = points(spark, E5, "accidente")
    got = sorted((r.segment_id, r.segment_seq, r.row_no, r.penalty_factor, r.hora_num) for r in t.collect())
    assert got == [("segA", 0, 1, 1.75, 8), ("segA", 1, 2, 1.75, 8), ("segA", 2, 0, 1.75, 8), ("segB", 0, 4, 1.75, 0), ("segB", 1, 3, 1.75, 0)]
    roads = spatial.apply_penalties(points(spark, E5, "referencia"), t, ["segment_id", "segment_seq"])
    assert [r.penalty_factor for r in roads.collect()] == [1.75] * 5


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(1)
    left = [(i, 60 + rng.random() * 0.01, 10 + rng.random() * 0.02) for i in range(150)]
    right = [(i, 60 + rng.random() * 0.01, 10 + rng.random() * 0.02) for i in range(150)]
    a, b = (spark.createDataFrame(x, "id long, lat double, lon double") for x in (left, right))
    got = {(r.id, r.r_id) for r in spatial.radius_pairs(a, b).collect()}
    brute = a.alias("a").crossJoin(b.alias("b")).filter(S.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 0.06)
    assert got == {(r[0], r[1]) for r in brute.select("a.id", "b.id").collect()} and got


def test_tokens_drop_nan(spark):
    row = spark.createDataFrame([("s", "Accidente", "Hernán", "San Fernando", None)], "segment_id string, tipo_evento string, comuna string, via_categoria string, dia_semana string")
    row = row.withColumns({c: F.lit("x") for c in ("franja_horaria", "duracion_categoria", "velocidad_categoria")})
    tokens = events.with_tokens(row).first().tokens
    assert "comuna=Hernán" in tokens and "dia=Día laboral" in tokens and not any("via=" in t for t in tokens)


def test_hotspot_without_hours(spark):
    t = points(spark, [("s", "0", "-36.82", "-73.05", "", "false", 0)], "congestion").withColumn("hora_fin", F.lit(None).cast("string"))
    r = hotspots.hotspots(t).first()
    assert (r.start_hour, r.end_hour) == (None, None)


def test_collaborative_filtering(spark):
    m = cf.user_item(spark.createDataFrame(R8, "user_id string, via string, rating double"))
    u = {(r.user_id, r.via): r.score for r in cf.user_scores(m).collect()}
    i = {(r.user_id, r.via): r.score for r in cf.item_scores(m).collect()}
    want = {("alice", "Ruta Verde"): (3.592879, 1.756959), ("bob", "Ruta Roja"): (3.465304, 1.845751), ("carla", "Ruta Azul"): (4.655463, 0.706602), ("david", "Ruta Azul"): (4.372850, 1.545951)}
    assert u == pytest.approx({k: v[0] for k, v in want.items()}, abs=1e-6)
    assert i == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-6)


def test_fallbacks_and_strategies(spark):
    r = spark.createDataFrame(R8, "user_id string, via string, rating double")
    q = spark.createDataFrame([("nobody", ["Ruta Azul"], 5, ["ubcf", "x", "ubcf"]), ("carla", [], 2, []), ("bob", ["Ruta Roja"], 2, ["ibcf"])], "user_id string, known_vias array<string>, limit int, strategies array<string>")
    got = sorted((x.user_id, x.asked, x.strategy, x.rank, x.via) for x in cf.playground(r, q).collect())
    assert got == [("bob", "ibcf", "popular", 1, "Ruta Azul"), ("bob", "ibcf", "popular", 2, "Ruta Verde"), ("carla", "ibcf", "ibcf", 1, "Ruta Azul"), ("carla", "ubcf", "ubcf", 1, "Ruta Azul"), ("nobody", "ubcf", "popular", 1, "Ruta Roja"), ("nobody", "ubcf", "popular", 2, "Ruta Verde")]


def test_vias_are_ranked_in_ranges(spark):
    rows = [("u", f"v{n}", float(n * 37 % 50)) for n in range(300)]
    r = spark.createDataFrame(rows, "user_id string, via string, rating double")
    q = spark.createDataFrame([("nobody", [], 200)], "user_id string, known array<string>, limit int")
    t = cf.popular(r, q)
    assert [x.via for x in sorted(t.collect(), key=lambda x: x["rank"])] == [v for _, v, _ in sorted(rows, key=lambda x: (-x[2], x[1]))][:200]
    assert "SinglePartition" not in t._jdf.queryExecution().toString()


def test_ratings_source(spark, tmp_path):
    (tmp_path / "user_ratings.csv").write_text("user_id,via,rating\n1,ruta azul,4\n2,nan,3\n3,x,bad\n")
    assert [tuple(r) for r in tables.profile_ratings(spark, str(tmp_path), "regional").collect()] == [("1", "Ruta Azul", 4.0, "Cobertura regional")]
    with pytest.raises(ValueError):
        tables.profile_ratings(spark, str(tmp_path), "nowhere")
    assert tables.scan_roads(spark, str(tmp_path / "absent.csv")).count() == 0


def test_noise_ignores_partitions(spark):
    d = spark.createDataFrame([(f"v{i}", float(i), i % 3, 1) for i in range(40)], "via string, danger_score double, accident_count long, congestion_count long")
    roads = spark.createDataFrame([(f"v{i}", 20.0 + i, 1.0, 1.0, -36.8, -73.0) for i in range(40)], "via string, velocidad_kmh double, distancia_km double, duracion_hrs double, lat double, lon double")
    of = lambda r: sorted(tuple(x) for x in ratings.sampled_profiles(ratings.incident_profiles(d, r)).collect())
    assert of(roads) == of(roads.repartition(5)) and of(roads)


def test_segment_edges_one_way(spark):
    rows = [("segA", "0", "-36.82", "-73.05", "", "true", 0), ("segA", "1", "-36.821", "-73.049", "", "true", 1)]
    e = points(spark, rows, "referencia")
    got = graph.segment_edges(e, graph.nodes(e)).collect()
    assert [(r.src, r.dst) for r in got] == [("segA::0", "segA::1")]
    assert got[0].base_km == pytest.approx(0.142434905, abs=1e-9)


def dijkstra(edges, src, dst):
    queue, best = [(0.0, src, None)], {}
    while queue:
        d, n, p = heapq.heappop(queue)
        if n not in best:
            best[n] = d
            for m, w in edges.get(n, []):
                heapq.heappush(queue, (d + w, m, n))
    return best.get(dst)


NODE = "node_id string, lat double, lon double, penalty_factor double, velocidad_kmh double, via string, tipo_evento string, dia_semana string, franja_horaria string"
SOLVE = "solve_id string, src string, dst string, day string, bucket string, avoid_congestion boolean, avoid_accidents boolean, penalties boolean, default_factor double"


@pytest.mark.parametrize("sizes", [{}, {"block_degrees": 0.01}, {"block_nodes": 3}])
def test_paths_equal_dijkstra(spark, sizes):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(25)]
    pairs = sorted({tuple(rng.sample(names, 2)) for _ in range(80)})
    weights = {p: rng.choice([1.0, 2.0, 0.5]) for p in pairs}
    adjacency = {}
    for (a, b), w in weights.items():
        adjacency.setdefault(a, []).append((b, w))
    node = spark.createDataFrame([(n, *((rng.random() * 0.1, rng.random() * 0.1) if i % 6 else (None, None)), 1.0, 40.0, "v", "Referencia", "", "") for i, n in enumerate(names)], NODE)
    edge = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, base_km double")
    ods = [(f"s{i}", *rng.sample(names, 2)) for i in range(8)] + [("same", "n3", "n3")]
    solves = spark.createDataFrame([(s, a, b, "Monday", "x", False, False, True, 1.0) for s, a, b in ods], SOLVE)
    factors = spark.createDataFrame([], "solve_id string, via string, factor double")
    found = {}
    for r in paths.shortest_paths(node, edge, solves, factors, **sizes).collect():
        found.setdefault(r.solve_id, []).append((r.position, r.node_id, r.peso))
    for s, a, b in ods:
        want = dijkstra(adjacency, a, b)
        if want is None:
            assert s not in found
            continue
        path = sorted(found[s])
        assert [p[0] for p in path] == list(range(len(path))) and path[0][1] == a and path[-1][1] == b
        assert path[-1][2] == pytest.approx(want)
        assert all(math.isclose(y[2] - x[2], weights[x[1], y[1]]) for x, y in zip(path, path[1:], strict=False))


def diamond(spark, sides, solve, factors=()):
    """The nodes between start and end on the least path of a diamond with two sides."""
    ends = [(n, 0.0, 0.0, 1.0, 40.0, "Ruta Gris", "Referencia", "", "") for n in ("start", "end")]
    node = spark.createDataFrame(ends + [(n, 0.0, 0.0, *rest) for n, *rest in sides], NODE)
    edge = spark.createDataFrame([x for n, *_ in sides for x in (("start", n, 1.0), (n, "end", 1.0))], "src string, dst string, base_km double")
    solves = spark.createDataFrame([("s", "start", "end", *solve)], SOLVE)
    t = paths.shortest_paths(node, edge, solves, spark.createDataFrame([("s", *f) for f in factors], "solve_id string, via string, factor double"))
    return [r.node_id for r in sorted(t.collect(), key=lambda r: r.position)][1:-1]


def test_preferred_via_wins(spark):
    sides = [("a", 1.0, 40.0, "Ruta Azul", "Referencia", "", ""), ("z", 1.0, 40.0, "Ruta Roja", "Referencia", "", "")]
    assert diamond(spark, sides, ("Monday", "x", False, False, True, 1.3), [("Ruta Roja", 0.5)]) == ["z"]
    assert diamond(spark, sides, ("Monday", "x", False, False, False, 1.3), [("Ruta Roja", 0.5)]) == ["z"]
    assert diamond(spark, sides, ("Monday", "x", False, False, True, 1.0)) == ["a"]  # a tie goes to the lesser name


def test_matching_congestion_is_avoided(spark):
    morning = S.HOUR_BUCKETS[1][2]
    sides = [("a", 1.0, 40.0, "Via Congestionada", "Congestión", "Monday", morning), ("z", 1.0, 20.0, "Via Libre", "Referencia", "", "")]
    assert diamond(spark, sides, ("Monday", morning, True, False, True, 1.0)) == ["z"]
    assert diamond(spark, sides, ("Sunday", "", True, False, True, 1.0)) == ["a"]
    assert diamond(spark, sides, ("Monday", morning, False, True, True, 1.0)) == ["a"]
    accident = [("a", 1.0, 40.0, "v", "Accidente", "Monday", morning), sides[1]]
    assert diamond(spark, accident, ("Monday", morning, False, True, True, 1.0)) == ["z"]


def test_edge_weights_equal_the_columns(spark):
    """The weight that settles a block is the one that finds predecessors, for all kinds of incidents and trips."""
    rows = [(k, p, d, b) for k in ("Accidente", "Congestión", "Referencia") for p in (1.0, 1.75) for d in ("Monday", "") for b in ("x", "")]
    trips = [(d, b, c, a) for d in ("monday", "Sunday", "") for b in ("x", "y", "") for c in (True, False) for a in (True, False)]
    e = spark.createDataFrame(rows, "kind string, penalty double, node_day string, node_bucket string").crossJoin(spark.createDataFrame(trips, "day string, bucket string, c boolean, a boolean"))
    own = [S.incident_factor(F.col("kind"), F.col("penalty"), F.col("node_day"), F.col("node_bucket"), F.col("node_day") if d else F.lit("-"), F.col("node_bucket") if b else F.lit("-"), F.lit(c), F.lit(a)) for c, a in paths.AVOID for d, b in paths.MATCH]
    want = S.incident_factor(F.col("kind"), F.col("penalty"), F.col("node_day"), F.col("node_bucket"), F.col("day"), F.col("bucket"), F.col("c"), F.col("a"))
    for r in e.select("*", F.array(*own).alias("incident"), want.alias("want")).collect():
        solve = {"day": r.day, "bucket": r.bucket, "avoid_congestion": r.c, "avoid_accidents": r.a, "prefs": {}, "default_factor": 1.0, "penalties": True}
        assert paths.weight(solve, ("v", 1.0, 1.0, r.node_day.lower(), r.node_bucket, r.incident)) == r.want


def test_single_node(spark):
    e = points(spark, [("segA", "0", "-36", "-73", "", "true", 0)], "referencia")
    n, edges = graph.build(e)
    trip = spark.createDataFrame([(1, (-36.0, -73.0), (-36.0, -73.0), [], [], "", 8.0, True, False)], "request_id long, origin struct<lat:double,lon:double>, destination struct<lat:double,lon:double>, ubcf_preferences array<struct<via:string,weight:double>>, ibcf_preferences array<struct<via:string,weight:double>>, day_of_week string, departure_hour double, avoid_congestion boolean, avoid_accidents boolean")
    planned, found = routes.solve(trip, n, edges)
    step = routes.steps(planned, found, n).filter("variant = 'baseline'").orderBy("position").collect()
    assert [(r.node_id, r.tipo_evento, r.dia_semana, r.franja_horaria) for r in step] == [("user_origin", "Usuario", "Monday", S.HOUR_BUCKETS[1][2]), ("segA::0", "Referencia", "Wednesday", S.HOUR_BUCKETS[0][2]), ("user_destination", "Usuario", "Monday", S.HOUR_BUCKETS[1][2])]


def test_nearest_node_of_far_points(spark):
    rng = random.Random(9)
    nodes = [(f"n{i}", -36 + rng.random() * 0.05, -73 + rng.random() * 0.05) for i in range(60)] + [("x", None, 1.0)]
    pts = [(i, lat, lon) for i, (lat, lon) in enumerate([(-36.0, -73.0), (-36.5, -73.0), (10.0, 100.0), (89.0, 0.0), (-36.02, -72.9)])]
    n, p = spark.createDataFrame(nodes, "node_id string, lat double, lon double"), spark.createDataFrame(pts, "point_id long, lat double, lon double")
    km = S.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("n.lat"), F.col("n.lon"))
    brute = p.alias("p").crossJoin(n.filter("lat is not null").alias("n")).groupBy("point_id").agg(F.min_by("node_id", F.struct(km, "node_id")).alias("node_id"))
    assert {tuple(r) for r in spatial.nearest_nodes(p, n).select("point_id", "node_id").collect()} == {tuple(r) for r in brute.collect()}
    assert spatial.nearest_nodes(p, n.limit(0)).filter("node_id is null").count() == 5


def test_every_street_has_a_route_request(spark, tmp_path):
    rows = [(n, 1 + n % 7 if n < 70 else 8, "view", 1.0) for n in range(71)] + [(100 + n, 10, "view", 1.0) for n in range(6)]  # street 8 has one point
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    point = {(r.user_id, r.indice_coord): (r.lat, r.lon) for r in driver_tables.points(spark, str(tmp_path)).collect()}
    got = {r.request_id: tuple(r.origin) for r in driver_tables.route_requests(spark, str(tmp_path)).collect()}
    assert got == {u: point[u, {8: 0, 10: 5}.get(u, 2)] for u in [*range(1, 9), 10]}


def test_scans_keep_the_order_of_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits, which Spark packs by size
    try:
        folder = tmp_path / "x.csv"
        folder.mkdir()
        for k, size in enumerate((2000, 10, 1200)):
            (folder / f"part-{k}.csv").write_text("a,b\n" + "".join(f"{k},{i}\n" for i in range(size)))
        got = [(int(r.a), int(r.b)) for r in sorted(tables.scan(spark, str(folder)).collect(), key=lambda r: r.row_no)]
        numbers = sorted(r.row_no for r in tables.scan(spark, str(folder)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k, i) for k, size in enumerate((2000, 10, 1200)) for i in range(size)] and numbers == list(range(3210))


def test_road_columns(spark, tmp_path):
    columns = ["segment_id", "indice_coord", "lat", "lon", "duracion_hrs", "distancia_km", "velocidad_kmh", "fecha", "hora_inicio", "hora_fin", "comuna", "via"]
    path = tmp_path / "roads.csv"
    path.write_text(",".join(columns) + "\n" + ",".join("1" for _ in columns) + "\n")
    assert [r.oneway for r in events.prepare(tables.scan_roads(spark, str(path)), "referencia").collect()] == [False]
    path.write_text(",".join(c for c in columns if c != "indice_coord") + "\n1\n")
    with pytest.raises(ValueError, match="indice_coord"):
        tables.scan_roads(spark, str(path))


def test_shared_folder_on_a_cluster():
    class Conf(dict):
        get = lambda self, k, d=None: dict.get(self, k, d)

    class Session:
        conf = Conf({"spark.master": "spark://h:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_polyline_cleanup(spark):
    kind = "array<struct<lat:double,lon:double>>"
    end = lambda x: F.struct(F.lit(x).alias("lat"), F.lit(x).alias("lon"))
    lines = [[], [(1.0, None)], [(1.0, 2.0), (None, 3.0)], [(1.0, 2.0), (3.0, 4.0), (None, None)]]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], f"i int, p {kind}")
    got = {r.i: [tuple(x) for x in r.x] for r in t.select("i", S.clean_polyline(F.col("p"), end(0.0), end(9.0)).alias("x")).collect()}
    assert got == {0: [], 1: [], 2: [(0.0, 0.0), (9.0, 9.0)], 3: [(1.0, 2.0), (3.0, 4.0)]}


def test_rejected_recommendation_requests(spark):
    t = spark.createDataFrame([("a", 1), ("b", 200), ("c", 0), ("d", 201), (None, 5), ("e", None)], "user_id string, limit int")
    good, bad = cf.valid_requests(t)
    assert {r.user_id for r in good.collect()} == {"a", "b"} and bad.count() == 4


def test_delay_and_distance(spark):
    step = spark.createDataFrame(
        [(1, "baseline", 0, "a", "s", 0, -36.0, -73.0, "Referencia", 0.0, "Wednesday", S.HOUR_BUCKETS[1][2]), (1, "baseline", 1, "b", "s", 1, -36.01, -73.01, "Congestión", 0.5, "Wednesday", S.HOUR_BUCKETS[1][2])],
        "request_id long, variant string, position int, node_id string, segment_id string, segment_seq int, lat double, lon double, tipo_evento string, duracion_hrs double, dia_semana string, franja_horaria string",
    )
    trip = lambda day: spark.createDataFrame([(1, day, 8.0)], "request_id long, day_of_week string, departure_hour double")
    assert routes.delays(step, trip("Wednesday")).first().extra_delay_min == 35.0
    assert routes.delays(step, trip("Monday")).count() == 0
    km = one(spark, S.haversine_km(F.lit(-36.0), F.lit(-73.0), F.lit(-36.01), F.lit(-73.01)))
    assert round(km, 2) == 1.43 and round(km / 35 * 60, 1) == 2.5


def brute_scores(rows, strategy):
    """Scores from whole matrices: ratings (user, item) and cosines of rows or columns."""
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    m = np.zeros((len(users), len(items)))
    for u, i, x in rows:
        m[users.index(u), items.index(i)] = x
    k = m if strategy == "ubcf" else m.T
    norm = np.sqrt((k * k).sum(1))
    sim = k @ k.T / np.outer(norm, norm)
    np.fill_diagonal(sim, 0)
    total, weight = (sim @ m, sim @ (m > 0)) if strategy == "ubcf" else (m @ sim, ((m > 0).astype(float) @ (sim > 0)))
    reach = (sim > 0).astype(float) @ (m > 0) if strategy == "ubcf" else (m > 0).astype(float) @ (sim > 0)
    return {(u, i): total[a, b] / weight[a, b] for a, u in enumerate(users) for b, i in enumerate(items) if not m[a, b] and reach[a, b]}


@pytest.fixture(scope="module")
def hot_ratings():
    """One item that everyone has rated, some that many have, and rare ones."""
    rng = random.Random(4)
    rows = [(f"u{u:03}", "hot", float(rng.randint(1, 5))) for u in range(120)]
    return rows + [(f"u{u:03}", f"i{i}", float(rng.randint(1, 5))) for u in range(120) for i in range(30) if rng.random() < (0.3 if i < 5 else 0.05)]


@pytest.mark.parametrize("strategy", ["ubcf", "ibcf"])
@pytest.mark.parametrize("held", [4_000_000, 60])
def test_scores_of_hot_items_equal_whole_matrices(spark, hot_ratings, strategy, held):
    """In one block, and in many small ones with the hot items joined by themselves."""
    m, users, vias = cf.numbered(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"))
    t = cf.scores(m, strategy, held=held).withColumnsRenamed({"user_id": "user_no", "via": "place"}).join(users, "user_no").join(vias, "place")
    got = {(r.user_id, r.via): r.score for r in t.collect()}
    assert got == pytest.approx(brute_scores(hot_ratings, strategy))


def test_limits_keep_the_best(spark, hot_ratings):
    m, users, vias = cf.numbered(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"))
    every = {(r.user_id, r.via): round(r.score, cf.DIGITS) for r in cf.scores(m, "ibcf").collect()}
    few = cf.scores(m, "ibcf", m.select(F.col("user_id").alias("user")).distinct().filter("user < 50").withColumn("limit", F.lit(3)), held=100).collect()
    for u in range(1, 50):
        best = sorted([(-s, i) for (v, i), s in every.items() if v == u])[:3]
        assert set(best) <= {(-round(r.score, cf.DIGITS), r.via) for r in few if r.user_id == u}
    assert all(r.user_id < 50 for r in few)


@pytest.mark.parametrize("of", ["user_id", "via"])
@pytest.mark.parametrize("held", [4_000_000, 200, 20])
def test_cosines_of_raters_of_a_hot_item(spark, hot_ratings, of, held):
    """One item that everyone has rated: each ordered pair once, whatever a task holds (20: rows longer than that are joined by themselves)."""
    over = "via" if of == "user_id" else "user_id"
    m, users, vias = cf.numbered(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"))
    names = {r[0]: r[1] for r in (users.select("user_no", "user_id") if of == "user_id" else vias.select("place", "via")).collect()}
    got = [(names[r.a], names[r.b], r.sim) for r in cf.cosines(m, of, over, held).collect()]
    rows = {}
    for u, i, x in hot_ratings:
        rows.setdefault(u if of == "user_id" else i, {})[i if of == "user_id" else u] = x
    norm = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in rows.items()}
    want = {(a, b): sum(x * rows[b][o] for o, x in rows[a].items() if o in rows[b]) / norm[a] / norm[b] for a in rows for b in rows if a != b and rows[a].keys() & rows[b].keys()}
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == pytest.approx(want)
    named = cf.similarity(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"), of, over)
    assert {(r.a, r.b): r.sim for r in named.collect()} == pytest.approx(want)


@pytest.mark.parametrize("numbers", [[], [5], [7] * 9, range(40), [3, 90, 70_000, 20_000_000], [9, 2, 300], [1 << 30, 1, 70_000]])
def test_packed_numbers_come_back(numbers):
    x = np.array(list(numbers), np.int32)
    assert cf._ints_of(cf._ints(x)).tolist() == x.tolist()
    for y in (x / 7, x % 3 * 0.1):
        assert cf._floats_of(cf._floats(y)).tolist() == y.tolist()


@pytest.mark.parametrize("weigh", [None, "left", "count"])
def test_users_at_once_get_what_each_gets_alone(weigh):
    rng = np.random.default_rng(3)
    held = cf.Held(rng.integers(1, 30, 200).astype(np.int32), rng.integers(40, 60, 200).astype(np.int32), rng.integers(-1, 6, 200).astype(float), scale=(np.arange(1, 40), rng.random(39)))
    users = [(u, u % 4 + 1 if u % 3 else None, [np.unique(rng.integers(1, 40, 6))], [], [np.array([41, u, 99])]) for u in range(38, 38 + held.most)]
    users = [(u, limit, mids, [rng.random(len(mids[0]))], out) for u, limit, mids, _, out in users]
    together = held.results(users, weigh, True)
    for user, (items, score) in zip(users, together, strict=True):
        alone = held.results([user], weigh, True)[0]
        assert items.tolist() == alone[0].tolist() and score.tolist() == pytest.approx(alone[1].tolist())
        assert all(i > user[0] and i not in (41, 99) for i in items)
    assert held.most == 64 and sum(len(items) for items, _ in together) > 64


def test_neighbours_are_packed_tightly(spark, hot_ratings):
    """A neighbour takes about a byte for its number and one for its product, with what a row needs besides (12 bytes before)."""
    m, users, vias = cf.numbered(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"))
    rows = cf.neighbours(*cf._rows(m, "user_id", "via")).collect()
    n = sum(len(cf._ints_of(r.mids)) for r in rows)
    assert n == 120 * 119 and sum(len(r.mids) + len(r.values) for r in rows) < 6 * n


def test_only_the_ends_of_long_lists_are_kept(spark, hot_ratings):
    """Those of a request that scored vias answer in full; others keep all for the vias without a score."""
    r = spark.createDataFrame(hot_ratings, "user_id string, via string, rating double")
    for limit in (12, 200):
        q = spark.createDataFrame([(f"u{u:03}", ["i3"], limit) for u in range(0, 120, 9)], "user_id string, known_vias array<string>, limit int")
        whole, some = cf.recommend(r, q, "ubcf"), cf.recommend(r, q, "ubcf", ends=2)
        assert sorted(cf.extremes(some, 2).collect()) == sorted(cf.extremes(whole, 2).collect())
        assert some.count() < whole.count() if limit == 12 else some.count() == whole.count()


def test_entries_are_sent_only_to_blocks_that_need_them(spark):
    """A rare item's entries go to as many blocks as it has raters at most, a hot one's to all."""
    m = spark.createDataFrame([(u, 0, 1.0) for u in range(1, 501)] + [(u, 1, 1.0) for u in (1, 2)], "user long, mid long, value double")
    right = m.withColumnRenamed("user", "item")
    rows = collections.Counter(r.mid for r in cf.sent(m, right, 16).collect())
    assert rows[0] == 500 * 16 and 2 <= rows[1] <= 4
    assert collections.Counter(r.block for r in cf.sent(m, right, 1).collect()) == {0: 502}


def test_names_cost_no_shuffle_of_results(spark, hot_ratings):
    """Names are put in as results are made: nothing is joined or shuffled after the product."""
    t = spark.createDataFrame(hot_ratings, "user_id string, via string, rating double")
    for df in (cf.similarity(t, "via", "user_id"), cf.item_scores(t)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("MapInArrow")] and "Repartition" not in plan[: plan.index("MapInArrow")]


def test_ranges_that_share_nothing_meet_no_common_block():
    """Entries of 50 separate groups of items: each range of users gets the blocks of its own items, not all."""
    cut = cf.Cut({r: 10 for r in range(cf.RANGES)}, 50_000, 50_000, cf.RANGES * 10 / 50)
    asked = {(r, b) for r in range(50) for b in cut.block(np.arange(r * 1000 + 1, r * 1000 + 1000)).tolist()}
    g, slots = cf._slots(asked, 50, cut.n_blocks)
    assert 50 <= cut.n_blocks <= 52 and g == 1 and len(slots) <= 150
    g, slots = cf._slots({(r, b) for r in range(50) for b in range(50)}, 50, 50)  # all meet all: a block's entries go to two parts
    assert len(slots) <= 100


def test_a_search_settles_few_nodes_at_first():
    """A line of 3,000 nodes whose target lies elsewhere: 500 are settled, the next one waits, and going on from it gives the same costs."""
    n = 3000
    row = paths.NO_EDGES | {"names": [str(i) for i in range(n)], "first": np.append(np.arange(n), n - 1).astype(np.int64).tobytes(), "to": np.arange(1, n).tobytes(), "numbers": np.zeros((4, n - 1), np.int32).tobytes(), "prices": np.ones((n - 1, 2)).tobytes(), "incidents": np.ones((1, 12)).tobytes()}
    block, weights, elsewhere = paths.Block(row), [1.0] * (n - 1), {"x": float("inf")}
    best, waits = block.settle(weights, elsewhere, {}, {0: 0.0}, 500)
    assert len(best) == 500 and waits == {(500, None): 500.0}
    rest, waits = block.settle(weights, elsewhere, best, {500: 500.0}, None)
    assert not waits and best | rest == block.settle(weights, elsewhere, {}, {0: 0.0})[0]


def test_popular_vias_meet_requests_where_these_are(spark):
    """Places are the same few for all requests: rows are shuffled by user only, never by place."""
    r = spark.createDataFrame([("u", f"v{n}", float(n)) for n in range(30)], "user_id string, via string, rating double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = cf.popular(r, spark.range(100).selectExpr("cast(id as string) user_id", "array('v29') known", "2 limit"))
        assert "SortMergeJoin" not in t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(x["rank"], x.via) for x in t.collect()} == {(1, "v28"), (2, "v27")} and t.count() == 200


def test_edges_are_shuffled_few_times(spark):
    """Pairs are made distinct once, by their ends, and heads are joined where measured edges lie (16 shuffles before)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, e = graph.build(points(spark, [("s", str(i), "-36.8", f"-73.{i}", "", "false", i) for i in range(4)], "referencia"))
        t = paths.edge_costs(n, e)
        assert t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 13
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert t.count() == 6  # three pairs, both ways


def test_pairs_come_in_runs(spark, hot_ratings):
    """A user's pairs follow each other, then the same turned around, so that one column of written rows hardly changes."""
    t = cf.similarity(spark.createDataFrame(hot_ratings, "user_id string, via string, rating double"), "user_id", "via").collect()
    assert sum(x.a == y.a or x.b == y.b for x, y in zip(t[:-1], t[1:], strict=True)) > 0.8 * len(t)


def test_cosines_of_zero_ratings(spark):
    """Pairs that share an item have a row, also where a row of zeros or nulls makes it 0; an empty table has none."""
    rows = [("a", "x", 0.0), ("b", "x", 2.0), ("c", "x", None), ("c", "y", 1.0), ("d", "z", 1.0)]
    got = {(r.a, r.b): r.sim for r in cf.similarity(spark.createDataFrame(rows, "user_id string, via string, rating double"), "user_id", "via").collect()}
    assert got == {(a, b): 0.0 for a in "abc" for b in "abc" if a != b}
    assert cf.similarity(spark.createDataFrame([], "user_id string, via string, rating double"), "via", "user_id").count() == 0


def test_solves_with_one_source_and_price_are_one_search(spark):
    """What can't change a price is left out: the day of a trip that avoids nothing, and preferences that are the default."""
    none = ("Monday", "x", False, False, True, 1.0)
    rows = [("a", "s", "t1", *none), ("b", "s", "t2", *none), ("c", "s", "t1", "Sunday", "y", False, False, True, 1.0), ("d", "s", "t1", *none)]
    rows += [("e", "s", "t1", "Monday", "x", True, False, True, 1.0), ("f", "s", "t1", "Sunday", "x", True, False, True, 1.0), ("g", "s", "t1", "Sunday", "x", True, True, False, 1.0), ("h", "r", "t1", *none)]
    factors = spark.createDataFrame([("d", "v", 1.0), ("c", "w", 0.5), ("b", "w", 1.0)], "solve_id string, via string, factor double")
    searches, solves = paths.searches_of(spark.createDataFrame(rows, SOLVE), factors)
    of = {r.solve_id: r.search_id for r in solves.collect()}
    assert of["a"] == of["b"] == of["d"] and len({of[x] for x in "acefgh"}) == 6 and searches.count() == 6
    assert {r.search_id: sorted(r.targets) for r in searches.collect()}[of["a"]] == ["t1", "t2"]


def test_many_targets_are_split(spark, monkeypatch):
    monkeypatch.setattr(paths, "TARGETS", 5)
    rows = [(f"x{i}", "s", f"t{i}", "", "", False, False, True, 1.0) for i in range(40)]
    searches, _ = paths.searches_of(spark.createDataFrame(rows, SOLVE), spark.createDataFrame([], "solve_id string, via string, factor double"))
    assert 5 <= searches.count() <= 12 and searches.selectExpr("sum(size(targets))").first()[0] == 40


def chain(spark, n):
    """A street of n nodes over as many blocks."""
    node = spark.createDataFrame([(f"n{i:03}", 0.05 * i, 0.0, 1.0, 40.0, "v", "Referencia", "", "") for i in range(n)], NODE)
    edge = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(n - 1)], "src string, dst string, base_km double")
    return node, edge, spark.createDataFrame([], "solve_id string, via string, factor double")


def test_a_trip_across_many_blocks(spark):
    """Twelve blocks take a round each, also after the rounds' tables became one; too few rounds are an error, not a longer way."""
    node, edge, factors = chain(spark, 24)
    solves = spark.createDataFrame([("s", "n000", "n023", "", "", False, False, True, 1.0), ("back", "n023", "n000", "", "", False, False, True, 1.0)], SOLVE)
    rounds = []
    found = paths.shortest_paths(node, edge, solves, factors, block_nodes=2, told=lambda k, n: rounds.append((k, n))).collect()
    assert [r.node_id for r in sorted(found, key=lambda r: r.position)] == [f"n{i:03}" for i in range(24)] and {r.solve_id for r in found} == {"s"}
    assert 10 <= len(rounds) <= 24 and all(n > 0 for _, n in rounds)
    with pytest.raises(RuntimeError):
        paths.shortest_paths(node, edge, solves, factors, most_rounds=3, block_nodes=2)


def test_searches_that_nothing_leaves_write_their_ways_only(spark):
    """A search that ends in its first round writes the way to its target, and none if there is none: not the six nodes that it has seen (9 rows before)."""
    node, edge, factors = chain(spark, 12)
    solves = spark.createDataFrame([("s", "n004", "n006", "", "", False, False, True, 1.0), ("none", "n006", "n000", "", "", False, False, True, 1.0)], SOLVE)
    rounds = []
    found = paths.shortest_paths(node, edge, solves, factors, told=lambda k, n: rounds.append((k, n))).collect()
    assert sorted((r.solve_id, r.position, r.node_id) for r in found) == [("s", i, f"n{4 + i:03}") for i in range(3)] and rounds == [(1, 3)]


def test_targets_in_several_lists_are_explored_once(spark, monkeypatch):
    """Lists of one source and price share their search: each of six nodes is settled once and sent on once at most."""
    monkeypatch.setattr(paths, "TARGETS", 1)
    node, edge, factors = chain(spark, 6)
    solves = spark.createDataFrame([(f"s{i}", "n000", f"n{i:03}", "", "", False, False, True, 1.0) for i in range(1, 6)], SOLVE)
    rounds = []
    found = paths.shortest_paths(node, edge, solves, factors, block_nodes=2, told=lambda k, n: rounds.append(n)).collect()
    assert sorted((r.solve_id, r.position, r.node_id) for r in found) == [(f"s{i}", k, f"n{k:03}") for i in range(1, 6) for k in range(i + 1)] and sum(rounds) <= 11


def test_blocks_are_packed_as_their_edges_pass():
    """Blocks of sorted edges are packed from a stream, wherever its batches end, and hold what a block by itself gives; nodes aren't sorted for it."""
    row = lambda b, s, d, db: {"src": s, "dst": d, "via": "v", "base_km": 1.0, "static_factor": 1.0, "block": b, "dst_block": db, "day": "", "bucket": "", "incident": [1.0] * 11 + [float(s)]}
    t = paths.pa.Table.from_pylist([row("a", "2", "1", "a"), row("a", "1", "2", "a"), row("b", "3", "1", "a"), row("b", "3", "4", "b"), row("b", "4", "3", "b"), row("c", "5", "5", "c")])
    want = [paths._pack([paths.pa.scalar(b)], t.slice(i, n)).to_pylist()[0] for b, i, n in (("a", 0, 2), ("b", 2, 3), ("c", 5, 1))]
    for n in (1, 2, 4, 9):
        assert [r for b in paths._pack_sorted(iter(t.to_batches(n))) for r in b.to_pylist()] == want
    assert [r["names"] for r in want] == [["2", "1"], ["3", "4"], ["5"]] and [r["out_names"] for r in want] == [[], ["1"], []]
    price = {"prefs": {}, "default_factor": 1.0, "penalties": True, "day": "", "bucket": "", "avoid_congestion": True, "avoid_accidents": True}
    assert paths.Block(want[1]).incident[:, -1].tolist() == [3.0, 4.0] and paths.Block(want[1]).weights(price) == [1.0] * 3


def trip(spark, origin, destination):
    schema = "request_id long, origin struct<lat:double,lon:double>, destination struct<lat:double,lon:double>, ubcf_preferences array<struct<via:string,weight:double>>, ibcf_preferences array<struct<via:string,weight:double>>, day_of_week string, departure_hour double, avoid_congestion boolean, avoid_accidents boolean"
    return spark.createDataFrame([(1, origin, destination, [], [], "lunes", 8.0, False, False)], schema)


def test_steps_without_a_place_and_the_cheapest_neighbour(spark):
    """The only node with a place is the source, so the target is its cheapest neighbour; steps without a place stand where the step before stands."""
    rows = [("a", -36.0, -73.0), ("b", None, None), ("c", None, None)]
    attributes = {"segment_id": "seg", "segment_seq": 0, "tipo_evento": "Referencia", "velocidad_kmh": 40.0, "duracion_hrs": 0.0, "via": "v", "comuna": "x", "penalty_factor": 1.0, "dia_semana": "", "franja_horaria": ""}
    node = spark.createDataFrame(rows, "node_id string, lat double, lon double").withColumns({k: F.lit(v) for k, v in attributes.items()})
    edge = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("c", "b", 0.5)], "src string, dst string, base_km double")
    t = trip(spark, (-36.0, -73.0), (-36.5, -73.0))
    assert routes.endpoints(t, node, edge).select("src", "dst").first() == ("a", "c")
    planned, found = routes.solve(t, node, edge)
    step = routes.steps(planned, found, node).filter("variant = 'baseline'").orderBy("position").collect()
    assert [(r.node_id, r.lat, r.lon) for r in step] == [("user_origin", -36.0, -73.0), ("a", -36.0, -73.0), ("c", -36.0, -73.0), ("user_destination", -36.5, -73.0)]
    # without any neighbour the target is the source
    alone = routes.endpoints(t, node.filter("node_id = 'a'"), edge.limit(0)).first()
    assert (alone.src, alone.dst) == ("a", "a")


@pytest.mark.parametrize("seed", [0, 1])
def test_order_statistics_by_counting(spark, monkeypatch, seed):
    from roadlens.operators import selection

    monkeypatch.setattr(selection, "BUCKETS", 8)  # several passes
    rng = random.Random(seed)
    values = [None, float("nan"), 1e308, -1e308, 0.0] + [rng.choice([rng.gauss(0, 1), 2.5, rng.gauss(0, 1e9)]) for _ in range(400)]
    df = spark.createDataFrame([(v, "x" if i % 3 else "y") for i, v in enumerate(values)], "v double, g string")
    own = sorted(v for v in values if v is not None and v == v)
    assert selection.at_ranks(df, "v", {None: [0, 7, 200, len(own) - 1, len(own)]}) == {(None, k): own[k] for k in (0, 7, 200, len(own) - 1)}
    by = {g: sorted(v for i, v in enumerate(values) if ("x" if i % 3 else "y") == g and v is not None and v == v) for g in "xy"}
    assert selection.at_ranks(df, "v", {"x": [3], "y": [5, 6]}, "g") == {("x", 3): by["x"][3], ("y", 5): by["y"][5], ("y", 6): by["y"][6]}
    some = df.filter("abs(v) < 10")
    got = selection.quantiles(some, {"v": [0.0, 0.33, 0.5, 1.0]})
    for q, x in got.items():
        assert x == pytest.approx(some.agg(F.percentile("v", F.lit(q[1]))).first()[0])
    assert selection.quantiles(df.limit(0), {"v": [0.5]}) == {("v", 0.5): None}


def test_segments_in_buckets_join_without_a_shuffle(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 40).alias("segment_id"), (500 - F.col("id")).alias("segment_seq"), (F.col("id") % 2).alias("kind")).repartition(6)
    a = tables.write_segments(df, str(tmp_path / "a"), "segments_a", ["kind"])
    b = tables.write_segments(df.filter("kind = 0"), str(tmp_path / "b"), "segments_b")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = a.join(b.groupBy("segment_id").count(), "segment_id")
        assert joined.count() == 250 and "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("segments_a", "segments_b"):
            spark.sql(f"drop table {name}")
    files = spark.read.parquet(str(tmp_path / "a")).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    assert len({r.file for r in files}) > 4
    for key in {(r.file, r.segment_id) for r in files}:
        seqs = [r.segment_seq for r in sorted(files, key=lambda r: r.at) if (r.file, r.segment_id) == key]
        assert seqs == sorted(seqs)


def test_heat_totals_are_those_of_the_points(spark):
    spots = spark.createDataFrame([("s", i, 0.0, 0.0, 0.1 * i, "Monday" if i % 2 else None, i % 2 == 0, "" if i % 3 else S.HOUR_BUCKETS[1][2], 6.0 if i % 5 else None, 9.0) for i in range(30)], "segment_id string, segment_seq int, lat double, lon double, weight double, day string, day_missing boolean, bucket string, start_hour double, end_hour double")
    trips = spark.createDataFrame([(1, "Monday", 8.0), (2, "Monday", 8.0), (3, "Sunday", 8.0), (4, None, 3.0), (5, "Monday", None)], "request_id long, day string, hour double")
    want = {(r.request_id, r.n, round(r.w, 6)) for r in hotspots.heat(spots, trips).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    assert {(r.request_id, r.points, round(r.weight, 6)) for r in hotspots.heat_totals(spots, trips).collect()} == want and len(want) == 5
    assert hotspots.heat_totals(spots.limit(0), trips).count() == 0


def test_nearest_node_of_very_many_far_points(spark):
    """10,000 points all over the globe and a dense town: bounds lead each to its node, also across the date line, at the poles and past an excluded node."""
    rng = np.random.default_rng(5)
    town = np.column_stack([-36.8 + rng.random(400) * 0.02, -73 + rng.random(400) * 0.02])
    lonely = [(10.0, 179.9999), (-89.9, 20.0), (60.0, -100.0), (60.0, -100.0), (0.0, 0.0)]
    places = np.vstack([town, lonely])
    nodes = spark.createDataFrame([(f"n{i:04}", float(a), float(b)) for i, (a, b) in enumerate(places)] + [("none", None, 1.0)], "node_id string, lat double, lon double")
    asked = np.column_stack([rng.random(10_000) * 180 - 90, rng.random(10_000) * 360 - 180])
    asked[:3000] = town[rng.integers(0, 400, 3000)] + rng.normal(0, 0.3, (3000, 2))
    asked[3000:3010] = [(10.0, -179.9999), (90.0, 0.0), (-90.0, 0.0), (60.0, -100.0), (0.0, 180.0), (10.0, 180.0), (10.0, -180.0), (-36.8, -73.0), (0.0, 0.0), (45.0, 45.0)]
    excluded = [None if i % 3 else f"n{rng.integers(400, 405):04}" for i in range(len(asked))]
    points_ = spark.createDataFrame([(i, float(a), float(b), x) for i, ((a, b), x) in enumerate(zip(asked, excluded, strict=True))] + [(99_999, None, 1.0, None)], "point_id long, lat double, lon double, skip string")
    got = {r.point_id: (r.node_id, r.km) for r in spatial.nearest_nodes(points_, nodes, exclude="skip").collect()}
    p, q = np.radians(asked), np.radians(places)
    h = np.sin((q[None, :, 0] - p[:, None, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[None, :, 0]) * np.sin((q[None, :, 1] - p[:, None, 1]) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h)))
    for i, x in enumerate(excluded):
        if x:
            km[i, int(x[1:])] = np.inf
    assert got.pop(99_999) == (None, None) and len(got) == 10_000
    assert all(got[i][1] == pytest.approx(km[i].min(), abs=1e-6) and km[i, int(got[i][0][1:])] == pytest.approx(km[i].min(), abs=1e-6) for i in got)
    assert got[3003][0] == ("n0402" if excluded[3003] != "n0402" else "n0403")  # ties go to the lesser name


@pytest.mark.parametrize("penalties", [[1.75], [1.35, 1.75], [1.0 + k / 50 for k in range(50)]])
def test_worst_penalty_equals_brute_force(spark, penalties):
    """Points over a few crowded cells and sparse ones, near the equator and far from it."""
    rng = np.random.default_rng(8)
    place = lambda n: np.vstack([np.column_stack([c + rng.random(n) * w, -73 + rng.random(n) * w]) for c, w in ((-36.8, 0.001), (-36.7, 0.02), (0.0, 0.002), (68.0, 0.004))])
    roads, spots = place(150), place(100)
    worth = rng.choice(penalties, len(spots))
    left = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(roads)] + [(9999, None, 1.0)], "key long, lat double, lon double")
    right = spark.createDataFrame([(float(a), float(b), float(w)) for (a, b), w in zip(spots, worth, strict=True)] + [(None, 1.0, 9.0)], "lat double, lon double, penalty_factor double")
    got = {r.key: r.near_penalty for r in spatial.worst_within(left, right, ["key"]).collect()}
    p, q = np.radians(roads), np.radians(spots)
    h = np.sin((q[None, :, 0] - p[:, None, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[None, :, 0]) * np.sin((q[None, :, 1] - p[:, None, 1]) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(h)) * 1000 <= 60
    assert got == {i: worth[near[i]].max() for i in range(len(roads)) if near[i].any()}


def test_worst_penalty_in_a_crowded_cell(spark):
    """100,000 points and 100,000 spots in one cell: ten thousand million pairs, of which next to none are compared."""
    spread = lambda seed, n: spark.range(n).select(F.col("id").alias("key"), (F.lit(-36.8) + F.rand(seed) * 0.0004).alias("lat"), (F.lit(-73.0) + F.rand(seed + 1) * 0.0004).alias("lon"))
    spots = spread(5, 100_000).withColumn("penalty_factor", F.when(F.col("key") % 2 == 0, 1.75).otherwise(1.35))
    got = spatial.worst_within(spread(1, 100_000), spots, ["key"]).groupBy("near_penalty").count().collect()
    assert [tuple(r) for r in got] == [(1.75, 100_000)]
