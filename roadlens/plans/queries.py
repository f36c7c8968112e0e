"""The registered queries, on the domain tables that driver_tables derives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.operators import cf, events, graph, hotspots, paths, ratings, roads, routes, spatial
from roadlens.sources import driver_tables as D
from roadlens.sources import shared, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: All tokens that the domain tables can have.
ONE_HOT = [
    *[f"evento={x}" for x in ("Accidente", "Congestión")],
    *[f"comuna=Comuna {n}" for n in range(25)],
    *[f"franja={x[2]}" for x in S.HOUR_BUCKETS],
    *[f"duracion={x}" for x in (*[x[1] for x in S.DURATION_BUCKETS], S.LONGEST, S.NO_DURATION)],
    *[f"velocidad={x}" for x in (*[x[1] for x in S.SPEED_BUCKETS], S.FASTEST, S.NO_SPEED)],
    *[f"dia={x}" for x in ("Fin de semana", "Día laboral")],
    *[f"via=Via {n}" for n in range(40)],
    f"via={events.OTHER_VIAS}",
]
PREPARED = [
    *["segment_id", "indice_coord", "lat", "lon", "duracion_hrs", "distancia_km", "velocidad_kmh", "hora_inicio", "hora_fin", "comuna", "via", "oneway"],
    *["tipo_evento", "penalty_factor", "hora_num", "src_rank", "row_no", "franja_horaria", "dia_semana", "duracion_categoria", "velocidad_categoria", "segment_seq"],
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def _rounded_fast(df: DataFrame, column: str, n: int = 6) -> DataFrame:
    """_rounded() of a column of not negative numbers by arithmetic, as the SQL's engine does it; round() makes a decimal of each."""
    return df.withColumn(column, F.floor(F.col(column) * 10.0**n + 0.5) / 10.0**n)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.raw_events(D.accidents(spark, d), D.congestions(spark, d), D.roads(spark, d))


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    return events.prepare(D.accidents(spark, d), "accidente").unionByName(events.prepare(D.congestions(spark, d), "congestion"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """All points without the penalty join, where penalties have no influence."""
    return _incidents(spark, d).unionByName(events.prepare(D.roads(spark, d), "referencia"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return events.segment_summary(_incidents(spark, d))


@query
def events_prepared(spark, d):
    return events.prepare(D.accidents(spark, d), "accidente").select(*PREPARED)


@query
def segment_seq(spark, d):
    return events.prepare(D.roads(spark, d), "referencia").select("segment_id", "row_no", "segment_seq")


@query
def raw_events_union(spark, d):
    return _points(spark, d).groupBy("tipo_evento", "franja_horaria").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("segment_id").alias("segments"))


@query
def road_penalties(spark, d):
    jitter = lambda df: df.withColumn("lat", F.col("lat") + (F.col("row_no") % 7) * 3e-5).withColumn("lon", F.col("lon") + (F.col("row_no") % 11) * 3e-5)
    incidents = _incidents(spark, d)
    return spatial.apply_penalties(jitter(events.prepare(D.roads(spark, d), "referencia")), jitter(incidents), ["segment_id", "segment_seq"]).select("segment_id", "segment_seq", "penalty_factor")


@query
def segment_summary(spark, d):
    return _rounded(_summary(spark, d), "duracion_hrs", "velocidad_kmh", "lat", "lon")


@query
def via_top30(spark, d):
    return events.top_vias(_summary(spark, d))


@query
def metadata_options(spark, d):
    t = events.options(_summary(spark, d), _points(spark, d))
    return _rounded(t.withColumns({c: F.array_join(c, "|") for c, kind in t.dtypes if kind.startswith("array")}), "lat_min", "lat_max", "lon_min", "lon_max")


@query
def segment_tokens(spark, d):
    return events.with_tokens(_summary(spark, d)).select("segment_id", F.array_join("tokens", "|").alias("tokens"))


@query
def transactions_long(spark, d):
    return events.transactions(_summary(spark, d))


@query
def transactions_onehot(spark, d):
    return events.one_hot(_summary(spark, d), ONE_HOT)


@query
def congestion_hotspots(spark, d):
    return _rounded(hotspots.hotspots(_incidents(spark, d)), "lat", "lon", "weight", "start_hour", "end_hour")


@query
def hotspots_limited(spark, d):
    return _rounded(hotspots.limited(hotspots.hotspots(_incidents(spark, d))), "lat", "lon", "weight", "start_hour", "end_hour")


@query
def heat_filter(spark, d):
    trips = D.points(spark, d).filter("indice_coord = 0").select(F.col("user_id").alias("request_id"), S.weekday(F.col("fecha")).alias("day"), (F.col("user_id") % 24).cast("double").alias("hour"))
    return _rounded(hotspots.heat_totals(shared.saved(hotspots.limited(hotspots.hotspots(_incidents(spark, d)))), trips), "weight")


@query
def ratings_clean(spark, d):
    return _rounded(tables.clean_ratings(D.ratings(spark, d)), "rating")


@query
def popularity(spark, d):
    return _rounded(cf.popularity(D.ratings(spark, d)), "rating")


@query
def user_similarity(spark, d):
    return _rounded_fast(cf.similarity(cf.user_item(D.ratings(spark, d)), "user_id", "via"), "sim")


@query
def item_similarity(spark, d):
    return _rounded_fast(cf.similarity(cf.user_item(D.ratings(spark, d)), "via", "user_id"), "sim")


@query
def ubcf_scores(spark, d):
    return _rounded_fast(cf.user_scores(cf.user_item(D.ratings(spark, d))), "score")


@query
def ibcf_scores(spark, d):
    return _rounded_fast(cf.item_scores(cf.user_item(D.ratings(spark, d))), "score")


def _top(spark, d, strategy, n=5, ends=None):
    requests = D.recommendation_requests(spark, d).withColumn("limit", F.lit(n))
    return cf.recommend(D.ratings(spark, d), requests, strategy, ends)


@query
def ubcf_topn(spark, d):
    return _top(spark, d, "ubcf")


@query
def ibcf_topn(spark, d):
    return _top(spark, d, "ibcf")


@query
def popular_fallback(spark, d):
    requests = D.recommendation_requests(spark, d).select("user_id", F.col("known_vias").alias("known"), "limit")
    return cf.popular(D.ratings(spark, d), requests)


@query
def playground(spark, d):
    return cf.playground(D.ratings(spark, d), D.recommendation_requests(spark, d))


@query
def preference_extremes(spark, d):
    return cf.extremes(_top(spark, d, "ubcf", 200, ends=20))


@query
def strategy_overlap(spark, d):
    return _rounded(cf.overlap(_top(spark, d, "ubcf"), _top(spark, d, "ibcf")), "mean_a", "mean_b", "mean_difference")


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared.new_path(spark)}/{name}"


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c != "row_no"])


@query
def accidents_from_csv(spark, d):
    """Accidents written as CSV in order, read back as text and prepared."""
    path, t = _file(spark, "accidents.csv"), D.accidents(spark, d)
    _text(t.repartitionByRange(4, "row_no").sortWithinPartitions("row_no")).write.option("header", True).option("emptyValue", "").option("nullValue", "NULL").csv(path)
    read = tables.scan_events(spark, path, "accidente")
    return events.prepare(read.withColumns({c: F.nullif(F.col(c), F.lit("NULL")) for c in read.columns if c != "row_no"}), "accidente").select("segment_id", "segment_seq", "row_no", "duracion_hrs", "velocidad_kmh", "via", "hora_num", "tipo_evento", "oneway")


@query
def roads_from_csv(spark, d):
    """Roads written as CSV in order and without oneway, read back and prepared."""
    path, t = _file(spark, "roads.csv"), D.roads(spark, d).drop("oneway")
    _text(t.repartitionByRange(4, "row_no").sortWithinPartitions("row_no")).write.option("header", True).csv(path)
    return events.prepare(tables.scan_roads(spark, path), "referencia").select("segment_id", "segment_seq", "row_no", "oneway", "via")


@query
def ratings_csv(spark, d):
    """Ratings through the sink, which orders them by user and via, and the profile's scan, with each row's place in the file."""
    folder = shared.new_path(spark)
    tables.write_csv(_rounded(D.ratings(spark, d), "rating"), f"{folder}/user_ratings_concepcion.csv")
    return tables.profile_ratings(spark, folder, "concepcion", keep=("row_no",))


@query
def road_rows_csv(spark, d):
    path = _file(spark, "rows.csv")
    tables.write_csv(road_rows(spark, d), path)
    t = tables.scan(spark, path)
    return t.select("segment_id", F.col("row_idx").cast("int").alias("row_idx"), F.col("velocidad_kmh").cast("double").alias("velocidad_kmh"), "via", "row_no")


@query
def derived_table(spark, d):
    """Incidents through the bucketed sink, with each point's place among its segment's rows of a file."""
    path = _file(spark, "incidents.parquet")
    name = f"incidents_{uuid.uuid4().hex}"
    tables.write_segments(_incidents(spark, d).drop("row_no"), path, name, ["tipo_evento"])
    spark.sql(f"drop table {name}")  # an external table: its files stay
    t = tables.scan(spark, path).withColumn("row", F.row_number().over(Window.partitionBy("tipo_evento", "segment_id").orderBy("row_no")) - 1)
    return t.select("segment_id", "segment_seq", "tipo_evento", "row")


@query
def ratings_by_user(spark, d):
    return _rounded(cf.ratings_by_user(D.ratings(spark, d)), "mean", "std")


@query
def rating_counts(spark, d):
    return cf.rating_counts(D.ratings(spark, d))


def _danger(spark, d):
    rated = tables.incidents_for_ratings(D.accidents(spark, d), D.congestions(spark, d))
    return ratings.via_danger(rated)


@query
def via_danger(spark, d):
    return _rounded(_danger(spark, d), "avg_duration", "danger_score")


@query
def via_safety_rating(spark, d):
    return _rounded(ratings.safety_ratings(_danger(spark, d)), "avg_duration", "danger_score", "normalized_danger", "safety_rating")


@query
def danger_report(spark, d):
    return _rounded(ratings.danger_report(ratings.safety_ratings(_danger(spark, d))), "mean_rating", "min_rating", "max_rating")


@query
def road_profiles(spark, d):
    lengths = D.roads(spark, d).withColumn("distancia_km", F.col("distancia_km") * (1 + F.col("row_no") % 8))  # equal means would leave only rounding errors to scale
    return ratings.road_profiles(lengths, "concepcion")


@query
def incident_profiles(spark, d):
    t = ratings.incident_profiles(_danger(spark, d), D.roads(spark, d), noise_scale=0.0)
    return _rounded(t.select("user_id", "via", "rating"), "rating", n=4)


@query
def incident_profiles_noisy(spark, d):
    return ratings.sampled_profiles(ratings.incident_profiles(_danger(spark, d), D.roads(spark, d)))


@query
def graph_nodes(spark, d):
    return _rounded(graph.nodes(_points(spark, d)), "lat", "lon")


@query
def graph_segment_edges(spark, d):
    p = _points(spark, d)
    return _rounded(graph.segment_edges(p, graph.nodes(p)), "base_km")


@query
def graph_junction_edges(spark, d):
    p = _points(spark, d)
    return _rounded(graph.junction_edges(p, graph.nodes(p)), "base_km")


@query
def graph_stats(spark, d):
    return graph.stats(*graph.build(_points(spark, d)))


def _road_graph(spark, d):
    """Graph of roads and incidents with penalties; written once, as every round of a solve reads it."""
    e = shared.saved(_events(spark, d))
    n, edges = graph.build(e)
    return e, n, shared.saved(_rounded(edges, "base_km", n=9))


@query
def nearest_node(spark, d):
    p = D.points(spark, d).select(F.col("event_id").alias("point_id"), (F.col("lat") + 1.1e-4).alias("lat"), (F.col("lon") + 0.7e-4).alias("lon"))
    return _rounded(spatial.nearest_nodes(p, graph.nodes(_points(spark, d))), "km")


@query
def edge_costs(spark, d):
    p = _points(spark, d)
    n, e = graph.build(p)
    return _rounded(paths.edge_costs(n, e).select("src", "dst", "base_km", "static_factor"), "base_km", "static_factor")


@query
def incident_factors(spark, d):
    n = graph.nodes(_points(spark, d))
    factor = S.incident_factor(F.col("tipo_evento"), F.col("penalty_factor"), F.col("dia_semana"), F.col("franja_horaria"), F.lit("monday"), F.lit(S.HOUR_BUCKETS[1][2]), F.lit(True), F.lit(True))
    return _rounded(n.select("node_id", factor.alias("factor")), "factor")


@query
def via_factors(spark, d):
    return routes.via_factors(D.route_requests(spark, d), "ubcf")


@query
def factor_compare(spark, d):
    return _rounded(routes.compare_factors(D.route_requests(spark, d)), "share")


@query
def route_request_rejects(spark, d):
    _, bad = routes.valid_requests(D.doubtful_route_requests(spark, d), spatial.bounds(D.points(spark, d)))
    return bad.select("request_id", "departure_hour")


@query
def recommendation_request_rejects(spark, d):
    _, bad = cf.valid_requests(D.doubtful_recommendation_requests(spark, d))
    return bad.select("request_id", "user_id", "limit")


def _routes(spark, d):
    e, n, edges = _road_graph(spark, d)
    requests, _ = routes.valid_requests(D.route_requests(spark, d), spatial.bounds(e))
    requests = shared.saved(requests)
    planned, found = routes.solve(requests, n, edges)
    return e, requests, planned, found, shared.saved(routes.steps(planned, found, n))


@query
def shortest_paths(spark, d):
    return _rounded(_routes(spark, d)[3], "peso")


@query
def delivery_routes(spark, d):
    """Long trips over a map of small blocks; those of a nation are one search."""
    _, n, edges = _road_graph(spark, d)
    return _rounded(routes.solve(D.delivery_requests(spark, d), n, edges, block_nodes=100)[1], "peso")


@query
def unroutable_requests(spark, d):
    _, _, planned, found, _ = _routes(spark, d)
    return routes.unroutable(planned, found)


@query
def route_steps(spark, d):
    columns = ["request_id", "variant", "position", "node_id", "lat", "lon", "tipo_evento", "dia_semana", "franja_horaria", "peso", "cumulative_km"]
    return _rounded(_routes(spark, d)[4].select(*columns), "lat", "lon", "peso")


@query
def route_variants(spark, d):
    _, requests, _, _, step = _routes(spark, d)
    return _rounded(routes.variants(step, requests), "cost")


@query
def route_delay(spark, d):
    _, requests, _, _, step = _routes(spark, d)
    return routes.delays(step, requests)


@query
def route_geometry(spark, d):
    e, _, _, _, step = _routes(spark, d)
    return _rounded(routes.geometry(step, e), "lat", "lon")


@query
def polylines(spark, d):
    """Each street's points as a line; every third point lacks its latitude."""
    lat = F.when(F.col("event_id") % 3 != 0, F.col("lat"))
    p = D.points(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("indice_coord", lat.alias("lat"), "lon"))).alias("points"))
    end = lambda x: F.struct(F.lit(x).alias("lat"), F.lit(x).alias("lon"))
    line = S.clean_polyline(F.transform("points", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))), end(0.0), end(1.0))
    t = p.select("user_id", line.alias("line"))
    return t.select("user_id", F.size("line").alias("points"), F.round(F.get("line", F.lit(0))["lat"], 6).alias("lat"), F.round(F.get("line", F.size("line") - 1)["lon"], 6).alias("lon"))


@query
def route_summary(spark, d):
    _, requests, _, _, step = _routes(spark, d)
    return routes.summary(routes.variants(step, requests))


@query
def penalty_scenarios(spark, d):
    return _rounded(routes.scenarios(_routes(spark, d)[4]), "sum_peso", "cost")


@query
def route_coverage(spark, d):
    _, requests, _, _, step = _routes(spark, d)
    return routes.coverage(step, requests)


@query
def road_rows(spark, d):
    p = D.points(spark, d)
    node = lambda n: F.struct((F.col("lon") + n * 5e-4).alias("x"), F.col("lat").alias("y"), F.lit(None).cast("string").alias("addr_city"), F.when(F.col("event_id") % 4 == 0, F.col("comuna")).alias("city"), F.lit(" ").alias("name"))
    point = lambda n: F.struct((F.col("lon") + n * 1e-4).alias("lon"), F.col("lat").alias("lat"))
    edges = p.select(
        F.col("event_id").cast("string").alias("u"),
        (F.col("event_id") + 1).cast("string").alias("v"),
        F.when(F.col("event_id") % 3 != 0, F.array(F.concat(F.lit("w"), "user_id"))).alias("osmid"),
        F.when(F.col("event_id") % 5 != 0, F.col("via")).alias("name"),
        F.lit("").alias("name_es"),
        F.lit(None).cast("string").alias("addr_city"),
        F.lit("").alias("ref"),
        ((F.col("event_id") % 9) * 10.0).alias("length_m"),
        F.when(F.col("event_id") % 7 != 0, F.array(F.concat((F.col("event_id") % 90).cast("string"), F.lit(" mph")), F.lit("x"))).alias("maxspeed"),
        F.element_at(F.array(*[F.lit(x) for x in ("no", "-1", "yes", "both")]), (F.col("event_id") % 4 + 1).cast("int")).alias("oneway"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.array(point(0), point(1)), F.array(point(2)))).alias("geometry"),
        node(0).alias("u_node"),
        node(1).alias("v_node"),
    )
    return _rounded(roads.road_rows(edges, "Region"), "lon", "lat", "duracion_hrs", "distancia_km")
