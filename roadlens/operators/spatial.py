"""Spatial joins on grid cells: radius join, nearest node, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S
from roadlens.sources.shared import saved

RADIUS_M = 60.0
DEGREE_M = 111_194.9  # metres in a degree of latitude


def bounds(points: DataFrame) -> DataFrame:
    pairs = [("lat_min", F.min("lat"), -90.0), ("lat_max", F.max("lat"), 90.0), ("lon_min", F.min("lon"), -180.0), ("lon_max", F.max("lon"), 180.0)]
    return points.agg(*[F.coalesce(c, F.lit(d)).alias(n) for n, c, d in pairs])


def in_box(lat: Column, lon: Column, box: tuple = S.BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """left columns with right's columns (prefix r_) for all pairs within the radius: right goes to its 3x3 cells, cells are joined, distances checked."""
    step = radius_m * 1.001 / DEGREE_M
    # longitude cells widen with latitude: rows of cells share the width at their own pole-ward edge, neighbours included
    row = lambda lat: F.floor(lat / step)
    width = lambda r: _width(r, step)
    l = left.filter("lat is not null and lon is not null").withColumn("cell_y", row(F.col("lat")))  # noqa: E741
    l = l.withColumn("cell_x", F.floor(F.col("lon") / width(F.col("cell_y"))))  # noqa: E741
    r = right.filter("lat is not null and lon is not null").select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("cell_y", F.explode(F.array(*[row(F.col("r_lat")) + d for d in (-1, 0, 1)])))
    r = r.withColumn("cell_x", F.explode(F.array(*[F.floor(F.col("r_lon") / width(F.col("cell_y"))) + d for d in (-1, 0, 1)])))
    near = S.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) * 1000 <= radius_m
    return l.join(r, ["cell_y", "cell_x"]).filter(near).drop("cell_y", "cell_x")


#: Fine cells along each side of a cell of the radius join.
FINE = 8


def _fine_cells(points: DataFrame, radius_m: float) -> DataFrame:
    """points with the cell (cell_y, cell_x) of the radius join and the fine cell (fine_y, fine_x) in it."""
    step = radius_m * 1.001 / DEGREE_M
    cell_y = F.floor(F.col("lat") / step)
    width = _width(cell_y, step)
    cell_x = F.floor(F.col("lon") / width)
    inside = lambda x: F.floor((x - F.floor(x)) * FINE).cast("int")
    return points.filter("lat is not null and lon is not null").withColumns({"cell_y": cell_y, "cell_x": cell_x, "fine_y": inside(F.col("lat") / step), "fine_x": inside(F.col("lon") / width)})


def _width(row: Column, step: float) -> Column:
    """Degrees of longitude of the cells of a row: they widen with latitude, by the width at the pole-ward edge of the next row."""
    return step / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), (F.abs(row) + 2) * step))), F.lit(1e-3))


def _apart(radius_m: float) -> tuple[Column, Column]:
    """Whether all points of the boxes l_ and r_ are within the radius of each other, and whether none are. Margins cover the flat map's error."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"r_{c}0") - F.col(f"l_{c}1"), F.col(f"l_{c}0") - F.col(f"r_{c}1"))
    span = lambda c: F.greatest(F.col(f"r_{c}1") - F.col(f"l_{c}0"), F.col(f"l_{c}1") - F.col(f"r_{c}0"))
    high = F.greatest(*[F.abs(F.col(c)) for c in ("l_y0", "l_y1", "r_y0", "r_y1")])
    least, most = F.cos(F.radians(high)), F.cos(F.radians(F.greatest(F.lit(0.0), high - 2 * radius_m / DEGREE_M)))
    metres = lambda y, x: F.sqrt(y * y + x * x) * DEGREE_M
    return metres(span("y"), span("x") * most) * 1.001 <= radius_m, metres(gap("y"), gap("x") * least) * 0.999 > radius_m


def worst_within(roads: DataFrame, spots: DataFrame, key: list[str], radius_m: float = RADIUS_M) -> DataFrame:
    """key columns with near_penalty, the largest penalty_factor of the spots within the radius; keys without any are left out.

    Boxes of fine cells meet before points do: a box that lies wholly within the radius of another gives it its largest penalty at once, and points are
    compared only for pairs of boxes that the radius cuts and that have something worse to offer. So one crowded cell never meets another point by point.
    """
    cell, fine = ["cell_y", "cell_x"], ["cell_y", "cell_x", "fine_y", "fine_x"]
    box = lambda p: [f(c).alias(f"{p}_{n}{i}") for c, n in (("lat", "y"), ("lon", "x")) for i, f in ((0, F.min), (1, F.max))]
    l, r = saved(_fine_cells(roads.select(*key, "lat", "lon"), radius_m)), saved(_fine_cells(spots.select("lat", "lon", "penalty_factor"), radius_m))  # noqa: E741
    lc = l.groupBy(*fine).agg(*box("l")).withColumnsRenamed({c: f"l_{c}" for c in fine})
    rc = r.groupBy(*fine).agg(*box("r"), F.max("penalty_factor").alias("most")).withColumnsRenamed({c: f"r_{c}" for c in fine})
    # a cell's boxes go to the cells around it; rows of other latitudes have other widths, so their columns follow from the box's longitudes
    step = radius_m * 1.001 / DEGREE_M
    rc = rc.withColumn("l_cell_y", F.explode(F.array(*[F.col("r_cell_y") + d for d in (-1, 0, 1)])))
    width = _width(F.col("l_cell_y"), step)
    rc = rc.withColumn("l_cell_x", F.explode(F.sequence(F.floor(F.col("r_x0") / width) - 1, F.floor(F.col("r_x1") / width) + 1)))
    whole, never = _apart(radius_m)
    pairs = saved(lc.join(rc, [f"l_{c}" for c in cell]).filter(~never).withColumn("whole", whole))  # FINE * FINE boxes of a cell at most
    sure = pairs.filter("whole").groupBy(*[f"l_{c}" for c in fine]).agg(F.max("most").alias("sure"))
    same = [f"l_{c}" for c in fine]
    open_ = pairs.filter("not whole").join(sure, same, "left").filter("sure is null or most > sure")
    points = l.withColumnsRenamed({"lat": "at_lat", "lon": "at_lon", **{c: f"l_{c}" for c in fine}})
    cut = points.join(open_.select(*same, *[f"r_{c}" for c in fine], "sure"), same).join(r.withColumnsRenamed({c: f"r_{c}" for c in fine}), [f"r_{c}" for c in fine])
    cut = cut.filter("sure is null or penalty_factor > sure").filter(S.haversine_km(F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon")) * 1000 <= radius_m)
    found = points.join(sure, same).select(*key, F.col("sure").alias("near")).unionByName(cut.select(*key, F.col("penalty_factor").alias("near")))
    return found.groupBy(*key).agg(F.max("near").alias("near_penalty"))


def apply_penalties(roads: DataFrame, incidents: DataFrame, key: list[str], radius_m: float = RADIUS_M) -> DataFrame:
    """roads with the largest penalty of themselves and of incidents within the radius."""
    spots = incidents.groupBy("lat", "lon").agg(F.max("penalty_factor").alias("penalty_factor"))
    joined = roads.join(worst_within(roads, spots, key, radius_m), key, "left")
    penalty = F.greatest(F.coalesce("penalty_factor", F.lit(1.0)), F.coalesce("near_penalty", F.lit(1.0)))
    return joined.withColumn("penalty_factor", penalty).drop("near_penalty").select(*roads.columns)


#: The pyramid of nearest_nodes: degrees of its widest cells, and how often they are cut into 4 x 4.
TOP, STEPS = 45.0, 8


def _pyramid(n: DataFrame) -> list[DataFrame]:
    """For each level, the widest cells first: y, x, count and parent (py, px) of the cells that hold nodes (columns y, x of the finest level)."""
    levels = [saved(n.groupBy("y", "x").agg(F.count(F.lit(1)).alias("count")))]
    for _ in range(STEPS):
        up = levels[-1].select(F.shiftright("y", 2).alias("y"), F.shiftright("x", 2).alias("x"), "count")
        levels.append(saved(up.groupBy("y", "x").agg(F.sum("count").alias("count"))))
    return [t.select("y", "x", "count", F.shiftright("y", 2).alias("py"), F.shiftright("x", 2).alias("px")) for t in reversed(levels)]


def _reach(width: float) -> tuple[Column, Column]:
    """Degrees of arc from a point (p_lat, p_lon) that all nodes of a cell (y, x) are away at least, and that some node is away at most.

    At least: the gap of latitudes, and the way to the meridian at the edge of the gap of longitudes (beyond 90 degrees: to the pole).
    At most: the way to the cell's middle and from there to its corner.
    """
    south, west, p = F.col("y") * width - 90, F.col("x") * width - 180, F.col("p_lat")
    gap_y = F.greatest(south - p, p - south - width, F.lit(0.0))
    east_of = F.pmod(F.col("p_lon") - west, F.lit(360.0))  # 0 to width: inside
    gap_x = F.when(east_of <= width, 0.0).otherwise(F.least(east_of - width, 360 - east_of))
    across = F.when(gap_x < 90, F.degrees(F.asin(F.cos(F.radians(p)) * F.sin(F.radians(gap_x))))).otherwise(90 - F.abs(p))
    middle = S.haversine_km(p, F.col("p_lon"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), south + width / 2)), west + width / 2) * 1000 / DEGREE_M
    return F.greatest(gap_y, across), middle + width


def _descend(left: DataFrame, n: DataFrame) -> DataFrame:
    """Candidate nodes of far points (point_id, p_lat, p_lon, excluded): cells of the pyramid are followed while they may hold the nearest node."""
    width, t = TOP, None
    for cells in _pyramid(n):
        if t is None:
            t = left.crossJoin(F.broadcast(cells))  # the globe has 45 cells of this width at most
        else:
            t = t.withColumnsRenamed({"y": "py", "x": "px"}).drop("count").join(cells, ["py", "px"])
        near, far = _reach(width)
        # a cell with one node may hold no other than the one that is left out
        far = F.when(F.col("excluded").isNull() | (F.col("count") > 1), far)
        t = t.drop("py", "px").withColumn("near", near).withColumn("best", F.min(far).over(Window.partitionBy("point_id")))
        t = t.filter(F.col("best").isNull() | (F.col("near") <= F.col("best") + 1e-6)).select("point_id", "p_lat", "p_lon", "excluded", "y", "x", "count")
        width /= 4
    return t.join(n, ["y", "x"])


def nearest_nodes(points: DataFrame, nodes: DataFrame, exclude: str | None = None, cell: float = 0.001) -> DataFrame:
    """points (point_id, lat, lon) with node_id and km of the nearest node (ties: least node_id), NULL if there is none.

    Nodes in the 3x3 cells around a point are tried; a hit closer than the cells' margin is final. Points without one descend a pyramid of occupied
    cells: of a point's cells those go on whose least possible distance is not beyond the greatest possible of another. Points without a place have no node.
    """
    excluded = F.col(exclude) if exclude else F.lit(None).cast("string")
    left = points.filter("lat is not null and lon is not null").select("point_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), excluded.alias("excluded"))
    n = nodes.filter("lat is not null and lon is not null").select("node_id", "lat", "lon")
    km = S.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    other = F.col("excluded").isNull() | (F.col("node_id") != F.col("excluded"))
    best = F.min_by(F.struct("node_id", "km"), F.struct("km", "node_id")).alias("best")
    at = lambda c: F.floor(F.col(c) / cell)
    around = left.withColumn("y", F.explode(F.array(*[at("p_lat") + d for d in (-1, 0, 1)]))).withColumn("x", F.explode(F.array(*[at("p_lon") + d for d in (-1, 0, 1)])))
    tried = around.join(n.withColumn("y", at("lat")).withColumn("x", at("lon")), ["y", "x"]).filter(other).withColumn("km", km)
    # degrees of longitude shrink towards the poles
    margin = F.lit(cell * DEGREE_M / 1000) * F.cos(F.radians(F.least(F.lit(89.9), F.abs("p_lat") + 2 * cell)))
    hits = saved(tried.filter(F.col("km") < margin).groupBy("point_id").agg(best))
    far = saved(left.join(hits, "point_id", "left_anti"))
    if not far.isEmpty():
        finest = TOP / 4**STEPS
        celled = saved(n.withColumn("y", F.floor((F.col("lat") + 90) / finest)).withColumn("x", F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / finest)))
        hits = hits.unionByName(saved(_descend(far, celled).filter(other).withColumn("km", km).groupBy("point_id").agg(best)))
    return points.select("point_id").join(hits, "point_id", "left").select("point_id", "best.node_id", "best.km")
