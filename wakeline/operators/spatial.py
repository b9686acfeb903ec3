"""Distance of pings from geometry layers, exact, without pairing all with all.

Cells that hold pings and cells that hold edges descend a grid pyramid together, by
factors of four. At each level a pair of cells is kept if the least distance of their
boxes is not above the largest distance of the ping cell to the box of some edge cell:
only then can the nearest edge lie there. Tests are on box corners, so a level costs a
few comparisons for each pair, a ping cell keeps the edge cells of a thin ring, and edges
themselves are joined at the leaves only. Leaf cells with a long list, or with many places,
are split further, and each part keeps what can be nearest in it.

Work is done once for each place that pings have, and once for each edge that the layer
holds. Tables are met by merge joins: what a small file grows into here has no size that a
plan could guess, so none of it is broadcast.

An edge is listed in the leaf cells along it: it is cut into pieces no longer than a
cell, each in the cell of its middle, and edge boxes are half a cell larger than the grid.

Two metrics share the descent. The planar one measures in the Mercator plane. The
great-circle one measures along the sphere: its cells are cubes that the sphere passes,
and the straight line through the sphere bounds the way along it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.columns import METRES_PER_NM, arc_angle, mercator_x, mercator_y, segment_distance
from wakeline.params import Params
from wakeline.session import durable

# Cell widths of the pyramid as powers of two, in metres: 4194 km to 4 km.
LEVELS = (22, 20, 18, 16, 14, 12)
TOP, LEAF = LEVELS[0], LEVELS[-1]
# Levels with a proven small number of cells: at most 23409 in the plane and 40000 about the sphere.
SMALL_LEVELS = (22, 20, 18)
# Leaf cells that are split once more, to 1 km, then to 256 m: those that list more edges than LONG or hold very many places.
FINE_LEVELS, LONG = (10, 8), 64
EDGE = ("x1", "y1", "x2", "y2")
PLANE, SPHERE = ("i", "j"), ("i", "j", "k")
# Fixed value: mean radius of the earth in metres.
EARTH_M = 6_371_008.8


def web_mercator(df: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    return df.withColumns({x: mercator_x("Lon"), y: mercator_y("Lat")})


def project_edges(edges: DataFrame) -> DataFrame:
    """Edges in longitude and latitude to metres."""
    return edges.select(
        "geom_id", mercator_x("x1").alias("x1"), mercator_y("y1").alias("y1"),
        mercator_x("x2").alias("x2"), mercator_y("y2").alias("y2"),
    )


def unit_vector(lon, lat) -> Column:
    """Direction from the middle of the earth as an array of three."""
    lon, lat = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lon, lat))
    return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def _cell(point: list[Column], axes: tuple[str, ...], level: int = LEAF) -> Column:
    size = float(1 << level)
    return F.struct(*[F.floor(x / size).alias(a) for x, a in zip(point, axes)])


def _parent(cell: str, axes: tuple[str, ...], steps: int) -> Column:
    return F.struct(*[F.shiftright(F.col(f"{cell}.{a}"), steps).alias(a) for a in axes])


def _centre(cell: str, level: int = LEAF) -> tuple[Column, Column]:
    size = float(1 << level)
    return (F.col(f"{cell}.i") + 0.5) * size, (F.col(f"{cell}.j") + 0.5) * size


def _pieces(edges: DataFrame, length: Column) -> DataFrame:
    """Edges once for each piece, with the place ``_t`` of its middle from 0 to 1."""
    n = F.greatest(F.ceil(length / float(1 << LEAF)), F.lit(1)).cast("bigint")
    return edges.withColumn("_n", n).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).withColumn(
        "_t", (F.col("_s") + 0.5) / F.col("_n")).drop("_s", "_n")


def planar_pieces(flat: DataFrame) -> DataFrame:
    """(edge, other): leaf cells along each edge of the plane."""
    cut = _pieces(flat, F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    middle = [F.col(a) + F.col("_t") * (F.col(b) - F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2"))]
    return cut.withColumn("other", _cell(middle, PLANE)).drop("_t")


def arc_pieces(edges: DataFrame) -> DataFrame:
    """(edge with unit vectors a and b, other): leaf cells along each great-circle arc."""
    ends = edges.select(unit_vector("x1", "y1").alias("a"), unit_vector("x2", "y2").alias("b"))
    ends = ends.withColumn("_w", arc_angle("a", "b"))
    cut = _pieces(ends, F.col("_w") * EARTH_M)
    low = F.coalesce(F.try_divide(F.sin((1 - F.col("_t")) * F.col("_w")), F.sin("_w")), 1 - F.col("_t"))
    high = F.coalesce(F.try_divide(F.sin(F.col("_t") * F.col("_w")), F.sin("_w")), F.col("_t"))
    middle = [(low * F.col("a")[k] + high * F.col("b")[k]) * EARTH_M for k in range(3)]
    return cut.withColumn("other", _cell(middle, SPHERE)).drop("_t", "_w")


def descend(cells: DataFrame, others: DataFrame, axes: tuple[str, ...], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(cell, other): for each leaf cell the edge cells that can hold the nearest edge of some point in it.

    A ping cell's pairs at a level are the edge cells of a ring about as wide as a cell,
    so a window over the cell has a short list to sort.
    """
    found, above = None, None
    for level in levels:
        here = cells.select(_parent("cell", axes, level - LEAF).alias("cell")).distinct()
        there = others.select(_parent("other", axes, level - LEAF).alias("other")).distinct()
        if found is None:
            # at most 100 cells cover the globe at this level
            top = there.agg(F.collect_list("other").alias("o")).scalar()
            pairs = here.withColumn("_o", top).select("cell", F.explode("_o").alias("other"))
        else:
            steps = above - level
            here = here.withColumn("_up", _parent("cell", axes, steps))
            there = there.withColumn("_by", _parent("other", axes, steps))
            small = level in SMALL_LEVELS
            here, there = (F.broadcast(t) if small else t.hint("merge") for t in (here, there))
            up = found.select(F.col("cell").alias("_up"), F.col("other").alias("_by"))
            pairs = up.join(here, "_up").join(there, "_by").select("cell", "other")
        size, margin = float(1 << level), float(1 << LEAF) / 2
        apart = [F.abs(F.col(f"cell.{a}") - F.col(f"other.{a}")) for a in axes]
        near = sum(F.pow(F.greatest((n - 1) * size - margin, F.lit(0.0)), 2) for n in apart)
        far = sum(F.pow((n + 1) * size, 2) for n in apart)
        reach = F.min(far).over(Window.partitionBy("cell"))
        found = pairs.withColumn("_reach", reach).filter(near <= F.col("_reach")).select("cell", "other")
        above = level
    return found


def _nearest(pairs: DataFrame, kept: list[str], distance: Column, slack: float) -> DataFrame:
    """(home, edge) of the pairs whose distance from the middle of home is at most ``slack`` above the least.

    The pairs are made twice, so that none is shuffled but those that stay.
    """
    met = pairs.withColumn("_d", distance)
    least = met.groupBy("home").agg(F.min("_d").alias("_least"))
    return met.join(least.hint("merge"), "home").filter(
        F.col("_d") <= F.col("_least") + F.lit(slack)).select("home", *kept).distinct()


def _home(point: list[Column], axes: tuple[str, ...], level: int) -> Column:
    """A cell with its level."""
    return F.struct(F.lit(level).alias("z"), *[_cell(point, axes, level)[a].alias(a) for a in axes])


def near_edges(
    spots: DataFrame, pieces: DataFrame, point: list[Column], axes: tuple[str, ...], p: Params, from_middle, slack
) -> tuple[DataFrame, DataFrame]:
    """(spots with the cell ``home`` each lies in, (home, edge): all edges that can be nearest inside).

    ``from_middle(level)`` is an edge's distance from the middle of home, ``slack(level)`` what the
    distances of two points of a cell from it add up to at most.
    """
    pieces = durable(pieces)
    others = durable(pieces.select("other").distinct())
    kept = [c for c in pieces.columns if c != "other"]
    spots = spots.withColumn("home", _home(point, axes, LEAF))
    leaves = durable(spots.select(F.struct(*[F.col(f"home.{a}").alias(a) for a in axes]).alias("cell")).distinct())
    found = durable(descend(leaves, others, axes))
    home = F.struct(F.lit(LEAF).alias("z"), *[F.col(f"cell.{a}").alias(a) for a in axes]).alias("home")
    pairs = found.join(pieces.hint("merge"), "other").select(home, *kept)
    lists = durable(_nearest(pairs, kept, from_middle(LEAF), slack(LEAF)))
    for level in FINE_LEVELS:
        crowded = spots.groupBy("home").count().filter(F.col("count") > p.group_rows)
        split = durable(lists.groupBy("home").count().filter(F.col("count") > LONG).union(crowded).select("home").distinct())
        if split.isEmpty():
            break
        spots = spots.join(split.withColumn("_split", F.lit(True)).hint("merge"), "home", "left").withColumn(
            "_up", F.when(F.col("_split"), F.col("home"))).withColumn(
            "home", F.when(F.col("_split"), _home(point, axes, level)).otherwise(F.col("home")))
        spots = durable(spots.drop("_split"))
        parts = spots.filter("_up is not null").select("home", "_up").distinct()
        pairs = parts.join(lists.withColumnRenamed("home", "_up").hint("merge"), "_up").select("home", *kept)
        whole = lists.join(split.hint("merge"), "home", "left_anti")
        lists = durable(whole.union(_nearest(pairs, kept, from_middle(level), slack(level))))
        spots = spots.drop("_up")
    return spots, lists


def covered_cells(edges: DataFrame) -> DataFrame:
    """(cell, geom_id): leaf cells whose centre lies inside a geometry.

    Each grid row cuts a geometry into intervals between its crossings; the cells
    of an interval are listed by index. Holes come out by the even-odd rule.
    """
    size = float(1 << LEAF)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low / size - 0.5), F.ceil(high / size - 0.5) - 1
    rows = edges.filter(last >= first).withColumn("j", F.explode(F.sequence(first, last)))
    at = (F.col("j") + 0.5) * size
    cut = F.col("x1") + (at - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    line = Window.partitionBy("j", "geom_id").orderBy("x")
    crossings = rows.select("j", "geom_id", cut.alias("x")).withColumns({
        "_k": F.row_number().over(line), "_x2": F.lead("x").over(line),
    })
    spans = crossings.filter((F.col("_k") % 2 == 1) & F.col("_x2").isNotNull())
    i0, i1 = F.ceil(F.col("x") / size - 0.5), F.ceil(F.col("_x2") / size - 0.5) - 1
    return spans.filter(i1 >= i0).select(
        "geom_id", F.explode(F.sequence(i0, i1)).alias("i"), "j"
    ).select(F.struct("i", "j").alias("cell"), "geom_id")


def edges_by_cell(flat: DataFrame) -> DataFrame:
    """(cell, edge): every leaf cell that an edge may pass, by the box of each piece.

    Edges that a geometry holds twice cancel out in the even-odd rule and are left out.
    """
    odd = flat.groupBy("geom_id", *EDGE).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")
    cut = planar_pieces(odd)
    i, j = (F.explode(F.sequence(F.col(f"other.{a}") - 1, F.col(f"other.{a}") + 1)) for a in PLANE)
    wide = cut.withColumn("_i", i).withColumn("_j", j)
    size = float(1 << LEAF)
    # a piece lies within half a cell of its middle, so within the nine cells about it; keep those its edge's box meets
    meets = lambda c, a, b: (F.greatest(a, b) >= F.col(c) * size) & (F.least(a, b) <= (F.col(c) + 1) * size)
    wide = wide.filter(meets("_i", F.col("x1"), F.col("x2")) & meets("_j", F.col("y1"), F.col("y2")))
    return wide.select(
        F.struct(F.col("_i").alias("i"), F.col("_j").alias("j")).alias("cell"), "geom_id", *EDGE
    ).distinct()


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0


def _placed(df: DataFrame) -> DataFrame:
    """Rows with their place and leaf cell in the plane; none where a coordinate is null."""
    rows = df.withColumns({"_px": mercator_x("Lon"), "_py": mercator_y("Lat")})
    known = F.col("_px").isNotNull() & F.col("_py").isNotNull()
    return rows.withColumn("cell", F.when(known, _cell([F.col("_px"), F.col("_py")], PLANE)))


def _leaves(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("cell").isNotNull()).select("cell").distinct()


def _inside_lists(leaves: DataFrame, flat: DataFrame) -> DataFrame:
    """(cell, _whole, _geoms): whether a geometry holds all of a leaf cell; if none does, for each geometry whose
    edges pass the cell these edges and whether it holds the cell's centre."""
    passing = leaves.join(edges_by_cell(flat).filter("geom_id is not null").hint("merge"), "cell").groupBy(
        "cell", "geom_id").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    inside = leaves.join(covered_cells(flat).filter("geom_id is not null").hint("merge"), "cell").select(
        "cell", "geom_id").distinct().withColumn("held", F.lit(True))
    geoms = passing.join(inside.hint("merge"), ["cell", "geom_id"], "full").withColumn("held", F.coalesce("held", F.lit(False)))
    whole = F.max(F.col("edges").isNull())
    return geoms.groupBy("cell").agg(
        whole.alias("_whole"), F.collect_list(F.when(F.col("edges").isNotNull(), F.struct("held", "edges"))).alias("_geoms"),
    ).withColumn("_geoms", F.when(~F.col("_whole"), F.col("_geoms")))


def _within(px: Column, py: Column) -> Column:
    """Whether a place lies inside a geometry: one holds its cell's centre, and edges on the way there change that."""
    cx, cy = _centre("cell")
    on_way = lambda e: (
        _side(px, py, cx, cy, e["x1"], e["y1"]) != _side(px, py, cx, cy, e["x2"], e["y2"])
    ) & (
        _side(e["x1"], e["y1"], e["x2"], e["y2"], px, py) != _side(e["x1"], e["y1"], e["x2"], e["y2"], cx, cy)
    )
    inside = F.exists("_geoms", lambda g: g["held"] != (F.size(F.filter(g["edges"], on_way)) % 2 == 1))
    return F.coalesce(F.col("_whole") | F.coalesce(inside, F.lit(False)), F.lit(False))


def distance_nm(
    df: DataFrame, edges: DataFrame, out: str, p: Params, polygons: bool = True, metric: str = "planar"
) -> DataFrame:
    """Add the distance to the layer in nautical miles; 0 inside polygons, null without coordinates or edges.

    ``metric`` is "planar", the Mercator plane, or "haversine", along the sphere to the
    great-circle arcs of the edges. Polygons' insides are those of the Mercator plane.
    """
    if metric not in ("planar", "haversine"):
        raise ValueError(f"unknown metric {metric!r}; expected 'planar' or 'haversine'")
    flat = project_edges(edges)
    known = F.col("cell").isNotNull()
    spots = durable(_placed(df.select("Lon", "Lat").distinct()).filter(known))
    if polygons:
        lists = _inside_lists(durable(_leaves(spots)), flat)
        spots = spots.join(lists.hint("merge"), "cell", "left").withColumn("_held", _within(F.col("_px"), F.col("_py")))
        spots = durable(spots.drop("_whole", "_geoms"))
    else:
        spots = spots.withColumn("_held", F.lit(False))
    if metric == "planar":
        point = [F.col("_px"), F.col("_py")]
        spots, lists = near_edges(
            spots.drop("cell"), planar_pieces(flat.select(*EDGE).distinct()), point, PLANE, p,
            lambda level: segment_distance(*_centre("home", level), *EDGE), lambda level: math.sqrt(2.0) * (1 << level))
        metres = segment_distance("_px", "_py", *EDGE)
    else:
        spots = spots.select("Lon", "Lat", "_held", unit_vector("Lon", "Lat").alias("_u"))
        point = [F.col("_u")[k] * EARTH_M for k in range(3)]
        spots, lists = near_edges(
            spots, _with_normals(arc_pieces(edges.select(*EDGE).distinct())), point, SPHERE, p, _from_middle, _span)
        metres = EARTH_M * _arc_distance(F.col("_u"), F.col)
    met = spots.join(lists.hint("merge"), "home").groupBy("Lon", "Lat").agg(
        F.max("_held").alias("_held"), F.least(F.lit(float("inf")), F.min(metres)).alias("_metres"))
    value = F.when(F.col("_held"), 0.0).otherwise(F.col("_metres")) / METRES_PER_NM
    found = met.select("Lon", "Lat", value.alias(out))
    kept = [c for c in df.columns if c != out]
    return df.select(*kept).join(found.hint("merge"), ["Lon", "Lat"], "left").select(*kept, out)


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: Column, b: Column) -> Column:
    return sum(a[k] * b[k] for k in range(3))


def _with_normals(arcs: DataFrame) -> DataFrame:
    """Add the unit normal ``n`` of each arc's plane and the directions ``s``, ``e`` in which its two ends open."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    out = arcs.withColumn("n", _cross(a, b)).withColumn("_l", F.sqrt(_dot(n, n)))
    unit = F.when(F.col("_l") > 1e-15, F.transform("n", lambda x: x / F.col("_l")))  # null: a point
    return out.withColumn("n", unit).withColumns({"s": _cross(n, a), "e": _cross(b, n)}).drop("_l")


def _arc_distance(u: Column, arc) -> Column:
    """Angle between a point and the nearest point of the shorter arc from a to b."""
    beside = F.coalesce((_dot(arc("s"), u) >= 0) & (_dot(arc("e"), u) >= 0), F.lit(False))
    across = F.asin(F.least(F.abs(_dot(arc("n"), u)), F.lit(1.0)))
    return F.when(beside, across).otherwise(F.least(arc_angle(u, arc("a")), arc_angle(u, arc("b"))))


def _from_middle(level: int) -> Column:
    """Angle between the sphere's point above the middle of a cell and an arc."""
    size = float(1 << level)
    g = [(F.col(f"home.{x}") + 0.5) * size for x in SPHERE]
    h = F.sqrt(sum(x * x for x in g))
    return _arc_distance(F.array(*[x / h for x in g]), F.col)


def _span(level: int) -> float:
    """The sphere's point above a cell's middle is within a cell's diagonal of every point of the sphere in it."""
    return 4.0 * math.asin(math.sqrt(3.0) * (1 << level) / 2.0 / EARTH_M) * (1 + 1e-9)


def spatial_features(
    df: DataFrame, p: Params, coast: DataFrame, fishing: DataFrame | None = None,
    routes: DataFrame | None = None, metric: str = "planar",
) -> DataFrame:
    """Distances to coast, fishing zones and routes; a missing layer adds no column."""
    out = distance_nm(df, coast, "dist_coast_nm", p, metric=metric)
    if fishing is not None:
        out = distance_nm(out, fishing, "dist_fishing_zone_nm", p, metric=metric)
    if routes is not None:
        out = distance_nm(out, routes, "dist_commercial_route_nm", p, polygons=False, metric=metric)
    return out
