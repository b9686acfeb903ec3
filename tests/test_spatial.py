"""The descent's work, the great-circle metric and awkward edges against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import spatial
from wakeline.params import Params

P = Params()


def coast(spark, n, seed=2):
    """A closed coastline of n edges about the origin, about 300 km wide."""
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = 1.4 + 0.1 * np.sin(9 * turn)
    x, y = 13 + r * np.cos(turn), 36 + r * np.sin(turn)
    rows = [(0, float(x[k]), float(y[k]), float(x[(k + 1) % n]), float(y[(k + 1) % n])) for k in range(n)]
    return spark.createDataFrame(rows, "geom_id long, x1 double, y1 double, x2 double, y2 double").repartition(4)


@pytest.mark.parametrize("axes", [spatial.PLANE, spatial.SPHERE])
@pytest.mark.parametrize("n", [3000])
def test_pairs_stay_linear_at_every_level(spark, axes, n):
    """A few dozen edge cells for each ping cell, whatever the number of edges; a round coast is the worst case."""
    edges = coast(spark, n)
    pings = spark.range(20_000).select((11 + F.rand(1) * 4).alias("Lon"), (34 + F.rand(2) * 4).alias("Lat"))
    if axes == spatial.PLANE:
        rows, pieces = spatial._placed(pings), spatial.planar_pieces(spatial.project_edges(edges))
    else:
        u = spatial.unit_vector("Lon", "Lat")
        rows = pings.select(spatial._cell([u[k] * spatial.EARTH_M for k in range(3)], axes).alias("cell"))
        pieces = spatial.arc_pieces(edges)
    leaves, others = spatial._leaves(rows).cache(), pieces.select("other").distinct().cache()
    for k in (2, 4, 6):
        level = spatial.LEVELS[k - 1]
        pairs = spatial.descend(leaves, others, axes, spatial.LEVELS[:k]).count()
        up = lambda t, c: t.select(spatial._parent(c, axes, level - spatial.LEAF)).distinct().count()
        assert pairs <= 30 * (up(leaves, "cell") + up(others, "other")) + 100


def arc_nm(p, a, b):
    unit = lambda lon, lat: np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    p, a, b = (unit(*np.radians(v)) for v in (p, a, b))
    angle = lambda u, v: 2 * np.arcsin(min(1, np.linalg.norm(u - v) / 2))
    n = np.cross(a, b)
    if np.linalg.norm(n) > 1e-15 and np.cross(n, a) @ p >= 0 and np.cross(b, n) @ p >= 0:
        best = np.arcsin(min(1, abs(n @ p) / np.linalg.norm(n)))
    else:
        best = min(angle(p, a), angle(p, b))
    return best * spatial.EARTH_M / 1852.0


def test_great_circle_distance(spark):
    rng = np.random.default_rng(8)
    arcs = [(k, *map(float, (rng.uniform(-180, 180), rng.uniform(-85, 85), rng.uniform(-180, 180), rng.uniform(-85, 85)))) for k in range(12)]
    arcs += [(20, 179.5, 10.0, -179.0, 11.0), (21, 10.0, 50.0, 10.0, 50.0), (22, 0.0, 89.9, 180.0, 89.9)]
    pings = [(k, *map(float, (rng.uniform(-180, 180), rng.uniform(-90, 90)))) for k in range(400)]
    pings += [(400, 179.99, 10.3), (401, -179.99, 10.3), (402, 77.0, 90.0), (403, None, 1.0)]
    edges = spark.createDataFrame(arcs, "geom_id long, x1 double, y1 double, x2 double, y2 double")
    rows = spark.createDataFrame(pings, "id long, Lon double, Lat double")
    got = {r.id: r.d for r in spatial.distance_nm(rows, edges, "d", P, polygons=False, metric="haversine").collect()}
    assert got.pop(403) is None and len(got) == 403
    for k, lon, lat in pings[:-1]:
        assert got[k] == pytest.approx(min(arc_nm((lon, lat), e[1:3], e[3:]) for e in arcs), abs=1e-6)


def test_one_minute_of_latitude_is_about_a_mile(spark):
    edges = spark.createDataFrame([(1, 12.0, 36.0, 13.0, 36.0)], "geom_id long, x1 double, y1 double, x2 double, y2 double")
    rows = spark.createDataFrame([(12.0, 35.0)], "Lon double, Lat double")
    near = lambda m: spatial.distance_nm(rows, edges, "d", P, False, m).first().d
    assert near("haversine") == pytest.approx(60.04, abs=0.01)
    assert near("planar") == pytest.approx(60.04 / np.cos(np.radians(35.5)), rel=0.01)
    with pytest.raises(ValueError):
        near("other")


def test_both_metrics_agree_on_the_inside(spark):
    edges = coast(spark, 300).cache()
    rows = spark.range(3000).select("id", (11 + F.rand(5) * 4).alias("Lon"), (34 + F.rand(6) * 4).alias("Lat")).cache()
    both = spatial.distance_nm(spatial.distance_nm(rows, edges, "a", P), edges, "b", P, metric="haversine")
    assert both.filter("(a = 0) <> (b = 0)").count() == 0
    assert 200 < both.filter("a = 0").count() < 2800
    # planar metres are stretched by 1 / cos(latitude)
    assert both.filter("a > 1 and abs(b / a - 0.809) > 0.03").count() == 0


def test_doubled_edges_and_no_edges(spark):
    square = [(1, 12.0, 36.0, 13.0, 36.0), (1, 13.0, 36.0, 13.0, 37.0), (1, 13.0, 37.0, 12.0, 37.0), (1, 12.0, 37.0, 12.0, 36.0)]
    kinds = "geom_id long, x1 double, y1 double, x2 double, y2 double"
    spur = [(1, 12.5, 36.0, 12.5, 35.0)] * 2  # there and back: no inside of its own
    rows = spark.createDataFrame([(12.4, 36.5), (12.6, 35.5)], "Lon double, Lat double")
    got = [r.d for r in spatial.distance_nm(rows, spark.createDataFrame(square + spur, kinds), "d", P).orderBy("Lon").collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(0.1 * 60 * 1.0011, rel=0.01)
    assert spatial.distance_nm(rows, spark.createDataFrame([], kinds), "d", P).filter("d is null").count() == 2
    for metric in ("planar", "haversine"):
        assert spatial.distance_nm(rows.limit(0), spark.createDataFrame(square, kinds), "d", P, metric=metric).count() == 0


def crowded_layer(spark, n=1200, copies=1):
    """(rows, n distinct edges in a few leaf cells, each some times, as tuples): lists are far longer than LONG."""
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 0.08, (n, 2)) + (12.0, 36.0)
    to = at + rng.uniform(-0.004, 0.004, (n, 2))
    edges = [(k, *map(float, (*at[k], *to[k]))) for k in range(n)]
    pings = [(k, *map(float, rng.uniform(0, 0.08, 2) + (12.0, 36.0))) for k in range(150)]
    pings += [(150 + k, *pings[k][1:]) for k in range(40)] + [(190, None, 36.0), (191, 12.0, None), (192, None, None), (193, 12.5, 36.5)]
    frame = spark.createDataFrame(edges * copies, "geom_id long, x1 double, y1 double, x2 double, y2 double")
    return spark.createDataFrame(pings, "id long, Lon double, Lat double"), frame, pings, edges


def plane_nm(p, a, b):
    flat = lambda lon, lat: 6378137.0 * np.array([np.radians(lon), np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))])
    p, a, b = flat(*p), flat(*a), flat(*b)
    t = min(max((p - a) @ (b - a) / ((b - a) @ (b - a)), 0), 1)
    return np.linalg.norm(p - a - t * (b - a)) / 1852.0


@pytest.mark.parametrize("metric, plain, group_rows", [("planar", plane_nm, 3), ("haversine", arc_nm, 200_000)])
def test_crowded_cells_are_split(spark, metric, plain, group_rows, monkeypatch):
    """Each list of a crowded layer is short in the end, and the distances are those of all edges; repeated pings stay."""
    rows, edges, pings, plain_edges = crowded_layer(spark)
    stored, real = [], spatial.durable
    monkeypatch.setattr(spatial, "durable", lambda df: stored.append(real(df)) or stored[-1])
    got = {r.id: r.d for r in spatial.distance_nm(rows, edges, "d", Params(group_rows=group_rows), False, metric).collect()}
    assert len(got) == len(pings) and sorted(k for k, v in got.items() if v is None) == [190, 191, 192]
    for k, lon, lat in pings[:150:3] + pings[-1:]:
        assert got[k] == pytest.approx(min(plain((lon, lat), e[1:3], e[3:]) for e in plain_edges), abs=1e-7)
    assert all(got[150 + k] == got[k] for k in range(40))
    lists = [t for t in stored if "home" in t.columns and "Lon" not in t.columns and len(t.columns) > 2][-1]
    assert lists.groupBy("home").count().agg(F.max("count")).first()[0] <= 2 * spatial.LONG


def test_equal_edges_are_met_once(spark, monkeypatch):
    """A layer that holds each edge five times is cut into pieces and listed as if it held it once."""
    rows, once, _, _ = crowded_layer(spark, 60)
    often = crowded_layer(spark, 60, 5)[1]
    real, sizes = spatial.durable, []
    for edges in (once, often):
        seen = []
        monkeypatch.setattr(spatial, "durable", lambda df: (seen.append(real(df)), seen[-1])[1])
        sizes.append([spatial.distance_nm(rows, edges, "d", P, False).agg(F.sum("d")).first()[0], [t.count() for t in seen]])
    assert sizes[0][1] == sizes[1][1] and sizes[0][0] == pytest.approx(sizes[1][0])


@pytest.mark.parametrize("metric", ["planar", "haversine"])
def test_no_table_of_the_descent_is_broadcast(spark, metric, monkeypatch):
    """Layer tables look small to a plan, as a file of few bytes makes them; only cells of the top levels are broadcast."""
    plans, real = [], spatial.durable
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spatial, "durable", lambda df: (plans.append((df.columns, shown(df))), real(df))[1])
    rows = spark.createDataFrame([(12.4, 36.5), (12.6, 35.5)], "Lon double, Lat double")
    out = spatial.distance_nm(rows, coast(spark, 50), "d", P, metric=metric)
    plans.append((out.columns, shown(out)))
    for columns, plan in plans:
        assert columns == ["cell", "other"] or "Broadcast" not in plan
    assert len(plans) > 5


def test_whole_cells_and_holes_of_polygons(spark):
    """A geometry that holds a whole leaf cell, one with a hole, and two that overlap there, against the even-odd rule."""
    def ring(g, x, y, w):
        c = [(x - w, y - w), (x + w, y - w), (x + w, y + w), (x - w, y + w)]
        return [(g, *map(float, (*c[k], *c[(k + 1) % 4]))) for k in range(4)]

    plain = ring(1, 12, 36, 0.5) + ring(1, 12, 36, 0.2) + ring(2, 12.1, 36.1, 0.15) + ring(3, 12.05, 36.0, 0.01) + ring(None, 13, 36, 0.2)
    edges = spark.createDataFrame(plain, "geom_id long, x1 double, y1 double, x2 double, y2 double")
    rng = np.random.default_rng(3)
    pings = [(k, *map(float, rng.uniform(-0.7, 0.7, 2) + (12, 36))) for k in range(400)]
    rows = spark.createDataFrame(pings, "id long, Lon double, Lat double")
    got = {r.id: r.d for r in spatial.distance_nm(rows, edges, "d", P).collect()}
    holds = lambda x, y, cx, cy, w: abs(x - cx) < w and abs(y - cy) < w
    for k, x, y in pings:
        ring_1 = holds(x, y, 12, 36, 0.5) and not holds(x, y, 12, 36, 0.2)
        assert (got[k] == 0) == (ring_1 or holds(x, y, 12.1, 36.1, 0.15) or holds(x, y, 12.05, 36.0, 0.01))
