"""Rotated and curvilinear grids against brute force."""

import struct

import numpy as np
import pytest

from gridskein.functions.sphere_geometry import geographic_position, north_of_rotated, rotated_position
from gridskein.grid import Grid, latlon_cells
from gridskein.operators import curvilinear as cv
from gridskein.sources import netcdf_cells, netcdf_rotations


def _unit(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def _warped(ny=11, nx=13, seed=3):
    """A small curvilinear grid over the north pole, its cells shaken."""
    rng = np.random.default_rng(seed)
    j, i = np.indices((ny, nx))
    y, x = (j - ny / 2 + rng.uniform(-0.2, 0.2, j.shape)) * 0.08, (i - nx / 2 + rng.uniform(-0.2, 0.2, j.shape)) * 0.08
    p = np.stack([x, y, np.ones_like(x)], -1)
    p /= np.linalg.norm(p, axis=-1, keepdims=True)
    return np.degrees(np.arcsin(p[..., 2])), np.degrees(np.arctan2(p[..., 1], p[..., 0])), p


def _cells(spark, lat, lon):
    rows = [(j, i, float(lat[j, i]), float(lon[j, i])) for j, i in np.ndindex(lat.shape)]
    return spark.createDataFrame(rows, "j int, i int, lat double, lon double")


def _places(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    found = [(float(90 - 30 * a), float(b)) for a, b in zip(rng.random(n), rng.uniform(-180, 180, n), strict=True)]
    return found, spark.createDataFrame([*found, found[0], (90.0, 0.0), (None, 1.0), (80.0, None), (-40.0, 10.0)], "lat double, lon double")


def test_positions_turn_there_and_back(spark):
    df = spark.createDataFrame([(a, b) for a in (-179.0, -60.0, 0.0, 33.0, 170.0) for b in (-89.0, -20.0, 0.0, 55.0)], "a double, b double")
    lon, lat = geographic_position("a", "b", -170.0, 40.0)
    there = df.select("a", "b", lon.alias("lon"), lat.alias("lat"))
    ra, rb = rotated_position("lon", "lat", -170.0, 40.0)
    for r in there.select("*", ra.alias("ra"), rb.alias("rb")).collect():
        assert abs((r.ra - r.a + 180) % 360 - 180) < 1e-9 and abs(r.rb - r.b) < 1e-9
    pole = spark.range(1).select(*[c.alias(n) for c, n in zip(geographic_position(0.0, 90.0, -170.0, 40.0), ("lon", "lat"), strict=True)]).first()
    assert abs(pole.lat - 40) < 1e-6 and abs(pole.lon + 170) < 1e-6


def test_north_is_where_latitude_grows(spark):
    h = 1e-4
    df = spark.createDataFrame([(a, b) for a in (-150.0, -20.0, 5.0, 120.0) for b in (-60.0, 10.0, 70.0)], "a double, b double")
    lat = lambda x, y: geographic_position(x, y, 20.0, 50.0)[1]
    x, y = north_of_rotated("a", "b", 50.0)
    rows = df.selectExpr("a", "b", f"a + {h} AS a2", f"b + {h} AS b2").select("b", x.alias("x"), y.alias("y"), lat("a", "b").alias("l"), lat("a2", "b").alias("lx"), lat("a", "b2").alias("ly")).collect()
    for r in rows:
        gx, gy = (r.lx - r.l) / h / np.cos(np.radians(r.b)), (r.ly - r.l) / h
        assert abs(gx - r.x * np.hypot(gx, gy)) < 1e-4 and abs(gy - r.y * np.hypot(gx, gy)) < 1e-4


@pytest.mark.parametrize("reach", [150e3, 700e3, 3000e3])
def test_nearest_by_brute_force(spark, reach):
    lat, lon, p = _warped()
    places, df = _places(spark)
    found = {(r.lat, r.lon): (r.j, r.i, r.distance) for r in cv.nearest_cells(_cells(spark, lat, lon), df, reach).collect()}
    want = {}
    for a, b in [*places, (90.0, 0.0), (-40.0, 10.0)]:
        d = 2 * 6.37e6 * np.arcsin(np.minimum(1, np.linalg.norm(p - _unit(a, b), axis=-1) / 2))
        j, i = np.unravel_index(d.argmin(), d.shape)
        if d[j, i] <= reach:
            want[a, b] = (j, i, d[j, i])
    assert found.keys() == want.keys() and len(want) > 10
    for k, (j, i, d) in want.items():
        assert found[k][:2] == (j, i) and abs(found[k][2] - d) < 1


def _brute(p, place):
    """Weights {(j, i): w} of a place: Newton's steps in every quad, taken where they end inside."""
    q = _unit(*place)
    lat, lon = np.radians(place)
    axes = np.array([[-np.sin(lon), np.cos(lon), 0], [-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)]])
    for j, i in np.ndindex(p.shape[0] - 1, p.shape[1] - 1):
        c = np.array([p[j, i], p[j, i + 1], p[j + 1, i], p[j + 1, i + 1]])
        if (c @ q).min() <= 0:
            continue
        f = (c @ axes.T) / (c @ q)[:, None]
        a = b = 0.5
        for _ in range(30):
            w = np.array([(1 - a) * (1 - b), a * (1 - b), (1 - a) * b, a * b])
            jac = np.array([(1 - b) * (f[1] - f[0]) + b * (f[3] - f[2]), (1 - a) * (f[2] - f[0]) + a * (f[3] - f[1])]).T
            if abs(np.linalg.det(jac)) < 1e-14:
                break
            a, b = np.array([a, b]) - np.linalg.solve(jac, w @ f)
        if -1e-9 <= a <= 1 + 1e-9 and -1e-9 <= b <= 1 + 1e-9 and np.abs(w @ f).max() < 1e-9:
            return {(j, i): w[0], (j, i + 1): w[1], (j + 1, i): w[2], (j + 1, i + 1): w[3]}
    return {}


@pytest.mark.parametrize("edge", [None, 0.02, 0.5, 3.0])
def test_weights_by_brute_force_for_any_edge(spark, edge):
    lat, lon, p = _warped()
    places, df = _places(spark)
    found = {}
    for r in cv.bilinear_weights(Grid(13, 11, cyclic=False), _cells(spark, lat, lon), df, edge).collect():
        found.setdefault((r.lat, r.lon), {})[r.j, r.i] = r.weight
    want = {place: w for place in [*places, (90.0, 0.0)] if (w := _brute(p, place))}
    assert found.keys() == want.keys() and 20 < len(want) < 61 and (90.0, 0.0) in want
    for place, w in want.items():
        assert abs(sum(found[place].values()) - 1) < 1e-12
        assert all(abs(found[place].get(k, 0.0) - x) < 1e-9 for k, x in w.items())


def test_cells_and_sides_are_met_exactly(spark):
    """Places on cells and half-way on sides, over the date line and on a row at the pole; holes and NULLs in the cube."""
    g, lats, lons = Grid(8, 3), [50.0, 70.0, 90.0], [45.0 * i for i in range(8)]
    places = spark.createDataFrame([(50.0, 315.0), (50.0, -22.5), (90.0, 0.0), (80.0, 337.5), (49.0, 3.0)], "lat double, lon double")
    w = cv.bilinear_weights(g, latlon_cells(spark, lats, lons), places)
    found = {}
    for r in w.collect():
        found.setdefault((r.lat, r.lon), {})[r.j, r.i] = round(r.weight, 9)
    assert found[50.0, 315.0][0, 7] == 1 and (50.0, -22.5) not in found  # the side is a great circle, north of 50 degrees between cells
    assert sum(x for (j, _), x in found[90.0, 0.0].items() if j == 2) == pytest.approx(1, abs=1e-6)
    assert found[80.0, 337.5][1, 7] == found[80.0, 337.5][1, 0] > 0 and (49.0, 3.0) not in found
    cube = spark.createDataFrame([(t, j, i, float(j) if (t, j, i) != (1, 1, 7) else None) for t in range(3) for j in range(3) for i in range(8) if (t, j, i) != (2, 1, 0)], "t int, j int, i int, v double")
    values = {(r.t, r.lat, r.lon): r.v for r in cv.at_places(cube, w, "v").collect()}
    assert 1 < values[0, 80.0, 337.5] < 2 and values[1, 80.0, 337.5] is None and values[2, 80.0, 337.5] is None and values[1, 50.0, 315.0] == 0
    assert cv.bilinear_weights(g, latlon_cells(spark, lats, lons).limit(0), places).count() == 0


def _rotated_file(mapping=True):
    """A file with rlat = 2, rlon = 3; axes, true positions, and a mapping about a rotated pole."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda key, value: name(key) + struct.pack(">iid", 6, 1, value)
    pole = (struct.pack(">ii", 12, 2) + number("grid_north_pole_latitude", 35.0) + number("grid_north_pole_longitude", -160.0)) if mapping else struct.pack(">ii", 0, 0)
    parts = [("rlat", [0], [10.0, 12.0]), ("rlon", [1], [-4.0, 0.0, 4.0]), ("latitude", [0, 1], [60.0, 61, 62, 63, 64, 65]), ("longitude", [0, 1], [1.0, 2, 3, 4, 5, 6]), ("rotated_pole", [], [0.0])]

    def header(begin):
        out = b"CDF\1" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("rlat") + struct.pack(">i", 2) + name("rlon") + struct.pack(">i", 3) + struct.pack(">iiii", 0, 0, 11, 5)
        for key, dims, values in parts:
            out += name(key) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + (pole if not dims else struct.pack(">ii", 0, 0)) + struct.pack(">iii", 6, 8 * len(values), begin)
            begin += 8 * len(values)
        return out

    return header(len(header(0))) + b"".join(struct.pack(f">{len(v)}d", *v) for _, _, v in parts)


def test_grids_from_files(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(_rotated_file())
    (tmp_path / "b.nc").write_bytes(_rotated_file(False))
    poles = netcdf_rotations(spark, str(tmp_path)).collect()
    assert [(r.variable, r.pole_lat, r.pole_lon) for r in poles] == [("rotated_pole", 35.0, -160.0)]
    cells = {(r.j, r.i): r for r in netcdf_cells(spark, str(tmp_path / "a.nc")).collect()}
    same = {(r.j, r.i): r for r in cv.rotated_cells(spark, [10.0, 12.0], [-4.0, 0.0, 4.0], 35.0, -160.0).collect()}
    assert cells == same and len(same) == 6
    assert abs(cells[0, 1].lat - 65) < 1e-9 and abs(cells[0, 1].lon - 20) < 1e-9 and cells[0, 1].north_x == pytest.approx(0) and cells[0, 1].north_y == pytest.approx(1)
    plain = {(r.j, r.i): (r.lat, r.lon) for r in netcdf_cells(spark, str(tmp_path / "b.nc")).collect()}
    assert plain[0, 2] == (62, 3) and plain[1, 0] == (63, 4)
    with pytest.raises(ValueError, match="neither"):
        netcdf_cells(spark, str(tmp_path / "b.nc"), names=("lat", "lon"))
