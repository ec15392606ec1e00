"""Queries of objects against plain loops, on fields whose own operators SQL checks."""

import collections

import numpy as np
import pytest

from gridskein.queries import QUERIES
from gridskein.queries import objects as q
from gridskein.queries._cube import GRID, cube, cube_z

from .oracle import DATA

SF = f"{DATA}/sf0.001"


def _fields(frame, names, shape):
    rows = frame.toPandas()
    place = tuple(rows[a].to_numpy() for a in ("t", "k", "j", "i") if a in rows)
    out = {}
    for n in names:
        out[n] = np.full(shape, np.nan)
        out[n][place] = rows[n]
    return out


def _km(lat1, lon1, lat2, lon2, r=6370.0):
    a, b = np.radians(lat1), np.radians(lat2)
    return r * np.arccos(np.clip(np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(lon2) - np.radians(lon1)), -1, 1))


@pytest.fixture(scope="module")
def smooth(spark):
    return _fields(q._smooth(spark, SF), ("u", "v", "msl", "rain", "lat", "lon", "dx", "dy"), (10, 50, 64))


def test_filled_cells_are_means_of_their_neighbours(spark):
    given = _fields(cube(spark, SF), ("u", "v"), (10, 50, 64))
    gone = (given["v"] >= -1) & (given["v"] <= 1)
    got = _fields(QUERIES["filter_fill_nan"](spark, SF), ("u",), (10, 50, 64))["u"]
    assert np.allclose(got[~gone], given["u"][~gone], atol=1e-6)
    up, down = np.concatenate([got[:, 1:], got[:, -2:-1]], axis=1), np.concatenate([got[:, 1:2], got[:, :-1]], axis=1)
    mean = (np.roll(got, 1, axis=2) + np.roll(got, -1, axis=2) + up + down) / 4
    assert np.abs(mean - got)[gone].max() < 1e-4 and gone.any()


def test_frontal_volumes_by_flood(spark):
    f = _fields(cube_z(spark, SF), ("u", "dx", "dy"), (10, 5, 10, 64))
    x = (np.roll(f["u"], -1, axis=3) - np.roll(f["u"], 1, axis=3)) / f["dx"]
    y = np.full_like(x, np.nan)
    y[:, :, 1:-1] = (f["u"][:, :, 2:] - f["u"][:, :, :-2]) / f["dy"][:, :, 1:-1]
    strong = np.nan_to_num(np.hypot(x, y)) > 1e-6
    want = set()
    for t in range(10):
        left = {(i, j, k) for k, j, i in zip(*np.nonzero(strong[t]), strict=True)}
        n = 0
        while left:
            todo, part = [min(left)], []
            left.discard(todo[0])
            while todo:
                i, j, k = todo.pop()
                part.append((k, j, i))
                for c in [((i + a) % 64, j + b, k + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]:
                    if c in left:
                        left.discard(c)
                        todo.append(c)
            n += 1
            if sum(f["dx"][t, k, j, i] * f["dy"][t, k, j, i] / 4 for k, j, i in part) >= 1e10 * 5:
                want |= {(t, n, *c) for c in part}
    got = {(r.t, r.label, r.k, r.j, r.i) for r in QUERIES["conn_frontalvolume"](spark, SF).collect()}
    assert got == want and want


def _inside(x, y, px, py):
    odd = False
    for k in range(len(px)):
        if (py[k] > y) != (py[k - 1] > y) and x < (px[k - 1] - px[k]) * (y - py[k]) / (py[k - 1] - py[k]) + px[k]:
            odd = not odd
    return odd


def _from_edge(x, y, px, py):
    best = np.inf
    for k in range(len(px)):
        a, d = np.array([px[k - 1], py[k - 1]]), np.array([px[k] - px[k - 1], py[k] - py[k - 1]])
        f = 0.0 if not d.any() else np.clip(((x, y) - a) @ d / (d @ d), 0, 1)
        best = min(best, np.hypot(*((x, y) - a - f * d)))
    return best


def test_events_on_the_grid(spark):
    events = q._polygons(spark, SF).select("t", "event", "geometry").collect()
    cells = {(r.t, r.event, r.j, r.i) for r in QUERIES["event_to_grid"](spark, SF).collect()}
    own = collections.defaultdict(set)
    for t, event, j, i in cells:
        own[t, event].add((j, i))
    for r in sorted(events, key=lambda r: r.event)[:40]:
        px, py = [p.x for p in r.geometry], [p.y for p in r.geometry]
        want = set()
        for j in range(50):
            for i in range(int(min(px)) - 2, int(max(px)) + 3):
                if _inside(i, j, px, py) or _from_edge(i, j, px, py) <= 0.5:
                    want.add((j, i % 64))
        assert own[r.t, r.event] == want
    f = _fields(cube(spark, SF), ("u", "lat", "lon", "dx", "dy"), (10, 50, 64))
    for r in QUERIES["event_properties"](spark, SF).collect():
        at = tuple(np.array([(r.t, j, i) for j, i in own[r.t, r.event]]).T)
        area = f["dx"][at] * f["dy"][at] / 4e6
        want = [(area * f[n][at]).sum() / area.sum() for n in ("u", "lon", "lat")] + [area.sum()]
        assert np.allclose([r.mean_var, r.com_lon, r.com_lat, r.event_area], want, atol=0.011)


def test_rain_by_the_masks_that_touch_it(spark, smooth):
    blobs = q.ft.precip_blobs(GRID, q._smooth(spark, SF), "rain", 500.0).select("t", "cells").collect()
    want = collections.defaultdict(float)
    for r in blobs:
        u = [smooth["u"][r.t, c.j, c.i] for c in r.cells]
        name = ("A" if max(u) > 1.5 else "") + ("B" if min(u) < -1.5 else "") or "U"
        want[r.t, name] += sum(smooth["rain"][r.t, c.j, c.i] for c in r.cells)
    got = {(r.t, r.combination): r.total for r in QUERIES["cyc_attribute_to_features"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_lows_by_plain_search(spark, smooth):
    """Greatest Laplacians and least pressures that are each other's nearest, then what is left of the former and least gradients."""
    msl, dx, dy = smooth["msl"], smooth["dx"], smooth["dy"]
    e, w = np.roll(msl, -1, axis=2), np.roll(msl, 1, axis=2)
    n, s = np.full_like(msl, np.nan), np.full_like(msl, np.nan)
    n[:, :-1], s[:, 1:] = msl[:, 1:], msl[:, :-1]
    lap = 4 * ((e - 2 * msl + w) / dx**2 + (n - 2 * msl + s) / dy**2)
    grad = np.hypot((e - w) / dx, (n - s) / dy)

    def box(a, pick):
        out = np.full_like(a, np.nan)
        around = [np.roll(a[:, 1 + b : 49 + b], -c, axis=2) for b in (-1, 0, 1) for c in (-1, 0, 1) if (b, c) != (0, 0)]
        out[:, 1:-1] = pick(np.stack([np.where(np.isnan(x), np.inf if pick is np.min else -np.inf, x) for x in around]), axis=0)
        return out

    mean = np.stack([[msl[t, max(0, j - 3) : j + 4].mean(axis=0) for j in range(50)] for t in range(10)])
    found = set()
    for t in range(10):
        for hemis in "NS":
            ok = ~np.isnan(lap[t]) & ~np.isnan(grad[t]) & ((smooth["lat"][t] >= 0) == (hemis == "N"))
            cells = lambda m: [tuple(c) for c in np.argwhere(m & ok)]  # noqa: B023, E731
            d = lambda a, b: 1000 * _km(smooth["lat"][t][a], smooth["lon"][t][a], smooth["lat"][t][b], smooth["lon"][t][b])  # noqa: B023, E731
            is_low = msl[t] < box(msl, np.min)[t]
            laps = [c for c in cells(lap[t] > box(lap, np.max)[t]) if lap[t][c] >= 1e-12]
            lows, flats = cells(is_low), cells((grad[t] < box(grad, np.min)[t]) & ~is_low)

            def match(a, b):
                near = {x: min(((d(x, y), y) for y in b if d(x, y) < 500e3), default=None) for x in a}  # noqa: B023
                back = {y: min(((d(x, y), x) for x in a if d(x, y) < 500e3), default=None) for y in b}  # noqa: B023
                return [(x, v[1]) for x, v in near.items() if v and back[v[1]][1] == x]

            closed = [(x, y) for x, y in match(laps, lows) if mean[t][y] - msl[t][y] > 20]
            used = {x for x, _ in closed}
            opened = [(x, y) for x, y in match([x for x in laps if x not in used], flats) if mean[t][y] - msl[t][y] >= 1]
            both = [("closed", x, y) for x, y in closed] + [("open", x, y) for x, y in opened]
            for kind, x, y in both:
                if not any((lap[t][a], (-b[0], -b[1])) > (lap[t][x], (-y[0], -y[1])) and d(b, y) < 750e3 for _, a, b in both if (a, b) != (x, y)):
                    found.add((t, hemis, kind, *map(int, y)))
    got = {(r.t, r.hemis, r.kind, r.j, r.i) for r in QUERIES["cyc_locate_cyclones"](spark, SF).collect()}
    assert got == found and found


def test_fronts_of_all_kinds_come_from_one_pass(spark):
    from pyspark.sql import functions as F

    from gridskein import plans
    from gridskein.operators import diagnostics as dg
    from gridskein.operators import features as ft
    from gridskein.operators.filters import smooth_xy
    from gridskein.queries import objects

    folder, cells = "/root/testdata/sf0.001", objects._cells(spark)
    lines = plans.front_lines(objects.GRID, objects._smooth(spark, folder), "th", "u", "v", cells, True, objects.COARSE)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= 4  # those of the zero lines
    cube = objects._smooth(spark, folder)
    for c in ("th", "u", "v"):
        cube = smooth_xy(objects.GRID, cube, c, objects.COARSE.nsmooth)
    cube = dg.front_maxcurv(objects.GRID, cube, "th", "u", "v")
    strong, speed, t = F.col("front_int") > objects.COARSE.frint_thres, F.col("front_spd"), objects.COARSE.frspd_thres
    cold = ft.zero_lines(objects.GRID, cube, "front_loc", strong & (-speed > t), cells, objects.COARSE)
    cold = ft.with_payload(objects.GRID, cold, cube, "front_int")
    found = {tuple(r) for r in lines.filter("type = 'cold'").select(*cold.columns).collect()}
    assert found == {tuple(r) for r in cold.collect()} and len(found) > 50
    assert {r.type for r in lines.select("type").distinct().collect()} <= {"cold", "warm", "stationary"}
