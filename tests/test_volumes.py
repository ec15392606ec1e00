"""Operators of volumes, lines and files that SQL doesn't check."""

import numpy as np
import pandas as pd
import pytest

from gridskein import sources
from gridskein.grid import Grid
from gridskein.operators import features, kernels, statistics, tracking
from gridskein.queries import QUERIES
from gridskein.queries._cube import GRID, LATS, LONS, cube, cube_z

from .oracle import DATA

SF = f"{DATA}/sf0.001"


def test_axes_of_deformation(spark):
    """Eigenvectors of the deformation that numpy makes of the neighbours' differences, cell by cell."""
    c = cube_z(spark, SF).filter("t = 1").toPandas()
    shape = (5, 10, 64)
    field = {n: np.empty(shape) for n in ("u", "v", "w", "dx", "dy")}
    for n, a in field.items():
        a[c["k"], c["j"], c["i"]] = c[n]
    got = QUERIES["diag_def_3d_axes"](spark, SF).filter("t = 1").toPandas()
    assert len(got) == 3 * 8 * 64
    for r in got.sample(200, random_state=0).itertuples():
        k, j, i = r.k, r.j, r.i
        g = np.array([[(field[n][k, j, (i + 1) % 64] - field[n][k, j, i - 1]) / field["dx"][k, j, i], (field[n][k, j + 1, i] - field[n][k, j - 1, i]) / field["dy"][k, j, i], (field[n][k + 1, j, i] - field[n][k - 1, j, i]) / -3000.0] for n in "uvw"])
        s = (g + g.T) / 2 - np.trace(g) / 3 * np.eye(3)
        for n, e in (("max", r.e_max), ("mid", r.e_mid), ("min", r.e_min)):
            x = np.array([getattr(r, f"{n}_{c}") for c in "xyz"])
            assert abs(np.linalg.norm(x) - 1) < 1e-5 and np.abs(s @ x - e * x).max() < 1e-5 * max(abs(r.e_max), abs(r.e_min)) and x[np.abs(x).argmax()] > 0


def test_natural_axes_come_back(spark):
    """Eigenvectors in coordinates of the flow, turned back, are those of the turned gradient."""
    rng = np.random.default_rng(1)
    g, (u, v, w) = rng.normal(size=(20, 3, 3)), rng.normal(size=(3, 20))
    turn = kernels.flow_axes(u, v, w)
    assert np.allclose(turn @ turn.transpose(0, 2, 1), np.eye(3)) and np.allclose((turn @ np.stack([u, v, w], axis=1)[:, :, None])[:, 1:], 0)
    e, x = kernels.deformation_axes(g, "all", turn)
    for n in range(20):
        a = turn[n] @ g[n]
        s = (a + a.T) / 2 - np.trace(a) / 3 * np.eye(3)
        assert np.allclose(s @ turn[n] @ x[n].T, turn[n] @ x[n].T * e[n])


def test_smoothing_with_missing_cells(spark):
    c = cube(spark, SF).toPandas()
    u = np.empty((10, 50, 64))
    u[c["t"], c["j"], c["i"]] = np.where(c["v"].between(-1, 1), np.nan, c["u"])
    mean = np.nanmean(u, axis=2).mean(axis=0)[None, :, None]
    filled = np.stack([kernels.fill_missing(a, True) for a in u - mean]) + mean
    for _ in range(2):
        d = np.roll(filled, -1, axis=2) - 2 * filled + np.roll(filled, 1, axis=2)
        d[:, 1:-1] += filled[:, 2:] - 2 * filled[:, 1:-1] + filled[:, :-2]
        filled = filled + d / 6
    want = np.where(np.isnan(u), np.nan, filled)
    got = np.full_like(want, np.nan)
    rows = QUERIES["filter_smooth_xy_nan"](spark, SF).toPandas()
    got[rows["t"], rows["j"], rows["i"]] = rows["u"]
    assert np.allclose(got, want, atol=2e-6, equal_nan=True) and np.isnan(got).any()


def test_polygons_in_degrees(spark):
    g = Grid(8, 5)
    lats, lons = [10.0 * j for j in range(5)], [45.0 * i for i in range(8)]
    box = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, 1), (b, 1), (b, 3), (a, 3), (a, 1))]
    frame = spark.createDataFrame([(1, box(2, 5)), (2, box(5, 10)), (3, [])], "id int, geometry array<struct<x:double,y:double>>")
    rows = sorted(features.polygons_to_coordinates(g, frame, lats, lons).collect(), key=lambda r: (r.id, r.part))
    bounds = [(r.id, r.part, *(f(p[c] for p in r.geometry) for c in "xy" for f in (min, max))) for r in rows]
    assert bounds == [(1, 0, 90.0, 225.0, 10.0, 30.0), (2, 0, 225.0, 315.0, 10.0, 30.0), (2, 1, 0.0, 90.0, 10.0, 30.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000])
def test_values_at_ranks(spark, n):
    rng = np.random.default_rng(n)
    values = np.r_[rng.normal(size=n // 2), np.full(n - n // 2, 0.25)]
    frame = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
    ranks = sorted({0, n // 3, n // 2, n - 1}) if n else []
    assert statistics.values_at_ranks(frame, "v", lambda m: ranks if m == n else None) == [sorted(values)[k] for k in ranks]
    low, high = statistics.percentile_thresholds(frame, "v", 0.1, 0.9).first()
    assert (low is None) == (n == 0)


def test_scales(spark):
    frame = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert statistics.scale_limits(frame, "v") == (0.0, 100.0) and statistics.scale_limits(frame, "v", "both") == (2.0, 98.0)
    assert statistics.scale_limits(frame, "v", "max", symmetric=True) == (-98.0, 98.0)
    assert statistics.scale_limits(frame.limit(0), "v") == (-0.5, 0.5) and statistics.scale_limits(frame.filter("v = 3"), "v") == (2.5, 3.5)
    assert statistics.scale_ticks((0.0, 100.0)) == [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
    assert statistics.scale_ticks((-0.3, 0.3), symmetric=True) == pytest.approx([-0.35, -0.25, -0.15, -0.05, 0.05, 0.15, 0.25, 0.35])


def test_netcdf_files_on_disk(spark, tmp_path):
    g = Grid(4, 3)
    rows = [(t, j, i, float(10 * t + j) + i / 8 if (j, i) != (1, 2) else None) for t in (0, 1) for j in range(3) for i in range(4)]
    frame = spark.createDataFrame(rows, "t int, j int, i int, a double")
    made = sources.netcdf_files(g, frame, ["a"], [1.0, 2.0, 3.0], [0.0, 90.0, 180.0, 270.0], {"a": (0.125, 2.0)}, {"a": {"units": "K"}})
    saved = sources.save_netcdf(made, str(tmp_path)).collect()
    assert sorted(r.path for r in saved) == [f"{tmp_path}/0.nc", f"{tmp_path}/1.nc"]
    back = sources.read_netcdf(spark, f"file://{tmp_path}/*.nc").toPandas()
    got = {(int(f.rsplit("/", 1)[1][0]), j, i): v for f, j, i, v in back[["file", "j", "i", "value"]].itertuples(index=False)}
    assert {k: None if pd.isna(v) else v for k, v in got.items()} == {(t, j, i): a for t, j, i, a in rows}
    axes = sources.netcdf_axes(spark, f"file://{tmp_path}/0.nc").toPandas()
    assert axes[axes["variable"] == "longitude"].sort_values("n")["value"].tolist() == [0.0, 90.0, 180.0, 270.0]


def test_axes_of_grids(spark, tmp_path):
    from pyspark.sql import functions as F

    np.savez(tmp_path / "static.npz", lat=np.array(LATS), lon=np.array(LONS))
    cells = sources.static_cells(spark, f"file://{tmp_path}/static.npz")
    known = cube(spark, SF).filter("t = 0").select("j", "i", "lat", "lon", "dx", "dy").toPandas().sort_values(["j", "i"]).to_numpy()
    assert np.allclose(cells.toPandas().sort_values(["j", "i"]).to_numpy(), known) and cells.count() == GRID.nx * GRID.ny
    np.savez(tmp_path / "other.npz", lat=np.array(LATS))
    with pytest.raises(ValueError, match="lat and lon"):
        sources.static_cells(spark, f"file://{tmp_path}/other.npz")
    unit = "hours since 2001-02-03 00:00:00"
    stamp = F.lit("2001-02-04 06:30:00").cast("timestamp")
    row = spark.range(1).select(sources.time_numbers(stamp, unit).alias("n"), stamp.alias("t")).withColumn("back", sources.parse_time_unit(F.col("n"), unit)).first()
    assert row.n == 30.5 and row.back == row.t
    assert [sources.vertical_axis(x)["values"] for x in (None, "sfc", "pv2000", "pt330", "850")] == [[], None, [2.0], [330.0], [85000.0]]


def test_spread_of_objects():
    """The rim gives the greatest distance of all cells."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        j, i = np.nonzero(rng.random((12, 30)) < 0.7)
        lat, lon = 5.0 + 6 * j, 12.0 * i
        y, x = np.radians(lat), np.radians(lon)
        every = 6371 * np.arccos(np.clip(np.sin(y)[:, None] * np.sin(y) + np.cos(y)[:, None] * np.cos(y) * np.cos(x[:, None] - x), -1, 1))
        assert np.isclose(kernels.spread_km(j, i, lat, lon, 30, True), every.max())


def test_rivers_by_brute_force(spark):
    """Labels on one side of the equator whose cells are far apart, from all pairs of cells."""
    c = cube(spark, SF).toPandas()
    rivers = QUERIES["conn_atmospheric_river"](spark, SF).toPandas()
    strong = cube(spark, SF).selectExpr("t", "j", "i", "hypot(u, v) > 3 AS m")
    own = features.label_connected_2d(GRID, strong, "m").toPandas().merge(c[["t", "j", "i", "lat", "lon"]], on=["t", "j", "i"])
    want = set()
    for (t, label), part in own.groupby(["t", "label"]):
        y, x = np.radians(part["lat"].to_numpy()), np.radians(part["lon"].to_numpy())
        far = 6371 * np.arccos(np.clip((np.sin(y)[:, None] * np.sin(y) + np.cos(y)[:, None] * np.cos(y) * np.cos(x[:, None] - x)).min(), -1, 1))
        if (part["lat"].min() > 0 or part["lat"].max() < 0) and (far > 1000 or (part["lat"].max() - part["lat"].min()) * 111 > 1000):
            want |= {(t, label, j, i) for j, i in zip(part["j"], part["i"], strict=True)}
    assert set(rivers[["t", "label", "j", "i"]].itertuples(index=False, name=None)) == want and want


def test_blocks_step_by_step(spark):
    """Blocks of all maxima in one loop over time."""
    g = Grid(36, 19)
    rng = np.random.default_rng(9)
    lat, lon = [-90.0 + 10 * j for j in range(19)], [10.0 * i for i in range(36)]
    rows, peaks = [], []
    for t in range(40):
        field = np.zeros((19, 36))
        for _ in range(int(rng.integers(0, 5))):
            field[rng.integers(12, 17), rng.integers(0, 36)] = rng.random() + 0.5
        for j in range(19):
            for i in range(36):
                rows.append((t, j, i, lat[j], lon[i], float(field[j, i])))
                around = [field[j + b, (i + a) % 36] for b in (-1, 0, 1) for a in (-1, 0, 1) if (a or b) and 0 <= j + b < 19]
                if field[j, i] > 0 and field[j, i] >= max(around) and 30 < lat[j] < 70:
                    peaks.append((t, j, i))
    apart = lambda a, b: abs((a - b + 180) % 360 - 180)
    blocks, before = {}, {}
    for t in range(40):
        now = {}
        for _, j, i in sorted(p for p in peaks if p[0] == t):
            fits = []
            for (j1, i1), (onset, name) in before.items():
                close = abs(lat[j] - lat[j1]) <= 27 and apart(lon[i], lon[i1]) <= 36 and abs(lat[j] - lat[onset[0]]) <= 40 and apart(lon[i], lon[onset[1]]) <= 54
                if close:
                    fits.append((np.hypot(lat[j] - lat[j1], apart(lon[i], lon[i1])), name, onset))
            name, onset = (min(fits)[1], min(fits)[2]) if fits else ((t * 19 + j) * 36 + i, (j, i))
            now[j, i] = onset, name
            blocks.setdefault(name, set()).add((t, j, i))
        before = now
    want = {(name, *p) for name, own in blocks.items() for p in own if len({t for t, _, _ in own}) >= 3}
    frame = spark.createDataFrame(rows, "t int, j int, i int, lat double, lon double, block double")
    got = {(r.block, r.t, r.j, r.i) for r in tracking.block_by_grad_rev(g, frame, min_steps=3).collect()}
    assert got == want and want


@pytest.mark.parametrize("tile", [(3, 4), (7, 50), (1, 1)])
def test_labels_are_the_same_in_tiles_of_any_size(spark, tile):
    from gridskein.operators import kernels
    from gridskein.operators.tiled_labels import label_tiles

    rng = np.random.default_rng(6)
    mask = rng.random((4, 11, 13)) < 0.5
    rows = [(int(t), int(j), int(i), bool(mask[t, j, i]) if rng.random() < 0.9 or mask[t, j, i] else None) for t, j, i in np.ndindex(mask.shape)]
    cube = spark.createDataFrame(rows, "t int, j int, i int, m boolean")
    for cyclic, diagonal, over_time in ((True, False, False), (False, True, False), (True, False, True)):
        found = {(r.t, r.j, r.i): r.label for r in label_tiles(Grid(13, 11, cyclic=cyclic), cube, "m", tile, diagonal, over_time).collect()}
        groups: dict = {}
        for cell, n in found.items():
            groups.setdefault((0 if over_time else cell[0], n), set()).add(cell)
        whole = kernels.label(mask, cyclic, diagonal) if over_time else np.stack([kernels.label(m, cyclic, diagonal) for m in mask])
        want: dict = {}
        for cell in zip(*map(np.ndarray.tolist, np.nonzero(whole)), strict=True):
            want.setdefault((0 if over_time else cell[0], int(whole[cell])), set()).add(cell)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
        if not over_time:
            assert groups == want


def test_rivers_are_found_slice_by_slice(spark, monkeypatch):
    """One group a slice, not one an object; the same objects as by comparing all cells of each."""
    plan = QUERIES["conn_atmospheric_river"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas [t") == 1 and "label" not in plan.split("FlatMapGroupsInPandas")[1].split("\n")[0].split("]")[0]
    rng, compared, spread = np.random.default_rng(5), [], kernels.spread_km
    monkeypatch.setattr(kernels, "spread_km", lambda *a: compared.append(1) or spread(*a))
    mask = rng.random((20, 40)) < 0.5
    label = kernels.label(mask, True)
    j, i = np.nonzero(mask)
    order = np.argsort(label[j, i], kind="stable")
    j, i = j[order], i[order]
    own, lat, lon, v = label[j, i], -40.0 + 5 * j, 9.0 * i, rng.normal(size=len(j))
    for poleward in (None, 0.3):
        kept = kernels.long_objects(own, j, i, lat, lon, v, 40, True, 900.0, poleward)
        for k in np.unique(own):
            at = own == k
            side = lat[at].min() > 0 or lat[at].max() < 0
            long = np.ptp(lat[at]) * 111 > 900 or spread(j[at], i[at], lat[at], lon[at], 40, True) > 900
            assert kept[at].all() == kept[at].any() == (side and long and (poleward is None or abs(v[at].mean()) >= poleward))
        assert 0 < kept.sum() < len(kept)
    assert 0 < len(compared) < own.max()
