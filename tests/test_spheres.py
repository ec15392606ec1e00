"""Wave breaking, harmonics of vectors, multigrid and classic netCDF files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridskein.grid import Grid
from gridskein.operators import features as ft
from gridskein.operators import harmonics as hm
from gridskein.operators import kernels as k
from gridskein.operators import wave_breaking as wb
from gridskein.sources import netcdf_axes, read_netcdf
from gridskein.sources.netcdf import ClassicFile

LATS, LONS = np.arange(-88.5, 90, 3.0), 5.625 * np.arange(64)
LEVELS = wb.contour_levels("PT", 21)


def _waves(tilt, size=60.0):
    """Waves whose crests lean east towards the north by ``tilt`` degrees a degree."""
    lon, lat = np.meshgrid(LONS, LATS)
    return 330 + 0.9 * lat + size * np.cos(np.radians(lat)) * np.sin(np.radians(3 * (lon - tilt * lat)))


def test_levels_of_contours():
    assert LEVELS[0] == 280 and LEVELS[10] == 330 and LEVELS[-1] == 380
    assert wb.contour_levels("Z5", 3) == [52150, 52500, 52850]


def test_breaking_by_tilt_and_hemisphere():
    north, south = LATS > 0, LATS < 0
    a, c = wb.breaking_cells(_waves(1.2), LATS, LONS, LEVELS)
    assert a[north].any() and not c[north].any() and c[south].any() and not a[south].any()
    a, c = wb.breaking_cells(_waves(-1.2), LATS, LONS, LEVELS)
    assert c[north].any() and not a[north].any() and a[south].any() and not c[south].any()


def test_no_breaking_without_overturning():
    for field in (_waves(0.0), _waves(1.2, 10.0), np.full((60, 64), 330.0), np.full((60, 64), np.nan)):
        a, c = wb.breaking_cells(field, LATS, LONS, LEVELS)
        assert not a.any() and not c.any()


def test_breaking_is_where_the_field_reverses():
    field = _waves(1.2)
    a, c = wb.breaking_cells(field, LATS, LONS, LEVELS)
    back = np.zeros(field.shape, bool)
    back[:-1] = field[1:] < field[:-1]
    near = back | np.roll(back, 1, 1) | np.roll(back, -1, 1) | np.roll(back, 1, 0) | np.roll(back, -1, 0)
    assert ((a | c) & near).sum() > 0.95 * (a | c).sum()


def test_order_of_rows_and_first_longitude_are_free():
    a, c = wb.breaking_cells(_waves(1.2), LATS, LONS, LEVELS)
    b, d = wb.breaking_cells(_waves(1.2)[::-1], LATS[::-1], LONS, LEVELS)
    assert (b[::-1] == a).all() and (d[::-1] == c).all()
    b, _ = wb.breaking_cells(np.roll(_waves(1.2), 32, 1), LATS, np.roll(LONS, 32), LEVELS)
    assert (np.roll(b, -32, 1) == a).all()


def test_contours_that_leave_or_close_do_not_count():
    lon, lat = np.meshgrid(LONS, LATS)
    bump = 330 + 60 * np.exp(-(((lon - 180) / 30) ** 2) - ((lat - 20) / 15) ** 2)  # closed contours over 180 W
    leaves = 330 + lat + 120 * np.sin(np.radians(lon))  # touch the first and the last row
    for field in (bump, leaves):
        a, c = wb.breaking_cells(field, LATS, LONS, [333.3])
        assert not a.any() and not c.any()


def test_westward_runs():
    x, y = np.array([0.0, 1, 2, 1.5, 1, 0.5, 1, 2]), np.array([0.0, 0, 0, 1, 2, 3, 3, 3])
    rising, falling = wb.westward_runs(x, y)
    assert rising.tolist() == [3, 4] and not len(falling)
    rising, falling = wb.westward_runs(x, -y)
    assert falling.tolist() == [3, 4] and not len(rising)
    assert not any(map(len, wb.westward_runs(x[2:], y[2:])))  # no turn before it


def _wind(seed=1, degree=8):
    lats, _ = k.gaussian_latitudes(24)
    rng, out = np.random.default_rng(seed), []
    for _ in range(2):
        c = np.zeros((degree + 1, degree + 1), complex)
        for m in range(degree + 1):
            c[m, m:] = rng.normal(size=degree + 1 - m) + 1j * rng.normal(size=degree + 1 - m) * (m > 0)
        c[0, 0] = 0
        out.append(c * 1e6)
    return lats, *out


def test_gradient_of_harmonics():
    _, c, _ = _wind()
    fine = np.linspace(-70, 70, 4001)
    east, north = k.gradient(c, fine, 48)
    field = k.synthesis(c, fine, 48)
    assert np.allclose(north[5:-5], (np.gradient(field, np.radians(fine), axis=0) / 6.37e6)[5:-5], atol=1e-3)
    waves = np.fft.irfft(np.fft.rfft(field, axis=1) * 1j * np.arange(25), 48, axis=1)
    assert np.allclose(east, waves / (6.37e6 * np.cos(np.radians(fine)))[:, None])


def test_helmholtz_parts_come_back(spark):
    lats, psi, chi = _wind()
    nx = 32
    (px, py), (cx, cy) = k.gradient(psi, lats, nx), k.gradient(chi, lats, nx)
    rows = [(0, j, i, float(cx[j, i] - py[j, i]), float(cy[j, i] + px[j, i])) for j in range(24) for i in range(nx)]
    cube = spark.createDataFrame(rows, "t int, j int, i int, u double, v double")
    found = hm.helmholtz_wind(Grid(nx, 24), cube, "u", "v", lats.tolist(), 8).toPandas().sort_values(["j", "i"])
    for name, want in (("u_rot", -py), ("v_rot", px), ("u_irr", cx), ("v_irr", cy), ("psi", k.synthesis(psi, lats, nx)), ("chi", k.synthesis(chi, lats, nx))):
        assert np.allclose(found[name].to_numpy().reshape(24, nx), want, atol=1e-8 * np.abs(want).max())


def _slice(spark, **fields):
    """One slice (t = 0) of fields on rows and cells."""
    names, (ny, nx) = list(fields), next(iter(fields.values())).shape
    return spark.createDataFrame([(0, j, i, *(float(fields[n][j, i]) for n in names)) for j in range(ny) for i in range(nx)], "t int, j int, i int, " + ", ".join(f"{n} double" for n in names))


def _fields(df, ny, nx, *names):
    rows = df.toPandas().sort_values(["j", "i"])
    return [rows[n].to_numpy().reshape(ny, nx) for n in names]


def _by_potentials(lats, psi, chi, nx):
    (px, py), (cx, cy) = k.gradient(psi, lats, nx), k.gradient(chi, lats, nx)
    return cx - py, cy + px


def test_vector_laplacian_and_its_inverse(spark):
    lats, psi, chi = _wind()
    n = np.arange(9)
    factor = -n * (n + 1) / 6.37e6**2
    u, v = _by_potentials(lats, psi, chi, 32)
    lu, lv = _by_potentials(lats, psi * factor, chi * factor, 32)
    g, rows = Grid(32, 24), lats.tolist()
    for a, b in zip(_fields(hm.vector_laplacian(g, _slice(spark, u=u, v=v), "u", "v", rows, 8), 24, 32, "u_lap", "v_lap"), (lu, lv), strict=True):
        assert np.allclose(a, b, atol=1e-8 * np.abs(b).max())
    for a, b in zip(_fields(hm.inverse_vector_laplacian(g, _slice(spark, u=lu, v=lv), "u", "v", rows, 8), 24, 32, "u", "v"), (u, v), strict=True):
        assert np.allclose(a, b, atol=1e-8 * np.abs(b).max())


def test_winds_come_back_from_vorticity_and_divergence(spark):
    lats, psi, chi = _wind()
    g, rows = Grid(32, 24), lats.tolist()
    u, v = _by_potentials(lats, psi, chi, 32)
    fields = hm.vorticity_divergence(g, _slice(spark, u=u, v=v), "u", "v", rows, 8)
    made = hm.wind_of(g, fields, "vor", "div", rows, 8, inverse=True).selectExpr("j", "i", "u_rot + u_irr AS u", "v_rot + v_irr AS v")
    for a, b in zip(_fields(made, 24, 32, "u", "v"), (u, v), strict=True):
        assert np.allclose(a, b, atol=1e-8 * np.abs(b).max())
    made = hm.wind_of(g, _slice(spark, psi=k.synthesis(psi, lats, 32), chi=k.synthesis(chi, lats, 32)), "psi", "chi", rows, 8).selectExpr("j", "i", "u_rot + u_irr AS u")
    assert np.allclose(_fields(made, 24, 32, "u")[0], u, atol=1e-8 * np.abs(u).max())


def test_gradient_and_laplacian_have_inverses(spark):
    lats, _, chi = _wind()
    g, rows, field = Grid(32, 24), lats.tolist(), k.synthesis(chi, lats, 32)
    east, north = k.gradient(chi, lats, 32)
    found = _fields(hm.inverse_gradient(g, _slice(spark, x=east, y=north), "x", "y", rows, 8), 24, 32, "value")[0]
    assert np.allclose(found, field, atol=1e-8 * np.abs(field).max())
    c = hm.analysis(g, _slice(spark, v=field), ["v"], rows, 8)
    back = hm.synthesis(hm.inverse_laplacian(hm.laplacian(c, ["v"]), ["v"]), ["v"], rows, 32, 8)
    assert np.allclose(_fields(back, 24, 32, "v")[0], field, atol=1e-8 * np.abs(field).max())
    found = {(r.m, r.n): complex(r.v_re, r.v_im) for r in c.collect()}
    assert len(found) == 45 and all(abs(x - chi[key]) < 1e-8 * np.abs(chi).max() for key, x in found.items())


def test_theta_derivative_by_differences(spark):
    lats, psi, chi = _wind()
    h = 1e-4
    u, v = _by_potentials(lats, psi, chi, 32)
    ahead, behind = _by_potentials(lats + h, psi, chi, 32), _by_potentials(lats - h, psi, chi, 32)
    found = _fields(hm.theta_derivative(Grid(32, 24), _slice(spark, u=u, v=v), "u", "v", lats.tolist(), 8), 24, 32, "u_theta", "v_theta")
    for a, x, y in zip(found, ahead, behind, strict=True):
        want = -(x - y) / np.radians(2 * h)
        assert np.allclose(a, want, atol=1e-6 * np.abs(want).max())


def test_slices_that_are_not_whole_have_no_harmonics(spark):
    rows = [(t, j, i, None if (t, j, i) == (1, 3, 4) else float(t + 1)) for t in range(4) for j in range(6) for i in range(8) if (t, j, i) != (2, 0, 0)]
    cube = spark.createDataFrame(rows, "t int, j int, i int, v double")
    lats = [-75.0 + 30 * j for j in range(6)]
    found = hm.spectral_truncation(Grid(8, 6), cube, "v", lats, 2).groupBy("t").agg(F.count("v").alias("n"), F.max("v").alias("v"), F.count(F.lit(1)).alias("rows")).orderBy("t").collect()
    assert [(r.n, r.rows) for r in found] == [(48, 48), (0, 48), (0, 48), (48, 48)] and abs(found[3].v - 4) < 1e-9
    assert hm.spectral_truncation(Grid(8, 6), cube.limit(0), "v", lats, 2).count() == 0


def test_sums_of_waves_need_no_further_shuffle(spark):
    """Above the one that gathers the waves of a row there is none."""
    g, lats = Grid(32, 24), [float(x) for x in np.linspace(-80, 80, 24)]
    plan = hm.spectral_truncation(g, _slice(spark, v=np.zeros((24, 32))), "v", lats, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.index("HashAggregate(keys=[t") < plan.index("REPARTITION_BY_COL")
    assert "Exchange" not in plan[: plan.index("REPARTITION_BY_COL")].replace("+- Exchange", "", 1)


def test_regridding_is_exact_for_few_harmonics(spark):
    lats, c, _ = _wind()
    field = k.synthesis(c, lats, 32)
    cube = spark.createDataFrame([(0, j, i, float(field[j, i])) for j in range(24) for i in range(32)], "t int, j int, i int, v double")
    new = np.linspace(-80, 80, 9)
    found = hm.spectral_regrid(Grid(32, 24), cube, "v", lats.tolist(), 8, new.tolist(), 40, 0.5).toPandas().sort_values(["j", "i"])
    assert np.allclose(found["v"].to_numpy().reshape(9, 40), k.synthesis(c, new, 80)[:, 1::2])


def test_gaussian_quadrature():
    lats, w = k.gaussian_latitudes(16)
    assert np.isclose(w.sum(), 2) and np.isclose((w * np.sin(np.radians(lats)) ** 30).sum(), 2 / 31)


def test_multigrid_solves():
    def operator(x, level):
        return x - 5 * sum(np.roll(x, s, (0, 1)) - x for s in k.NEAR4) / 4.0**level

    b = np.random.default_rng(3).normal(size=(64, 32))
    x, rest = k.multigrid(operator, b)
    assert rest < 1e-9 and np.allclose(operator(x, 0), b, atol=1e-4)
    assert np.allclose(x, k.conjugate_gradient(lambda z: operator(z, 0), b, steps=500)[0], atol=1e-5)


def test_frontal_volume_on_fine_grids(spark):
    rows = []
    for t in range(2):
        for kk in range(2):
            for j in range(6):
                for i in range(8):
                    step = 0.0 if i < 4 else 10.0
                    spike = 9.0 * (t == 1 and i == 2 and j == 3)  # alone: smoothing takes it below the first limit
                    rows.append((t, kk, j, i, step + spike, 2.0, 2.0, i >= 6 or i < 2))
    cube = spark.createDataFrame(rows, "t int, k int, j int, i int, v double, dx double, dy double, high boolean")
    g = Grid(8, 6, 2, slice_cols=("t", "k"))
    found = ft.frontal_volume_small(g, g.slices(cube), "v", large=2.5, small=4.0, min_size=1.0).toPandas()
    steep = found[found["t"] == 0]
    assert set(steep["i"]) == {0, 3, 4, 7} and set(steep["j"]) == {1, 2, 3, 4} and steep["label"].nunique() == 2  # 7 and 0, across the seam; 3 and 4
    assert ft.frontal_volume(g, g.slices(cube), "v", 4.0, 1.0).filter("t = 1 AND i = 1 AND j = 3").count() == 2
    assert set(found[found["t"] == 1]["i"]) == {0, 3, 4, 7}
    masked = ft.frontal_volume_small(g, g.slices(cube), "v", large=2.5, small=4.0, min_size=1.0, mountain="high").toPandas()
    assert set(masked[masked["t"] == 0]["i"]) == {3, 4}
    assert ft.frontal_volume_small(g, g.slices(cube), "v", large=2.5, small=4.0, min_size=1e9).count() == 0


def _classic(version=1, records=2):
    """A file with time (grows), y = 2, x = 3; packed v(time, y, x), doubles y(y), time(time)."""
    offset = ">q" if version == 2 else ">i"
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda key, kind, code, value: name(key) + struct.pack(">ii", kind, 1) + struct.pack(code, value).ljust(-(-struct.calcsize(code) // 4) * 4, b"\0")
    text = lambda key, value: name(key) + struct.pack(">ii", 2, len(value)) + value.encode() + b"\0" * (-len(value) % 4)

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", records)
        out += struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("y") + struct.pack(">i", 2) + name("x") + struct.pack(">i", 3)
        out += struct.pack(">ii", 0, 0)
        out += struct.pack(">ii", 11, 3)
        out += name("v") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 3) + number("scale_factor", 6, ">d", 0.5) + number("add_offset", 6, ">d", 100.0) + number("_FillValue", 3, ">h", -9) + struct.pack(">ii", 3, 12) + struct.pack(offset, begins[0])
        out += name("y") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, 16) + struct.pack(offset, begins[1])
        out += name("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 12, 1) + text("units", "hours since 2000-01-01") + struct.pack(">ii", 4, 4) + struct.pack(offset, begins[2])
        return out

    size = len(header((0, 0, 0)))
    body = struct.pack(">dd", 10.0, 20.0)
    for r in range(records):
        body += struct.pack(">6h", *[-9 if (r, c) == (1, 4) else 10 * r + c for c in range(6)]) + struct.pack(">i", 6 * r)
    return header((size + 16, size, size + 28)) + body


@pytest.mark.parametrize("version", [1, 2])
def test_classic_netcdf(spark, tmp_path, version):
    (tmp_path / "a.nc").write_bytes(_classic(version))
    found = {(r.t, r.j, r.i): r.value for r in read_netcdf(spark, str(tmp_path), dims=("time", "y", "x")).collect()}
    assert len(found) == 12 and found[0, 0, 0] == 100 and found[1, 0, 2] == 106 and found[1, 1, 1] is None
    axes = {(r.variable, r.n): (r.value, r.units) for r in netcdf_axes(spark, str(tmp_path)).collect()}
    assert axes == {("y", 0): (10, ""), ("y", 1): (20, ""), ("time", 0): (0, "hours since 2000-01-01"), ("time", 1): (6, "hours since 2000-01-01")}
    assert read_netcdf(spark, str(tmp_path), variables=()).count() == 0


def test_other_files_are_refused():
    for content, said in ((b"\x89HDF\r\n\x1a\n", "HDF5"), (b"GRIB", "unknown"), (b"", "unknown")):
        with pytest.raises(ValueError, match=said):
            ClassicFile(content)
