"""Grids, sources, intervals, tracks and streams on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridskein import sources
from gridskein.grid import Grid, cartesian_cells, latlon_cells
from gridskein.operators import derivatives as dv
from gridskein.operators import time_buckets as tb
from gridskein.operators import tracking as tk
from gridskein.operators.components import connected_components


def _cube(spark, values):
    rows = [(0, j, i, None if v is None else float(v), 2.0, 2.0) for j, row in enumerate(values) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "t int, j int, i int, v double, dx double, dy double")


def _values(df, name="r"):
    return {(r.j, r.i): r[name] for r in df.select("j", "i", name).collect()}


def test_constant_and_ramp(spark):
    g = Grid(5, 4, cyclic=False)
    flat = _values(_cube(spark, [[7] * 5] * 4).withColumn("r", dv.lap2(g, "v")))
    assert flat[1, 1] == 0 and flat[0, 1] is None and flat[1, 0] is None
    ramp = _values(_cube(spark, [[3 * i for i in range(5)]] * 4).withColumn("r", dv.ddx(g, "v")))
    assert ramp[2, 2] == 3 and ramp[2, 4] is None


def test_wrap_equals_inside(spark):
    g = Grid(64, 1)
    wave = [[np.sin(2 * np.pi * (i + 5) / 64) for i in range(64)]]
    found = _values(_cube(spark, wave).withColumn("r", dv.ddx_o4(g, "v")))
    assert np.allclose([found[0, i] for i in range(64)], [2 * np.pi / 64 * np.cos(2 * np.pi * (i + 5) / 64) for i in range(64)], atol=1e-5)


def test_hole_spreads_to_its_neighbours_only(spark):
    g = Grid(7, 7, cyclic=False)
    values = [[1.0] * 7 for _ in range(7)]
    values[3][3] = None
    found = _values(_cube(spark, values).withColumn("r", dv.lap2(g, "v")))
    assert {c for c, v in found.items() if v is None and 0 < c[0] < 6 and 0 < c[1] < 6} == {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)}


def test_cells(spark):
    cells = {(r.j, r.i): r for r in latlon_cells(spark, [0.0, 10.0, 30.0], [0.0, 90.0, 180.0, 270.0]).collect()}
    assert np.isclose(cells[0, 0].dy, 111111.11 * 20) and np.isclose(cells[1, 0].dy, 111111.11 * 30) and np.isclose(cells[0, 3].dx, 111111.11 * 180)
    assert {r.dx for r in cartesian_cells(spark, [0, 1, 3], [0, 1]).filter("i = 2").collect()} == {4.0}


def test_levels():
    for name, kind, value in (("pt330", "isentropic", 330), ("pv2000", "pv", 2), ("10m", "height", 10), ("850", "pressure", 85000), ("sfc", "surface", 0)):
        assert sources.parse_level(name) == (kind, value) and sources.format_level(kind, value) == name
    with pytest.raises(ValueError):
        sources.parse_level("x")


def test_catalogue_conflict():
    c = sources.Catalogue()
    c.register(sources.Variable("u", "wind", "m/s"))
    with pytest.raises(ValueError):
        c.register(sources.Variable("u", "wind", "kt"))


def test_save_and_read(spark, tmp_path):
    rows = [(dt.datetime(2020, m, 1), 0, i, float(m)) for m in (1, 2, 3) for i in range(4)]
    sources.save_fields(spark.createDataFrame(rows, "t timestamp, j int, i int, u double"), str(tmp_path / "a"))
    found = sources.instantaneous(spark, str(tmp_path / "a"), ["u"], "2020-02-01", "2020-03-01")
    assert found.count() == 4 and found.first().u == 2.0
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sources.instantaneous(spark, str(tmp_path / "a"), ["u"], "2020-01-01", "2021-01-01", limit=3)


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "f.npz", u=np.array([[[1.0, np.nan]]]), w=np.zeros(3))
    rows = sources.read_arrays(spark, str(tmp_path / "f.npz")).orderBy("i").collect()
    assert [(r.variable, r.t, r.j, r.i, r.value) for r in rows] == [("u", 0, 0, 0, 1.0), ("u", 0, 0, 1, None)]


def test_leap_pentad(spark):
    days = spark.sql("SELECT timestamp(date_add(date'2020-01-01', id)) AS t FROM range(366)".replace("id)", "CAST(id AS INT))"))
    sizes = tb.aggregate(days.withColumn("v", F.lit(1.0)), "t", "v", tb.CAL_PENTAD, 86400).groupBy("cnt").count().collect()
    assert {r["cnt"]: r["count"] for r in sizes} == {5: 72, 6: 1}


def test_incomplete_months_go(spark):
    days = spark.sql("SELECT timestamp(date_add(date'2021-01-15', CAST(id AS INT))) AS t, 1.0D AS v FROM range(60)")
    assert [r.t_start.month for r in tb.aggregate(days, "t", "v", tb.CAL_MONTH, 86400).collect()] == [2]


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == n + 3
    assert connected_components(links.limit(0)).count() == 0


def test_tracks_continue_and_restart(spark):
    rows = [("N", t, 0, 0, "closed", 50.0, 10.0 + t, 99000.0, 200.0, 1e-9) for t in (0, 1, 2, 5)]
    lows = spark.createDataFrame(rows, "hemis string, t int, j int, i int, kind string, lat double, lon double, msl double, prominence double, lap double")
    found = tk.track_cyclones(lows).orderBy("t").collect()
    assert [r.track_id for r in found] == [0, 0, 0, 1]
    smooth = tk.smooth_tracks(tk.track_cyclones(lows)).orderBy("t").collect()
    assert smooth[0].segment_len is None and smooth[1].segment_len > 0
