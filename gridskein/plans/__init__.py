"""Ready-made plans: what a user asks of a data set, from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..grid import Grid
from ..operators import diagnostics as dg
from ..operators import features as ft
from ..operators import tracking as tk
from ..operators.filters import smooth_xy
from ..storage import materialise


def jet_axes(g: Grid, cube: DataFrame, u: str, v: str, cells: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Jet axes with the wind speed: zero lines of the shear across the flow where it decreases fast enough."""
    cube = dg.grad_shear_nat(g, dg.shear_nat(g, g.slices(cube), u, v), u, v).withColumn("speed", F.hypot(u, v))
    jets = materialise(cube.select("t", "j", "i", "shear_nat", "grad_shear_nat", "speed"), "jets")  # read several times
    lines = ft.zero_lines(g, g.slices(jets), "shear_nat", F.col("speed") * F.col("grad_shear_nat") <= -config.jetint_thres, cells, config)
    return ft.with_payload(g, lines, jets, "speed")


def jet_axes_by_speed(g: Grid, cube: DataFrame, u: str, v: str, cells: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Jet axes of smoothed wind where it is fast."""
    cube = smooth_xy(g, smooth_xy(g, g.slices(cube), u, config.nsmooth), v, config.nsmooth)
    cube = dg.grad_shear_nat(g, dg.shear_nat(g, cube, u, v), u, v).withColumn("speed", F.hypot(u, v))
    jets = materialise(cube.select("t", "j", "i", "shear_nat", "grad_shear_nat", "speed"), "jets")  # read several times
    lines = ft.zero_lines(g, g.slices(jets), "shear_nat", (F.col("grad_shear_nat") < 0) & (F.col("speed") >= config.jet_speed), cells, config)
    return ft.with_payload(g, lines, jets, "speed")


def front_lines(g: Grid, cube: DataFrame, s: str, u: str, v: str, cells: DataFrame, by_curvature: bool = True, config: Config = DEFAULTS) -> DataFrame:
    """Cold, warm and stationary fronts (column type) with their intensity."""
    cube = g.slices(cube)
    for c in (s, u, v):
        cube = smooth_xy(g, cube, c, config.nsmooth)
    cube = (dg.front_maxcurv if by_curvature else dg.front_maxgrad)(g, cube, s, u, v)
    speed, strong = F.col("front_spd"), F.col("front_int") > config.frint_thres if by_curvature else F.col("front_int") < config.frint_thres
    fast, t = speed * (-1 if by_curvature else 1), config.frspd_thres
    # What follows reads the fronts several times; the windows before them run once.
    fronts = materialise(cube.select("t", "j", "i", "front_loc", "front_int", speed.alias("front_spd")), "fronts")
    kinds = {"cold": strong & (fast > t), "warm": strong & (fast < -t), "stationary": strong & (F.abs(speed) < t)}
    lines = ft.with_payload(g, ft.zero_lines_of_kinds(g, g.slices(fronts), "front_loc", kinds, cells, config), fronts, "front_int")
    return lines.select("t", "line_id", "pt", "x", "y", "payload", "type")


def wind_lines(g: Grid, cube: DataFrame, u: str, v: str, cells: DataFrame, kind: str, config: Config = DEFAULTS) -> DataFrame:
    """Lines of convergence, vorticity or deformation."""
    cube = g.slices(cube)
    field, threshold = {"convergence": (-dg.div(g, u, v), -config.div_thres), "vorticity": (dg.vor(g, u, v), config.vor_thres), "deformation": (dg.def_total(g, u, v), config.def_thres)}[kind]
    ridges = materialise(cube.select("t", "j", "i", "dx", "dy", field.alias("__r")), "ridges")  # read twice
    return ft.ridge_lines(g, g.slices(ridges), "__r", threshold, cells, config)


def cyclone_tracks(g: Grid, cube: DataFrame, msl: str, oro: str, step_hours: float, config: tk.TrackConfig = tk.TRACKING) -> tuple[DataFrame, DataFrame]:
    """(points, tracks): lows located, linked and smoothed, and what became of each track."""
    tracks = tk.track_cyclones(tk.locate_cyclones(g, g.slices(cube), msl, oro, config), config)
    return tk.smooth_tracks(tracks, config), tk.aggregate_trackinfo(tracks, step_hours)
