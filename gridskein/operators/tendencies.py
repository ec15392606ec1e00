"""Tendencies of deformation, slope and wind. Functions take a cube and add columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sphere_geometry import coriolis
from ..grid import Grid, ratio
from .derivatives import ddx, ddx2, ddx_on_q, ddxy, ddy, ddy2, ddy_on_q, ddz, ddz_on_q
from .diagnostics import def_shear, def_stretch, vor

_HELPERS = ("__sh", "__st", "__d2")


def _with_deformation(g: Grid, cube: DataFrame, u: str, v: str) -> DataFrame:
    sh, st = def_shear(g, u, v), def_stretch(g, u, v)
    return cube.withColumns({"__sh": sh, "__st": st, "__d2": sh * sh + st * st})


def _from_parts(cube: DataFrame, stretch: Column, shear: Column) -> DataFrame:
    """Relative tendency and turning that tendencies of the two parts of deformation amount to."""
    sh, st, d2 = (F.col(c) for c in _HELPERS)
    return cube.withColumns({"tend_abs": ratio(st * stretch + sh * shear, d2), "tend_ang": 0.5 * ratio(st * shear - sh * stretch, d2)}).drop(*_HELPERS)


def def_adv(g: Grid, cube: DataFrame, u: str, v: str) -> DataFrame:
    """Advection: adds tend_abs (relative) and tend_ang; the angle's by its two parts, so it has no jump."""
    cube = _with_deformation(g, cube, u, v).withColumn("__d", F.sqrt("__d2"))
    along = lambda c: F.col(u) * ddx(g, c) + F.col(v) * ddy(g, c)
    size = ratio(-along("__d"), F.col("__d"))
    angle = -0.5 * ratio(F.col("__st") * along("__sh") - F.col("__sh") * along("__st"), F.col("__d2"))
    return cube.withColumns({"tend_abs": size, "tend_ang": angle}).drop(*_HELPERS, "__d")


def def_adv3d(g: Grid, cube: DataFrame, u: str, v: str, w: str) -> DataFrame:
    """Advection with the vertical wind, by the parts of deformation (uses dz)."""
    cube = _with_deformation(g, cube, u, v)
    along = lambda c: F.col(u) * ddx(g, c) + F.col(v) * ddy(g, c) + F.col(w) * ddz(g, c)
    return _from_parts(cube, -along("__st"), -along("__sh"))


def def_beta(g: Grid, cube: DataFrame, u: str, v: str, beta: str) -> DataFrame:
    """Beta effect."""
    cube = _with_deformation(g, cube, u, v)
    sh, st, d2 = (F.col(c) for c in _HELPERS)
    b, x, y = F.col(beta), F.col(u), F.col(v)
    return cube.withColumns({"tend_abs": ratio(b * (st * x + sh * y), d2), "tend_ang": ratio(b * (sh * x - st * y), d2)}).drop(*_HELPERS)


def def_prescor(g: Grid, cube: DataFrame, u: str, v: str, geop: str, lat: str = "lat") -> DataFrame:
    """Pressure gradient and Coriolis effect; the neighbours of ``geop`` must be there (``Grid.neighbours``)."""
    cube = _with_deformation(g, cube, u, v)
    sh, st, d2 = (F.col(c) for c in _HELPERS)
    xy, diff = ddxy(g, geop), ddx2(g, geop) - ddy2(g, geop)
    size = ratio(-2 * xy * sh - diff * st, d2)
    return cube.withColumns({"tend_abs": size, "tend_ang": ratio(-xy * st + 0.5 * diff * sh, d2) - 0.5 * coriolis(lat)}).drop(*_HELPERS)


def def_tilt(g: Grid, cube: DataFrame, u: str, v: str, w: str) -> DataFrame:
    """Tilting of vertical shear (uses dz)."""
    cube = _with_deformation(g, cube, u, v)
    uz, vz, wx, wy = ddz(g, u), ddz(g, v), ddx(g, w), ddy(g, w)
    return _from_parts(cube, -(uz * wx - vz * wy), -(uz * wy + vz * wx))


def uv_prescor(g: Grid, u: str, v: str, z: str, lat: str = "lat") -> tuple[Column, Column]:
    """Acceleration by pressure gradient and Coriolis force."""
    f = coriolis(lat)
    return -ddx(g, z) + f * F.col(v), -ddy(g, z) - f * F.col(u)


def accgrad_eigs(g: Grid, cube: DataFrame, u: str, v: str, mont: str, lat: str = "lat") -> DataFrame:
    """Adds the two eigenvalues (re, im) of the acceleration's gradient tensor, the larger or conjugate-positive first."""
    ax, ay = uv_prescor(g, u, v, mont, lat)
    cube = cube.withColumns({"__ax": ax, "__ay": ay})
    a, b, c, d = ddx(g, "__ax"), ddy(g, "__ax"), ddx(g, "__ay"), ddy(g, "__ay")
    cube = cube.withColumns({"__h": 0.5 * (a + d), "__k": 0.25 * (a - d) * (a - d) + b * c})
    h, k = F.col("__h"), F.col("__k")
    real, imaginary = F.when(k >= 0, F.sqrt(F.abs(k))).when(k < 0, 0.0), F.when(k < 0, F.sqrt(F.abs(k))).when(k >= 0, 0.0)
    return cube.withColumns({"plus_re": h + real, "plus_im": imaginary, "minus_re": h - real, "minus_im": -imaginary}).drop("__ax", "__ay", "__h", "__k")


def rotation_strain_ratio(g: Grid, cube: DataFrame, u: str, v: str, mont: str, lat: str = "lat", out: str = "ratio") -> DataFrame:
    """Adds vorticity less twice the axis' turning by pressure and Coriolis force, over deformation."""
    cube = cube.withColumns({"__z": vor(g, u, v), "__t": F.sqrt(def_shear(g, u, v) ** 2 + def_stretch(g, u, v) ** 2)})
    cube = def_prescor(g, g.neighbours(cube, mont), u, v, mont, lat)
    added = [f"{mont}_{d}" for d in ("e", "w", "n", "s", "ne", "nw", "se", "sw")]
    return cube.withColumn(out, ratio(F.col("__z") - 2 * F.col("tend_ang"), F.col("__t"))).drop("__z", "__t", "tend_abs", "tend_ang", *added)


def slope_adv(g: Grid, cube: DataFrame, u: str, v: str, slope: str = "slope", out: str = "r") -> DataFrame:
    """Adds the advection of the slope along its surface."""
    return cube.withColumn(out, -(F.col(u) * ddx(g, slope) + F.col(v) * ddy(g, slope)))


def slope_iadv(g: Grid, cube: DataFrame, u: str, v: str, th: str, slope: str = "slope", out: str = "r") -> DataFrame:
    """Adds the wind along the gradient of the slope on surfaces of ``th``, from levels that aren't such surfaces."""
    return cube.withColumn(out, F.col(u) * ddx_on_q(g, slope, th) + F.col(v) * ddy_on_q(g, slope, th))


def cross_isentropic_wind(u: str, v: str, w: str) -> Column:
    """The vertical wind less what flows along the isentropes, from dzdx and dzdy of ``isentropic_slope`` or ``pressure_slope``."""
    return F.col(w) - F.col(u) * F.col("dzdx") - F.col(v) * F.col("dzdy")


def slope_terms(g: Grid, cube: DataFrame, u: str, v: str, w: str, th: str, heating: str) -> DataFrame:
    """Adds the slope's tendencies by deformation (slope_def), tilting (slope_tilt), tilting by what crosses isentropes (slope_cross) and heating (slope_diab).

    The cube needs dzdx, dzdy, dzdth and slope of ``isentropic_slope``.
    """
    x, y, s = F.col("dzdx"), F.col("dzdy"), F.col("slope")
    cube = cube.withColumns({"w_ci": cross_isentropic_wind(u, v, w), "__heat": F.col("dzdth") * F.col(heating)})
    ux, uy, vx, vy = ddx(g, u), ddy(g, u), ddx(g, v), ddy(g, v)
    tilt = lambda c: ratio(x * (ddx(g, c) - ddz_on_q(g, c, th) * ddx(g, th)) + y * (ddy(g, c) - ddz_on_q(g, c, th) * ddy(g, th)), s)
    return cube.withColumns(
        {
            "slope_def": -ratio(x * x * ux + x * y * (vx + uy) + y * y * vy, s),
            "slope_tilt": tilt(w),
            "slope_cross": tilt("w_ci"),
            "slope_diab": -ratio(x * ddx(g, "__heat") + y * ddy(g, "__heat"), s),
        }
    ).drop("__heat")
