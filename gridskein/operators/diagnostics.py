"""Diagnostics of wind and scalar fields on horizontal slices.

Functions with one difference level return Columns; those that differentiate
derived fields take a cube and add columns step by step, on the partitioning
that the first step needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..constants import G, RL
from ..functions.sphere_geometry import coriolis
from ..functions.thermodyn import rho_from_t_p, theta_from_temp
from ..grid import Grid, ratio
from .derivatives import ddx, ddy, ddz, ddz_on_q, lap2


def _wind(u: str, v: str) -> tuple[Column, Column, Column]:
    u, v = F.col(u), F.col(v)
    return u, v, u * u + v * v


def vor(g: Grid, u: str, v: str) -> Column:
    """Vorticity."""
    return ddx(g, v) - ddy(g, u)


def div(g: Grid, u: str, v: str) -> Column:
    """Divergence."""
    return ddx(g, u) + ddy(g, v)


def def_shear(g: Grid, u: str, v: str) -> Column:
    """Shear deformation."""
    return ddy(g, u) + ddx(g, v)


def def_stretch(g: Grid, u: str, v: str) -> Column:
    """Stretching deformation."""
    return ddx(g, u) - ddy(g, v)


def def_total(g: Grid, u: str, v: str) -> Column:
    """Total deformation."""
    sh, st = def_shear(g, u, v), def_stretch(g, u, v)
    return F.sqrt(sh * sh + st * st)


def def_angle(g: Grid, u: str, v: str) -> Column:
    """Angle from the x axis to the axis of dilatation."""
    return 0.5 * F.atan2(def_shear(g, u, v), def_stretch(g, u, v))


def wrapped_once(angle: Column) -> Column:
    """An axis angle moved by pi once into [-pi/2, pi/2)."""
    return F.when(angle >= F.pi() / 2, angle - F.pi()).when(angle < -F.pi() / 2, angle + F.pi()).otherwise(angle)


def def_angle_nat(g: Grid, u: str, v: str) -> Column:
    """Angle from the wind to the axis of dilatation."""
    return wrapped_once(def_angle(g, u, v) - F.atan2(F.col(v), F.col(u)))


def vor_curv(g: Grid, u: str, v: str) -> Column:
    """Curvature vorticity."""
    x, y, ff2 = _wind(u, v)
    return ratio(x * x * ddx(g, v) + x * y * (ddy(g, v) - ddx(g, u)) - y * y * ddy(g, u), ff2)


def def_stretch_nat(g: Grid, u: str, v: str) -> Column:
    """Stretching deformation in natural coordinates."""
    x, y, ff2 = _wind(u, v)
    return ratio((x * x - y * y) * def_stretch(g, u, v) + 2 * x * y * def_shear(g, u, v), ff2)


def def_shear_nat(g: Grid, u: str, v: str, consistent: bool = False) -> Column:
    """Shear deformation in natural coordinates.

    The first factor is u_y + v_y, as results in use have it; ``consistent``
    takes the shear deformation u_y + v_x instead.
    """
    x, y, ff2 = _wind(u, v)
    first = ddy(g, u) + (ddx(g, v) if consistent else ddy(g, v))
    return ratio((x * x - y * y) * first + 2 * x * y * (ddy(g, v) - ddx(g, u)), ff2)


def okuboweiss(g: Grid, u: str, v: str) -> Column:
    """Okubo-Weiss criterion."""
    d, z = def_total(g, u, v), vor(g, u, v)
    return 0.25 * (d * d - z * z)


def isoline_angle(g: Grid, s: str) -> Column:
    """Angle of a scalar's isolines to the x axis."""
    return F.atan2(-ddx(g, s), ddy(g, s))


def isoline_to_deformation_angle(g: Grid, u: str, v: str, s: str) -> Column:
    """Angle from a scalar's isolines to the axis of dilatation."""
    return def_angle(g, u, v) - isoline_angle(g, s)


def frontogenesis(g: Grid, u: str, v: str, s: str) -> tuple[Column, Column]:
    """(stretching, stirring) rates of a scalar's gradient."""
    beta = isoline_to_deformation_angle(g, u, v, s)
    d = def_total(g, u, v)
    return -0.5 * (div(g, u, v) - d * F.cos(2 * beta)), 0.5 * (vor(g, u, v) + d * F.sin(2 * beta))


def shear_nat(g: Grid, cube: DataFrame, u: str, v: str, out: str = "shear_nat") -> DataFrame:
    """Adds the shear of the wind speed across the flow."""
    cube = cube.withColumn("__ff", F.sqrt(_wind(u, v)[2]))
    found = ratio(F.col(u) * ddy(g, "__ff") - F.col(v) * ddx(g, "__ff"), F.col("__ff"))
    return cube.withColumn(out, found).drop("__ff")


def grad_shear_nat(g: Grid, cube: DataFrame, u: str, v: str, out: str = "grad_shear_nat") -> DataFrame:
    """Adds the gradient across the flow of ``shear_nat``."""
    cube = shear_nat(g, cube, u, v, "__s").withColumn("__ff", F.sqrt(_wind(u, v)[2]))
    found = ratio(F.col(u) * ddy(g, "__s") - F.col(v) * ddx(g, "__s"), F.col("__ff"))
    return cube.withColumn(out, found).drop("__s", "__ff")


def def_nat_shearless(g: Grid, u: str, v: str) -> tuple[Column, Column]:
    """(magnitude, angle to the flow) of the deformation without the flow's shear part."""
    x, y, ff2 = _wind(u, v)
    ux, uy, vx, vy = ddx(g, u), ddy(g, u), ddx(g, v), ddy(g, v)
    across = ratio(x * (x * uy + y * vy) - y * (x * ux + y * vx), ff2)  # change of speed across the flow
    # The shear of the speed alone, rotated from the flow's axes to the grid's.
    ux, uy = ux + ratio(across * x * y, ff2), uy - ratio(across * x * x, ff2)
    vx, vy = vx + ratio(across * y * y, ff2), vy - ratio(across * x * y, ff2)
    sh, st = uy + vx, ux - vy
    return F.sqrt(sh * sh + st * st), wrapped_once(0.5 * F.atan2(sh, st) - F.atan2(y, x))


def uv_geo_from_pot(g: Grid, z: str, lat: str = "lat") -> tuple[Column, Column]:
    """Geostrophic wind from geopotential; next to none at the equator itself."""
    f = coriolis(lat)
    f = F.when(f == 0, 9e99).otherwise(f)
    return -ddy(g, z) / f, ddx(g, z) / f


def parfitt_f(g: Grid, t: str, u: str, v: str, lat: str = "lat", scale: float = 0.45 / 100e3) -> Column:
    """Parfitt's front diagnostic: vorticity times temperature gradient, over a typical gradient and f."""
    x, y = ddx(g, t), ddy(g, t)
    return ratio(vor(g, u, v) * F.sqrt(x * x + y * y), scale * coriolis(lat))


def frontogenesis_terms(g: Grid, cube: DataFrame, u: str, v: str, w: str, s: str, heat: str) -> DataFrame:
    """Adds the contributions of divergence, deformation, tilting and heating to the growth of a scalar's gradient."""
    sx, sy = ddx(g, s), ddy(g, s)
    cube = cube.withColumns({"__x": sx, "__y": sy, "__z": ddz(g, s), "__r": F.sqrt(sx * sx + sy * sy)})
    x, y, z, r = (F.col(c) for c in ("__x", "__y", "__z", "__r"))
    ux, uy, vx, vy = ddx(g, u), ddy(g, u), ddx(g, v), ddy(g, v)
    return cube.withColumns(
        {
            "front_div": -0.5 * r * (ux + vy),
            "front_def": ratio(-0.5 * ((x * x - y * y) * (ux - vy) + 2 * x * y * (vx + uy)), r),
            "front_tilt": ratio(-z * (x * ddx(g, w) + y * ddy(g, w)), r),
            "front_heat": ratio(x * ddx(g, heat) + y * ddy(g, heat), r),
        }
    ).drop("__x", "__y", "__z", "__r")


def streamline_radius(g: Grid, u: str, v: str) -> Column:
    """Radius of curvature of streamlines, from the turning of the wind along the flow over one cell."""
    x, y, ff2 = _wind(u, v)
    turn = lambda a: F.when(a > F.pi(), a - 2 * F.pi()).when(a < -F.pi(), a + 2 * F.pi()).otherwise(a)
    angle = F.atan2(F.col(v), F.col(u))
    tx, ty = turn(g.x(angle, 1) - g.x(angle, -1)), turn(g.y(angle, 1) - g.y(angle, -1))
    ff = F.sqrt(ff2)
    ds = ratio(F.abs(x) * F.col("dx") + F.abs(y) * F.col("dy"), ff)
    return ratio(ds, F.tan(ratio(x * tx + y * ty, ff)))


def rwb_by_grad_rev(g: Grid, pv: str, lat: str = "lat", threshold: float = 4e-12) -> dict[str, Column]:
    """Rossby wave breaking by reversal of the meridional gradient: flags and sizes, anticyclonic and cyclonic."""
    x, y, sign = ddx(g, pv), ddy(g, pv), F.signum(F.col(lat))
    y = y * sign
    tested = x.isNotNull() & y.isNotNull() & (F.abs(F.col(lat)) < 90)
    anti = (F.atan2(y * sign, x) + F.pi() / 2) * sign > 0
    size, back = F.sqrt(x * x + y * y), F.when(y < 0, -y).otherwise(0.0)
    flag = F.when(y < -threshold, 1).otherwise(0)
    out = {"tested": F.when(tested, 1).otherwise(0)}
    for name, kind in (("a", anti), ("c", ~anti)):
        here = tested & kind
        out |= {f"flag_{name}": F.when(here, flag).otherwise(0), f"size_{name}": F.when(here & (flag == 1), size).otherwise(0.0), f"back_{name}": F.when(here, back).otherwise(0.0)}
    return out


def front_maxcurv(g: Grid, cube: DataFrame, s: str, u: str, v: str) -> DataFrame:
    """Adds front_int, front_spd, front_loc by the curvature of the gradient's size (Berry et al.)."""
    x, y = ddx(g, s), ddy(g, s)
    cube = cube.withColumns({"__x": x, "__y": y, "__r": F.sqrt(x * x + y * y)})
    cube = cube.withColumns({"__rx": ddx(g, "__r"), "__ry": ddy(g, "__r")})
    cube = cube.withColumn("__a", F.sqrt(F.col("__rx") * F.col("__rx") + F.col("__ry") * F.col("__ry")))
    found = {
        "front_int": ratio(F.col("__x") * F.col("__rx") + F.col("__y") * F.col("__ry"), F.col("__r")),
        "front_spd": ratio(F.col(u) * F.col("__rx") + F.col(v) * F.col("__ry"), F.col("__a")),
        "front_loc": ddx(g, "__a") + ddy(g, "__a"),
    }
    return cube.withColumns(found).drop("__x", "__y", "__r", "__rx", "__ry", "__a")


def front_maxgrad(g: Grid, cube: DataFrame, s: str, u: str, v: str) -> DataFrame:
    """Adds front_int, front_spd, front_loc by the gradient's size (Jenkner et al.)."""
    x, y = ddx(g, s), ddy(g, s)
    r = F.sqrt(x * x + y * y)
    return cube.withColumns({"front_int": r, "front_spd": ratio(F.col(u) * x + F.col(v) * y, r), "front_loc": lap2(g, s)})


def block_indicator(g: Grid, cube: DataFrame, v: str, dj: int = 30, di: int = 15, out: str = "block") -> DataFrame:
    """Adds the difference of the means south and north of a cell, smoothed over 2 di + 1 columns; 0 near the edges and where one of the rows is missing or NULL."""
    w = g.along_y
    sides = [w.rangeBetween(-dj, -1), w.rangeBetween(1, dj)]
    south, north = (F.when(F.count(v).over(s) == dj, F.sum(v).over(s)) for s in sides)
    inside = (F.col("j") >= dj) & (F.col("j") < g.ny - dj)
    cube = cube.withColumn("__b", F.when(inside, (south - north) / dj))
    row = g.along_x.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.collect_list(F.coalesce("__b", F.lit(0.0))).over(row)
    if g.cyclic:
        near = F.transform(F.sequence(F.lit(-di), F.lit(di)), lambda s: F.element_at(values, F.pmod(F.col("i") + s, F.lit(g.nx)) + 1))
        mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / (2 * di + 1)
    else:
        mean = F.when((F.col("i") >= di) & (F.col("i") < g.nx - di), F.avg("__b").over(g.along_x.rowsBetween(-di, di)))
    return cube.withColumn(out, F.when(inside, F.coalesce(mean, F.lit(0.0))).otherwise(0.0)).drop("__b")


def z_from_hydrostasy(g: Grid, cube: DataFrame, t: str, p: str, ps: str, phis: str, out: str = "phi") -> DataFrame:
    """Adds geopotential, integrated upwards from the surface; the highest k lies lowest."""
    below = Window.partitionBy(*[c for c in g.slice_cols if c != "k"], "j", "i").orderBy(F.desc("k"))
    base = F.coalesce((F.lag(p).over(below) + F.col(p)) / 2, F.col(ps))
    top = F.coalesce((F.lead(p).over(below) + F.col(p)) / 2, F.col(p))
    cube = cube.withColumns({"__low": RL * F.col(t) * F.log(ratio(base, F.col(p))), "__high": RL * F.col(t) * F.log(ratio(F.col(p), top))})
    whole = F.coalesce(F.sum(F.col("__low") + F.col("__high")).over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return cube.withColumn(out, F.col(phis) + whole + F.col("__low")).drop("__low", "__high")


def isentropic_slope(g: Grid, cube: DataFrame, z: str, th: str, dzdth_max: float = 1e4, lo: float = 1e-5, hi: float = 1e3, out: str = "slope") -> DataFrame:
    """Adds the slope of isentropes from z and theta on levels; NULL where they are too steep or outside [lo, hi]."""
    dzdth = ddz_on_q(g, z, th)
    cube = cube.withColumns({"dzdth": dzdth, "__x": ddx(g, z) - dzdth * ddx(g, th), "__y": ddy(g, z) - dzdth * ddy(g, th)})
    slope = F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))
    fine = (F.abs("dzdth") <= dzdth_max) & slope.between(lo, hi)
    return cube.withColumns({"dzdx": F.col("__x"), "dzdy": F.col("__y"), out: F.when(fine, slope)}).drop("__x", "__y")


def pressure_slope(g: Grid, cube: DataFrame, z: str, th: str, dp: str = "dz", config: Config = DEFAULTS, out: str = "slope") -> DataFrame:
    """Adds the slope of isentropes from levels of pressure, and dzdx, dzdy (along isentropes), dzdp, dthdx_p, dthdy_p, dthdp, dzdth.

    ``dp`` is the distance between the levels next to one.  dzdth and what needs it
    are NULL where theta rises by less than ``dzdth_min`` a metre, the slope also
    where it is outside its limits.
    """
    dzdth = ddz_on_q(g, z, th)
    gx, gy = ddx(g, z), ddy(g, z)
    tx, ty = ddx(g, th), ddy(g, th)
    cube = cube.withColumns({"dzdth": F.when(ratio(F.lit(1.0), dzdth) >= config.dzdth_min, dzdth), "__zx": gx, "__zy": gy, "dzdp": ddz(g, z, dp), "dthdx_p": tx, "dthdy_p": ty, "dthdp": ddz(g, th, dp)})
    cube = cube.withColumns({"dzdx": F.col("__zx") - F.col("dthdx_p") * F.col("dzdth"), "dzdy": F.col("__zy") - F.col("dthdy_p") * F.col("dzdth")}).drop("__zx", "__zy")
    slope = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy"))
    return cube.withColumn(out, F.when(slope.between(config.slope_min, config.slope_max), slope))


def prepare_pressure_slope(g: Grid, cube: DataFrame, z: str, temp: str, pres: str, omega: str, dp: str = "dz", config: Config = DEFAULTS) -> DataFrame:
    """Adds th, rho and w of air on levels of pressure, and all that ``pressure_slope`` does."""
    cube = cube.withColumns({"th": theta_from_temp(temp, pres), "rho": rho_from_t_p(temp, pres)})
    return pressure_slope(g, cube.withColumn("w", omega_to_w(omega, "rho")), z, "th", dp, config)


def omega_to_w(omega: str, rho: str) -> Column:
    """Vertical wind from omega."""
    return ratio(-F.col(omega), G * F.col(rho))
