"""Queries of derivatives, diagnostics, thermodynamics and geometry on cubes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sphere_geometry as sg
from ..functions import thermodyn as td
from ..operators import derivatives as dv
from ..operators import diagnostics as dg
from ..operators import tendencies as tn
from ._cube import GRID, GRID_Z, cube, cube_z, rounded, rounded_sql, stages_sql

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
_K4 = ("t", "k", "j", "i")


def _add(name: str, spark_fn: Callable, stages: list[dict[str, str]], outs: dict[str, float], levels: bool = False) -> None:
    """Register a query on the cube: spark_fn(grid, cube) gives Columns by name or a cube with them."""
    g, keys = (GRID_Z, _K4) if levels else (GRID, ("t", "j", "i"))

    def query(spark, sf_dir) -> DataFrame:
        base = g.slices((cube_z if levels else cube)(spark, sf_dir))
        made = spark_fn(g, base)
        return rounded(made if isinstance(made, DataFrame) else base.withColumns(made), outs, keys)

    QUERIES[name] = query
    ORACLE_SQL[name] = stages_sql(stages, levels) + "\n" + rounded_sql(outs, f"s{len(stages)}", keys)


UX, UY, VX, VY = "(u[e] - u[w]) / dx", "(u[n] - u[s]) / dy", "(v[e] - v[w]) / dx", "(v[n] - v[s]) / dy"
SX, SY = "(s[e] - s[w]) / dx", "(s[n] - s[s]) / dy"
D1 = {"ux": UX, "uy": UY, "vx": VX, "vy": VY}
S1 = {"sx": SX, "sy": SY}
FF2 = "nullif(u * u + v * v, 0)"
SH, ST = "(uy + vx)", "(ux - vy)"
ANGLE = f"0.5 * atan2({SH}, {ST})"

# Derivatives.
_add("deriv_ddx", lambda g, c: {"r": dv.ddx(g, "u")}, [{"r": UX}], {"r": 1e6})
_add("deriv_ddy", lambda g, c: {"r": dv.ddy(g, "u")}, [{"r": UY}], {"r": 1e6})
_add("deriv_ddx_o4", lambda g, c: {"r": dv.ddx_o4(g, "u")}, [{"r": "(8 * (u[e] - u[w]) - (u[ee] - u[ww])) / (6 * dx)"}], {"r": 1e6})
_add("deriv_ddy_o4", lambda g, c: {"r": dv.ddy_o4(g, "u")}, [{"r": "(8 * (u[n] - u[s]) - (u[nn] - u[ss])) / (6 * dy)"}], {"r": 1e6})
_add("deriv_ddx2", lambda g, c: {"r": dv.ddx2(g, "u")}, [{"r": "(u[e] - 2 * u + u[w]) / (dx * dx)"}], {"r": 1e12})
_add("deriv_ddy2", lambda g, c: {"r": dv.ddy2(g, "u")}, [{"r": "(u[n] - 2 * u + u[s]) / (dy * dy)"}], {"r": 1e12})
_add("deriv_ddxy", lambda g, c: g.neighbours(c, "u").withColumn("r", dv.ddxy(g, "u")), [{"r": "(u[ne] - u[nw] - u[se] + u[sw]) / (dx * dy)"}], {"r": 1e12})
_add("deriv_lap2", lambda g, c: {"r": dv.lap2(g, "u")}, [{"r": "(u[e] - 2 * u + u[w]) / (dx * dx) + (u[n] - 2 * u + u[s]) / (dy * dy)"}], {"r": 1e12})
_add("deriv_antilap2", lambda g, c: {"r": dv.antilap2(g, "u")}, [{"r": "(u[e] - 2 * u + u[w]) / (dx * dx) - (u[n] - 2 * u + u[s]) / (dy * dy)"}], {"r": 1e12})
_add("deriv_grad", lambda g, c: dict(zip(("x", "y"), dv.grad(g, "s"), strict=True)), [{"x": f"CASE WHEN {SY} IS NOT NULL THEN {SX} END", "y": f"CASE WHEN {SX} IS NOT NULL THEN {SY} END"}], {"x": 1e6, "y": 1e6})
_add("deriv_ddz", lambda g, c: {"r": dv.ddz(g, "u")}, [{"r": "(u[u] - u[d]) / dz"}], {"r": 1e6}, True)
ONQ = "((qu / nullif(ql, 0)) * (u[d] - u) + (ql / nullif(qu, 0)) * (u - u[u])) / nullif(qu + ql, 0)"
Q1 = {"qu": "th - th[u]", "ql": "th[d] - th"}
_add("deriv_ddz_on_q", lambda g, c: {"r": dv.ddz_on_q(g, "u", "th")}, [Q1, {"r": ONQ}], {"r": 1e3}, True)
_add("deriv_ddx_on_q", lambda g, c: {"r": dv.ddx_on_q(g, "u", "th")}, [Q1, {"r": f"{UX} - {ONQ} * ((th[e] - th[w]) / dx)"}], {"r": 1e6}, True)
_add("deriv_ddy_on_q", lambda g, c: {"r": dv.ddy_on_q(g, "u", "th")}, [Q1, {"r": f"{UY} - {ONQ} * ((th[n] - th[s]) / dy)"}], {"r": 1e6}, True)
_add("deriv_grad_3d", lambda g, c: dict(zip(("x", "y", "r"), dv.grad_3d(g, "u"), strict=True)), [{"x": f"CASE WHEN {UY} IS NOT NULL THEN {UX} END", "y": UY, "r": "(u[u] - u[d]) / dz"}], {"x": 1e6, "y": 1e6, "r": 1e6}, True)

# Diagnostics of the wind.
_add("diag_vor", lambda g, c: {"r": dg.vor(g, "u", "v")}, [D1, {"r": "vx - uy"}], {"r": 1e6})
_add("diag_div", lambda g, c: {"r": dg.div(g, "u", "v")}, [D1, {"r": "ux + vy"}], {"r": 1e6})
_add("diag_def_shear", lambda g, c: {"r": dg.def_shear(g, "u", "v")}, [D1, {"r": SH}], {"r": 1e6})
_add("diag_def_stretch", lambda g, c: {"r": dg.def_stretch(g, "u", "v")}, [D1, {"r": ST}], {"r": 1e6})
_add("diag_def_total", lambda g, c: {"r": dg.def_total(g, "u", "v")}, [D1, {"r": f"sqrt({SH} * {SH} + {ST} * {ST})"}], {"r": 1e6})
_add("diag_def_angle", lambda g, c: {"r": dg.def_angle(g, "u", "v")}, [D1, {"r": ANGLE}], {"r": 1})
WRAP = "CASE WHEN a >= pi() / 2 THEN a - pi() WHEN a < -pi() / 2 THEN a + pi() ELSE a END"
_add("diag_def_angle_nat", lambda g, c: {"r": dg.def_angle_nat(g, "u", "v")}, [D1, {"a": f"{ANGLE} - atan2(v, u)"}, {"r": WRAP}], {"r": 1})
_add("diag_vor_curv", lambda g, c: {"r": dg.vor_curv(g, "u", "v")}, [D1, {"r": f"(u * u * vx + u * v * (vy - ux) - v * v * uy) / {FF2}"}], {"r": 1e6})
_add("diag_def_stretch_nat", lambda g, c: {"r": dg.def_stretch_nat(g, "u", "v")}, [D1, {"r": f"((u * u - v * v) * {ST} + 2 * u * v * {SH}) / {FF2}"}], {"r": 1e6})
_add("diag_def_shear_nat", lambda g, c: {"r": dg.def_shear_nat(g, "u", "v")}, [D1, {"r": f"((u * u - v * v) * (uy + vy) + 2 * u * v * (vy - ux)) / {FF2}"}], {"r": 1e6})
_add("diag_okuboweiss", lambda g, c: {"r": dg.okuboweiss(g, "u", "v")}, [D1, {"r": f"0.25 * ({SH} * {SH} + {ST} * {ST} - (vx - uy) * (vx - uy))"}], {"r": 1e11})
_add("diag_shear_nat", lambda g, c: dg.shear_nat(g, c, "u", "v", "r"), [{"ff": "sqrt(u * u + v * v)"}, {"r": "(u * ((ff[n] - ff[s]) / dy) - v * ((ff[e] - ff[w]) / dx)) / nullif(ff, 0)"}], {"r": 1e6})
_add(
    "diag_grad_shear_nat",
    lambda g, c: dg.grad_shear_nat(g, c, "u", "v", "r"),
    [{"ff": "sqrt(u * u + v * v)"}, {"a": "(u * ((ff[n] - ff[s]) / dy) - v * ((ff[e] - ff[w]) / dx)) / nullif(ff, 0)"}, {"r": "(u * ((a[n] - a[s]) / dy) - v * ((a[e] - a[w]) / dx)) / nullif(ff, 0)"}],
    {"r": 1e11},
)
_add("diag_isoline_angle", lambda g, c: {"r": dg.isoline_angle(g, "s")}, [S1, {"r": "atan2(-sx, sy)"}], {"r": 1})
_add("diag_isoline_to_deformation_angle", lambda g, c: {"r": dg.isoline_to_deformation_angle(g, "u", "v", "s")}, [D1 | S1, {"r": f"{ANGLE} - atan2(-sx, sy)"}], {"r": 1})
BETA = f"2 * ({ANGLE} - atan2(-sx, sy))"
_add(
    "diag_frontogenesis",
    lambda g, c: dict(zip(("x", "y"), dg.frontogenesis(g, "u", "v", "s"), strict=True)),
    [D1 | S1, {"d": f"sqrt({SH} * {SH} + {ST} * {ST})", "b": BETA}, {"x": "-0.5 * (ux + vy - d * cos(b))", "y": "0.5 * (vx - uy + d * sin(b))"}],
    {"x": 1e6, "y": 1e6},
)
F_SQL = "2 * 7.292123516990375e-05 * sin(radians(lat))"
_add("diag_uv_geo_from_pot", lambda g, c: dict(zip(("x", "y"), dg.uv_geo_from_pot(g, "s"), strict=True)), [S1, {"x": f"-sy / ({F_SQL})", "y": f"sx / ({F_SQL})"}], {"x": 1e3, "y": 1e3})
_add("diag_parfitt_f", lambda g, c: {"r": dg.parfitt_f(g, "s", "u", "v")}, [D1 | S1, {"r": f"(vx - uy) * sqrt(sx * sx + sy * sy) / ((0.45::DOUBLE / 100000) * ({F_SQL}))"}], {"r": 1})
_add(
    "diag_def_nat_shearless",
    lambda g, c: dict(zip(("x", "y"), dg.def_nat_shearless(g, "u", "v"), strict=True)),
    [
        D1,
        {"b": f"(u * (u * uy + v * vy) - v * (u * ux + v * vx)) / {FF2}"},
        {"ax": f"ux + b * u * v / {FF2}", "ay": f"uy - b * u * u / {FF2}", "bx": f"vx + b * v * v / {FF2}", "bz": f"vy - b * u * v / {FF2}"},
        {"x": "sqrt((ay + bx) * (ay + bx) + (ax - bz) * (ax - bz))", "a": "0.5 * atan2(ay + bx, ax - bz) - atan2(v, u)"},
        {"y": WRAP},
    ],
    {"x": 1e6, "y": 1},
)
_add("diag_streamline_radius", lambda g, c: {"r": 1 / dg.streamline_radius(g, "u", "v")}, [
    {"g": "atan2(v, u)", "ff": "sqrt(u * u + v * v)"}, {"a": "g[e] - g[w]", "b": "g[n] - g[s]"},
    {"a2": "CASE WHEN a > pi() THEN a - 2 * pi() WHEN a < -pi() THEN a + 2 * pi() ELSE a END", "b2": "CASE WHEN b > pi() THEN b - 2 * pi() WHEN b < -pi() THEN b + 2 * pi() ELSE b END"},
    {"r": "tan((u * a2 + v * b2) / nullif(ff, 0)) / ((abs(u) * dx + abs(v) * dy) / nullif(ff, 0))"},
], {"r": 1e3})
R, R2 = "sqrt(sx * sx + sy * sy)", {"r0": "sqrt(sx * sx + sy * sy)"}
_add(
    "diag_front_maxcurv",
    lambda g, c: dg.front_maxcurv(g, c, "s", "u", "v"),
    [S1, R2, {"rx": "(r0[e] - r0[w]) / dx", "ry": "(r0[n] - r0[s]) / dy"}, {"a": "sqrt(rx * rx + ry * ry)"},
     {"front_int": "(sx * rx + sy * ry) / nullif(r0, 0)", "front_spd": "(u * rx + v * ry) / nullif(a, 0)", "front_loc": "(a[e] - a[w]) / dx + (a[n] - a[s]) / dy"}],
    {"front_int": 1e10, "front_spd": 1, "front_loc": 1e15},
)
_add(
    "diag_front_maxgrad",
    lambda g, c: dg.front_maxgrad(g, c, "s", "u", "v"),
    [S1, {"front_int": R, "front_spd": f"(u * sx + v * sy) / nullif({R}, 0)", "front_loc": "(s[e] - 2 * s + s[w]) / (dx * dx) + (s[n] - 2 * s + s[s]) / (dy * dy)"}],
    {"front_int": 1e6, "front_spd": 1, "front_loc": 1e10},
)
TH = {"tx": "(th[e] - th[w]) / dx", "ty": "(th[n] - th[s]) / dy", "tz": "(th[u] - th[d]) / dz"}
_add(
    "diag_frontogenesis_contributors",
    lambda g, c: dg.frontogenesis_terms(g, c, "u", "v", "w", "th", "z"),
    [
        D1 | TH | {"wx": "(w[e] - w[w]) / dx", "wy": "(w[n] - w[s]) / dy", "hx": "(z[e] - z[w]) / dx", "hy": "(z[n] - z[s]) / dy"},
        {"m": "sqrt(tx * tx + ty * ty)"},
        {
            "front_div": "-0.5 * m * (ux + vy)", "front_def": "-0.5 * ((tx * tx - ty * ty) * (ux - vy) + 2 * tx * ty * (vx + uy)) / nullif(m, 0)",
            "front_tilt": "-tz * (tx * wx + ty * wy) / nullif(m, 0)", "front_heat": "(tx * hx + ty * hy) / nullif(m, 0)",
        },
    ],
    {"front_div": 1e11, "front_def": 1e11, "front_tilt": 1e11, "front_heat": 1e6}, True,
)
SLOPE = [Q1 | {"zx": "(z[e] - z[w]) / dx", "zy": "(z[n] - z[s]) / dy", "tx": "(th[e] - th[w]) / dx", "ty": "(th[n] - th[s]) / dy"},
         {"dzdth": ONQ.replace("u[d]", "z[d]").replace("u[u]", "z[u]").replace("- u)", "- z)").replace("(u -", "(z -")},
         {"a": "zx - dzdth * tx", "b": "zy - dzdth * ty"}, {"c": "sqrt(a * a + b * b)"},
         {"dzdx": "a", "dzdy": "b", "slope": "CASE WHEN abs(dzdth) <= 10000 AND c BETWEEN 0.00001 AND 1000 THEN c END"}]
_add("diag_isentropic_slope", lambda g, c: dg.isentropic_slope(g, c, "z", "th"), SLOPE, {"slope": 1e6, "dzdx": 1e6, "dzdy": 1e6, "dzdth": 1}, True)
_add("diag_rwb_by_grad_rev", lambda g, c: dg.rwb_by_grad_rev(g, "s"), [
    S1, {"y": "sy * sign(lat)", "sg": "sign(lat)"}, {"ok": "sx IS NOT NULL AND y IS NOT NULL", "an": "(atan2(y * sg, sx) + pi() / 2) * sg > 0", "fl": "CASE WHEN y < -4e-12 THEN 1 ELSE 0 END", "sz": "sqrt(sx * sx + y * y)", "bk": "CASE WHEN y < 0 THEN -y ELSE 0 END"},
    {"tested": "CASE WHEN ok THEN 1 ELSE 0 END", "flag_a": "CASE WHEN ok AND an THEN fl ELSE 0 END", "flag_c": "CASE WHEN ok AND NOT an THEN fl ELSE 0 END",
     "size_a": "CASE WHEN ok AND an AND fl = 1 THEN sz ELSE 0 END", "size_c": "CASE WHEN ok AND NOT an AND fl = 1 THEN sz ELSE 0 END",
     "back_a": "CASE WHEN ok AND an THEN bk ELSE 0 END", "back_c": "CASE WHEN ok AND NOT an THEN bk ELSE 0 END"},
], {"tested": 1, "flag_a": 1, "flag_c": 1, "size_a": 1e6, "size_c": 1e6, "back_a": 1e6, "back_c": 1e6})

# Tendencies.
DEF = {"sh": SH, "st": ST, "df": f"sqrt({SH} * {SH} + {ST} * {ST})", "an": ANGLE}
_add("tend_def_adv", lambda g, c: tn.def_adv(g, c, "u", "v"), [D1, DEF, {
    "tend_abs": "-(u * ((df[e] - df[w]) / dx) + v * ((df[n] - df[s]) / dy)) / nullif(df, 0)",
    "tend_ang": "-0.5 * (st * (u * ((sh[e] - sh[w]) / dx) + v * ((sh[n] - sh[s]) / dy)) - sh * (u * ((st[e] - st[w]) / dx) + v * ((st[n] - st[s]) / dy))) / nullif(df * df, 0)"}], {"tend_abs": 1e6, "tend_ang": 1e6})
_add("tend_def_beta", lambda g, c: tn.def_beta(g, c.withColumn("beta", 1e-11 * F.cos(F.radians("lat"))), "u", "v", "beta"), [D1, DEF, {"be": "1e-11 * cos(radians(lat))"}, {
    "tend_abs": "be * (st * u + sh * v) / nullif(df * df, 0)", "tend_ang": "be * (sh * u - st * v) / nullif(df * df, 0)"}], {"tend_abs": 1e6, "tend_ang": 1e6})
_add("tend_def_prescor", lambda g, c: tn.def_prescor(g, g.neighbours(c, "s"), "u", "v", "s", "lat"), [D1, DEF, {
    "xx": "(s[e] - 2 * s + s[w]) / (dx * dx)", "yy": "(s[n] - 2 * s + s[s]) / (dy * dy)", "xy": "(s[ne] - s[nw] - s[se] + s[sw]) / (dx * dy)", "fc": F_SQL}, {
    "tend_abs": "(-2 * xy * sh - (xx - yy) * st) / nullif(df * df, 0)", "tend_ang": "(-xy * st + 0.5 * (xx - yy) * sh) / nullif(df * df, 0) - 0.5 * fc"}], {"tend_abs": 1e3, "tend_ang": 1e3})
_add("tend_uv_prescor", lambda g, c: dict(zip(("x", "y"), tn.uv_prescor(g, "u", "v", "s"), strict=True)), [S1, {"x": f"-sx + {F_SQL} * v", "y": f"-sy - {F_SQL} * u"}], {"x": 1e6, "y": 1e6})
_add("tend_def_tilt", lambda g, c: tn.def_tilt(g, c, "u", "v", "w"), [D1 | {"uz": "(u[u] - u[d]) / dz", "vz": "(v[u] - v[d]) / dz", "wx": "(w[e] - w[w]) / dx", "wy": "(w[n] - w[s]) / dy"}, DEF, {
    "a": "-(uz * wx - vz * wy)", "b": "-(uz * wy + vz * wx)"}, {"tend_abs": "(st * a + sh * b) / nullif(df * df, 0)", "tend_ang": "0.5 * (st * b - sh * a) / nullif(df * df, 0)"}], {"tend_abs": 1e6, "tend_ang": 1e6}, True)
_add("tend_slope_adv", lambda g, c: tn.slope_adv(g, dg.isentropic_slope(g, c, "z", "th"), "u", "v"), [*SLOPE, {"r": "-(u * ((slope[e] - slope[w]) / dx) + v * ((slope[n] - slope[s]) / dy))"}], {"r": 1e9}, True)
_add("tend_accgrad_eigs", lambda g, c: tn.accgrad_eigs(g, c, "u", "v", "s"), [S1, {"ax": f"-sx + {F_SQL} * v", "ay": f"-sy - {F_SQL} * u"}, {
    "a": "(ax[e] - ax[w]) / dx", "b": "(ax[n] - ax[s]) / dy", "c": "(ay[e] - ay[w]) / dx", "d": "(ay[n] - ay[s]) / dy"}, {"h": "0.5 * (a + d)", "k": "0.25 * (a - d) * (a - d) + b * c"}, {
    "plus_re": "CASE WHEN k >= 0 THEN h + sqrt(k) ELSE h END", "plus_im": "CASE WHEN k < 0 THEN sqrt(-k) ELSE k * 0 END", "minus_re": "CASE WHEN k >= 0 THEN h - sqrt(k) ELSE h END", "minus_im": "CASE WHEN k < 0 THEN -sqrt(-k) ELSE k * 0 END"}],
    {"plus_re": 1e9, "plus_im": 1e9, "minus_re": 1e9, "minus_im": 1e9})

# Thermodynamics.
ES, EQ = "611.2 * exp(17.67 * (temp - 273.15) / (temp - 273.15 + 243.5))", "q * p / (0.622 + 0.378 * q)"
MV = "q / (1 - q)"
for _name, _col, _sql in (
    ("e_sat_liq", lambda: td.e_sat_liq("temp"), ES),
    ("e_from_q", lambda: td.e_from_q("q", "p"), EQ),
    ("e_from_mv", lambda: td.e_from_mv("q", "p"), "q * p / (0.622 + q)"),
    ("e_from_rh", lambda: td.e_from_rh("u", "temp"), f"u / 100 * ({ES})"),
    ("tdew_from_e", lambda: td.tdew_from_e(td.e_from_q("q", "p")), f"243.5 * ln(({EQ}) / 611.2) / (17.67 - ln(({EQ}) / 611.2)) + 273.15"),
    ("q_from_e", lambda: td.q_from_e(td.e_from_q("q", "p"), "p") * 1e3, f"0.622 * ({EQ}) / (p - 0.378 * ({EQ})) * 1000"),
    ("mv_from_e", lambda: td.mv_from_e(td.e_from_q("q", "p"), "p") * 1e3, f"0.622 * ({EQ}) / (p - ({EQ})) * 1000"),
    ("rh_from_e", lambda: td.rh_from_e(td.e_from_q("q", "p"), "temp"), f"100 * ({EQ}) / ({ES})"),
    ("mv_from_q", lambda: td.mv_from_q("q") * 1e3, f"{MV} * 1000"),
    ("te_from_q", lambda: td.te_from_q("q", "temp"), f"temp + 2.501e6 / 1004.0 * ({MV})"),
    ("thetae_from_q", lambda: td.thetae_from_q("q", "temp", "p"), f"temp * pow(100000 / (p - ({EQ})), 287.04 / 1004.0) * pow(100 * ({EQ}) / ({ES}), -({MV}) * (461.5 / 1004.0)) * exp(2.501e6 * ({MV}) / (1004.0 * temp))"),
    ("exner", lambda: td.exner("p"), "pow(p / 100000, 287.04 / 1004.0)"),
    ("theta_from_temp", lambda: td.theta_from_temp("temp", "p"), "temp / pow(p / 100000, 287.04 / 1004.0)"),
    ("temp_from_theta", lambda: td.temp_from_theta("temp", "p"), "temp * pow(p / 100000, 287.04 / 1004.0)"),
    ("rho_from_T_p", lambda: td.rho_from_t_p("temp", "p"), "p / (287.04 * temp)"),
    ("density_from_temp", lambda: td.specific_volume("temp", "p"), "287.04 * temp / p"),
    ("w_from_omega", lambda: td.w_from_omega("u", td.rho_from_t_p("temp", "p")), "-u / (9.81 * (p / (287.04 * temp)))"),
    ("geop_from_montgp", lambda: td.geop_from_montgomery("s", "temp", "p") * 1e-3, "(s - 1004.0 * temp * pow(p / 100000, 287.04 / 1004.0)) / 1000"),
    ("cold_air_outbreak_index", lambda: td.cold_air_outbreak("temp", F.col("p") / 100, F.col("temp") + F.col("u"), F.lit(0.0), F.col("q") * 60, None),
     "CASE WHEN q * 60 > 0.5 THEN NULL WHEN (temp + u) * pow(1000 / (p / 100), 287.04 / 1004.0) - temp * pow(1000 / 850.0, 287.04 / 1004.0) < 0 THEN 0 ELSE (temp + u) * pow(1000 / (p / 100), 287.04 / 1004.0) - temp * pow(1000 / 850.0, 287.04 / 1004.0) END"),
):

    def _query(spark, sf_dir, col=_col):
        return rounded(cube(spark, sf_dir).withColumn("r", col()), {"r": 1})

    QUERIES[f"thermo_{_name}"] = _query
    _exact = re.sub(r"(?<![\w.])(\d+\.\d+(?:e\d+)?|\d+e\d+)(?![\w.])", r"\1::DOUBLE", _sql)
    ORACLE_SQL[f"thermo_{_name}"] = stages_sql([{"r": _exact}]) + "\n" + rounded_sql({"r": 1}, "s1")

# Geometry.
_LL = {"a1": "radians(lat)", "a2": "radians(lat / 2 + 5)", "dl": "radians(10 - lon / 3)"}
ARC = "sin(a1) * sin(a2) + cos(a1) * cos(a2) * cos(dl)"


def _points():
    return "lon", "lat", F.col("lon") * (2 / 3) + 10, F.col("lat") / 2 + 5


_to = {"lon2": "lon * (2::DOUBLE / 3) + 10", "lat2": "lat / 2 + 5"}
_rad = {"a1": "radians(lat)", "a2": "radians(lat2)", "dl": "radians(lon2) - radians(lon)", "dg": "radians(lon2 - lon)"}
_geo = [_to, _rad]
for _name, _cols, _more, _outs in (
    ("dist_sphere", lambda: {"r": sg.dist_sphere(*_points())}, {"r": f"6370000 * acos(greatest(-1, least(1, {ARC})))"}, {"r": 1e-3}),
    ("haversine", lambda: {"r": sg.haversine(*_points())}, {"r": "2 * 6371 * asin(sqrt(least(1, pow(sin((a2 - a1) / 2), 2) + cos(a1) * cos(a2) * pow(sin(dg / 2), 2))))"}, {"r": 1e-3}),
    ("great_circle_distance", lambda: {"r": sg.great_circle_distance(6.37e6, *[F.radians(c) for c in _points()])},
     {"r": f"6370000 * atan2(sqrt(pow(cos(a2) * sin(dl), 2) + pow(cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(dl), 2)), {ARC})"}, {"r": 1e-3}),
    ("approx_distance", lambda: {"r": sg.approx_distance(6.37e6, *[F.radians(c) for c in _points()])}, {"r": "6370000 * sqrt(pow(dl * cos((a1 + a2) / 2), 2) + pow(a2 - a1, 2))"}, {"r": 1e-3}),
    ("direction_on_sphere", lambda: {"r": sg.direction_on_sphere(*_points())}, {"r": "CASE WHEN atan2(sin(dg) * cos(a2), cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(dg)) < 0 THEN 2 * pi() ELSE 0 END + atan2(sin(dg) * cos(a2), cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(dg))"}, {"r": 1}),
    ("rossby_radius", lambda: {"r": sg.rossby_radius("lat")}, {"r": "0.13::DOUBLE / (2 * 7.29e-5 * sin(radians(abs(lat))))"}, {"r": 1e-3}),
    ("go_on_sphere", lambda: dict(zip(("x", "y"), sg.go_on_sphere("lon", "lat", F.col("u") * 1e5, F.col("v") * 1e5), strict=True)), {
        "x": "degrees(radians(lon) + atan2(sin(atan2(u * 1e5, v * 1e5)) * sin(sqrt(u * u + v * v) * 1e5 / 6366200) * cos(a1), cos(sqrt(u * u + v * v) * 1e5 / 6366200) - sin(a1) * sin(asin(sin(a1) * cos(sqrt(u * u + v * v) * 1e5 / 6366200) + cos(a1) * sin(sqrt(u * u + v * v) * 1e5 / 6366200) * cos(atan2(u * 1e5, v * 1e5))))))",
        "y": "degrees(asin(sin(a1) * cos(sqrt(u * u + v * v) * 1e5 / 6366200) + cos(a1) * sin(sqrt(u * u + v * v) * 1e5 / 6366200) * cos(atan2(u * 1e5, v * 1e5))))"}, {"x": 1, "y": 1}),
):
    _add(f"geo_{_name}", lambda g, c, cols=_cols: cols(), [*_geo, _more], _outs)
