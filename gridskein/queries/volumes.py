"""Queries of fields with levels, of lines on maps, of scales and of files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import diagnostics as dg
from ..operators import features as ft
from ..operators import filters as fl
from ..operators import statistics as st
from ..operators import tendencies as tn
from ..storage import shared_dir
from . import objects
from ._cube import CUBE_SQL, GRID, GRID_Z, LATS, LONS, cube, cube_z, rounded, rounded_sql, stages_sql
from .fields import D1, DEF, F_SQL, ONQ, Q1, SLOPE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_K4 = ("t", "k", "j", "i")


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _field(name: str, made, stages: list[dict[str, str]], outs: dict[str, float], levels: bool = True) -> None:
    """A query that adds columns to the cube, with SQL in stages."""
    g, keys, source = (GRID_Z, _K4, cube_z) if levels else (GRID, ("t", "j", "i"), cube)
    _add(name, lambda s, d: rounded(made(g, g.slices(source(s, d))), outs, keys), stages_sql(stages, levels) + "\n" + rounded_sql(outs, f"s{len(stages)}", keys))


def on_q(v: str) -> str:
    """The SQL of ``ddz_on_q`` for a variable, after the stage Q1."""
    return ONQ.replace("u[d]", f"{v}[d]").replace("u[u]", f"{v}[u]").replace("- u)", f"- {v})").replace("(u -", f"({v} -")


def _grad(v: str, x: str, y: str) -> dict[str, str]:
    return {x: f"({v}[e] - {v}[w]) / dx", y: f"({v}[n] - {v}[s]) / dy"}


# Tendencies.
_ALONG = "(u * (({0}[e] - {0}[w]) / dx) + v * (({0}[n] - {0}[s]) / dy) + w * (({0}[u] - {0}[d]) / dz))"
_field("tend_def_adv3d", lambda g, c: tn.def_adv3d(g, c, "u", "v", "w"), [D1, DEF, {"a": "-" + _ALONG.format("st"), "b": "-" + _ALONG.format("sh")}, {
    "tend_abs": "(st * a + sh * b) / nullif(df * df, 0)", "tend_ang": "0.5 * (st * b - sh * a) / nullif(df * df, 0)"}], {"tend_abs": 1e6, "tend_ang": 1e6})
_field("tend_rotation_strain_ratio", lambda g, c: tn.rotation_strain_ratio(g, c, "u", "v", "s"), [D1, DEF, {
    "xx": "(s[e] - 2 * s + s[w]) / (dx * dx)", "yy": "(s[n] - 2 * s + s[s]) / (dy * dy)", "xy": "(s[ne] - s[nw] - s[se] + s[sw]) / (dx * dy)", "fc": F_SQL},
    {"ta": "(-xy * st + 0.5 * (xx - yy) * sh) / nullif(df * df, 0) - 0.5 * fc"}, {"ratio": "(vx - uy - 2 * ta) / nullif(df, 0)"}], {"ratio": 1e-3}, False)
_X, _Y, _S = "dzdx", "dzdy", "nullif(slope, 0)"
_field("tend_slope_terms", lambda g, c: tn.slope_terms(g, dg.isentropic_slope(g, c, "z", "th"), "u", "v", "w", "th", "w"), [
    *SLOPE, D1 | {"wci": "w - u * dzdx - v * dzdy", "heat": "dzdth * w"},
    {"wq": on_q("w"), "cq": on_q("wci")} | _grad("w", "wx", "wy") | _grad("wci", "cx", "cy") | _grad("heat", "hx", "hy"),
    {"slope_def": f"-(dzdx * dzdx * ux + dzdx * dzdy * (vx + uy) + dzdy * dzdy * vy) / {_S}", "slope_tilt": f"(dzdx * (wx - wq * tx) + dzdy * (wy - wq * ty)) / {_S}",
     "slope_cross": f"(dzdx * (cx - cq * tx) + dzdy * (cy - cq * ty)) / {_S}", "slope_diab": f"-(dzdx * hx + dzdy * hy) / {_S}"}],
    {"slope_def": 1e9, "slope_tilt": 1e9, "slope_cross": 1e9, "slope_diab": 1e9})
_field("tend_slope_iadv", lambda g, c: tn.slope_iadv(g, dg.isentropic_slope(g, c, "z", "th"), "u", "v", "th"), [
    *SLOPE, {"sq": on_q("slope")} | _grad("slope", "sx", "sy"), {"r": "u * (sx - sq * tx) + v * (sy - sq * ty)"}], {"r": 1e9})


def _with_pressure(c: DataFrame) -> DataFrame:
    """The cube with temperature and pressure in place of theta; levels are 14000 Pa apart."""
    return c.withColumns({"temp": F.col("th") * 0.9, "pres": 30000.0 + 14000.0 * F.col("k"), "omega": F.col("w"), "dz": F.lit(28000.0)}).drop("th", "w")


_PRES = [
    {"temp": "th * 0.9::DOUBLE", "pres": "30000.0::DOUBLE + 14000.0::DOUBLE * k", "omega": "w"},
    {"th2": "temp / pow(pres / 100000, 287.04::DOUBLE / 1004)", "rho": "pres / (287.04::DOUBLE * temp)"},
    {k: e.replace("th", "th2") for k, e in Q1.items()} | _grad("z", "zx", "zy") | _grad("th2", "dthdx_p", "dthdy_p") | {"dzdp": "(z[u] - z[d]) / 28000", "dthdp": "(th2[u] - th2[d]) / 28000", "w2": "-omega / (9.81::DOUBLE * rho)"},
    {"q": on_q("z").replace("th", "th2")},
    {"dzdth": "CASE WHEN 1 / nullif(q, 0) >= 0.0001 THEN q END"},
    {"dzdx": "zx - dthdx_p * dzdth", "dzdy": "zy - dthdy_p * dzdth"},
    {"c": "sqrt(dzdx * dzdx + dzdy * dzdy)", "w_ci": "w2 - u * dzdx - v * dzdy"},
    {"slope": "CASE WHEN c BETWEEN 0.00001 AND 1000 THEN c END"},
]
_PREPARED = lambda g, c: dg.prepare_pressure_slope(g, _with_pressure(c), "z", "temp", "pres", "omega")
_field("diag_pressure_slope", _PREPARED, _PRES, {"slope": 1e6, "dzdx": 1e6, "dzdy": 1e6, "dzdp": 1e6, "dthdx_p": 1e6, "dthdy_p": 1e6, "dthdp": 1e6, "dzdth": 1})
_field("diag_cross_isentropic_wind", lambda g, c: _PREPARED(g, c).withColumn("w_ci", tn.cross_isentropic_wind("u", "v", "w")), _PRES, {"w_ci": 1e3})

# Deformation in three dimensions: the oracle has the eigenvalues in closed form.
_G3 = D1 | {"uz": "(u[u] - u[d]) / dz", "vz": "(v[u] - v[d]) / dz", "wx": "(w[e] - w[w]) / dx", "wy": "(w[n] - w[s]) / dy", "wz": "(w[u] - w[d]) / dz"}
_NAMES = [f"{c}{d}" for c in "uvw" for d in "xyz"]
_EIGEN = [
    {"a": "ux - (ux + vy + wz) / 3", "b": "vy - (ux + vy + wz) / 3", "c": "wz - (ux + vy + wz) / 3", "d": "(uy + vx) / 2", "e": "(uz + wx) / 2", "f": "(vz + wy) / 2"},
    {"p": "sqrt((a * a + b * b + c * c + 2 * (d * d + e * e + f * f)) / 6)", "det": "a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)"},
    {"phi": "acos(greatest(-1, least(1, det / nullif(2 * p * p * p, 0)))) / 3"},
    {"e_max": "coalesce(2 * p * cos(phi), p)", "e_min": "coalesce(2 * p * cos(phi + 2 * pi() / 3), p)"},
    {"e_mid": "-(e_max + e_min)"},
]
_WHOLE = " AND ".join(f"{n} IS NOT NULL" for n in _NAMES)
_E3 = {"e_max": 1e3, "e_mid": 1e3, "e_min": 1e3}
_NATURAL = [
    {"rho": "1.2::DOUBLE - 0.1::DOUBLE * k"},
    {"wm": "-w * rho * 9.81::DOUBLE", "dzm": "-dz * rho * 9.81::DOUBLE"},
    {k: e.replace("w[", "wm[").replace("/ dz", "/ dzm") for k, e in _G3.items()} | {"l2": "nullif(sqrt(u * u + v * v), 0)", "l3": "nullif(sqrt(u * u + v * v + w * w), 0)"},
    {f"r{x}": f"(u * u{x} + v * v{x} + w * w{x}) / l3" for x in "xyz"} | {f"n{x}": f"(u * v{x} - v * u{x}) / l2" for x in "xyz"} | {f"m{x}": f"-(u * u{x} + v * v{x}) * w / (l2 * l3) + w{x} * l2 / l3" for x in "xyz"},
]


def _deformation(name: str, part: str = "all", natural: bool = False) -> None:
    def query(s, d):
        c = cube_z(s, d).withColumn("rho", 1.2 - 0.1 * F.col("k"))
        return rounded(ft.def_3d(GRID_Z, GRID_Z.slices(c), "u", "v", "w", "rho" if natural else None, part, natural), _E3, _K4)

    first, eigen, whole = [_G3], list(_EIGEN), _WHOLE
    if natural:
        turned = dict(zip(_NAMES, [f"{r}{x}" for r in "rnm" for x in "xyz"], strict=True))
        first = _NATURAL
        whole += " AND l2 IS NOT NULL"
        eigen[0] = {k: "".join(turned.get(w, w) for w in re.split(r"(\b[uvw][xyz]\b)", e)) for k, e in eigen[0].items()}
    if part != "all":
        eigen[0] = {k: e if (k in "abc") == (part == "stretch") else "0.0::DOUBLE" for k, e in eigen[0].items()}
    stages = [*first, *eigen]
    _add(name, query, stages_sql(stages, True) + "\n" + rounded_sql(_E3, f"(SELECT * FROM s{len(stages)} WHERE {whole})", _K4))


_deformation("diag_def_3d")
_deformation("diag_def_3d_stretch", "stretch")
_deformation("diag_def_3d_shear", "shear")
_deformation("diag_def_3d_nat", natural=True)


def _axes(s, d):
    found = ft.def_3d(GRID_Z, GRID_Z.slices(cube_z(s, d)), "u", "v", "w", vectors=True)
    return found.select(*_K4, "e_max", "e_mid", "e_min", *[F.round(F.col(f"v_{n}")[m], 6).alias(f"{n}_{x}") for n in ("max", "mid", "min") for m, x in enumerate("xyz")])


_add("diag_def_3d_axes", _axes)

# Lines on maps.
_lines = objects._drawn
_D = objects._DRAWN


def _carried(s, d):
    return _lines(s, d).withColumn("payload", F.col("y") * 10 + F.col("x"))


_NEAR = "CAST(round(y) AS INTEGER) AS j, CAST(round(x) AS INTEGER) % 64 AS i"
_add("line_mask_lines_payload", lambda s, d: rounded(ft.mask_lines_with_data(GRID, _carried(s, d)), {"value": 1}), _D + rounded_sql({"value": 1}, f"(SELECT t, j, i, arg_max(y * 10 + x, line_id * 1000 + pt) AS value FROM (SELECT *, {_NEAR} FROM d) GROUP BY ALL)"))
_add("line_mask_lines_with_data", lambda s, d: rounded(ft.mask_lines_with_data(GRID, _lines(s, d), cube(s, d), "v"), {"value": 1}), _D + rounded_sql({"value": 1}, f"(SELECT t, j, i, v AS value FROM (SELECT DISTINCT t, {_NEAR} FROM d) JOIN s0 USING (t, j, i))"))
_GAUSS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-5, 6), fl.gauss_weights(5, 1.0), strict=True))
_DENSE = objects.ORACLE_SQL["line_normalize_lines"]
_DENSE = _DENSE[: _DENSE.rindex("SELECT t, j, i, round(density")]
_add("line_smear_lines", lambda s, d: rounded(ft.smear_lines(GRID, _lines(s, d), objects._cells(s)), {"density": 1e9}), _DENSE + f""", n AS (SELECT t, j, i, sum(sqrt(pow(dx * di / 2, 2) + pow(dy * dj / 2, 2)) / 2 / (dx * dy / 4)) AS density FROM h JOIN c ON c.j = cy AND c.i = CAST(cx AS INTEGER) % 64 GROUP BY ALL),
    z AS (SELECT x.t, c.j, c.i, coalesce(n.density, 0) AS a FROM (SELECT DISTINCT t FROM d) x CROSS JOIN c LEFT JOIN n ON n.t = x.t AND n.j = c.j AND n.i = c.i), w(o, f) AS (VALUES {_GAUSS}),
    y1 AS (SELECT z.t, z.j - w.o AS j, z.i, sum(w.f * z.a) AS a, count(*) AS n FROM z, w GROUP BY ALL), x1 AS (SELECT t, j, (i - o + 64) % 64 AS i, sum(f * CASE WHEN n = 11 THEN a END) AS a, min(n) AS n FROM y1, w GROUP BY ALL)
    """ + rounded_sql({"density": 1e9}, "(SELECT t, j, i, CASE WHEN n = 11 THEN a END AS density FROM x1 WHERE j BETWEEN 0 AND 49)"))  # fmt: skip
_add("line_to_coordinates", lambda s, d: rounded(ft.lines_to_coordinates(GRID, _lines(s, d), objects._cells(s)), {"x": 1, "y": 1}, ("t", "line_id", "pt")), _D + rounded_sql({"x": 1, "y": 1}, "(SELECT t, line_id, pt, 5.625 * x AS x, -73.5 + 3 * y AS y FROM d)", ("t", "line_id", "pt")))
_add("line_long_lines", lambda s, d: rounded(ft.long_lines(_lines(s, d).filter(F.col("y") > F.col("line_id")), 32), {"x": 1}, ("t", "line_id", "pt")),
     _D + ", e AS (SELECT * FROM d WHERE y > line_id)\n" + rounded_sql({"x": 1}, "(SELECT * FROM e WHERE (t, line_id) IN (SELECT (t, line_id) FROM e GROUP BY t, line_id HAVING count(*) >= 32))", ("t", "line_id", "pt")))
_add("filter_concat1lonlat", lambda s, d: rounded(fl.append_first_column(GRID, cube(s, d).select("t", "j", "i", "lon", "lat", "u"), "lon"), {"lon": 1, "lat": 1, "u": 1}),
     f"WITH {CUBE_SQL}\n" + rounded_sql({"lon": 1, "lat": 1, "u": 1}, "(SELECT t, j, i, lon, lat, u FROM s0 UNION ALL SELECT t, j, 64, lon + 360, lat, u FROM s0 WHERE i = 0)"))


def _with_gaps(s, d):
    return cube(s, d).withColumn("u", F.when(F.col("v").between(-1, 1), None).otherwise(F.col("u")))


_add("filter_smooth_xy_nan", lambda s, d: rounded(ft.smooth_xy_missing(GRID, _with_gaps(s, d), "u", 2), {"u": 1}))
_add("contour_to_coordinates", lambda s, d: ft.polygons_to_coordinates(GRID, objects._contours(s, d).filter("closed"), LATS, LONS).select("t", "level", "contour_id", "part", F.size("geometry").alias("n"), "geometry"))

# Solvers: what the operator makes of a field gives the field back.


def _applied(s, d):
    """u - 1.5 (its four neighbours - 4 u), periodic in both directions."""
    c = cube(s, d).select("t", "j", "i", "u")
    near = c.select("t", F.explode(F.array(*[F.struct(F.pmod(F.col("j") + b, F.lit(50)).alias("j"), F.pmod(F.col("i") + a, F.lit(64)).alias("i")) for b, a in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("c"), "u")
    return c.join(near.groupBy("t", "c.j", "c.i").agg(F.sum("u").alias("near")), ["t", "j", "i"]).withColumn("b", F.col("u") - 1.5 * (F.col("near") - 4 * F.col("u")))


#: Slices without one of their cells have no solution.
_SOLVED = f"WITH {CUBE_SQL}, g AS (SELECT * FROM (SELECT t, count(u) = 3200 AS whole FROM s0 GROUP BY t), (SELECT CAST(unnest(range(50)) AS INTEGER) AS j), (SELECT CAST(unnest(range(64)) AS INTEGER) AS i))\n"
for _method in ("multigrid", "cg", "bicgstab"):
    _add(f"solve_{_method}", lambda s, d, m=_method: rounded(ft.solve_helmholtz(GRID, _applied(s, d), "b", 1.5, m), {"x": 1e-2}), _SOLVED + rounded_sql({"x": 1e-2}, "(SELECT g.t, g.j, g.i, CASE WHEN g.whole THEN u END AS x FROM g LEFT JOIN s0 ON s0.t = g.t AND s0.j = g.j AND s0.i = g.i)"))

# Scales and files.


def _ticks(s, d):
    limits = st.scale_limits(cube(s, d), "u", "both")
    return s.createDataFrame(list(enumerate(st.scale_ticks(limits))), "n int, tick double").withColumn("tick", F.round("tick", 6))


_add("util_autoscale", _ticks, f"""WITH {CUBE_SQL}, o AS (SELECT list_sort(list(u)) AS a, count(*) AS n FROM s0), l AS (SELECT a[CAST(floor(0.02 * n) AS BIGINT) + 1] AS lo, a[CAST(floor(0.98 * n) AS BIGINT) + 1] AS hi FROM o),
    e AS (SELECT *, log10((hi - lo) / 7) AS g FROM l), w AS (SELECT lo, hi, arg_min(k, abs(log10(k) - (g - floor(g)))) * pow(10, floor(any_value(g))) AS w FROM e, (SELECT unnest([1, 2, 3, 5, 10]) AS k) GROUP BY lo, hi),
    rg AS (SELECT w, floor(lo / w) AS a, ceil(hi / w) AS b FROM w)
    SELECT CAST(x AS INTEGER) AS n, round((a + x) * w, 6) AS tick FROM (SELECT w, a, unnest(range(0, CAST(b - a AS BIGINT) + 1)) AS x FROM rg)""")


def _files(s, d):
    """Slices packed into netCDF files, a file for each time, and read back."""
    made = sources.netcdf_files(GRID, cube(s, d), ["u", "v"], LATS, LONS, {"u": (0.001, 1.0)})
    return sources.rows_of_netcdf(made.withColumnRenamed("t", "time")).groupBy("file", "variable").agg(F.count("value").alias("n"), F.round(F.sum(F.col("value") * (F.col("j") + 1) * (F.col("i") + 1)) / 1000, 2).alias("total"))


_add("src_netcdf_files", _files, f"""WITH {CUBE_SQL}, p AS (SELECT t, j, i, 'u' AS variable, round_even((u - 1) / 0.001::DOUBLE, 0) * 0.001::DOUBLE + 1 AS x FROM s0 UNION ALL SELECT t, j, i, 'v', v FROM s0)
    SELECT CAST(t AS VARCHAR) AS file, variable, count(*) AS n, round(sum(x * (j + 1) * (i + 1)) / 1000, 2) AS total FROM p GROUP BY ALL""")


def _stored(s, d):
    """The cube written to netCDF files by the data source, a file for each time; the folder."""
    sources.register_netcdf(s)
    path = f"{shared_dir(s)}/gridskein/netcdf-{uuid.uuid4().hex}"
    sources.netcdf_files(GRID, cube(s, d), ["u", "v"], LATS, LONS, {"u": (0.001, 1.0)}).write.format("netcdf").mode("append").save(path)
    return path


def _from_source(s, d):
    rows = s.read.format("netcdf").load(_stored(s, d)).filter("variable = 'u'")
    t = F.regexp_extract("file", r"(\d+)\.nc$", 1).cast("int").alias("t")
    return rows.groupBy(t).agg(F.count("value").alias("n"), F.round(F.sum(F.col("value") * (F.col("j") + 1) * (F.col("i") + 1)) / 1000, 2).alias("total"))


def _by_latitude(s, d):
    """Means of a variable by the coordinate that the files themselves give."""
    path = _stored(s, d)
    lat = s.read.format("netcdf").option("axes", "true").load(path).filter("variable = 'latitude'").select("file", F.col("n").cast("int").alias("j"), F.col("value").alias("lat"))
    rows = s.read.format("netcdf").load(path).filter("variable = 'v'").join(lat, ["file", "j"])
    return rows.groupBy("lat").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_add("src_netcdf_source", _from_source, f"""WITH {CUBE_SQL} SELECT t, count(*) AS n, round(sum((round_even((u - 1) / 0.001::DOUBLE, 0) * 0.001::DOUBLE + 1) * (j + 1) * (i + 1)) / 1000, 2) AS total FROM s0 GROUP BY t""")
_add("src_netcdf_axes", _by_latitude, f"""WITH {CUBE_SQL} SELECT lat, count(*) AS n, round(avg(v), 6) AS mean FROM s0 GROUP BY lat""")
