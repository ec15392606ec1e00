"""Queries of rotated grids and of spherical harmonics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..grid import unrotated
from ..operators import curvilinear as cv
from ..operators import harmonics as hm
from ..operators.kernels import gaussian_latitudes
from ..plans.derived import default_derivations
from ._cube import CUBE_SQL, GRID, LATS, LONS, cube, rounded, rounded_sql, stages_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The true place of the rotated grid's north pole; off the map's lines, so that no two cells are equally far from a place.
POLE_LAT, POLE_LON = 40.3, -167.1


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _cells(s):
    return cv.rotated_cells(s, LATS, LONS, POLE_LAT, POLE_LON, cyclic=True)


def _places(s):
    """A regular grid of latitudes and longitudes, 10 degrees wide."""
    return s.range(17 * 36).select((F.floor(F.col("id") / 36) * 10.0 - 80).alias("lat"), (F.col("id") % 36 * 10.0 - 180).alias("lon"))


def _on_map(s, d):
    """Wind on the rotated grid, turned to true east and north, between cells at the places of the map."""
    east, north = unrotated("u", "v")
    turned = cube(s, d).select("t", "j", "i", "u", "v").join(_cells(s).select("j", "i", "north_x", "north_y"), ["j", "i"]).withColumns({"east": east, "north": north})
    return rounded(cv.at_places(turned, cv.bilinear_weights(GRID, _cells(s), _places(s)), "east", "north"), {"east": 1, "north": 1}, ("t", "lat", "lon"))


def _nearest(s, d):
    """The cube's nearest values at the places of the map, up to 200 km away."""
    near = cv.nearest_cells(_cells(s), _places(s), 200e3)
    return rounded(cube(s, d).select("t", "j", "i", "u").join(near, ["j", "i"]), {"u": 1, "distance": 1e-3}, ("t", "lat", "lon"))


_RAD = "radians(-73.5::DOUBLE + 3 * j) AS b, radians(5.625::DOUBLE * i) AS a"
#: Cells (j, i, x, y, z, nx, ny): unit vectors in true axes and true north in the grid's; places (lat, lon, qx, qy, qz).
_SPHERE = f"""c0 AS (SELECT j, i, sin(b) AS sb, cos(b) AS cb, sin(a) AS sa, cos(a) AS ca, radians({POLE_LAT}::DOUBLE) AS p, radians({POLE_LON}::DOUBLE) AS o
    FROM (SELECT j, i, {_RAD} FROM (SELECT unnest(range(50)) AS j), (SELECT unnest(range(64)) AS i))),
c1 AS (SELECT *, cos(p) * sb - sin(p) * ca * cb AS x1, -sa * cb AS y1, sin(p) * sb + cos(p) * ca * cb AS z, -cos(p) * sa AS n1, sin(p) * cb - cos(p) * sb * ca AS n2 FROM c0),
c AS (SELECT j, i, cos(o) * x1 - sin(o) * y1 AS x, sin(o) * x1 + cos(o) * y1 AS y, z, n1 / sqrt(n1 * n1 + n2 * n2) AS nx, n2 / sqrt(n1 * n1 + n2 * n2) AS ny FROM c1),
q AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS qx, cos(radians(lat)) * sin(radians(lon)) AS qy, sin(radians(lat)) AS qz
    FROM (SELECT (id // 36) * 10.0::DOUBLE - 80 AS lat, (id % 36) * 10.0::DOUBLE - 180 AS lon FROM (SELECT unnest(range(612)) AS id)))"""
_NEAREST_SQL = f"""WITH {CUBE_SQL}, {_SPHERE},
d AS (SELECT lat, lon, j, i, 6370000.0::DOUBLE * 2 * asin(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy) + (z - qz) * (z - qz)) / 2) AS distance FROM q, c),
n AS (SELECT * FROM d WHERE distance <= 200000 QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY distance, j, i) = 1),
o AS (SELECT t, n.lat, n.lon, u, distance FROM n JOIN s0 USING (j, i))
""" + rounded_sql({"u": 1, "distance": 1e-3}, "o", ("t", "lat", "lon"))


def _map_sql() -> str:
    """Quads by the sides that places lie on, against all quads; coordinates in them by Newton's steps; NULL where a cell that counts is missing or NULL."""
    corner = {"00": "j = k.j AND {n}.i = k.i", "01": "j = k.j AND {n}.i = (k.i + 1) % 64", "10": "j = k.j + 1 AND {n}.i = k.i", "11": "j = k.j + 1 AND {n}.i = (k.i + 1) % 64"}
    joins = " ".join(f"JOIN c c{n} ON c{n}." + on.format(n=f"c{n}") for n, on in corner.items())
    columns = ", ".join(f"c{n}.{c} AS {c}{n}" for n in corner for c in "xyz")
    triple = lambda m, n: f"(y{m} * z{n} - z{m} * y{n}) * qx + (z{m} * x{n} - x{m} * z{n}) * qy + (x{m} * y{n} - y{m} * x{n}) * qz"
    ring = [triple(m, n) for m, n in (("00", "01"), ("01", "11"), ("11", "10"), ("10", "00"))]
    inside = f"x00 * qx + y00 * qy + z00 * qz > 0 AND ((least({', '.join(ring)}) >= -1e-13) OR (greatest({', '.join(ring)}) <= 1e-13))"
    flat = ", ".join(f"(x{n} * (-sin(radians(lon))) + y{n} * cos(radians(lon))) / (x{n} * qx + y{n} * qy + z{n} * qz) AS u{n}, (z{n} * cos(radians(lat)) - (x{n} * cos(radians(lon)) + y{n} * sin(radians(lon))) * sin(radians(lat))) / (x{n} * qx + y{n} * qy + z{n} * qz) AS v{n}" for n in corner)
    parts = [CUBE_SQL, _SPHERE, f"k AS (SELECT k.j, k.i, {columns} FROM c k {joins} WHERE k.j < 49)",
             f"m AS (SELECT * FROM q, k WHERE {inside} QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY j, i) = 1)", f"w0 AS (SELECT lat, lon, j, i, {flat}, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b FROM m)"]
    at = lambda d: f"((1 - a) * (1 - b) * {d}00 + a * (1 - b) * {d}01 + (1 - a) * b * {d}10 + a * b * {d}11)"
    by_a = lambda d: f"((1 - b) * ({d}01 - {d}00) + b * ({d}11 - {d}10))"
    by_b = lambda d: f"((1 - a) * ({d}10 - {d}00) + a * ({d}11 - {d}01))"
    for n in range(8):
        parts.append(f"w{n}d AS (SELECT *, {at('u')} AS ru, {at('v')} AS rv, {by_a('u')} AS au, {by_a('v')} AS av, {by_b('u')} AS bu, {by_b('v')} AS bv FROM w{n})")
        parts.append(f"w{n + 1} AS (SELECT * EXCLUDE (ru, rv, au, av, bu, bv) REPLACE (a - (ru * bv - rv * bu) / (au * bv - av * bu) AS a, b - (au * rv - av * ru) / (au * bv - av * bu) AS b) FROM w{n}d)")
    parts.append("g AS (SELECT t, j, i, u * ny - v * nx AS east, u * nx + v * ny AS north FROM s0 JOIN c USING (j, i))")
    parts.append("h AS (SELECT lat, lon, j, i, (1 - a) * (1 - b) AS f FROM w8 UNION ALL SELECT lat, lon, j, (i + 1) % 64, a * (1 - b) FROM w8 UNION ALL SELECT lat, lon, j + 1, i, (1 - a) * b FROM w8 UNION ALL SELECT lat, lon, j + 1, (i + 1) % 64, a * b FROM w8)")
    parts.append("o AS (SELECT t, lat, lon, CASE WHEN sum(CASE WHEN east IS NOT NULL THEN f END) > 1 - 1e-12 THEN sum(f * east) END AS east, CASE WHEN sum(CASE WHEN north IS NOT NULL THEN f END) > 1 - 1e-12 THEN sum(f * north) END AS north FROM g JOIN h USING (j, i) GROUP BY t, lat, lon)")
    return "WITH " + ",\n".join(parts) + "\n" + rounded_sql({"east": 1, "north": 1}, "o", ("t", "lat", "lon"))


_add("grid_rotated_to_map", _on_map, _map_sql())
_add("grid_nearest_cells", _nearest, _NEAREST_SQL)


_DEGREE = 12
_MAP_LATS, _MAP_NX = [-60.0 + 5 * k for k in range(25)], 72


def _polynomials(family: str, weight: str) -> list[str]:
    """CTEs that end in <family> (m, k, j, b): for each wave m functions cos(lat)^m times polynomials of degree k, orthonormal under a weight of the points.

    Each comes from the two before it by the recurrence of orthogonal polynomials, so the SQL knows no Legendre function.
    """
    parts = [f"{family}0 AS (SELECT m, j, x, {weight} AS w, c ** m AS b, 0.0::DOUBLE AS before, 1.0::DOUBLE AS norm FROM points, (SELECT unnest(range({_DEGREE + 1})) AS m))"]
    for k in range(_DEGREE):
        parts.append(f"{family}{k + 1} AS (SELECT m, j, x, w, (x - sum(w * x * b * b) OVER v / sum(w * b * b) OVER v) * b - sum(w * b * b) OVER v / norm * before AS b, b AS before, sum(w * b * b) OVER v AS norm FROM {family}{k} WHERE m < {_DEGREE - k} WINDOW v AS (PARTITION BY m))")
    every = " UNION ALL ".join(f"SELECT m, {k} AS k, j, w, b / sqrt(sum(w * b * b) OVER (PARTITION BY m)) AS b FROM {family}{k}" for k in range(_DEGREE + 1))
    return [*parts, f"{family} AS ({every})"]


def _harmonics_parts(v: str, nx: int = 64, first: int = 0, inverse: bool = False, source: str = "s0") -> list[str]:
    """CTEs that end in o (t, j, i, v): the least squares of the rows by orthogonal polynomials; the inverse Laplacian by those of Gaussian quadrature.

    Points are the rows (0 to 49), the nodes of the quadrature (from 100) and the rows of the other map (from 200); result rows begin with the point ``first``.
    A slice with a NULL or without one of its cells has NULLs.
    """
    lats, weights = gaussian_latitudes(16)
    nodes = ", ".join(f"({100 + n}, {math.sin(math.radians(b))!r}::DOUBLE, 0.0::DOUBLE, {float(w)!r}::DOUBLE)" for n, (b, w) in enumerate(zip(lats.tolist(), weights.tolist(), strict=True)))
    parts = [f"points AS (SELECT j, x, sqrt(1 - x * x) AS c, CASE WHEN j < 100 THEN sqrt(1 - x * x) ELSE 0.0::DOUBLE END AS rowweight, g FROM (SELECT unnest(range(50)) AS j, sin(radians(-73.5::DOUBLE + 3 * unnest(range(50)))) AS x, 0.0::DOUBLE AS g UNION ALL SELECT j, x, g FROM (VALUES {nodes}) n(j, x, z, g) UNION ALL SELECT 200 + unnest(range(25)), sin(radians(-60.0::DOUBLE + 5 * unnest(range(25)))), 0.0::DOUBLE))"]
    parts += _polynomials("a", "rowweight")
    parts.append(f"f AS (SELECT t, j, m, CASE WHEN count({v}) = 64 THEN sum({v} * cos(2 * pi() * m * i / 64)) / 64 END AS re, CASE WHEN count({v}) = 64 THEN -sum({v} * sin(2 * pi() * m * i / 64)) / 64 END AS im FROM {source}, (SELECT unnest(range({_DEGREE + 1})) AS m) GROUP BY t, j, m)")
    parts.append("d AS (SELECT t, m, k, CASE WHEN count(re) = 50 THEN sum(w * b * re) END AS re, CASE WHEN count(im) = 50 THEN sum(w * b * im) END AS im FROM f JOIN a USING (m, j) GROUP BY t, m, k)")
    parts.append("e AS (SELECT t, m, j, sum(re * b) AS re, sum(im * b) AS im FROM d JOIN a USING (m, k) GROUP BY t, m, j)")
    made = "e"
    if inverse:
        parts += _polynomials("l", "g")
        parts.append("dl AS (SELECT t, m, k, sum(w * b * re) AS re, sum(w * b * im) AS im FROM e JOIN l USING (m, j) WHERE j BETWEEN 100 AND 199 GROUP BY t, m, k)")
        parts.append("el AS (SELECT t, m, j, sum(re * b * f) AS re, sum(im * b * f) AS im FROM (SELECT *, CASE WHEN m + k > 0 THEN -(6370000.0::DOUBLE ** 2) / ((m + k) * (m + k + 1)) ELSE 0 END AS f FROM dl) JOIN l USING (m, k) GROUP BY t, m, j)")
        made = "el"
    parts.append(f"o AS (SELECT t, j - {first} AS j, i, sum(CASE WHEN m > 0 THEN 2 ELSE 1 END * (re * cos(2 * pi() * m * i / {nx}) - im * sin(2 * pi() * m * i / {nx}))) AS {v} FROM {made}, (SELECT unnest(range({nx})) AS i) WHERE j BETWEEN {first} AND {first + 99} GROUP BY t, j, i)")
    return parts


def _harmonics_sql(v: str, scale: float, *more, **options) -> str:
    return "WITH " + ",\n".join([CUBE_SQL, *_harmonics_parts(v, *more, **options)]) + "\n" + rounded_sql({v: scale}, "o")


def _irrotational_sql() -> str:
    """Differences of the inverse Laplacian of the divergence."""
    near = {"e": "n.j = o.j AND n.i = (o.i + 1) % 64", "w": "n.j = o.j AND n.i = (o.i + 63) % 64", "n": "n.j = o.j + 1 AND n.i = o.i", "s": "n.j = o.j - 1 AND n.i = o.i"}
    joins = " ".join(f"LEFT JOIN o {d} ON {d}.t = o.t AND " + on.replace("n.j", f"{d}.j").replace("n.i", f"{d}.i") for d, on in near.items())
    last = f"r AS (SELECT o.t, o.j, o.i, (e.chi - w.chi) / dx AS u_irr, (n.chi - s.chi) / dy AS v_irr FROM o JOIN s1 ON s1.t = o.t AND s1.j = o.j AND s1.i = o.i {joins})"
    divergence = stages_sql([{"chi": "coalesce((u[e] - u[w]) / dx + (v[n] - v[s]) / dy, 0)"}]).replace("r AS (SELECT vec_id", "raw AS (SELECT vec_id", 1).replace("FROM r)", "FROM raw)")
    return divergence + ",\n" + ",\n".join([*_harmonics_parts("chi", inverse=True, source="s1"), last]) + "\n" + rounded_sql({"u_irr": 1, "v_irr": 1}, "r")


def _wind(s, d):
    return cube(s, d).select("t", "j", "i", "u", "v")


_add("sphere_trunc_triangular", lambda s, d: rounded(hm.spectral_truncation(GRID, _wind(s, d), "u", LATS, _DEGREE), {"u": 1}), _harmonics_sql("u", 1))
_add("sphere_sh_synthesis_ilaplace", lambda s, d: rounded(hm.spectral_truncation(GRID, _wind(s, d), "u", LATS, _DEGREE, True), {"u": 1e-12}), _harmonics_sql("u", 1e-12, inverse=True))
_add("sphere_regrid", lambda s, d: rounded(hm.spectral_regrid(GRID, _wind(s, d), "u", LATS, _DEGREE, _MAP_LATS, _MAP_NX), {"u": 1}), _harmonics_sql("u", 1, _MAP_NX, 200))
_add("sphere_helmholtz_wind", lambda s, d: rounded(hm.helmholtz_wind(GRID, _wind(s, d), "u", "v", LATS, _DEGREE), {"vor": 1e5, "div": 1e5, "psi": 1e-6, "chi": 1e-6, "u_rot": 1, "v_rot": 1, "u_irr": 1, "v_irr": 1}))
_add("sphere_irot_wind", lambda s, d: rounded(hm.irrotational_wind(GRID, GRID.slices(cube(s, d)), "u", "v", LATS, _DEGREE), {"u_irr": 1, "v_irr": 1}), _irrotational_sql())
_add("sphere_vector_laplacian", lambda s, d: rounded(hm.vector_laplacian(GRID, _wind(s, d), "u", "v", LATS, _DEGREE), {"u_lap": 1e10, "v_lap": 1e10}))
_add("sphere_theta_derivative", lambda s, d: rounded(hm.theta_derivative(GRID, _wind(s, d), "u", "v", LATS, _DEGREE), {"u_theta": 1, "v_theta": 1}))

_DERIVED = {"vor": 1e6, "def_total": 1e6, "rho": 1, "theta_grad": 1e6, "okuboweiss": 1e11}
_add(
    "plan_derived_variables",
    lambda s, d: rounded(default_derivations().derive(GRID, cube(s, d), *_DERIVED), _DERIVED),
    stages_sql([
        {"ux": "(u[e] - u[w]) / dx", "uy": "(u[n] - u[s]) / dy", "vx": "(v[e] - v[w]) / dx", "vy": "(v[n] - v[s]) / dy", "theta": "temp / ((p / 100000) ** (287.04::DOUBLE / 1004.0::DOUBLE))"},
        {"vor": "vx - uy", "def_total": "sqrt((uy + vx) ** 2 + (ux - vy) ** 2)", "rho": "p / (287.04::DOUBLE * temp)", "theta_grad": "sqrt(((theta[e] - theta[w]) / dx) ** 2 + ((theta[n] - theta[s]) / dy) ** 2)"},
        {"okuboweiss": "0.25::DOUBLE * (def_total * def_total - vor * vor)"},
    ]) + "\n" + rounded_sql(_DERIVED, "s3"),
)
