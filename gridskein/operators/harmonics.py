"""Spherical harmonics as joins: Fourier sums along rows, Legendre tables along columns.

Coefficients are rows (keys, m, n, <v>_re, <v>_im) of the waves m >= 0; those of m > 0
count twice.  Sums along a row are made by cells and waves with partial aggregates;
the tables (m, n, j) are made by tasks, one order m at a time, and meet the waves by
(m, j) and the coefficients by (m, n).  No task holds a slice, and tables grow
with the grid and the degree only.

Latitudes are those of the rows j = 0, 1, ... and may be any; coefficients are the
least squares over them, weighted by the cosine.  A slice with a NULL or without one of
its cells has NULL coefficients; winds count as zero where they are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..storage import materialise
from . import kernels
from .derivatives import ddx, ddy

RADIUS = 6.37e6


def legendre_table(spark: SparkSession, lats: Sequence[float], degree: int, fit: bool = False) -> DataFrame:
    """(m, n, j, p): normalised associated Legendre functions of the rows; with ``fit`` the factors that give coefficients by least squares."""
    sines, cosines = np.sin(np.radians(np.asarray(lats, float))), np.cos(np.radians(np.asarray(lats, float)))
    root = np.sqrt(np.maximum(cosines, 1e-6))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch["id"]:
                p = kernels.legendre_order(int(m), degree, sines)
                if fit:
                    p = np.linalg.pinv((p * root).T) * root
                n, j = np.indices(p.shape)
                yield pd.DataFrame({"m": np.full(p.size, m, "int32"), "n": (n.ravel() + m).astype("int32"), "j": j.ravel().astype("int32"), "p": p.ravel()})

    return spark.range(degree + 1).mapInPandas(rows, "m int, n int, j int, p double")


def _whole(c: str, value: Column, count: int | None = None) -> Column:
    """A sum's value where no term is missing."""
    return F.when(F.count(c) == (F.count(F.lit(1)) if count is None else F.lit(count)), value)


def analysis(g: Grid, cube: DataFrame, names: Sequence[str], lats: Sequence[float], degree: int, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, m, n, <v>_re, <v>_im): coefficients of the variables up to a degree."""
    waves = cube.select(*keys, "j", "i", *names).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(min(degree, g.nx // 2)))))
    angle = F.pmod(F.col("m") * F.col("i"), F.lit(g.nx)) * (2 * math.pi / g.nx)
    waves = waves.withColumns({"__c": F.cos(angle) / g.nx, "__s": -F.sin(angle) / g.nx})
    parts = [_whole(v, F.sum(F.col(v) * F.col(w)), g.nx).alias(f"{v}_{part}") for v in names for part, w in (("re", "__c"), ("im", "__s"))]
    rows = waves.groupBy(*keys, "j", "m").agg(*parts).join(legendre_table(cube.sparkSession, lats, degree, fit=True), ["m", "j"])
    columns = [f"{v}_{part}" for v in names for part in ("re", "im")]
    return rows.groupBy(*keys, "m", "n").agg(*[_whole(c, F.sum(F.col(c) * F.col("p")), len(lats)).alias(c) for c in columns])


def synthesis(coefficients: DataFrame, names: Sequence[str], lats: Sequence[float], nx: int, degree: int, keys: tuple[str, ...] = ("t",), shift: float = 0.0) -> DataFrame:
    """(keys, j, i, names): the fields of coefficients on rows of nx cells, which start ``shift`` cells east of the meridian."""
    columns = [f"{v}_{part}" for v in names for part in ("re", "im")]
    rows = coefficients.join(legendre_table(coefficients.sparkSession, lats, degree), ["m", "n"])
    waves = rows.groupBy(*keys, "j", "m").agg(*[_whole(c, F.sum(F.col(c) * F.col("p"))).alias(c) for c in columns])
    cells = waves.repartition(*keys, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))  # the sums over waves need no further shuffle
    angle = (F.pmod(F.col("m") * F.col("i"), F.lit(nx)) + F.col("m") * shift) * (2 * math.pi / nx)
    twice = F.when(F.col("m") > 0, 2.0).otherwise(1.0)
    cells = cells.withColumns({"__c": twice * F.cos(angle), "__s": -twice * F.sin(angle)})
    value = lambda v: _whole(f"{v}_re", F.sum(F.col(f"{v}_re") * F.col("__c") + F.col(f"{v}_im") * F.col("__s"))).alias(v)
    return cells.groupBy(*keys, "j", "i").agg(*[value(v) for v in names])


def _times(coefficients: DataFrame, names: Sequence[str], factor: Column) -> DataFrame:
    return coefficients.withColumns({f"{v}_{part}": F.col(f"{v}_{part}") * factor for v in names for part in ("re", "im")})


def laplacian(coefficients: DataFrame, names: Sequence[str], radius: float = RADIUS) -> DataFrame:
    """Coefficients of the fields' Laplacians."""
    return _times(coefficients, names, -F.col("n") * (F.col("n") + 1) / radius**2)


def inverse_laplacian(coefficients: DataFrame, names: Sequence[str], radius: float = RADIUS) -> DataFrame:
    """Coefficients of the fields, without mean, whose Laplacians are given."""
    return _times(coefficients, names, F.when(F.col("n") > 0, -(radius**2) / (F.col("n") * (F.col("n") + 1))).otherwise(0.0))


def _with_slopes(coefficients: DataFrame, names: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    """Adds coefficients, up to one degree more, of d/dlon (<v>_x) and of cos(lat) d/dlat (<v>_y)."""
    m, n = F.col("m"), F.col("n")
    e = lambda n: F.sqrt((n * n - m * m) / (4 * n * n - 1))
    part = lambda n, own, y: F.struct(n.alias("n"), F.lit(own).alias("own"), y.cast("double").alias("y"))
    parts = F.array(part(n, 1.0, F.lit(0.0)), part(n + 1, 0.0, -n * e(n + 1)), part(n - 1, 0.0, F.when(n > m, (n + 1) * e(n))))
    rows = coefficients.withColumn("__p", F.explode(parts)).filter("__p.n >= m").drop("n").withColumn("n", F.col("__p.n"))
    own, y = F.col("__p.own"), F.col("__p.y")
    sums = {}
    for v in names:
        re, im = F.col(f"{v}_re"), F.col(f"{v}_im")
        sums |= {f"{v}_re": own * re, f"{v}_im": own * im, f"{v}_x_re": -own * m * im, f"{v}_x_im": own * m * re, f"{v}_y_re": y * re, f"{v}_y_im": y * im}
    return rows.groupBy(*keys, "m", "n").agg(*[F.sum(x).alias(c) for c, x in sums.items()])


def _by_row(values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("j") + 1)


def _cosines(lats: Sequence[float]) -> list[float]:
    return [math.cos(math.radians(x)) for x in lats]


def _inverse_cosine(lats: Sequence[float]) -> Column:
    """1 / cos(lat), zero at the poles."""
    return _by_row([1 / c if abs(c) > 1e-9 else 0.0 for c in _cosines(lats)])


def with_gradients(coefficients: DataFrame, names: Sequence[str], lats: Sequence[float], nx: int, degree: int, keys: tuple[str, ...] = ("t",), radius: float = RADIUS) -> DataFrame:
    """(keys, j, i, and for each name v, v_x, v_y): fields and their gradients towards east and north, exact for each harmonic; zero at the poles."""
    every = [f"{v}{side}" for v in names for side in ("", "_x", "_y")]
    found = synthesis(_with_slopes(coefficients, names, keys), every, lats, nx, degree + 1, keys)
    return found.withColumns({f"{v}_{side}": F.col(f"{v}_{side}") * _inverse_cosine(lats) / radius for v in names for side in "xy"})


def _wind_gradients(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, j, i, and for U, V the components times cos(lat), and their gradients)."""
    scaled = cube.select(*keys, "j", "i", *[(F.coalesce(F.col(c), F.lit(0.0)) * _by_row(_cosines(lats))).alias(n) for c, n in ((u, "U"), (v, "V"))])
    return with_gradients(analysis(g, scaled, ["U", "V"], lats, degree + 1, keys), ["U", "V"], lats, g.nx, degree + 1, keys)


def vorticity_divergence(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, j, i, vor, div) of a wind whose components times cos(lat) have harmonics up to degree + 1."""
    inverse = _inverse_cosine(lats)
    found = _wind_gradients(g, cube, u, v, lats, degree, keys)
    return found.select(*keys, "j", "i", ((F.col("V_x") - F.col("U_y")) * inverse).alias("vor"), ((F.col("U_x") + F.col("V_y")) * inverse).alias("div"))


def wind_of(g: Grid, cube: DataFrame, psi: str, chi: str, lats: Sequence[float], degree: int, keys: tuple[str, ...] = ("t",), inverse: bool = False) -> DataFrame:
    """(keys, j, i, psi, chi, u_rot, v_rot, u_irr, v_irr): the winds of a stream function and of a velocity potential.

    With ``inverse`` the columns are vorticity and divergence, and psi and chi
    (without mean) are the fields whose Laplacians they are.
    """
    c = analysis(g, cube.select(*keys, "j", "i", F.col(psi).alias("psi"), F.col(chi).alias("chi")), ["psi", "chi"], lats, degree, keys)
    found = with_gradients(inverse_laplacian(c, ["psi", "chi"]) if inverse else c, ["psi", "chi"], lats, g.nx, degree, keys)
    parts = {"u_rot": -F.col("psi_y"), "v_rot": F.col("psi_x"), "u_irr": F.col("chi_x"), "v_irr": F.col("chi_y")}
    return found.select(*keys, "j", "i", "psi", "chi", *[x.alias(n) for n, x in parts.items()])


def helmholtz_wind(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int) -> DataFrame:
    """(t, j, i, vor, div, psi, chi, u_rot, v_rot, u_irr, v_irr): vorticity and divergence by harmonics up to a degree, stream function and velocity potential, and the two winds that they make."""
    fields = materialise(vorticity_divergence(g, cube, u, v, lats, degree), "vorticity")
    return fields.join(wind_of(g, fields, "vor", "div", lats, degree, inverse=True), ["t", "j", "i"])


def vector_laplacian(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int) -> DataFrame:
    """(t, j, i, u_lap, v_lap): the wind whose stream function is the wind's vorticity and whose potential its divergence."""
    made = wind_of(g, vorticity_divergence(g, cube, u, v, lats, degree), "vor", "div", lats, degree)
    return made.select("t", "j", "i", (F.col("u_rot") + F.col("u_irr")).alias("u_lap"), (F.col("v_rot") + F.col("v_irr")).alias("v_lap"))


def inverse_vector_laplacian(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int) -> DataFrame:
    """(t, j, i, u, v): the wind whose vector Laplacian is given."""
    c = analysis(g, vorticity_divergence(g, cube, u, v, lats, degree), ["vor", "div"], lats, degree)
    twice = inverse_laplacian(inverse_laplacian(c, ["vor", "div"]), ["vor", "div"])
    found = with_gradients(twice, ["vor", "div"], lats, g.nx, degree)
    return found.select("t", "j", "i", (F.col("div_x") - F.col("vor_y")).alias(u), (F.col("div_y") + F.col("vor_x")).alias(v))


def theta_derivative(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int) -> DataFrame:
    """(t, j, i, u_theta, v_theta): derivatives of a wind's components by colatitude (in radians); zero at the poles."""
    found = _wind_gradients(g, cube, u, v, lats, degree, ("t",))
    inverse, sine = _inverse_cosine(lats), _by_row([math.sin(math.radians(x)) for x in lats])
    by_theta = lambda n: -(RADIUS * F.col(f"{n}_y") + F.col(n) * inverse * sine) * inverse
    return found.select("t", "j", "i", by_theta("U").alias("u_theta"), by_theta("V").alias("v_theta"))


def inverse_gradient(g: Grid, cube: DataFrame, x: str, y: str, lats: Sequence[float], degree: int, out: str = "value") -> DataFrame:
    """(t, j, i, value): the field without mean whose gradient (the part of it without rotation) is given."""
    c = inverse_laplacian(analysis(g, vorticity_divergence(g, cube, x, y, lats, degree), ["div"], lats, degree), ["div"])
    return synthesis(c, ["div"], lats, g.nx, degree).withColumnRenamed("div", out)


def spectral_truncation(g: Grid, cube: DataFrame, v: str, lats: Sequence[float], degree: int, inverse_laplace: bool = False) -> DataFrame:
    """(t, j, i, v): the field's harmonics up to a degree, or the inverse Laplacian of that."""
    c = analysis(g, cube, [v], lats, degree)
    return synthesis(inverse_laplacian(c, [v]) if inverse_laplace else c, [v], lats, g.nx, degree)


def spectral_regrid(g: Grid, cube: DataFrame, v: str, lats: Sequence[float], degree: int, new_lats: Sequence[float], new_nx: int, shift: float = 0.0) -> DataFrame:
    """(t, j, i, v) on another grid around the globe, by harmonics up to a degree; ``shift`` moves its columns east, in its own cells (0.5: half-way between)."""
    return synthesis(analysis(g, cube, [v], lats, degree), [v], new_lats, new_nx, degree, shift=shift)


def irrotational_wind(g: Grid, cube: DataFrame, u: str, v: str, lats: Sequence[float], degree: int) -> DataFrame:
    """Adds u_irr, v_irr: the gradient of the inverse Laplacian of the divergence."""
    divergence = cube.withColumn("chi", F.coalesce(ddx(g, u) + ddy(g, v), F.lit(0.0)))
    chi = spectral_truncation(g, divergence.select("t", "j", "i", "chi"), "chi", lats, degree, True)
    joined = g.slices(cube.join(chi, ["t", "j", "i"]), cube)
    return joined.withColumns({"u_irr": ddx(g, "chi"), "v_irr": ddy(g, "chi")}).drop("chi")
