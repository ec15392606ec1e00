"""Grids, and neighbours of cells as Column expressions.

A field cube is a DataFrame with a row for each (t, [k,] j, i) and a column for
each variable; missing values are NULL.  ``dx`` and ``dy`` are the distances
between a cell's two neighbours (double the spacing).  Rows of a cube must be
dense: one for each index, so that the row before is the cell before.

Scale: ``Grid.slices`` partitions a cube by its horizontal slices once; windows
along x and along y, and all later ones on columns derived from them, then need
a sort but no further shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import METRES_PER_DEGREE


#: Rows of a partition of whole slices.
_ROWS = 1 << 16


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


@dataclass(frozen=True)
class Grid:
    """Numbers of cells, names of the index columns, and whether x is cyclic."""

    nx: int
    ny: int
    nz: int = 1
    cyclic: bool = True
    slice_cols: tuple[str, ...] = ("t",)

    def slices(self, cube: DataFrame, like: DataFrame | None = None) -> DataFrame:
        """The cube partitioned by horizontal slice.

        A stage of many windows sorts its partition many times, so partitions hold
        about ``_ROWS`` rows (a slice at least), however many there are: rows are
        counted first, which needs no column but those that rows depend on; a frame
        ``like`` it, with as many rows, is counted in its place where that is cheaper.
        """
        n = -(-(cube if like is None else like).count() // _ROWS)
        return cube.repartition(n, *self.slice_cols) if n > 1 else cube.repartition(*self.slice_cols)

    @property
    def along_x(self):
        return Window.partitionBy(*self.slice_cols, "j").orderBy("i")

    @property
    def along_y(self):
        return Window.partitionBy(*self.slice_cols, "i").orderBy("j")

    @property
    def along_z(self):
        return Window.partitionBy(*[c for c in self.slice_cols if c != "k"], "j", "i").orderBy("k")

    @property
    def along_t(self):
        return Window.partitionBy(*[c for c in self.slice_cols if c != "t"], "j", "i").orderBy("t")

    def _wrapped(self, value: Column, n: int) -> Column:
        """The value n cells further round a cyclic row: from its other end where the row ends."""
        w = self.along_x
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        plain = F.lead(value, n).over(w) if n > 0 else F.lag(value, -n).over(w)
        if not self.cyclic:
            return plain
        for step in range(abs(n)):
            place = step + 1 if n > 0 else self.nx - step
            edge = self.nx - n + step if n > 0 else -n - 1 - step
            plain = F.when(F.col("i") == edge, F.nth_value(value, place).over(whole)).otherwise(plain)
        return plain

    def x(self, name: str | Column, n: int) -> Column:
        """The value n cells to the east (negative: west)."""
        return self._wrapped(F.col(name) if isinstance(name, str) else name, n)

    def y(self, name: str | Column, n: int) -> Column:
        """The value n rows up in j; NULL beyond the edges."""
        value = F.col(name) if isinstance(name, str) else name
        return F.lead(value, n).over(self.along_y) if n > 0 else F.lag(value, -n).over(self.along_y)

    def z(self, name: str | Column, n: int) -> Column:
        """The value n levels up in k; NULL beyond the edges."""
        value = F.col(name) if isinstance(name, str) else name
        return F.lead(value, n).over(self.along_z) if n > 0 else F.lag(value, -n).over(self.along_z)

    def neighbours(self, cube: DataFrame, *names: str) -> DataFrame:
        """The cube with the eight neighbours of variables as columns <name>_e, _w, _n, _s, _ne, _nw, _se, _sw."""
        sides = {f"{v}_{d}": self.x(v, s) for v in names for d, s in (("e", 1), ("w", -1))}
        cube = cube.withColumns(sides)
        more = {}
        for v in names:
            for d, s in (("n", 1), ("s", -1)):
                more |= {f"{v}_{d}": self.y(v, s), f"{v}_{d}e": self.y(f"{v}_e", s), f"{v}_{d}w": self.y(f"{v}_w", s)}
        return cube.withColumns(more)

    def with_levels(self, nz: int) -> Grid:
        """The same grid for cubes with levels."""
        return replace(self, nz=nz, slice_cols=("t", "k"))


def latlon_cells(spark: SparkSession, lats: list[float], lons: list[float], cyclic: bool = True) -> DataFrame:
    """(j, i, lat, lon, dx, dy) of a regular grid: distances between the neighbours of each cell, one-sided ones doubled."""
    nx, ny = len(lons), len(lats)
    base = spark.range(nx * ny).select((F.col("id") / nx).cast("int").alias("j"), (F.col("id") % nx).cast("int").alias("i"))
    lat, lon = F.array(*map(F.lit, map(float, lats))), F.array(*map(F.lit, map(float, lons)))
    at = lambda a, n: F.element_at(a, n + 1)
    clip = lambda c, top: F.greatest(F.lit(0), F.least(c, F.lit(top)))
    j, i = F.col("j"), F.col("i")
    dlat = (at(lat, clip(j + 1, ny - 1)) - at(lat, clip(j - 1, ny - 1))) * F.when((j == 0) | (j == ny - 1), 2.0).otherwise(1.0)
    if cyclic:
        dlon = F.lit(720.0 / nx)
    else:
        dlon = (at(lon, clip(i + 1, nx - 1)) - at(lon, clip(i - 1, nx - 1))) * F.when((i == 0) | (i == nx - 1), 2.0).otherwise(1.0)
    cells = base.select("j", "i", at(lat, j).alias("lat"), at(lon, i).alias("lon"), dlon.alias("dlon"), dlat.alias("dlat"))
    return cells.select("j", "i", "lat", "lon", (METRES_PER_DEGREE * F.col("dlon") * F.cos(F.radians("lat"))).alias("dx"), (METRES_PER_DEGREE * F.col("dlat")).alias("dy"))


def cartesian_cells(spark: SparkSession, xs: list[float], ys: list[float]) -> DataFrame:
    """(j, i, x, y, dx, dy) of a Cartesian grid, distances as in ``latlon_cells``."""
    nx, ny = len(xs), len(ys)
    ends = lambda a, n: [2 * (a[1] - a[0]), *(a[m + 1] - a[m - 1] for m in range(1, n - 1)), 2 * (a[n - 1] - a[n - 2])]
    x = spark.createDataFrame(list(zip(range(nx), map(float, xs), map(float, ends(xs, nx)), strict=True)), "i int, x double, dx double")
    y = spark.createDataFrame(list(zip(range(ny), map(float, ys), map(float, ends(ys, ny)), strict=True)), "j int, y double, dy double")
    return y.crossJoin(x).select("j", "i", "x", "y", "dx", "dy")  # two axes: the grid itself


def local_north(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cells with (north_x, north_y): the normalised gradient of latitude in grid coordinates."""
    gx, gy = ratio(grid.x("lat", 1) - grid.x("lat", -1), F.col("dx")), ratio(grid.y("lat", 1) - grid.y("lat", -1), F.col("dy"))
    found = cells.withColumns({"north_x": gx, "north_y": gy}).withColumn("north_r", F.hypot("north_x", "north_y"))
    return found.withColumns({"north_x": ratio(F.col("north_x"), F.col("north_r")), "north_y": ratio(F.col("north_y"), F.col("north_r"))}).drop("north_r")


def unrotated(u: str, v: str) -> tuple[Column, Column]:
    """Wind components towards true east and north, from grid components and ``local_north``."""
    u, v, x, y = F.col(u), F.col(v), F.col("north_x"), F.col("north_y")
    return u * y - v * x, u * x + v * y
