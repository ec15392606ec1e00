"""Filters on cubes: smoothing, FIR filters, masks, packing, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid, ratio


def smooth_xy(g: Grid, cube: DataFrame, v: str, passes: int, coef: float = 1 / 6, out: str | None = None) -> DataFrame:
    """Diffusive smoothing: each pass adds coef times the second differences in x and y (none across edges that don't wrap)."""
    out = out or v
    cube = cube.withColumn(out, F.col(v))
    for _ in range(passes):
        x = g.x(out, 1) - 2 * F.col(out) + g.x(out, -1)
        y = g.y(out, 1) - 2 * F.col(out) + g.y(out, -1)
        inner_y = (F.col("j") > 0) & (F.col("j") < g.ny - 1)
        inner_x = F.lit(True) if g.cyclic else (F.col("i") > 0) & (F.col("i") < g.nx - 1)
        cube = cube.withColumn(out, F.col(out) + coef * (F.when(inner_y, y).otherwise(0.0) + F.when(inner_x, x).otherwise(0.0)))
    return cube


def _fir(value, shift, weights: list[float]) -> Column:
    n = len(weights) // 2
    terms = [w * (shift(k - n) if k != n else value) for k, w in enumerate(weights)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def filter_xy(g: Grid, cube: DataFrame, v: str, weights: list[float], out: str | None = None) -> DataFrame:
    """A symmetric filter of odd length along y, then x; NULL where it reaches beyond an edge."""
    cube = cube.withColumn("__f", _fir(F.col(v), lambda n: g.y(v, n), weights))
    return cube.withColumn(out or v, _fir(F.col("__f"), lambda n: g.x("__f", n), weights)).drop("__f")


def filter_t(g: Grid, cube: DataFrame, v: str, weights: list[float], out: str | None = None) -> DataFrame:
    """A filter of odd length along time; NULL at the ends."""
    shift = lambda n: F.lead(v, n).over(g.along_t) if n > 0 else F.lag(v, -n).over(g.along_t)
    return cube.withColumn(out or v, _fir(F.col(v), shift, weights))


def lanczos_weights(cutoff: float, window: int, size: int = 2) -> list[float]:
    """Low-pass weights for a cutoff in steps, 2 * size * window / 2 + 1 of them, that sum to one."""
    n = window * size // 2
    raw = []
    for k in range(-n, n + 1):
        sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
        raw.append(sinc(2 * k / cutoff) * sinc(k / (n + 1)))
    total = sum(raw)
    return [w / total for w in raw]


def gauss_weights(n: int, stddev: float) -> list[float]:
    """2 n + 1 values of a Gaussian that sum to one."""
    raw = [math.exp(-0.5 * (k / stddev) ** 2) for k in range(-n, n + 1)]
    return [w / sum(raw) for w in raw]


def kernel3(g: Grid, cube: DataFrame, v: str, passes: int, corner: float = 0.0, side: float = 1.0, centre: float = 2.0, out: str | None = None) -> DataFrame:
    """Passes of a 3 x 3 kernel, wrapped in x; in the end the two rows next to each pole are NULL."""
    out = out or v
    cube = cube.withColumn(out, F.col(v))
    total = centre + 4 * side + 4 * corner
    j = F.col("j")
    for _ in range(passes):
        cube = cube.withColumns({"__e": g.x(out, 1), "__w": g.x(out, -1)})
        ring = F.col(out) * centre + side * (F.col("__e") + F.col("__w") + g.y(out, 1) + g.y(out, -1))
        if corner:
            ring = ring + corner * (g.y("__e", 1) + g.y("__e", -1) + g.y("__w", 1) + g.y("__w", -1))
        cube = cube.withColumn(out, F.when((j > 0) & (j < g.ny - 1), ring / total).otherwise(F.col(out))).drop("__e", "__w")
    return cube.withColumn(out, F.when((j > 1) & (j < g.ny - 2), F.col(out)))


def momentum_flux(cube: DataFrame, u: str, v: str, out: str = "flux") -> DataFrame:
    """Adds the product of the deviations of two components from their zonal means."""
    row = Window.partitionBy("t", "j")
    return cube.withColumn(out, (F.col(u) - F.avg(u).over(row)) * (F.col(v) - F.avg(v).over(row)))


def mask_grow(g: Grid, cube: DataFrame, mask: str, n: int, out: str | None = None) -> DataFrame:
    """A boolean mask grown n times by its four neighbours."""
    out = out or mask
    cube = cube.withColumn(out, F.col(mask))
    no = F.lit(False)
    for _ in range(n):
        near = [F.coalesce(c, no) for c in (g.x(out, 1), g.x(out, -1), g.y(out, 1), g.y(out, -1))]
        cube = cube.withColumn(out, F.col(out) | near[0] | near[1] | near[2] | near[3])
    return cube


def mirror_y(g: Grid, cube: DataFrame) -> DataFrame:
    """The cube and its mirror image beyond the pole (rows ny to 2 ny - 3), shifted by half a circle."""
    inner = cube.filter((F.col("j") > 0) & (F.col("j") < g.ny - 1))
    image = inner.withColumns({"j": F.lit(2 * g.ny - 2) - F.col("j"), "i": F.pmod(F.col("i") + g.nx // 2, F.lit(g.nx))})
    return cube.unionByName(image)


def append_first_column(g: Grid, cube: DataFrame, lon: str | None = None) -> DataFrame:
    """The cube with its first column again at the end; its longitude is 360 degrees more."""
    first = cube.filter("i = 0").withColumn("i", F.lit(g.nx))
    return cube.unionByName(first.withColumn(lon, F.col(lon) + 360) if lon else first)


def unpack(value: Column, scale: float, offset: float, fill: int) -> Column:
    """Numbers from packed ones; the fill value is NULL."""
    return F.when(value != fill, value * scale + offset)


def pack(cube: DataFrame, v: str, fill: int = -32768, steps: int = 65534) -> DataFrame:
    """Adds packed (short), scale and offset that use the whole range of values."""
    limits = F.broadcast(cube.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi")))  # one row
    scale = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / steps).otherwise(1.0)
    cube = cube.crossJoin(limits).withColumns({"scale": scale, "offset": (F.col("__hi") + F.col("__lo")) / 2})
    number = F.greatest(F.lit(-32767), F.least(F.lit(32767), F.rint((F.col(v) - F.col("offset")) / F.col("scale"))))
    return cube.withColumn("packed", F.coalesce(number, F.lit(fill)).cast("short")).drop("__lo", "__hi")


def at_index(g: Grid, cube: DataFrame, v: str, places: DataFrame) -> DataFrame:
    """Values of rows at fractional places (t, j, x): linear between neighbours in i, NULL outside."""
    low = places.withColumns({"i": F.floor("x").cast("int"), "__f": F.col("x") - F.floor("x")})
    one = cube.select("t", "j", "i", F.col(v).alias("__a"))
    two = cube.select("t", "j", (F.col("i") - 1).alias("i"), F.col(v).alias("__b"))
    joined = low.join(one, ["t", "j", "i"], "left").join(two, ["t", "j", "i"], "left")
    value = F.when(F.col("__f") == 0, F.col("__a")).otherwise((1 - F.col("__f")) * F.col("__a") + F.col("__f") * F.col("__b"))
    return joined.select(*places.columns, value.alias(v))


def at_position(cube: DataFrame, v: str, places: DataFrame) -> DataFrame:
    """Bilinear values at places (t, y, x) in index coordinates; places outside the grid are NULL."""
    corners = places.withColumns({"__j": F.floor("y").cast("int"), "__i": F.floor("x").cast("int"), "__n": F.monotonically_increasing_id()})
    corners = corners.select("*", F.explode(F.expr("array(struct(0 AS dj, 0 AS di), struct(0 AS dj, 1 AS di), struct(1 AS dj, 0 AS di), struct(1 AS dj, 1 AS di))")).alias("c"))
    fy, fx = F.col("y") - F.col("__j"), F.col("x") - F.col("__i")
    weight = F.when(F.col("c.dj") == 1, fy).otherwise(1 - fy) * F.when(F.col("c.di") == 1, fx).otherwise(1 - fx)
    corners = corners.withColumns({"__w": weight, "j": F.col("__j") + F.col("c.dj"), "i": F.col("__i") + F.col("c.di")}).filter("__w > 0")
    joined = corners.join(cube.select("t", "j", "i", F.col(v).alias("__v")), ["t", "j", "i"], "left")
    whole = F.count("__v") == F.count(F.lit(1))
    return joined.groupBy("t", "y", "x").agg(F.when(whole, F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias(v))


def vert_by_coord(g: Grid, cube: DataFrame, v: str, coord: str, levels: list[float], out: str = "value") -> DataFrame:
    """(t, level, j, i, value): linear between the levels whose coordinate brackets it (either direction), NULL where none does."""
    steps = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    pairs = cube.withColumns({"__c": g.z(coord, 1), "__v": g.z(v, 1)})
    c0, c1, x = F.col(coord), F.col("__c"), F.col("level")
    inside = ((c0 <= x) & (x < c1)) | ((c0 >= x) & (x > c1))
    value = F.col(v) + ratio((x - c0) * (F.col("__v") - F.col(v)), c1 - c0)
    keys = [c for c in g.slice_cols if c != "k"]
    return pairs.select(*keys, "j", "i", coord, v, "__c", "__v", steps).groupBy(*keys, "level", "j", "i").agg(F.min(F.when(inside, value)).alias(out))


def section_points(vertices: list[tuple[float, float]], spacing: float) -> list[tuple[float, float, float]]:
    """(x, y, distance) along a polyline, at most ``spacing`` apart; vertices included."""
    out, done = [], 0.0
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:], strict=False):
        d = math.hypot(x1 - x0, y1 - y0)
        n = max(1, math.ceil(d / spacing))
        out += [(x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n, done + d * k / n) for k in range(n)]
        done += d
    return [*out, (*vertices[-1], done)]
