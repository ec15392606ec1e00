"""Rotated and curvilinear grids: their cells, the cells nearest to places, and values between cells.

Cells and quads of four cells meet places in cubes of space that hold their unit
vectors, so poles and the date line are places like any other.  A place is looked
up once, however many rows have it; its weights then meet the cube by cell.

Places with a NULL in lat or lon have no row; neither have those outside the grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sphere_geometry import geographic_position, north_of_rotated
from ..grid import Grid, latlon_cells

_AXES = ("x", "y", "z")
_CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def rotated_cells(spark: SparkSession, rlats: Sequence[float], rlons: Sequence[float], pole_lat: float, pole_lon: float, cyclic: bool = False) -> DataFrame:
    """(j, i, rlat, rlon, lat, lon, dx, dy, north_x, north_y) of a regular grid about a rotated pole.

    Distances are along the grid's own axes.  (north_x, north_y) is true north in
    grid coordinates, for ``unrotated``; NULL at the true poles.
    """
    own = latlon_cells(spark, list(rlats), list(rlons), cyclic).withColumnsRenamed({"lat": "rlat", "lon": "rlon"})
    lon, lat = geographic_position("rlon", "rlat", pole_lon, pole_lat)
    x, y = north_of_rotated("rlon", "rlat", pole_lat)
    return own.select("j", "i", "rlat", "rlon", lat.alias("lat"), lon.alias("lon"), "dx", "dy", x.alias("north_x"), y.alias("north_y"))


def _with_unit(df: DataFrame) -> DataFrame:
    """Adds the unit vector x, y, z of lat, lon."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return df.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _places(places: DataFrame) -> DataFrame:
    """The distinct places, with unit vectors."""
    return _with_unit(places.select("lat", "lon").dropna().distinct())


def _in_cubes(df: DataFrame, low: dict[str, Column], high: dict[str, Column], edge: float) -> DataFrame:
    """A row for each cube that the box from ``low`` to ``high`` touches."""
    for c in _AXES:
        df = df.withColumn(f"c{c}", F.explode(F.sequence(F.floor(low[c] / edge), F.floor(high[c] / edge))))
    return df


def nearest_cells(cells: DataFrame, places: DataFrame, reach: float, radius: float = 6.37e6) -> DataFrame:
    """(lat, lon, j, i, distance): the nearest cell within ``reach`` metres of each distinct place (lat, lon).

    Of cells equally far the least (j, i) is taken.  Any set of cells with j, i,
    lat, lon will do.  A place without a cell in reach has no row.
    """
    chord = 2 * math.sin(min(reach / radius, math.pi) / 2)
    edge = 2 * chord
    own = _with_unit(cells.select("j", "i", "lat", "lon").dropna()).drop("lat", "lon")
    own = own.select("j", "i", *[F.col(c).alias(f"p{c}") for c in _AXES], *[F.floor(F.col(c) / edge).alias(f"c{c}") for c in _AXES])
    margin = chord * (1 + 1e-9)
    asked = _in_cubes(_places(places), {c: F.col(c) - margin for c in _AXES}, {c: F.col(c) + margin for c in _AXES}, edge)
    square = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in _AXES)
    met = asked.join(own, [f"c{c}" for c in _AXES]).withColumn("d", square).filter(F.col("d") <= chord * chord * (1 + 1e-12))
    best = met.groupBy("lat", "lon").agg(F.min(F.struct("d", "j", "i")).alias("b"))
    return best.select("lat", "lon", "b.j", "b.i", (2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt("b.d") / 2))).alias("distance"))


def _quads(g: Grid, cells: DataFrame) -> DataFrame:
    """(j, i, p00, p01, p10, p11): unit vectors of the cells (j, i), (j, i + 1), (j + 1, i), (j + 1, i + 1); quads without one of them are left out."""
    roles = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _CORNERS])
    parts = _with_unit(cells.select("j", "i", "lat", "lon").dropna()).withColumn("role", F.explode(roles))
    west = F.col("i") - F.col("role.b")
    parts = parts.select((F.col("j") - F.col("role.a")).alias("j"), (F.pmod(west, F.lit(g.nx)) if g.cyclic else west).alias("i"), "role", F.struct(*_AXES).alias("p"))
    corner = lambda a, b: F.max(F.when((F.col("role.a") == a) & (F.col("role.b") == b), F.col("p")))
    return parts.groupBy("j", "i").agg(*[corner(a, b).alias(f"p{a}{b}") for a, b in _CORNERS]).dropna()


def bilinear_weights(g: Grid, cells: DataFrame, places: DataFrame, edge: float | None = None) -> DataFrame:
    """(lat, lon, j, i, weight): the up to four cells around each distinct place (lat, lon), and their weights.

    A quad's sides are great circles; a place's coordinates in it invert the
    bilinear map of the quad's corners on the plane that touches the sphere at
    the place.  Of several quads (places on a side) the least (j, i) is taken.
    Quads must be convex and smaller than a third of the sphere's radius or so;
    rows at a pole may meet in one point.  ``edge`` is that of the cubes, by
    default what nine in ten quads fit in; it changes no result.
    """
    quads = _quads(g, cells)
    names = [f"p{a}{b}" for a, b in _CORNERS]
    far = lambda p, q: sum((F.col(p)[c] - F.col(q)[c]) * (F.col(p)[c] - F.col(q)[c]) for c in _AXES)
    bulge = F.greatest(*[far(p, q) for n, p in enumerate(names) for q in names[n + 1 :]]) / 3 + 1e-12
    quads = quads.withColumn("bulge", bulge)
    low = {c: F.least(*[F.col(p)[c] for p in names]) - F.col("bulge") for c in _AXES}
    high = {c: F.greatest(*[F.col(p)[c] for p in names]) + F.col("bulge") for c in _AXES}
    if edge is None:
        size = F.greatest(*[high[c] - low[c] for c in _AXES])
        edge = max(quads.agg(F.percentile_approx(size, 0.9)).first()[0] or 1.0, 1e-6)  # one number
    spread = _in_cubes(quads, low, high, edge).drop("bulge")
    asked = _places(places)
    asked = asked.select("lat", "lon", *_AXES, *[F.floor(F.col(c) / edge).alias(f"c{c}") for c in _AXES])
    met = asked.join(spread, [f"c{c}" for c in _AXES])

    lat, lon = F.radians("lat"), F.radians("lon")
    east, north = (-F.sin(lon), F.cos(lon), F.lit(0.0)), (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))
    dot = lambda p, v: sum(F.col(p)[c] * w for c, w in zip(_AXES, v, strict=True))
    met = met.withColumns({f"r{p}": dot(p, [F.col(c) for c in _AXES]) for p in names}).filter(F.least(*[F.col(f"r{p}") for p in names]) > 0)
    met = met.select("lat", "lon", "j", "i", *[(dot(p, v) / F.col(f"r{p}")).alias(f"{d}{p}") for p in names for d, v in (("u", east), ("v", north))])
    side = {"e": ("p01", "p00"), "f": ("p10", "p00")}
    met = met.withColumns({f"{n}{d}": F.col(f"{d}{p}") - F.col(f"{d}{q}") for n, (p, q) in side.items() for d in "uv"})
    met = met.withColumns({**{f"g{d}": F.col(f"{d}p11") - F.col(f"{d}p10") - F.col(f"e{d}") for d in "uv"}, **{f"h{d}": -F.col(f"{d}p00") for d in "uv"}})
    cross = lambda a, b: F.col(f"{a}u") * F.col(f"{b}v") - F.col(f"{a}v") * F.col(f"{b}u")
    turn = (F.col("up11") - F.col("up00")) * (F.col("vp10") - F.col("vp01")) - (F.col("vp11") - F.col("vp00")) * (F.col("up10") - F.col("up01"))
    met = met.withColumns({"k0": cross("h", "e"), "k1": cross("h", "g") + cross("e", "f"), "k2": cross("g", "f"), "turn": F.signum(turn)})
    met = met.withColumn("root", F.col("turn") * F.sqrt(F.greatest(F.lit(0.0), F.col("k1") * F.col("k1") - 4 * F.col("k0") * F.col("k2"))))
    met = met.withColumn("b", F.when(F.col("k1") * F.col("turn") >= 0, -2 * F.col("k0") / F.nullif(F.col("k1") + F.col("root"), F.lit(0.0))).otherwise((F.col("root") - F.col("k1")) / F.nullif(2 * F.col("k2"), F.lit(0.0))))
    along = {d: F.col(f"e{d}") + F.col("b") * F.col(f"g{d}") for d in "uv"}
    length = along["u"] * along["u"] + along["v"] * along["v"]
    a = sum((F.col(f"h{d}") - F.col("b") * F.col(f"f{d}")) * along[d] for d in "uv") / F.nullif(length, F.lit(0.0))
    within = lambda c: F.col(c).between(-1e-9, 1 + 1e-9)
    met = met.withColumn("a", F.coalesce(a, F.lit(0.0)))

    # where a side is one point (a pole), a is free if that point is the place; the quad's continuation isn't in the quad
    rest = [F.col(f"h{d}") - F.col("b") * F.col(f"f{d}") - F.col("a") * along[d] for d in "uv"]
    size = sum(F.col(f"{n}{d}") * F.col(f"{n}{d}") for n in "ef" for d in "uv")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    inside = F.when(within("a") & within("b") & (sum(r * r for r in rest) <= 1e-12 * size), F.struct("j", "i", clip("a").alias("a"), clip("b").alias("b")))  # a filter would be pushed down and repeat all terms above
    found = met.groupBy("lat", "lon").agg(F.min(inside).alias("q")).filter("q IS NOT NULL")
    column = lambda di: F.pmod(F.col("q.i") + di, F.lit(g.nx)) if g.cyclic else F.col("q.i") + di
    share = lambda c, d: F.col(c) if d else 1 - F.col(c)
    corners = F.array(*[F.struct((F.col("q.j") + dj).alias("j"), column(di).alias("i"), (share("q.b", dj) * share("q.a", di)).alias("weight")) for dj, di in _CORNERS])
    return found.select("lat", "lon", F.explode(corners).alias("c")).select("lat", "lon", "c.j", "c.i", "c.weight").filter("weight > 0")


def at_places(cube: DataFrame, weights: DataFrame, *names: str, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, lat, lon, names): weighted sums of the cells of ``weights`` for each key of the cube; NULL where one of the cells is missing or NULL."""
    joined = cube.select(*keys, "j", "i", *names).join(weights, ["j", "i"])
    share = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))
    value = lambda v: F.when(share(v) > 1 - 1e-12, F.sum(F.col(v) * F.col("weight")))
    return joined.groupBy(*keys, "lat", "lon").agg(*[value(v).alias(v) for v in names])
