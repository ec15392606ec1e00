"""Objects and lines in cubes: labels, floods, lines, contours, lows and rain objects.

Each horizontal slice is one group that a numpy kernel handles; slices have a
fixed size, whatever the length of the series, so groups are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..constants import G
from ..grid import Grid, ratio
from ..storage import materialise
from . import kernels
from .derivatives import ddx, ddx2, ddxy, ddy, ddy2, ddz
from .filters import filter_xy, gauss_weights, smooth_xy


def per_slice(g: Grid, cube: DataFrame, kernel: Callable[[dict[str, np.ndarray]], pd.DataFrame], schema: str, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Applies a kernel to the arrays (ny, nx), or with levels (nz, ny, nx), of each slice; the result gets the key columns."""
    sizes = {"k": g.nz, "j": g.ny, "i": g.nx}
    axes = [a for a in ("k", "j", "i") if a in cube.columns and a not in by]
    names = [c for c in cube.columns if c not in (*axes, *by)]

    def apply(key, rows):
        shape = tuple(sizes[a] for a in axes)
        place = tuple(rows[a].to_numpy() for a in axes)
        arrays = {}
        for c in names:
            arrays[c] = np.full(shape, np.nan)
            arrays[c][place] = rows[c].to_numpy(float, na_value=np.nan)
        out = kernel(arrays)
        for n, (c, v) in enumerate(zip(by, key, strict=True)):
            out.insert(n, c, v)
        return out

    kinds = ", ".join(f"{c} {cube.schema[c].dataType.simpleString()}" for c in by)
    return cube.groupBy(*by).applyInPandas(apply, f"{kinds}, {schema}")


def _cells(label: np.ndarray, **more: np.ndarray) -> pd.DataFrame:
    place = np.nonzero(label)
    names = ("k", "j", "i")[-label.ndim :]
    return pd.DataFrame({**{n: p.astype("int32") for n, p in zip(names, place, strict=True)}, "label": label[place].astype("int32"), **{c: v[place] for c, v in more.items()}})


def label_connected_2d(g: Grid, cube: DataFrame, mask: str) -> DataFrame:
    """(t, j, i, label) of a boolean mask's four-connected components, cells outside left out."""
    def kernel(a):
        return _cells(kernels.label(a["m"] > 0, g.cyclic))

    return per_slice(g, cube.select("t", "j", "i", F.col(mask).cast("double").alias("m")), kernel, "j int, i int, label int")


def label_connected_3d(g: Grid, cube: DataFrame, mask: str) -> DataFrame:
    """(t, k, j, i, label) of components that touch in any direction."""
    def kernel(a):
        return _cells(kernels.label(a["m"] > 0, g.cyclic, True))

    return per_slice(g, cube.select("t", "k", "j", "i", F.col(mask).cast("double").alias("m")), kernel, "k int, j int, i int, label int")


def label_extents(labels: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Size and extent of each label: number of cells, or area where ``cells`` (j, i, area) is given."""
    axes = [a for a in ("k", "j", "i") if a in labels.columns]
    size = F.count(F.lit(1)).cast("double")
    if cells is not None:
        labels, size = labels.join(cells, ["j", "i"]), F.sum("area")
    return labels.groupBy("t", "label").agg(size.alias("size"), *[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def mask_minimum_connect(g: Grid, cube: DataFrame, v: str, seeds: DataFrame, threshold: float) -> DataFrame:
    """Cells (t, j, i) at or above a threshold that are connected with seeds (t, j, i)."""
    labels = label_connected_2d(g, cube.withColumn("__m", F.col(v) >= threshold), "__m")
    wanted = labels.join(seeds.select("t", "j", "i").distinct(), ["t", "j", "i"]).select("t", "label").distinct()
    return labels.join(wanted, ["t", "label"], "left_semi").select("t", "j", "i")


def connect_in_time(labels: DataFrame) -> DataFrame:
    """(kind, t, label, next): objects that overlap in the next step (life), that have no forerunner (birth), or no follower (death)."""
    axes = [a for a in ("k", "j", "i") if a in labels.columns]
    later = labels.select((F.col("t") - 1).alias("t"), *axes, F.col("label").alias("next"))
    life = labels.join(later, ["t", *axes]).select("t", "label", "next").distinct()
    every = labels.select("t", "label").distinct()
    limits = labels.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    born = every.join(life.select((F.col("t") + 1).alias("t"), F.col("next").alias("label")), ["t", "label"], "left_anti")
    died = every.join(life, ["t", "label"], "left_anti")
    limits = F.broadcast(limits)  # one row
    born = born.crossJoin(limits).filter("t > lo").select(F.lit("birth").alias("kind"), "t", "label", F.lit(None).cast("int").alias("next"))
    died = died.crossJoin(limits).filter("t < hi").select(F.lit("death").alias("kind"), "t", "label", F.lit(None).cast("int").alias("next"))
    return life.select(F.lit("life").alias("kind"), "t", "label", "next").unionByName(born).unionByName(died)


def fill_nan(g: Grid, cube: DataFrame, v: str) -> DataFrame:
    """(t, j, i, v) with missing cells filled smoothly from around."""
    def kernel(a):
        out = kernels.fill_missing(a[v], g.cyclic)
        j, i = np.indices(out.shape)
        return pd.DataFrame({"j": j.ravel().astype("int32"), "i": i.ravel().astype("int32"), v: out.ravel()})

    return per_slice(g, cube.select("t", "j", "i", v), kernel, f"j int, i int, {v} double")


def smooth_xy_missing(g: Grid, cube: DataFrame, v: str, passes: int, out: str | None = None) -> DataFrame:
    """Smoothing of a field with missing cells: they are filled from around, as deviations from the mean of their row and all times, and are missing again in the end."""
    rows = cube.groupBy("t", "j").agg(F.avg(v).alias("m")).groupBy("j").agg(F.avg("m").alias("__mean"))
    rows = F.broadcast(rows)  # the grid's rows
    filled = fill_nan(g, cube.join(rows, "j").withColumn("__d", F.col(v) - F.col("__mean")), "__d")
    whole = g.slices(cube.join(filled, ["t", "j", "i"]).join(rows, "j").withColumn("__d", F.col("__d") + F.col("__mean")), cube)
    smooth = smooth_xy(g, whole, "__d", passes)
    return smooth.withColumn(out or v, F.when(F.col(v).isNotNull() & ~F.isnan(v), F.col("__d"))).drop("__d", "__mean")


# Lines.


def _zero_step(v: str, near: Column) -> Column:
    """How far towards its neighbour a field is zero; NULL: it isn't."""
    return F.when(F.col(v) == 0, F.when(near == 0, 0.5).otherwise(0.0)).when(F.col(v) * near < 0, ratio(F.col(v), F.col(v) - near))


def find_zeroloc(g: Grid, cube: DataFrame, v: str) -> DataFrame:
    """(t, x, y): places where a field is zero or changes sign between neighbours along x and along y, linear between them."""
    def scan(near, x: float, y: float):
        step = _zero_step(v, near)
        return cube.select("t", (F.col("i") + step * x).alias("x"), (F.col("j") + step * y).alias("y")).filter("x IS NOT NULL")

    return scan(g.x(v, 1), 1.0, 0.0).unionByName(scan(g.y(v, 1), 0.0, 1.0)).distinct()


def find_maxloc(g: Grid, cube: DataFrame, v: str, threshold: float, radius: float = DEFAULTS.searchrad) -> DataFrame:
    """(t, x, y): points of ridge lines: where the slope along the sharpest curvature vanishes within ``radius`` cells."""
    cube = g.neighbours(cube, v)
    cube = cube.withColumns({"__x": ddx(g, v), "__y": ddy(g, v), "__xx": 4 * ddx2(g, v), "__yy": 4 * ddy2(g, v), "__xy": ddxy(g, v)})
    xx, yy, xy = F.col("__xx"), F.col("__yy"), F.col("__xy")
    half = (xx + yy) / 2
    low = half - F.sqrt(F.greatest(F.lit(0.0), half * half - (xx * yy - xy * xy)))
    ex, ey = low - yy, xy
    flat = (F.abs(ex) + F.abs(ey)) == 0
    ex, ey = F.when(flat, F.when(xx <= yy, 1.0).otherwise(0.0)).otherwise(ex), F.when(flat, F.when(xx <= yy, 0.0).otherwise(1.0)).otherwise(ey)
    size = F.hypot(ex, ey)
    ex, ey = ratio(ex, size), ratio(ey, size)
    ds = ratio(-(F.col("__x") * ex + F.col("__y") * ey), low)
    di, dj = 2 * ds * ex / F.col("dx"), 2 * ds * ey / F.col("dy")
    found = cube.filter(F.col(v) >= threshold).select("t", (F.col("i") + di).alias("x"), (F.col("j") + dj).alias("y"), F.hypot(di, dj).alias("r"), low.alias("low"))
    return found.filter((F.col("r") <= radius) & (F.col("low") < 0)).select("t", "x", "y")


def join_lines(g: Grid, points: DataFrame, cells: DataFrame, config: Config = DEFAULTS, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """(keys, line_id, pt, x, y): lines through points, see ``kernels.join_line``; ``cells`` has j, i, dx, dy of the fixed grid."""
    spacing = cells.select("j", "i", "dx", "dy").toPandas()  # one row per cell of the grid
    dx, dy = np.ones((g.ny, g.nx)), np.ones((g.ny, g.nx))
    dx[spacing["j"], spacing["i"]], dy[spacing["j"], spacing["i"]] = spacing["dx"], spacing["dy"]

    def apply(key, rows):
        rows = rows.sort_values(["x", "y"])
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        lines = kernels.join_line(x, y, dx, dy, g.nx, g.cyclic, config.searchrad, config.minlen)
        out = pd.DataFrame([(n, m, x[k], y[k]) for n, line in enumerate(lines) for m, k in enumerate(line)], columns=["line_id", "pt", "x", "y"])
        for n, (c, v) in enumerate(zip(by, key, strict=True)):
            out.insert(n, c, v)
        return out

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)
    return points.groupBy(*by).applyInPandas(apply, f"{kinds}, line_id int, pt int, x double, y double")


def with_payload(g: Grid, lines: DataFrame, cube: DataFrame, v: str) -> DataFrame:
    """Adds to line points the field's value at their cell."""
    places = lines.withColumns({"i": F.pmod(F.floor("x"), F.lit(g.nx)).cast("int"), "j": F.floor("y").cast("int")})
    return places.join(cube.select("t", "j", "i", F.col(v).alias("payload")).hint("merge"), ["t", "j", "i"], "left").drop("i", "j")


def zero_lines(g: Grid, cube: DataFrame, v: str, where, cells: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Lines where a field is zero, among cells that fulfil a condition."""
    masked = cube.withColumn("__l", F.when(where, F.col(v)))
    return join_lines(g, find_zeroloc(g, masked, "__l"), cells, config)


def zero_lines_of_kinds(g: Grid, cube: DataFrame, v: str, kinds: dict[str, Column], cells: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """``zero_lines`` for several conditions, whose names are in the column type, in one pass over the cube."""
    names = {kind: f"__l{n}" for n, kind in enumerate(kinds)}
    cube = cube.withColumns({names[kind]: F.when(where, F.col(v)) for kind, where in kinds.items()})
    point = lambda kind, near, x, y: F.struct(F.lit(kind).alias("type"), (F.col("i") + _zero_step(names[kind], near) * x).alias("x"), (F.col("j") + _zero_step(names[kind], near) * y).alias("y"))
    scans = [point(kind, near, x, y) for kind, n in names.items() for near, x, y in ((g.x(n, 1), 1.0, 0.0), (g.y(n, 1), 0.0, 1.0))]
    points = cube.select("t", F.array(*scans).alias("p")).select("t", F.explode("p").alias("p")).select("t", "p.*").filter("x IS NOT NULL").distinct()
    return join_lines(g, points, cells, config, ("t", "type"))


def ridge_lines(g: Grid, cube: DataFrame, v: str, threshold: float, cells: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Lines along which a field is greatest across, where it reaches a threshold."""
    return with_payload(g, join_lines(g, find_maxloc(g, cube, v, threshold, config.searchrad), cells, config), cube, v)


def mask_lines(g: Grid, lines: DataFrame) -> DataFrame:
    """(t, j, i) of the cells nearest to line points."""
    return lines.select("t", F.round("y").cast("int").alias("j"), F.pmod(F.round("x").cast("int"), F.lit(g.nx)).alias("i")).distinct()


def normalize_lines(g: Grid, lines: DataFrame, cells: DataFrame) -> DataFrame:
    """(t, j, i, density): length of lines in a cell over its area; each segment counts half at either end."""
    w = Window.partitionBy("t", "line_id").orderBy("pt")
    ends = lines.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).filter("x0 IS NOT NULL")
    step = F.abs(F.col("x") - F.col("x0"))
    ends = ends.withColumns({"di": F.least(step, g.nx - step) if g.cyclic else step, "dj": F.abs(F.col("y") - F.col("y0"))})
    cell = lambda x, y: F.struct(F.round(y).cast("int").alias("j"), F.pmod(F.round(x).cast("int"), F.lit(g.nx)).alias("i"))
    halves = ends.select("t", "di", "dj", F.explode(F.array(cell(F.col("x"), F.col("y")), cell(F.col("x0"), F.col("y0")))).alias("c")).select("t", "di", "dj", "c.*")
    halves = halves.join(cells.select("j", "i", "dx", "dy"), ["j", "i"])
    length = F.hypot(F.col("dx") * F.col("di") / 2, F.col("dy") * F.col("dj") / 2) / 2
    return halves.groupBy("t", "j", "i").agg(F.sum(length / (F.col("dx") * F.abs("dy") / 4)).alias("density"))


def mask_lines_with_data(g: Grid, lines: DataFrame, cube: DataFrame | None = None, v: str = "payload") -> DataFrame:
    """(t, j, i, value) of the cells nearest to line points: a field's value there or, without ``cube``, what the last of the points carries."""
    cell = [F.round("y").cast("int").alias("j"), F.pmod(F.round("x").cast("int"), F.lit(g.nx)).alias("i")]
    if cube is not None:
        return mask_lines(g, lines).join(cube.select("t", "j", "i", F.col(v).alias("value")), ["t", "j", "i"])
    return lines.select("t", *cell, F.struct("line_id", "pt").alias("o"), v).groupBy("t", "j", "i").agg(F.max_by(v, "o").alias("value"))


def smear_lines(g: Grid, lines: DataFrame, cells: DataFrame, reach: int = 5, stddev: float = 1.0) -> DataFrame:
    """(t, j, i, density): length of lines over area in all cells, smoothed by a Gaussian along y and x; NULL where that reaches beyond an edge."""
    every = lines.select("t").distinct().crossJoin(F.broadcast(cells.select("j", "i")))  # the grid at each time
    dense = every.join(normalize_lines(g, lines, cells), ["t", "j", "i"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    return filter_xy(g, g.slices(dense, every), "density", gauss_weights(reach, stddev))


def long_lines(lines: DataFrame, least: int) -> DataFrame:
    """Lines of at least so many points."""
    return lines.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("t", "line_id"))).filter(F.col("__n") >= least).drop("__n")


def lines_to_coordinates(g: Grid, lines: DataFrame, cells: DataFrame, x: str = "lon", y: str = "lat", turn: float = 360.0) -> DataFrame:
    """Lines with the coordinates of their points in place of grid indices, linear between cells; ``turn`` is what x gains in a round of a cyclic grid."""
    near = g.neighbours(cells.withColumn("t", F.lit(0)).select("t", "j", "i", x, y), x, y)
    ahead = F.when(F.col("i") == g.nx - 1, turn).otherwise(0.0) if g.cyclic else F.lit(0.0)
    near = near.select("j", "i", *[F.col(f"{c}{d}").alias(f"__{n}{d}") for n, c in (("x", x), ("y", y)) for d in ("", "_n")], *[(F.col(f"{c}{d}") + (ahead if n == "x" else 0.0)).alias(f"__{n}{d}") for n, c in (("x", x), ("y", y)) for d in ("_e", "_ne")])
    places = lines.withColumns({"i": F.pmod(F.floor("x"), F.lit(g.nx)).cast("int") if g.cyclic else F.floor("x").cast("int"), "j": F.floor("y").cast("int"), "__fx": F.col("x") - F.floor("x"), "__fy": F.col("y") - F.floor("y")})
    fx, fy = F.col("__fx"), F.col("__fy")
    between = lambda a, b, f: F.when(f == 0, a).otherwise(a + f * (b - a))
    at = lambda n: between(between(F.col(f"__{n}"), F.col(f"__{n}_e"), fx), between(F.col(f"__{n}_n"), F.col(f"__{n}_ne"), fx), fy)
    rounds = F.floor(F.col("x") / g.nx) * turn if g.cyclic else F.lit(0.0)
    joined = places.join(F.broadcast(near), ["j", "i"], "left")  # the grid's cells
    return joined.select(*[c for c in lines.columns if c not in ("x", "y")], (at("x") + rounds).alias("x"), at("y").alias("y"))


# Contours.


def calculate_contours(g: Grid, cube: DataFrame, v: str, levels: list[float], dlon: float, periodic_add: float = 120.0) -> DataFrame:
    """(t, level, contour_id, closed, exp_lon, mean_lat, geometry): contours in cell indices, over a slice with its first columns again at the end.

    Points are rounded to cells, repeated ones dropped; of contours that hold no
    points but another's (modulo the circle) only the other stays.
    """
    extra = int(periodic_add / dlon)

    def kernel(a):
        field = np.concatenate([a["v"], a["v"][:, :extra]], axis=1)
        rows = []
        for level in levels:
            found = []
            for line in kernels.contour_lines(field, level):
                cells = list(dict.fromkeys(map(tuple, np.rint(line[:, ::-1]).astype(int).tolist())))
                if len(cells) >= 4:
                    found.append((bool((line[0] == line[-1]).all()), cells, {(x % g.nx, y) for x, y in cells}))
            keep = [not any(s <= o[2] and (len(s) < len(o[2]) or n > m) for m, o in enumerate(found) if m != n) for n, (_, _, s) in enumerate(found)]
            for n, (closed, cells, _) in enumerate(f for f, k in zip(found, keep, strict=True) if k):
                xs, ys = zip(*cells, strict=True)
                rows.append((float(level), n, closed, len(set(xs)) * dlon, round(float(np.mean(ys)), 2), [{"x": float(x), "y": float(y)} for x, y in cells]))
        return pd.DataFrame(rows, columns=["level", "contour_id", "closed", "exp_lon", "mean_lat", "geometry"])

    schema = "level double, contour_id int, closed boolean, exp_lon double, mean_lat double, geometry array<struct<x:double,y:double>>"
    return per_slice(g, cube.select("t", "j", "i", F.col(v).alias("v")), kernel, schema)


def polygons_to_coordinates(g: Grid, polygons: DataFrame, lats: list[float], lons: list[float]) -> DataFrame:
    """Polygons (geometry in cell indices) in degrees; one that passes the last meridian becomes two parts, without the strip between the last column and the first.

    Adds ``part``, from 0.  A part of less than three points has no row.
    """
    lat, lon = np.asarray(lats, float), np.asarray(lons, float)

    def apply(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                points = np.array([[p["x"], p["y"]] for p in r["geometry"]], float).reshape(-1, 2)
                whole = (points[:, 0] < g.nx).all()
                parts = [points] if whole else [kernels.clipped(points, g.nx - 1, False), kernels.clipped(points, g.nx, True)]
                for n, part in enumerate(p for p in parts if len(p) >= 3):
                    x, y = part[:, 0].astype(int) % g.nx, np.clip(part[:, 1].astype(int), 0, g.ny - 1)
                    rows.append({**r, "part": n, "geometry": [{"x": float(a), "y": float(c)} for a, c in zip(lon[x], lat[y], strict=True)]})
            yield pd.DataFrame(rows, columns=[*b.columns, "part"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in polygons.schema)
    return polygons.mapInPandas(apply, f"{kinds}, part int")


def calculate_cutoffs(contours: DataFrame, min_exp: float = 5.0) -> DataFrame:
    """Closed contours of at least ``min_exp`` degrees that don't span as much as the widest."""
    widest = F.broadcast(contours.agg(F.max("exp_lon").alias("widest")))  # one row
    return contours.crossJoin(widest).filter((F.col("closed")) & (F.col("exp_lon") >= min_exp) & (F.col("exp_lon") < F.col("widest"))).drop("widest")


def _widest(contours: DataFrame) -> DataFrame:
    return contours.crossJoin(F.broadcast(contours.agg(F.max("exp_lon").alias("widest")))).filter("exp_lon = widest").drop("widest")  # one row


def calculate_overturnings(g: Grid, contours: DataFrame, dlon: float, range_group: float = 5.0, min_exp: float = 5.0) -> DataFrame:
    """(t, level, contour_id, x_min, x_max, y_min, y_max, orientation): where the widest contours pass a longitude three times or more."""
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            x, y = np.array([p["x"] for p in r.geometry]), np.array([p["y"] for p in r.geometry])
            often = [v for v, n in zip(*np.unique(x, return_counts=True), strict=True) if n >= 3]
            groups = np.split(often, np.flatnonzero(np.diff(often) > range_group / dlon) + 1) if often else []
            spans = [(float(s[0]), float(s[-1])) for s in groups if len(s)]
            seen: list[set] = []
            for lo, hi in spans:
                cells = {int(c) % g.nx for c in range(int(lo), int(hi) + 1)}
                if hi - lo < min_exp / dlon or any(cells <= s for s in seen):
                    continue
                seen.append(cells)
                part = (x >= lo) & (x <= hi)
                first, last = y[np.flatnonzero(x == lo)[0]], y[np.flatnonzero(x == hi)[-1]]
                middle = (g.ny - 1) / 2
                kind = "cyclonic" if abs(first - middle) <= abs(last - middle) else "anticyclonic"
                out.append((r.t, r.level, r.contour_id, lo, hi, float(y[part].min()), float(y[part].max()), kind))
        return pd.DataFrame(out, columns=["t", "level", "contour_id", "x_min", "x_max", "y_min", "y_max", "orientation"])

    kind = contours.schema["t"].dataType.simpleString()
    schema = f"t {kind}, level double, contour_id int, x_min double, x_max double, y_min double, y_max double, orientation string"
    return _widest(contours).mapInPandas(lambda batches: map(kernel, batches), schema)


def calculate_streamers(g: Grid, contours: DataFrame, lats: list[float], dlon: float, geo_dis: float = 800.0, cont_dis: float = 1500.0, max_width: float = 120.0) -> DataFrame:
    """(t, level, contour_id, first, last, geometry): parts of the widest contours whose ends are near each other but far along the contour.

    Of parts that lie inside another's range the outer stays; of parts whose base
    lines cross, that with the longest way along the contour.
    """
    lat = np.asarray(lats, float)

    def crosses(a, b) -> bool:
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return side(*a, b[0]) * side(*a, b[1]) < 0 and side(*b, a[0]) * side(*b, a[1]) < 0

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            x, y = np.array([p["x"] for p in r.geometry]), np.array([p["y"] for p in r.geometry])
            la, lo = lat[np.clip(y.astype(int), 0, len(lat) - 1)], x * dlon
            way = np.r_[0, np.cumsum(kernels.distance_km(la[:-1], lo[:-1], la[1:], lo[1:], 6371.0))]
            near = kernels.distance_km(la[:, None], lo[:, None], la[None], lo[None], 6371.0) < geo_dis
            good = np.triu(near & (way[None] - way[:, None] > cont_dis) & (np.abs(x[:, None] - x[None]) <= max_width), 1)
            pairs = sorted(zip(*map(list, np.nonzero(good)), strict=True), key=lambda p: (way[p[0]] - way[p[1]], p))
            kept: list[tuple[int, int]] = []
            for a, b in pairs:
                base = ((x[a], y[a]), (x[b], y[b]))
                if any(a >= c and b <= d for c, d in kept) or any(crosses(base, ((x[c], y[c]), (x[d], y[d]))) for c, d in kept):
                    continue
                if not any(crosses(base, ((x[k], y[k]), (x[k + 1], y[k + 1]))) for k in range(len(x) - 1)):
                    kept.append((a, b))
            for a, b in kept:
                out.append((r.t, r.level, r.contour_id, int(a), int(b), [{"x": float(p), "y": float(q)} for p, q in zip(x[a : b + 1], y[a : b + 1], strict=True)]))
        return pd.DataFrame(out, columns=["t", "level", "contour_id", "first", "last", "geometry"])

    kind = contours.schema["t"].dataType.simpleString()
    schema = f"t {kind}, level double, contour_id int, first int, last int, geometry array<struct<x:double,y:double>>"
    return _widest(contours).mapInPandas(lambda batches: map(kernel, batches), schema)


def _between(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to ``high``, one row each; none if there are none."""
    first, last = F.ceil(low).cast("int"), F.floor(high).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))


def polygon_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, y1, x2, y2): the edges of polygons (geometry: array of x, y), the one that closes it included; null and empty ones have none."""
    n = F.size("geometry")
    before = F.concat(F.slice("geometry", n, F.lit(1)), F.slice("geometry", F.lit(1), n - 1))
    edge = F.explode(F.arrays_zip(before.alias("p"), F.col("geometry").alias("q"))).alias("e")
    return polygons.filter(n > 0).select(*keys, edge).select(*keys, F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def rasterize(g: Grid, events: DataFrame, radius: float = 0.5) -> DataFrame:
    """(t, event, j, i): cells in the polygons of events (t, event, geometry in cell indices), or nearer than ``radius`` to an edge.

    Each edge meets the rows of cells that it passes; its crossings with them,
    sorted along a row, bound what lies inside.  Cells near an edge are looked for
    where the edge passes a row, so both grow with the edges' lengths and the
    cells found.  Columns past the last meridian go round; rows outside the grid
    have none.  Parts of one event may overlap; each cell comes once.
    """
    edges = materialise(polygon_edges(events, ["t", "event"]), "edges")
    clipped = lambda low, high: _between(F.greatest(low, F.lit(0.0)), F.least(high, F.lit(g.ny - 1.0)))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.filter("y1 <> y2").select("*", clipped(low, F.ceil(high) - 1.0).alias("j"))
    crossings = rows.select("t", "event", "j", ((F.col("x1") - F.col("x2")) * (F.col("j") - F.col("y2")) / (F.col("y1") - F.col("y2")) + F.col("x2")).alias("x"))
    along = Window.partitionBy("t", "event", "j").orderBy("x")
    spans = crossings.select("*", F.row_number().over(along).alias("n"), F.lead("x").over(along).alias("to")).filter("n % 2 = 1")
    inside = spans.select("t", "event", "j", _between(F.col("x"), F.ceil("to") - 1.0).alias("i"))
    # The part of an edge within the radius of a row, and the cells as near to that.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rows = edges.select("*", clipped(low - radius, high + radius).alias("j"))
    at = lambda d: F.col("x1") + F.when(dy == 0, F.lit(0.0 if d < 0 else 1.0)).otherwise(share((F.col("j") + d - F.col("y1")) / F.nullif(dy, F.lit(0.0)))) * dx
    near = rows.select("*", _between(F.least(at(-radius), at(radius)) - radius, F.greatest(at(-radius), at(radius)) + radius).alias("i"))
    f = share(((F.col("i") - F.col("x1")) * dx + (F.col("j") - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12)))
    off = F.hypot(F.col("i") - F.col("x1") - f * dx, F.col("j") - F.col("y1") - f * dy)
    near = near.filter(off < radius).select("t", "event", "j", "i")
    return inside.unionByName(near).select("t", "event", "j", F.pmod("i", F.lit(g.nx)).alias("i")).distinct()


def event_properties(cells: DataFrame, cube: DataFrame, v: str) -> DataFrame:
    """(t, event, mean_var, com_lon, com_lat, event_area) over the cells of events, weighted with the cells' areas (columns area, lat, lon of the cube)."""
    a = F.col("area")
    sums = cells.join(cube, ["t", "j", "i"]).groupBy("t", "event").agg(
        (F.sum(a * F.col(v)) / F.sum(a)).alias("mean_var"), (F.sum(a * F.col("lon")) / F.sum(a)).alias("com_lon"), (F.sum(a * F.col("lat")) / F.sum(a)).alias("com_lat"), F.sum(a).alias("event_area")
    )
    return sums.select("t", "event", *[F.round(c, 2).alias(c) for c in ("mean_var", "com_lon", "com_lat", "event_area")])


# Lows and rain.


def _physical(cube: DataFrame, *names: str) -> DataFrame:
    return cube.select("t", "j", "i", *names, "lat", "lon", (F.col("dx") * F.abs("dy") / 4e6).alias("area"))


def cyclone_by_contour(g: Grid, cube: DataFrame, msl: str, oro: str, config: Config = DEFAULTS) -> DataFrame:
    """(t, id, lat, lon, lowest, outer, size, cells): lows with their cells (array of j, i)."""
    def kernel(a):
        labels, table = kernels.cyclones_by_contour(a[msl], a[oro], a["lat"], a["lon"], a["area"], config.cyc_minsize, config.cyc_maxsize, config.cyc_maxoro, config.cyc_mindist, config.cyc_minprominence)
        out = pd.DataFrame(table, columns=["id", "lat", "lon", "lowest", "outer", "size"])
        out["cells"] = [[{"j": int(j), "i": int(i)} for j, i in zip(*np.nonzero(labels == k), strict=True)] for k in out["id"]]
        return out

    return per_slice(g, _physical(cube, msl, oro), kernel, "id int, lat double, lon double, lowest double, outer double, size double, cells array<struct<j:int,i:int>>")


def precip_blobs(g: Grid, cube: DataFrame, rain: str, min_distance: float) -> DataFrame:
    """(t, id, lat, lon, peak, size, cells): rain objects with their cells."""
    def kernel(a):
        labels, table = kernels.blobs(a[rain], a["lat"], a["lon"], a["area"], min_distance)
        out = pd.DataFrame(table, columns=["id", "lat", "lon", "peak", "size"])
        out["cells"] = [[{"j": int(j), "i": int(i)} for j, i in zip(*np.nonzero(labels == k), strict=True)] for k in out["id"]]
        return out

    return per_slice(g, _physical(cube, rain), kernel, "id int, lat double, lon double, peak double, size double, cells array<struct<j:int,i:int>>")


def attribute_to_features(objects: DataFrame, masks: DataFrame, cube: DataFrame, v: str) -> DataFrame:
    """(t, combination, total): sum of a field over objects (t, id, cells), by the set of masks (t, name, j, i) that touch the object; none: U."""
    cells = objects.select("t", "id", F.explode("cells").alias("c")).select("t", "id", "c.*")
    touched = cells.join(masks, ["t", "j", "i"]).groupBy("t", "id").agg(F.array_join(F.array_sort(F.collect_set("name")), "").alias("combination"))
    sums = cells.join(cube.select("t", "j", "i", v), ["t", "j", "i"]).groupBy("t", "id").agg(F.sum(v).alias("total"))
    return sums.join(touched, ["t", "id"], "left").groupBy("t", F.coalesce("combination", F.lit("U")).alias("combination")).agg(F.sum("total").alias("total"))


def atmospheric_river(g: Grid, cube: DataFrame, u: str, v: str, threshold: float = 250.0, min_length: float = 2000.0, min_poleward: float | None = None) -> DataFrame:
    """(t, label, j, i): connected moisture transports above a threshold, long enough and on one side of the equator."""
    def kernel(a):
        label = kernels.label(a["m"] > 0, g.cyclic)
        cells = _cells(label, lat=a["lat"], lon=a["lon"], v=a["v"]).sort_values("label", kind="stable", ignore_index=True)
        keep = kernels.long_objects(*(cells[c].to_numpy() for c in ("label", "j", "i", "lat", "lon", "v")), g.nx, g.cyclic, min_length, min_poleward)
        return cells.loc[keep, ["label", "j", "i"]]

    strong = cube.select("t", "j", "i", (F.hypot(u, v) > threshold).cast("double").alias("m"), F.col(v).alias("v"), "lat", "lon")
    return per_slice(g, strong, kernel, "label int, j int, i int")


def _steep(g: Grid, v: str, threshold: float):
    x, y = ddx(g, v), ddy(g, v)
    return F.sqrt(x * x + y * y) > threshold


def _large_volumes(g: Grid, cube: DataFrame, strong, mountain: str | None, min_size: float) -> DataFrame:
    strong = strong if mountain is None else strong & ~F.coalesce(F.col(mountain).cast("boolean"), F.lit(False))
    labels = label_connected_3d(g, cube.withColumn("__m", strong), "__m")
    area = cube.select("j", "i", (F.col("dx") * F.abs("dy") / 4).alias("area")).distinct()
    large = label_extents(labels, area).filter(F.col("size") >= min_size * g.nz)
    return labels.join(large.select("t", "label"), ["t", "label"], "left_semi").select("t", "label", "k", "j", "i")


def frontal_volume(g: Grid, cube: DataFrame, tfp: str, threshold: float = DEFAULTS.tfp_large, min_size: float = DEFAULTS.minsize, mountain: str | None = None) -> DataFrame:
    """(t, label, k, j, i): components, over levels, of strong gradients of the thermal front parameter that are large enough; none where ``mountain`` is true."""
    return _large_volumes(g, cube, _steep(g, tfp, threshold), mountain, min_size)


def frontal_volume_small(
    g: Grid, cube: DataFrame, tfp: str, smoothed: str | None = None, large: float = DEFAULTS.tfp_large, small: float = DEFAULTS.tfp_small, min_size: float = DEFAULTS.minsize, mountain: str | None = None, passes: int = DEFAULTS.nsmooth
) -> DataFrame:
    """As ``frontal_volume`` for fine grids: the gradient exceeds ``small``, and that of the smoothed field (``smoothed``, or made here) exceeds ``large``."""
    if smoothed is None:
        smoothed, cube = "__smooth", smooth_xy(g, cube, tfp, passes, out="__smooth")
    return _large_volumes(g, cube, _steep(g, tfp, small) & _steep(g, smoothed, large), mountain, min_size)


def dist_from_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(t, j, i, distance in m) from each cell (j, i, lat, lon) to the nearest of a mask (t, j, i) in the same slice.

    Cells at one latitude are a row.  For each row of the mask only its cell nearest
    in longitude matters to a cell, so a slice costs its cells times the mask's rows.
    """
    every = cells.select("j", "i", "lat", "lon").toPandas()  # the grid's cells
    place = {(j, i): k for k, (j, i) in enumerate(zip(every["j"], every["i"], strict=True))}
    lat, lon = every["lat"].to_numpy(), every["lon"].to_numpy()

    def apply(key, rows: pd.DataFrame) -> pd.DataFrame:
        marked = [place[c] for c in zip(rows["j"], rows["i"], strict=True) if c in place]
        out = every[["j", "i"]].assign(distance=kernels.distance_from(lat, lon, lat[marked], lon[marked]))
        out.insert(0, "t", key[0])
        return out if marked else out.iloc[:0]

    kinds = ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in ("t", "j", "i"))
    return mask.select("t", "j", "i").groupBy("t").applyInPandas(apply, f"{kinds}, distance double")


def solve_helmholtz(g: Grid, cube: DataFrame, v: str, coef: float, method: str = "multigrid", tolerance: float = 1e-22) -> DataFrame:
    """(t, j, i, x): for each slice the solution of x - coef (sum of the four neighbours - 4 x) = v on a doubly periodic grid, by multigrid, cg or bicgstab.

    A slice with a NULL or without one of its cells has none: x is NULL in all its cells.
    """
    solver = {"multigrid": kernels.multigrid, "cg": kernels.conjugate_gradient, "bicgstab": kernels.bicgstab}[method]

    def operator(x, level: int = 0):
        near = sum(np.roll(x, s, (0, 1)) for s in kernels.NEAR4)
        return x - coef / 4**level * (near - 4 * x)

    def kernel(a):
        whole = np.isfinite(a[v]).all()
        out = solver(operator, a[v], tolerance=tolerance)[0] if whole else a[v]
        j, i = np.indices(out.shape)
        return pd.DataFrame({"j": j.ravel().astype("int32"), "i": i.ravel().astype("int32"), "x": out.ravel() if whole else pd.array([None] * out.size, "Float64")})

    return per_slice(g, cube.select("t", "j", "i", v), kernel, "j int, i int, x double")


def def_3d(g: Grid, cube: DataFrame, u: str, v: str, w: str, rho: str | None = None, part: str = "all", natural: bool = False, vectors: bool = False) -> DataFrame:
    """(t, k, j, i, e_max, e_mid, e_min): eigenvalues of the symmetric velocity gradient without its divergence (uses dz).

    ``part`` may be "stretch" (the diagonal alone) or "shear" (the rest alone).
    ``natural`` turns the gradient's rows into coordinates that follow the flow
    first.  With ``rho``, w and dz are in pressure and are turned into metres by
    the published factor -rho g.  ``vectors`` adds v_max, v_mid, v_min (x, y, z; of
    length one, the largest component positive).  Cells whose gradient isn't whole
    have no row.
    """
    if part not in ("all", "stretch", "shear"):
        raise ValueError(f"not a part of deformation: {part}")
    up = "dz"
    if rho:
        cube, up = cube.withColumns({"__wm": -F.col(w) * F.col(rho) * G, "__dzm": -F.col("dz") * F.col(rho) * G}), "__dzm"
    names = {}
    for c, n in (("u", u), ("v", v), ("w", "__wm" if rho else w)):
        names |= {f"{c}x": ddx(g, n), f"{c}y": ddy(g, n), f"{c}z": ddz(g, n, up)}
    rows = cube.select("t", "k", "j", "i", *[c.alias(f"__{n}") for n, c in names.items()], *[F.col(c).cast("double").alias(f"__{n}") for n, c in (("u", u), ("v", v), ("w", w))]).dropna()
    if natural:
        rows = rows.filter("__u <> 0 OR __v <> 0")  # calm cells have no direction

    def kernel(batches):
        for b in batches:
            a = np.stack([b[f"__{r}{c}"].to_numpy() for r in "uvw" for c in "xyz"], axis=1).reshape(-1, 3, 3)
            turn = kernels.flow_axes(*(b[f"__{c}"].to_numpy() for c in "uvw")) if natural else None
            e, x = kernels.deformation_axes(a, part, turn)
            out = {"t": b["t"], "k": b["k"], "j": b["j"], "i": b["i"], "e_max": e[:, 0], "e_mid": e[:, 1], "e_min": e[:, 2]}
            if vectors:
                out |= {f"v_{n}": list(x[:, m]) for m, n in enumerate(("max", "mid", "min"))}
            yield pd.DataFrame(out)

    more = ", v_max array<double>, v_mid array<double>, v_min array<double>" if vectors else ""
    return rows.mapInPandas(kernel, f"t int, k int, j int, i int, e_max double, e_mid double, e_min double{more}")
