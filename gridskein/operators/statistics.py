"""Statistics per cell over time, histograms, regressions and kernel averages.

All are grouped aggregations with partial sums before the shuffle; ``by`` names
the key columns (by default the cell).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import ratio

CELL = ("j", "i")


def basic(cube: DataFrame, v: str, by: tuple[str, ...] = CELL, step: str = "t", first_step: int = 0) -> DataFrame:
    """Minimum, maximum, mean, standard deviation and the sum of value times step number; NULL where a step misses the value."""
    whole = F.count(v) == F.count(F.lit(1))
    out = {"minv": F.min(v), "maxv": F.max(v), "mean": F.avg(v), "stddev": F.stddev_samp(v), "tprod": F.sum(F.col(v) * (F.col(step) + 1 + first_step))}
    return cube.groupBy(*by).agg(*[F.when(whole, c).alias(n) for n, c in out.items()])


def basic_confidence(cube: DataFrame, trend: DataFrame, v: str, by: tuple[str, ...] = CELL, step: str = "t", first_step: int = 0) -> DataFrame:
    """Sum of squared residuals (ressq) about a trend: ``trend`` has the keys, trend and icept."""
    rest = F.col(v) - F.col("icept") - F.col("trend") * (F.col(step) + 1 + first_step)
    return cube.join(trend, list(by)).groupBy(*by).agg(F.sum(rest * rest).alias("ressq"))


def basic_weighted(cube: DataFrame, v: str, weight: str, by: tuple[str, ...] = CELL) -> DataFrame:
    """Extremes among positive weights, weighted mean and standard deviation, and the sum of weights."""
    w, x = F.col(weight), F.col(v)
    positive = F.when(w > 0, x)
    sums = cube.groupBy(*by).agg(F.min(positive).alias("minv"), F.max(positive).alias("maxv"), F.sum(w * x).alias("a"), F.sum(w * x * x).alias("b"), F.sum(w).alias("wsum"))
    mean = ratio(F.col("a"), F.col("wsum"))
    spread = ratio(F.col("b"), F.col("wsum")) - mean * mean
    return sums.select(*by, "minv", "maxv", mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("stddev"), "wsum")


def bin_index(value: Column, bounds: list[float]) -> Column:
    """Number (from 0) of the half-open bin of a value; the one bin whose upper bound is less wraps around; the last takes what fits nowhere."""
    found = F.lit(None).cast("int")
    for k in reversed(range(len(bounds) - 1)):
        lo, hi = bounds[k], bounds[k + 1]
        inside = (value >= lo) & (value < hi) if hi >= lo else (value >= lo) | (value < hi)
        found = F.when(inside, k).otherwise(found)
    return F.when(value.isNotNull(), F.coalesce(found, F.lit(len(bounds) - 2)))


def binned(cube: DataFrame, v: str, bounds: list[float], by: tuple[str, ...] = CELL) -> DataFrame:
    """One row per key: hist (counts of all bins), mfv (centre of the fullest bin, the first of equals) and med (centre of the median's bin)."""
    n = len(bounds) - 1
    counts = [F.count(F.when(F.col("__b") == k, 1)).alias(f"__{k}") for k in range(n)]
    wide = cube.withColumn("__b", bin_index(F.col(v), bounds)).groupBy(*by).agg(*counts)
    hist = F.array(*[F.col(f"__{k}") for k in range(n)])
    centres = F.array(*[F.lit((bounds[k] + bounds[k + 1]) / 2) for k in range(n)])
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    half = F.floor((total + 1) / 2)
    running = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(hist, 1, k), F.lit(0).cast("long"), lambda a, x: a + x))
    mode = F.array_position(hist, F.array_max(hist))
    median = F.array_position(F.transform(running, lambda c: c >= half), True)
    at = lambda place: F.when(total > 0, F.element_at(centres, place.cast("int")))
    return wide.select(*by, hist.alias("hist"), at(mode).alias("mfv"), at(median).alias("med"))


def hist2d(rows: DataFrame, x: str, x0: float, dx: float, nx: int, y: str, y0: float, dy: float, ny: int) -> DataFrame:
    """(bx, by, n) for bins on two linear scales; values outside count under the bin -1, -1."""
    place = lambda c, first, step: ((F.col(c) - first) / step).cast("int")  # noqa: E731  towards zero
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(place(x, x0, dx).alias("bx"), place(y, y0, dy).alias("by"))
    inside = F.col("bx").between(0, nx - 1) & F.col("by").between(0, ny - 1)
    return rows.select(F.when(inside, F.col("bx")).otherwise(-1).alias("bx"), F.when(inside, F.col("by")).otherwise(-1).alias("by")).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def windrose(rows: DataFrame, direction: Column, speed: Column, sectors: int, bounds: list[float]) -> DataFrame:
    """(sector, bin, n, percent): sectors centred on north, speeds in half-open bins, the last open above."""
    width = 360.0 / sectors
    sector = F.pmod(F.floor((F.pmod(direction, F.lit(360.0)) + width / 2) / width), F.lit(sectors)).cast("int")
    kind = F.lit(None).cast("int")
    for k, lo in enumerate(bounds):
        kind = F.when(speed >= lo, k).otherwise(kind)
    counted = rows.select(sector.alias("sector"), kind.alias("bin")).filter("sector IS NOT NULL AND bin IS NOT NULL").groupBy("sector", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("sector", "bin", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # one row


def regress(cube: DataFrame, v: str, projected: str, patterns: DataFrame, step: str = "t", by: tuple[str, ...] = CELL) -> tuple[DataFrame, DataFrame]:
    """Time series of patterns (n, keys, pat) in ``projected``, and the regression of ``v`` on each: (n, t, ts) and (n, keys, res)."""
    series = cube.join(patterns, list(by)).groupBy("n", step).agg(F.sum(F.col(projected) * F.col("pat")).alias("ts"))
    maps = cube.join(series, step).groupBy("n", *by).agg(F.sum(F.col("ts") * F.col(v)).alias("res"))
    return series, maps


def kernel_average(points: DataFrame, cells: DataFrame, lx: float, ly: float, z: str = "z", mask_below: float = 1e-3, relative: bool = True) -> DataFrame:
    """(keys of cells, density, average): Gaussian kernels with lengths lx, ly at points (x, y, z), up to four lengths away.

    Cells whose density is below ``mask_below`` (of the largest, if relative) are
    NULL. Points and cells are joined by tiles of four lengths, so the work
    follows the neighbours, not all pairs.
    """
    side_x, side_y = 4 * lx, 4 * ly
    tile = lambda c, side: F.floor(F.col(c) / side)
    spread = F.explode(F.expr("array(-1, 0, 1)"))
    near = points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col(z).alias("pz"), tile("x", side_x).alias("tx"), tile("y", side_y).alias("ty"))
    near = near.withColumn("a", spread).withColumn("b", spread).select("px", "py", "pz", (F.col("tx") + F.col("a")).alias("tx"), (F.col("ty") + F.col("b")).alias("ty"))
    keys = [c for c in cells.columns if c not in ("x", "y")]
    both = cells.withColumns({"tx": tile("x", side_x), "ty": tile("y", side_y)}).join(near, ["tx", "ty"])
    d2 = ((F.col("x") - F.col("px")) / lx) ** 2 + ((F.col("y") - F.col("py")) / ly) ** 2
    w = F.exp(-d2 / 2)
    sums = both.filter((F.abs(F.col("x") - F.col("px")) <= side_x) & (F.abs(F.col("y") - F.col("py")) <= side_y)).groupBy(*keys).agg(F.sum(w).alias("density"), F.sum(w * F.col("pz")).alias("wz"))
    top = sums.agg(F.max("density").alias("top"))
    least = mask_below * F.col("top") if relative else F.lit(mask_below)
    kept = F.col("density") >= least
    return sums.crossJoin(F.broadcast(top)).select(*keys, F.when(kept, F.col("density")).alias("density"), F.when(kept, F.col("wz") / F.col("density")).alias("average"))


def values_at_ranks(rows: DataFrame, v: str, ranks: Callable[[int], list[int]]) -> list[float]:
    """The values at ranks (from 0) of the sorted values that aren't missing; ``ranks`` gets their number.  Empty if there are none.

    A histogram of 1024 bins around a rank is counted, then one of the bin that
    holds it, until that has one value: a few passes, each of which brings as many
    counts to the driver, whatever the number of rows.
    """
    rows = rows.select(F.col(v).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    found = []
    for rank in ranks(n) if n else []:
        lo, hi, below = low, high, 0
        while lo < hi:
            place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / 1024)), F.lit(1023))
            bins = rows.filter(F.col("v").between(lo, hi)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
            for b in bins:
                if below + b["n"] > rank:
                    lo, hi = b["lo"], b["hi"]
                    break
                below += b["n"]
        found.append(lo)
    return found


def percentile_thresholds(rows: DataFrame, v: str, low: float, high: float) -> DataFrame:
    """(lower, upper): the values at given shares of the sorted values, exact; NULL without any."""
    at = lambda share, n: max(0, math.ceil(round(share * n, 9)) - 1)
    found = values_at_ranks(rows, v, lambda n: [at(low, n), at(high, n)]) or [None, None]
    return rows.sparkSession.createDataFrame([tuple(found)], "lower double, upper double")


def scale_limits(rows: DataFrame, v: str, extend: str = "neither", shares: tuple[float, float] = (0.02, 0.98), symmetric: bool = False) -> tuple[float, float]:
    """Limits of a colour scale: least and greatest value or, where ``extend`` (neither, min, max, both) lets values lie outside, those at given shares."""
    ends = values_at_ranks(rows, v, lambda n: [0, n - 1])
    if not ends:
        return -0.5, 0.5
    if ends[0] == ends[1]:
        return ends[0] - 0.5, ends[0] + 0.5
    inner = values_at_ranks(rows, v, lambda n: [math.floor(shares[0] * n), min(n - 1, math.floor(shares[1] * n))])
    lo, hi = inner[0] if extend in ("min", "both") else ends[0], inner[1] if extend in ("max", "both") else ends[1]
    if lo == hi:
        lo, hi = ends
    if symmetric:
        hi = max(abs(lo), abs(hi))
        lo = -hi
    return lo, hi


def scale_ticks(limits: tuple[float, float], steps: int = 7, symmetric: bool = False, intervals: tuple[float, ...] = (1, 2, 3, 5, 10)) -> list[float]:
    """Ticks of a colour scale: multiples of the allowed interval (times a power of ten) that comes nearest to so many steps; halves of it if symmetric."""
    lo, hi = limits
    size = math.log10((hi - lo) / steps)
    power = math.floor(size)
    width = min(intervals, key=lambda k: abs(math.log10(k) - (size - power))) * 10.0**power
    half = 0.5 if symmetric else 0.0
    first, last = math.floor(lo / width - half) + half, math.ceil(hi / width + half) - half
    return [round(first + k, 6) * width for k in range(round(last - first) + 1)]


def mask_insignificant(value: Column, mean: Column, sigma: Column, n: float) -> Column:
    """The value, NULL where it is within n sigma of the mean."""
    return F.when(F.abs(value - mean) >= n * sigma, value)
