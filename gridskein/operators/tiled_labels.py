"""Labels of connected cells of slices larger than a task, and of whole series: by tiles, joined at their seams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..storage import materialise
from . import kernels
from .components import connected_components
from .ranks import ranked


def label_tiles(g: Grid, cube: DataFrame, mask: str, tile: tuple[int, int] = (256, 256), diagonal: bool = False, over_time: bool = False) -> DataFrame:
    """(t, j, i, label) of the components of a boolean mask, cells outside left out; the same whatever the size of a tile.

    Cells of a slice are connected with their four neighbours, or all eight if
    ``diagonal``; with ``over_time`` also with the same cell of the next step, and
    labels then run through the whole series.  Labels are numbered from 1 in order
    of their first cell (x outermost), of each step or, over time, of all.  A task
    labels one tile (rows, columns) of a slice; only cells at seams meet those of
    other tiles, and only tiles' labels go on to the components.  Null masks are
    outside; ``t`` is a whole number.
    """
    rows, columns = tile
    cells = cube.filter(F.coalesce(F.col(mask).cast("double") > 0, F.lit(False))).select("t", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"))
    kind = cells.schema["t"].dataType.simpleString()
    cells = cells.withColumns({"tj": F.floor(F.col("j") / rows), "ti": F.floor(F.col("i") / columns)})

    def kernel(_, part):
        j, i = part["j"].to_numpy(), part["i"].to_numpy()
        inside = np.zeros((j.max() - j.min() + 1, i.max() - i.min() + 1), bool)
        inside[j - j.min(), i - i.min()] = True
        label = kernels.label(inside, False, diagonal)[j - j.min(), i - i.min()]
        node = (part["t"].to_numpy(np.int64) * g.nx + i) * g.ny + j
        first = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, node)
        return pd.DataFrame({"t": part["t"], "j": j, "i": i, "node": first[label]})

    own = materialise(cells.groupBy("t", "tj", "ti").applyInPandas(kernel, f"t {kind}, j int, i int, node long"), "tiles")
    # Each cell at a tile's end looks for its neighbours beyond it; over time all cells look for the next step's.
    steps = [(0, 0, 1), (0, 1, 0), *([(0, 1, 1), (0, 1, -1)] if diagonal else []), *([(1, 0, 0)] if over_time else [])]
    ahead = F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("j"), F.lit(c).alias("i")) for a, b, c in steps])
    to_i = F.col("i") + F.col("d.i")
    looking = own.withColumn("d", F.explode(ahead)).withColumns({"to_t": (F.col("t") + F.col("d.t")).cast(kind), "to_j": F.col("j") + F.col("d.j"), "to_i": F.pmod(to_i, F.lit(g.nx)) if g.cyclic else to_i})
    leaves = (F.col("d.t") > 0) | (F.floor(F.col("to_j") / rows) != F.floor(F.col("j") / rows)) | (F.floor(F.col("to_i") / columns) != F.floor(F.col("i") / columns)) | (F.col("to_i") != to_i)
    there = own.select(F.col("t").alias("to_t"), F.col("j").alias("to_j"), F.col("i").alias("to_i"), F.col("node").alias("b"))
    links = looking.filter(leaves).select("to_t", "to_j", "to_i", F.col("node").alias("a")).join(there, ["to_t", "to_j", "to_i"]).filter("a <> b").select("a", "b").distinct()
    roots = materialise(connected_components(links), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    named = own.join(roots.join(least, "root").select("node", "least"), "node", "left").select("t", "j", "i", F.coalesce("least", "node").alias("first"))
    series = F.lit(0) if over_time else F.floor(F.col("first") / (g.nx * g.ny))
    numbers = ranked(named.select("first").distinct().withColumn("of", series), "first", within=("of",))
    return named.join(numbers, "first").select("t", "j", "i", (F.col("rank") + 1).cast("int").alias("label"))
