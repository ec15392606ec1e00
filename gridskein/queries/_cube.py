"""Field cubes made of the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, latlon_cells

NX, NY = 64, 50
LATS = [-73.5 + 3 * j for j in range(NY)]
LONS = [5.625 * i for i in range(NX)]
GRID = Grid(NX, NY)
#: Levels and rows of the cube with levels.
NZ, NYZ = 5, 10
GRID_Z = Grid(NX, NYZ, NZ, slice_cols=("t", "k"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession) -> DataFrame:
    return F.broadcast(latlon_cells(spark, LATS, LONS))  # 3200 rows, whatever the input


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, j, i, v, u, s, temp, p, q, lat, lon, dx, dy): one horizontal slice for 50 vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"), "embedding")
    e = e.select((F.col("vec_id") / 50).cast("int").alias("t"), (F.col("vec_id") % 50).cast("int").alias("j"), "i", F.col("e").cast("double").alias("e"), F.element_at("embedding", (F.col("i") + 7) % NX + 1).cast("double").alias("f"))
    e = e.select("t", "j", "i", (20 * F.col("e")).alias("u"), (20 * F.col("f")).alias("v"), (280 + 40 * F.col("e")).alias("temp"), (100000.0 - 1500.0 * F.col("j")).alias("p"), (0.01 * (F.col("e") + 0.6)).alias("q"), (1000 * F.col("f") + 10 * F.col("j")).alias("s"))
    return e.join(_cells(spark), ["j", "i"])


def cube_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, k, j, i, u, v, w, th, z, lat, lon, dx, dy, dz): levels k, lowest last; theta falls and height rises with them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"), "embedding")
    f = lambda n: F.element_at("embedding", (F.col("i") + n) % NX + 1).cast("double")
    e = e.select((F.col("vec_id") / 50).cast("int").alias("t"), (F.col("vec_id") % 5).cast("int").alias("k"), (F.floor(F.col("vec_id") / 5) % 10).cast("int").alias("j"), "i", F.col("e").cast("double").alias("e"), f(7).alias("f"), f(3).alias("h"))
    e = e.select("t", "k", "j", "i", (20 * F.col("e")).alias("u"), (20 * F.col("f")).alias("v"), (0.1 * F.col("h")).alias("w"), (340 - 10.0 * F.col("k") + 4 * F.col("e")).alias("th"), (8000 - 1500.0 * F.col("k") + 300 * F.col("f")).alias("z"))
    return e.join(_cells(spark), ["j", "i"]).withColumn("dz", F.lit(-3000.0))


_CELL_SQL = "-73.5 + 3 * j AS lat, 5.625 * i AS lon, 111111.11 * 11.25 * cos(radians(-73.5 + 3 * j)) AS dx, 111111.11 * 6.0 AS dy"
CUBE_SQL = f"""r AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS e, CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE) AS f, CAST(embedding[(i + 3) % 64 + 1] AS DOUBLE) AS h
    FROM (SELECT vec_id, embedding, CAST(unnest(range(0, 64)) AS INTEGER) AS i FROM embeddings)),
s0 AS (SELECT *, {_CELL_SQL} FROM (SELECT CAST(vec_id // 50 AS INTEGER) AS t, CAST(vec_id % 50 AS INTEGER) AS j, i, 20 * e AS u, 20 * f AS v, 280 + 40 * e AS temp,
    100000.0::DOUBLE - 1500.0::DOUBLE * (vec_id % 50) AS p, 0.01::DOUBLE * (e + 0.6::DOUBLE) AS q, 1000 * f + 10 * (vec_id % 50) AS s FROM r))"""
CUBE_Z_SQL = CUBE_SQL[: CUBE_SQL.index("s0 AS")] + f"""s0 AS (SELECT *, {_CELL_SQL}, -3000.0::DOUBLE AS dz FROM (SELECT CAST(vec_id // 50 AS INTEGER) AS t, CAST(vec_id % 5 AS INTEGER) AS k,
    CAST(vec_id // 5 % 10 AS INTEGER) AS j, i, 20 * e AS u, 20 * f AS v, 0.1::DOUBLE * h AS w, 340 - 10.0::DOUBLE * (vec_id % 5) + 4 * e AS th, 8000 - 1500.0::DOUBLE * (vec_id % 5) + 300 * f AS z FROM r))"""

_OFFSETS = {"e": ("i", 1), "w": ("i", -1), "n": ("j", 1), "s": ("j", -1), "u": ("k", 1), "d": ("k", -1)}


def stages_sql(stages: list[dict[str, str]], levels: bool = False, first: int = 0) -> str:
    """CTEs of stages over the cube; in an expression ``v[e]`` is v of the cell to the east ([ne], [ww] and so on; [u], [d]: next level up, down in k)."""
    keys = ["t", "k", "j", "i"] if levels else ["t", "j", "i"]
    parts = [CUBE_Z_SQL if levels else CUBE_SQL]
    for n, stage in enumerate(stages, first):
        text = ", ".join(f"{e} AS {c}" for c, e in stage.items())
        sides: dict[str, set[str]] = {}
        for v, d in re.findall(r"\b(\w+)\[([newsud]+)\]", text):
            sides.setdefault(d, set()).add(v)
        joins = []
        for d, names in sides.items():
            shift = {"i": 0, "j": 0, "k": 0}
            for c in d:
                shift[_OFFSETS[c][0]] += _OFFSETS[c][1]
            at = lambda k: f"(i + {shift['i'] % NX}) % {NX}" if k == "i" else f"{k} + {shift.get(k, 0)}"  # noqa: B023, E731
            cols = ", ".join([*(f"{k} AS {k}__{d}" for k in keys), *(f"{v} AS {v}__{d}" for v in sorted(names))])
            joins.append(f"LEFT JOIN (SELECT {cols} FROM s{n}) ON " + " AND ".join(f"{k}__{d} = {at(k)}" for k in keys))
        text = re.sub(r"\b(\w+)\[([newsud]+)\]", r"\1__\2", text)
        own = "*" if not sides else "s%d.*" % n
        parts.append(f"s{n + 1} AS (SELECT {own}, {text} FROM s{n} {' '.join(joins)})")
    return "WITH " + ",\n".join(parts)


def rounded(df: DataFrame, outs: dict[str, float], keys: tuple[str, ...] = ("t", "j", "i")) -> DataFrame:
    """Keys, and columns times their scale, rounded alike in both engines."""
    return df.select(*keys, *[(F.round(F.col(c) * scale, 6) + 0.0).alias(c) for c, scale in outs.items()])


def rounded_sql(outs: dict[str, float], source: str, keys: tuple[str, ...] = ("t", "j", "i")) -> str:
    return f"SELECT {', '.join([*keys, *(f'round({c} * {scale}::DOUBLE, 6) + 0.0::DOUBLE AS {c}' for c, scale in outs.items())])} FROM {source}"
