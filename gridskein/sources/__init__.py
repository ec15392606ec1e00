"""Field data at rest: catalogue, levels, readers and writers."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import latlon_cells
from .netcdf import netcdf_axes, netcdf_cells, netcdf_files, netcdf_rotations, read_netcdf, rows_of_netcdf, save_netcdf
from .netcdf_source import register_netcdf

__all__ = ["Catalogue", "Variable", "format_level", "instantaneous", "level_kind", "level_value", "netcdf_axes", "netcdf_cells", "netcdf_files", "netcdf_rotations", "parse_level", "parse_time_unit", "read_arrays", "read_netcdf", "register_netcdf", "rows_of_netcdf", "save_composites", "save_fields", "save_netcdf", "static_cells", "time_numbers", "vertical_axis"]


@dataclass(frozen=True)
class Variable:
    """What a variable is: short name, long name, units, and how it is averaged (bins, lines, object masks)."""

    name: str
    long_name: str
    units: str
    bins: tuple[float, ...] | None = None
    lines: bool = False
    mask: bool = False

    @property
    def averaged(self) -> str:
        """Its name after averaging: lines and masks become frequencies."""
        return f"{self.name}_freq" if self.lines or self.mask else self.name


@dataclass
class Catalogue:
    """Registered variables; conflicting registrations are errors."""

    variables: dict[str, Variable] = field(default_factory=dict)

    def register(self, variable: Variable) -> None:
        if self.variables.setdefault(variable.name, variable) != variable:
            raise ValueError(f"{variable.name} is registered differently already")

    def with_metadata(self, df: DataFrame) -> DataFrame:
        """The frame with the variables' metadata at its columns."""
        for c in df.columns:
            if v := self.variables.get(c):
                df = df.withMetadata(c, {"long_name": v.long_name, "units": v.units})
        return df


def parse_level(level: str) -> tuple[str, float]:
    """(kind, value) of a level's name: 'pt330' (K), 'pv2000' (PVU), '10m', 'sfc', '850' (Pa)."""
    if level == "sfc":
        return "surface", 0.0
    if m := re.fullmatch(r"pt(\d+(?:\.\d+)?)", level):
        return "isentropic", float(m[1])
    if m := re.fullmatch(r"pv(\d+(?:\.\d+)?)", level):
        return "pv", float(m[1]) / 1000
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)m", level):
        return "height", float(m[1])
    if m := re.fullmatch(r"\d+(?:\.\d+)?", level):
        return "pressure", float(level) * 100
    raise ValueError(f"not a level: {level}")


def format_level(kind: str, value: float) -> str:
    """The inverse of ``parse_level``."""
    if kind == "surface":
        return "sfc"
    return {"isentropic": "pt{:g}", "pv": "pv{:g}", "height": "{:g}m", "pressure": "{:g}"}[kind].format(value * {"pv": 1000, "pressure": 0.01}.get(kind, 1))


def level_kind(level: Column) -> Column:
    """The kind of a column of level names."""
    rules = (("^sfc$", "surface"), (r"^pt\d", "isentropic"), (r"^pv\d", "pv"), (r"^[\d.]+m$", "height"), (r"^[\d.]+$", "pressure"))
    found = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        found = F.when(level.rlike(pattern), kind).otherwise(found)
    return found


def level_value(level: Column) -> Column:
    """The value of a column of level names, in the units of ``parse_level``."""
    number = F.try_to_number(F.regexp_extract(level, r"(\d+(?:\.\d+)?)", 1), F.lit("999999D999")).cast("double")
    kind = level_kind(level)
    return F.when(kind == "surface", 0.0).when(kind == "pv", number / 1000).when(kind == "pressure", number * 100).otherwise(number)


def save_fields(cube: DataFrame, path: str, partition_by: tuple[str, ...] = ("year", "month"), time: str = "t", overwrite: bool = False) -> None:
    """Write a cube as Parquet, by year and month of its times, sorted by time within files."""
    cube = cube.withColumns({"year": F.year(time), "month": F.month(time)})
    spread = cube.repartition(*partition_by).sortWithinPartitions(*partition_by, time)
    spread.write.mode("overwrite" if overwrite else "error").partitionBy(*partition_by).parquet(path)


def save_composites(composites: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write composites, a folder for each."""
    composites.write.mode("overwrite" if overwrite else "error").partitionBy("composite").parquet(path)


def instantaneous(spark: SparkSession, path: str, variables: list[str], start: str, end: str, levels: list[str] | None = None, time: str = "t", limit: float | None = None) -> DataFrame:
    """Fields of [start, end): only the months, columns and row groups that are asked for are read.

    With ``limit`` a request for more values is refused, after counting its rows.
    """
    df = spark.read.parquet(path)
    begin, stop = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if {"year", "month"} <= set(df.columns):
        months = 12 * F.col("year") + F.col("month")
        df = df.filter((months >= 12 * F.year(begin) + F.month(begin)) & (months <= 12 * F.year(stop) + F.month(stop)))
    df = df.filter((F.col(time) >= begin) & (F.col(time) < stop))
    if levels:
        df = df.filter(F.col("plev").isin(*levels))
    keys = [c for c in (time, "plev", "k", "j", "i") if c in df.columns]
    df = df.select(*keys, *variables)
    if limit is not None and (n := df.count() * len(variables)) > limit:
        raise ValueError(f"{n} values are more than the limit of {limit:g}")
    return df


def read_arrays(spark: SparkSession, path: str, names: tuple[str, ...] = ("t", "j", "i")) -> DataFrame:
    """Cubes in .npy and .npz files: (file, variable, indices, value); missing values are NULL."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                for variable, values in data.items() if hasattr(data, "items") else [("data", data)]:
                    if values.ndim != len(names):
                        continue
                    flat = values.astype(float).ravel()
                    places = np.unravel_index(np.arange(len(flat)), values.shape)
                    for s in range(0, len(flat), 100_000):
                        part = slice(s, s + 100_000)
                        out = pd.DataFrame({"file": file, "variable": variable, **{n: p[part].astype("int32") for n, p in zip(names, places, strict=True)}, "value": flat[part]})
                        yield out.astype({"value": object}).where(out.notna(), None)

    kinds = ", ".join(f"{n} int" for n in names)
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"file string, variable string, {kinds}, value double")
    return found.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def parse_time_unit(value: Column, unit: str) -> Column:
    """Timestamps of numbers 'seconds|minutes|hours|days since <date>'."""
    m = re.fullmatch(r"(second|minute|hour|day)s? since (.+)", unit.strip())
    if not m:
        raise ValueError(f"not a time unit: {unit}")
    width = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[1]]
    return F.timestamp_seconds(F.unix_timestamp(F.lit(m[2]).cast("timestamp")) + value * width)


def time_numbers(value: Column, unit: str) -> Column:
    """The inverse of ``parse_time_unit``: the numbers that a new time axis gives to timestamps."""
    m = re.fullmatch(r"(second|minute|hour|day)s? since (.+)", unit.strip())
    if not m:
        raise ValueError(f"not a time unit: {unit}")
    width = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[1]]
    return (F.unix_timestamp(value) - F.unix_timestamp(F.lit(m[2]).cast("timestamp"))) / width


def vertical_axis(level: str | None) -> dict:
    """Name, unit and values of the vertical axis of a field on a level; without one, an empty axis."""
    if level is None:
        return {"name": "", "unit": "", "values": []}
    kind, value = parse_level(level)
    if kind == "surface":
        return {"name": None, "unit": None, "values": None}
    return {"name": "lev", "unit": {"isentropic": "K", "pv": "PVU", "height": "m", "pressure": "Pa"}[kind], "values": [value]}


def static_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the grid whose axes ``lat`` and ``lon`` an .npz file has (as ``latlon_cells``)."""
    axes = {r["variable"]: r["values"] for r in read_arrays(spark, path, ("n",)).filter("variable IN ('lat', 'lon')").groupBy("variable").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values")).collect()}  # two axes
    if set(axes) != {"lat", "lon"}:
        raise ValueError(f"a grid needs lat and lon; {path} has {sorted(axes)}")
    return latlon_cells(spark, axes["lat"], axes["lon"])
