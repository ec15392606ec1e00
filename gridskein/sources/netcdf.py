"""Files in the classic netCDF formats (CDF-1, -2 and -5), read and written without a library.

Each file is one task; its header says where the values lie, and rows leave in
parts of fixed size.  Spark's ``binaryFile`` hands over files of up to 2 GB.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators.curvilinear import rotated_cells
from ..storage import materialise

#: External types of the format by number.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Values in a batch of rows.
PART = 100_000


@dataclass
class Variable:
    """A variable: dimensions, attributes, type, place of its first value, and whether it grows by records."""

    name: str
    dims: list[str]
    shape: tuple[int, ...]
    dtype: np.dtype
    begin: int
    grows: bool
    attributes: dict = field(default_factory=dict)


class ClassicFile:
    """Header of a file's content; ``values`` yields arrays.

    ``size`` is that of the file where ``content`` is only its beginning; a header
    that isn't all there is an EOFError.
    """

    def __init__(self, content: bytes, size: int | None = None):
        try:
            self._parse(content, len(content) if size is None else size)
        except struct.error as error:
            raise EOFError("the header is longer than what was read") from error

    def _parse(self, content: bytes, size_of_file: int) -> None:
        if content[:3] != b"CDF" or content[3:4] not in (b"\x01", b"\x02", b"\x05"):
            kind = "netCDF-4 (HDF5)" if content[:4] == b"\x89HDF" else "unknown"
            raise ValueError(f"not a classic netCDF file but {kind}; convert it with a netCDF tool, or to Parquet or .npz")
        self.content, self.at, version = content, 4, content[3]
        self.count_code, self.offset_code = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
        self.records = self._number(self.count_code)
        dims = [(self._name(), self._number(self.count_code)) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        sizes = {}
        for _ in range(self._list()):
            name = self._name()
            own = [dims[self._number(self.count_code)] for _ in range(self._number(self.count_code))]
            attributes = self._attributes()
            dtype = np.dtype(TYPES[self._number(">i")])
            self._number(self.count_code)  # the size that is stored overflows in large files
            grows = bool(own) and own[0][1] == 0
            shape = tuple(size for _, size in own[grows:])
            sizes[name] = int(np.prod(shape, dtype=np.int64)) * dtype.itemsize
            self.variables[name] = Variable(name, [d for d, _ in own], shape, dtype, self._number(self.offset_code), grows, attributes)
        growing = [n for n, v in self.variables.items() if v.grows]
        self.stride = sizes[growing[0]] if len(growing) == 1 else sum(-(-sizes[n] // 4) * 4 for n in growing)
        if self.records < 0:  # a stream: as many as the file holds
            first = min((self.variables[n].begin for n in growing), default=size_of_file)
            self.records = (size_of_file - first) // self.stride if self.stride else 0

    def _number(self, code: str) -> int:
        value = struct.unpack_from(code, self.content, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def _list(self) -> int:
        self._number(">i")
        return self._number(self.count_code)

    def _bytes(self, size: int) -> bytes:
        value = self.content[self.at : self.at + size]
        if len(value) < size:
            raise EOFError("the header is longer than what was read")
        self.at += -(-size // 4) * 4
        return value

    def _name(self) -> str:
        return self._bytes(self._number(self.count_code)).decode("utf-8")

    def _attributes(self) -> dict:
        found = {}
        for _ in range(self._list()):
            name, dtype = self._name(), np.dtype(TYPES[self._number(">i")])
            n = self._number(self.count_code)
            raw = self._bytes(n * dtype.itemsize)
            found[name] = raw.decode("utf-8", "replace").rstrip("\0") if dtype.kind == "S" else np.frombuffer(raw, dtype).astype(dtype.newbyteorder("="))
        return found

    def values(self, name: str) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the first record, values) of each record, or once of a variable that doesn't grow."""
        v = self.variables[name]
        n = int(np.prod(v.shape, dtype=np.int64))
        for k in range(self.records if v.grows else 1):
            flat = np.frombuffer(self.content, v.dtype, n, v.begin + k * self.stride)
            yield k, flat.reshape((1, *v.shape) if v.grows else v.shape)

    def unpacked(self, name: str) -> Iterator[tuple[int, np.ndarray]]:
        """As ``values``, as doubles: scaled, shifted, NaN where they are missing."""
        for k, raw in self.values(name):
            yield k, unpacked(raw, self.variables[name].attributes)


def unpacked(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """Stored values as doubles: scaled and shifted as the variable's attributes say, NaN where they are missing."""
    number = lambda key, default: float(np.asarray(attributes.get(key, default)).ravel()[0])
    gone = [x for key in ("_FillValue", "missing_value") if key in attributes and not isinstance(attributes[key], str) for x in np.ravel(attributes[key]).tolist()]
    out = raw.astype(float) * number("scale_factor", 1.0) + number("add_offset", 0.0)
    out[np.isin(raw, gone)] = np.nan
    return out


def _field(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attribute_list(attributes: dict) -> bytes:
    if not attributes:
        return struct.pack(">ii", 0, 0)
    parts = [struct.pack(">ii", 12, len(attributes))]
    for name, value in attributes.items():
        if isinstance(value, str):
            kind, n, raw = 2, len(value.encode()), value.encode()
        else:
            value = np.atleast_1d(value)
            kind = {"h": 3, "i": 4, "f": 5, "d": 6}[value.dtype.char]
            n, raw = len(value), value.astype(TYPES[kind]).tobytes()
        parts.append(_field(name) + struct.pack(">ii", kind, n) + raw + b"\0" * (-len(raw) % 4))
    return b"".join(parts)


def classic_bytes(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A file in the format CDF-2: dimensions, and variables (dimensions, values, attributes) of shorts, ints, floats or doubles; none grows."""
    names = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", 10, len(dims)) + b"".join(_field(d) + struct.pack(">i", n) for d, n in dims.items())
    head += _attribute_list(attributes or {})
    entries, data = [], []
    for name, (own, values, more) in variables.items():
        kind = {"h": 3, "i": 4, "f": 5, "d": 6}[values.dtype.char]
        raw = values.astype(TYPES[kind]).tobytes()
        raw += b"\0" * (-len(raw) % 4)
        entry = _field(name) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(d)) for d in own) + _attribute_list(more) + struct.pack(">ii", kind, len(raw))
        entries.append(entry)
        data.append(raw)
    head += struct.pack(">ii", 11, len(entries))
    at = len(head) + sum(len(e) + 8 for e in entries)
    for entry, raw in zip(entries, data, strict=True):
        head += entry + struct.pack(">q", at)
        at += len(raw)
    return head + b"".join(data)


def netcdf_files(g: Grid, cube: DataFrame, variables: list[str], lats: list[float], lons: list[float], packing: dict[str, tuple[float, float]] | None = None, attributes: dict[str, dict] | None = None) -> DataFrame:
    """(t, content): a classic netCDF file for each horizontal slice, with its coordinates.

    Values are doubles or, for variables in ``packing`` (scale, offset), shorts;
    missing ones are the fill value.  ``attributes`` are the variables' own.  Each
    file is made in the task that has the slice; ``save_netcdf`` writes them.
    """
    lat, lon = np.asarray(lats, float), np.asarray(lons, float)
    dims = {"time": 1, "latitude": g.ny, "longitude": g.nx}

    def make(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = {"latitude": (("latitude",), lat, {"units": "degrees_north"}), "longitude": (("longitude",), lon, {"units": "degrees_east"})}
        for name in variables:
            values = np.full((1, g.ny, g.nx), np.nan)
            values[0, rows["j"], rows["i"]] = rows[name].to_numpy(float, na_value=np.nan)
            more = dict((attributes or {}).get(name, {}))
            if name in (packing or {}):
                scale, offset = packing[name]
                whole = np.rint((values - offset) / scale)
                values = np.where(np.abs(whole) <= 32767, whole, -32768).astype(np.int16)  # NaN too
                more |= {"scale_factor": np.float64(scale), "add_offset": np.float64(offset), "_FillValue": np.int16(-32768)}
            found[name] = (("time", "latitude", "longitude"), values, more)
        return pd.DataFrame({"t": [key[0]], "content": [classic_bytes(dims, found)]})

    kind = cube.schema["t"].dataType.simpleString()
    return cube.select("t", "j", "i", *variables).groupBy("t").applyInPandas(make, f"t {kind}, content binary")


def save_netcdf(files: DataFrame, folder: str) -> DataFrame:
    """Write the files of ``netcdf_files`` as <t>.nc into a folder that all executors have mounted; returns (t, path, size)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for t, content in zip(batch["t"], batch["content"], strict=True):
                paths.append(f"{folder}/{t}.nc")
                part = f"{paths[-1]}.{uuid.uuid4().hex}"  # a task that runs twice leaves whole files
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, paths[-1])
            yield pd.DataFrame({"t": batch["t"], "path": paths, "size": batch["content"].map(len)})

    kind = files.schema["t"].dataType.simpleString()
    return materialise(files.mapInPandas(write, f"t {kind}, path string, size long"), "netcdf")


def rows_of_netcdf(files: DataFrame, dims: tuple[str, ...] = ("time", "latitude", "longitude"), columns: tuple[str, ...] = ("t", "j", "i"), variables: tuple[str, ...] | None = None) -> DataFrame:
    """As ``read_netcdf``, from a frame with two columns: what names a file, and its content."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                data = ClassicFile(content)
                for name, v in data.variables.items():
                    if tuple(v.dims) != tuple(dims) or v.dtype.kind == "S" or variables is not None and name not in variables:
                        continue
                    for first, values in data.unpacked(name):
                        flat = values.ravel()
                        for s in range(0, len(flat), PART):
                            part = np.arange(s, min(s + PART, len(flat)))
                            places = np.unravel_index(part, values.shape)
                            index = {c: (p + (first if k == 0 else 0)).astype("int32") for k, (c, p) in enumerate(zip(columns, places, strict=True))}
                            yield pd.DataFrame({"file": file, "variable": name, **index, "value": flat[part]})

    named = files.select(F.col(files.columns[0]).cast("string").alias("path"), F.col(files.columns[1]).alias("content"))
    found = named.mapInPandas(rows, f"file string, variable string, {', '.join(f'{c} int' for c in columns)}, value double")
    return found.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_netcdf(spark: SparkSession, path: str, dims: tuple[str, ...] = ("time", "latitude", "longitude"), columns: tuple[str, ...] = ("t", "j", "i"), variables: tuple[str, ...] | None = None) -> DataFrame:
    """(file, variable, indices, value): all values of numeric variables that have exactly these dimensions, in order.

    ``columns`` names the indices.  Packed values are scaled and shifted; fill
    values are NULL.  Variables with other dimensions give no rows.  An HDF5-based
    or foreign file is an error.
    """
    return rows_of_netcdf(spark.read.format("binaryFile").load(path).select("path", "content"), dims, columns, variables)


def netcdf_axes(spark: SparkSession, path: str) -> DataFrame:
    """(file, variable, dim, n, value, units) of variables with one dimension: coordinates of the indices."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                data = ClassicFile(content)
                for name, v in data.variables.items():
                    if len(v.dims) == 1 and v.dtype.kind != "S":
                        for first, values in data.unpacked(name):
                            yield pd.DataFrame({"file": file, "variable": name, "dim": v.dims[0], "n": np.arange(len(values)) + first, "value": values, "units": str(v.attributes.get("units", ""))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, variable string, dim string, n long, value double, units string")


def netcdf_rotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, variable, pole_lat, pole_lon) of grid mappings about a rotated pole."""
    names = ("grid_north_pole_latitude", "grid_north_pole_longitude")  # fixed names of the CF conventions

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for name, v in ClassicFile(content).variables.items():
                    if all(a in v.attributes for a in names):
                        lat, lon = (float(v.attributes[a][0]) for a in names)
                        yield pd.DataFrame({"file": [file], "variable": [name], "pole_lat": [lat], "pole_lon": [lon]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, variable string, pole_lat double, pole_lon double")


def netcdf_cells(spark: SparkSession, path: str, dims: tuple[str, str] = ("rlat", "rlon"), names: tuple[str, str] = ("latitude", "longitude"), cyclic: bool = False) -> DataFrame:
    """Cells of the grid of one file, whose rows and columns are ``dims``.

    With a rotated pole in the file: ``rotated_cells``.  Else (j, i, lat, lon) of a
    curvilinear grid, from the variables ``names`` with both dimensions.  A file
    with several different poles, or with neither a pole nor those variables, is an error.
    """
    poles = netcdf_rotations(spark, path).select("pole_lat", "pole_lon").distinct().limit(2).collect()
    if len(poles) > 1:
        raise ValueError(f"{path} has more than one rotated pole")
    if poles:
        axes = netcdf_axes(spark, path).filter(F.col("dim").isin(*dims) & (F.col("variable") == F.col("dim"))).select("dim", "n", "value").distinct()
        found = {d: [r["value"] for r in axes.filter(F.col("dim") == d).orderBy("n").collect()] for d in dims}  # two axes
        if not all(found.values()):
            raise ValueError(f"{path} has no coordinates {dims}")
        return rotated_cells(spark, found[dims[0]], found[dims[1]], poles[0]["pole_lat"], poles[0]["pole_lon"], cyclic)
    both = read_netcdf(spark, path, dims, ("j", "i"), names).groupBy("j", "i")
    cells = both.agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(c) for n, c in zip(names, ("lat", "lon"), strict=True)])
    if cells.isEmpty():
        raise ValueError(f"{path} has neither a rotated pole nor {names} with dimensions {dims}")
    return cells
