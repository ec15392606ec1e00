"""Classic netCDF files as a Spark data source: ``spark.read.format("netcdf")`` and ``df.write.format("netcdf")``.

    register_netcdf(spark)
    fields = spark.read.format("netcdf").load("s3://bucket/era/*.nc")
    fields.filter("variable = 'u' AND t BETWEEN 10 AND 20")

Rows are (file, variable, indices, value), or with option ``axes`` true the
coordinates (file, variable, dim, n, value, units).  Filters on the variable and
on the first index are pushed down; a task reads a file's header and then only the
bytes of the records that are asked for, so no file is held whole and none is too
large.  Large files are split among tasks by their size; a task takes its share of
the pieces that the header names.  Paths are those that pyarrow's file systems
know (local, S3, GCS, HDFS); a name's last part may have * and ?.

The writer takes the frames of ``netcdf_files`` (t, content), writes each file
under a temporary name and puts all in place when the job commits; a task that
fails or runs twice leaves nothing behind.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .netcdf import PART, ClassicFile, unpacked

#: Bytes of a file for each task.
SPLIT = 32 << 20
#: Bytes that are read of a file at first, for its header.
HEAD = 16 << 10
_AXES = "file string, variable string, dim string, n long, value double, units string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """``file:/x`` as ``file:///x``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def files_at(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, a folder or a pattern names, by name; hidden and temporary ones are left out."""
    system, inner = _open(_uri(path))
    prefix = _uri(path)[: len(_uri(path)) - len(inner)]
    folder, pattern = posixpath.split(inner.rstrip("/"))
    if not set("*?[") & set(pattern):
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.File:
            return [(prefix + info.path, info.size)]
        folder, pattern = inner, "*"
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=False))
    keep = [f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"]
    return sorted((prefix + f.path, f.size) for f in keep)


class RangeFile:
    """A file that is read by ranges; ``taken`` counts the bytes."""

    def __init__(self, path: str):
        system, inner = _open(path)
        self.source, self.taken = system.open_input_file(inner), 0
        self.size = self.source.size()

    def read(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        out = self.source.read(n)
        self.taken += len(out)
        return out

    def header(self) -> ClassicFile:
        """The header, from as much of the file's beginning as it needs."""
        n, content = min(HEAD, self.size), b""
        while True:
            content += self.read(len(content), n - len(content))
            try:
                return ClassicFile(content, self.size)
            except EOFError:
                if n >= self.size:
                    raise
                n = min(4 * n, self.size)

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *error: object) -> None:
        self.source.close()


@dataclass
class Piece(InputPartition):
    """Every ``of``-th piece of a file, from ``share``."""

    path: str
    share: int
    of: int


class NetcdfReader(DataSourceReader):
    """Reads the values of one layout of dimensions, or the coordinates."""

    def __init__(self, path: str, dims: tuple[str, ...], columns: tuple[str, ...], axes: bool):
        self.path, self.dims, self.columns, self.axes = path, dims, columns, axes
        self.variables: set[str] | None = None
        self.first, self.last = -(2**63), 2**63 - 1  # of the first index

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equality with variables and bounds of the first index; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "variable" and isinstance(f, (EqualTo, In)):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.variables = these if self.variables is None else self.variables & these
            elif not self.axes and name == self.columns[0] and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif not self.axes and name == self.columns[0] and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif not self.axes and name == self.columns[0] and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        """By files and their sizes alone: no header is read for planning."""
        of = lambda size: 1 if self.axes else max(1, -(-size // SPLIT))
        return [Piece(path, k, of(size)) for path, size in files_at(self.path) for k in range(of(size))]

    def pieces(self, data: ClassicFile) -> Iterator[tuple[str, int, int, int]]:
        """(variable, record, first value, stop) of at most PART values each, of what is asked for."""
        for name, v in data.variables.items():
            fits = len(v.dims) == 1 if self.axes else tuple(v.dims) == self.dims
            if not fits or v.dtype.kind == "S" or self.variables is not None and name not in self.variables:
                continue
            n = int(np.prod(v.shape, dtype=np.int64))
            low, high, row = 0, n, n
            if not self.axes and not v.grows:  # the first index lies within
                row = n // max(1, v.shape[0])
                low, high = max(0, self.first) * row, min(v.shape[0] - 1, self.last) * row + row
            records = range(max(0, self.first), min(data.records - 1, self.last) + 1) if v.grows and not self.axes else range(data.records if v.grows else 1)
            for k in records:
                yield from ((name, k, at, min(at + PART, high)) for at in range(low, high, PART))

    def batches(self, source: RangeFile, share: int, of: int, path: str) -> Iterator[pa.RecordBatch]:
        data = source.header()
        for number, (name, record, begin, stop) in enumerate(self.pieces(data)):
            if number % of != share:
                continue
            v = data.variables[name]
            raw = source.read(v.begin + record * data.stride * v.grows + begin * v.dtype.itemsize, (stop - begin) * v.dtype.itemsize)
            values = unpacked(np.frombuffer(raw, v.dtype), v.attributes)
            n, at = len(values), np.arange(begin, stop)
            value = pa.array(values, mask=np.isnan(values))
            constant = lambda text: pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [text]).cast(pa.string())  # noqa: B023, E731
            if self.axes:
                columns = {"file": constant(path), "variable": constant(name), "dim": constant(v.dims[0]), "n": pa.array(at + record), "value": value, "units": constant(str(v.attributes.get("units", "")))}
            else:
                shape = (1, *v.shape) if v.grows else v.shape
                places = np.unravel_index(at, shape)
                index = {c: pa.array((p + (record if k == 0 else 0)).astype(np.int32)) for k, (c, p) in enumerate(zip(self.columns, places, strict=True))}
                columns = {"file": constant(path), "variable": constant(name), **index, "value": value}
            yield pa.RecordBatch.from_pydict(columns)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        with RangeFile(partition.path) as source:
            yield from self.batches(source, partition.share, partition.of, partition.path)


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final paths of a task's files."""

    files: list[tuple[str, str]]


class NetcdfWriter(DataSourceWriter):
    """Writes (t, content) as <t>.nc; what is in the folder goes with ``overwrite``."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _uri(path).rstrip("/"), overwrite

    def write(self, iterator: Iterator) -> Written:
        system, folder = _open(self.path)
        hidden = f"{folder}/_temporary"
        system.create_dir(hidden, recursive=True)
        files = []
        for row in iterator:
            name = f"{row['t']}.nc"
            files.append((f"{hidden}/{uuid.uuid4().hex}-{name}", f"{folder}/{name}"))
            with system.open_output_stream(files[-1][0]) as out:
                out.write(row["content"])
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for path, _ in files_at(self.path):
                system.delete_file(_open(path)[1])
        for before, after in (f for m in messages if m for f in m.files):
            system.move(before, after)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = _open(self.path)
        if system.get_file_info(f"{folder}/_temporary").type == pafs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")


class NetcdfSource(DataSource):
    """Options: path; dims and columns (comma-separated: the layout that is read, and the names of its indices); axes."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _listed(self, key: str, default: str) -> tuple[str, ...]:
        return tuple(x.strip() for x in self.options.get(key, default).split(","))

    def _axes(self) -> bool:
        return self.options.get("axes", "false").lower() == "true"

    def schema(self) -> str:
        if self._axes():
            return _AXES
        return f"file string, variable string, {', '.join(f'{c} int' for c in self._listed('columns', 't,j,i'))}, value double"

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options["path"], self._listed("dims", "time,latitude,longitude"), self._listed("columns", "t,j,i"), self._axes())

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options["path"], overwrite)


def register_netcdf(spark: SparkSession) -> None:
    """Make the format ``netcdf`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)
