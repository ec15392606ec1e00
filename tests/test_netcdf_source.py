"""The netCDF data source: rows, pushed filters, bytes read, splits, and the committing writer."""

from __future__ import annotations

import numpy as np
import pytest

from gridskein.sources import netcdf, netcdf_source, register_netcdf
from gridskein.sources.netcdf_source import NetcdfReader, NetcdfWriter, RangeFile

from .test_spheres import _classic


def _file(path, t=6, y=20, x=30):
    """Two fields of t x y x x doubles and their coordinates."""
    dims = {"time": t, "latitude": y, "longitude": x}
    u = np.arange(t * y * x, dtype=float).reshape(t, y, x)
    found = {"latitude": (("latitude",), np.arange(y) + 0.5, {"units": "degrees_north"}), "u": (("time", "latitude", "longitude"), u, {}), "v": (("time", "latitude", "longitude"), np.where(u % 7 == 0, np.nan, -u), {})}
    path.write_bytes(netcdf.classic_bytes(dims, found))
    return u


def test_rows_and_filters(spark, tmp_path):
    register_netcdf(spark)
    u = _file(tmp_path / "a.nc")
    rows = spark.read.format("netcdf").load(f"{tmp_path}/*.nc")
    assert rows.count() == 2 * u.size and rows.filter("value IS NULL").count() == len(range(0, u.size, 7))
    some = rows.filter("variable = 'u' AND t >= 2 AND t < 4 AND j = 3")
    assert {(r.t, r.j, r.i): r.value for r in some.collect()} == {(t, 3, i): u[t, 3, i] for t in (2, 3) for i in range(30)}
    assert rows.filter("variable = 'u' AND variable = 'v'").count() == 0 and rows.filter("t > 5").count() == 0 and rows.filter("t = 5 AND variable IN ('v', 'w')").count() == 600
    axes = spark.read.format("netcdf").option("axes", "true").load(str(tmp_path))
    assert [(r.variable, r.dim, r.n, r.value, r.units) for r in axes.orderBy("n").limit(2).collect()] == [("latitude", "latitude", k, k + 0.5, "degrees_north") for k in (0, 1)]


def test_only_bytes_asked_for_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf_source, "HEAD", 1024)
    u = _file(tmp_path / "a.nc", 40)
    reader = NetcdfReader(str(tmp_path), ("time", "latitude", "longitude"), ("t", "j", "i"), False)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    left = list(reader.pushFilters([EqualTo(("variable",), "v"), GreaterThanOrEqual(("t",), 10), LessThan(("t",), 13), EqualTo(("i",), 3)]))
    assert left == [EqualTo(("i",), 3)]
    (part,) = reader.partitions()
    with RangeFile(part.path) as source:
        got = sum(b.num_rows for b in reader.batches(source, part.share, part.of, part.path))
        assert got == 3 * 600 and source.taken == 1024 + 3 * 600 * 8
        assert source.size > 2 * u.size * 8


@pytest.mark.parametrize("version", [1, 2])
def test_records_headers_in_parts_and_splits(spark, tmp_path, monkeypatch, version):
    for name, value in (("SPLIT", 40), ("HEAD", 16), ("PART", 4)):
        monkeypatch.setattr(netcdf_source, name, value)
    (tmp_path / "a.nc").write_bytes(_classic(version))
    reader = NetcdfReader(str(tmp_path), ("time", "y", "x"), ("t", "j", "i"), False)
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 3 and len(rows) == 12
    by = {(r["t"], r["j"], r["i"]): r["value"] for r in rows}
    assert by[0, 0, 0] == 100 and by[1, 0, 2] == 106 and by[1, 1, 1] is None
    axes = NetcdfReader(str(tmp_path), ("time", "y", "x"), ("t", "j", "i"), True)
    assert sorted((r["variable"], r["n"], r["value"]) for p in axes.partitions() for b in axes.read(p) for r in b.to_pylist()) == [("time", 0, 0), ("time", 1, 6), ("y", 0, 10), ("y", 1, 20)]


def test_foreign_files_are_refused(tmp_path):
    (tmp_path / "a.nc").write_bytes(b"\x89HDF" + bytes(100))
    reader = NetcdfReader(str(tmp_path), ("t",), ("t",), False)
    with pytest.raises(ValueError, match="HDF5"):
        list(reader.read(reader.partitions()[0]))


def test_writer_commits_whole_jobs(spark, tmp_path):
    register_netcdf(spark)
    folder = tmp_path / "out"
    files = spark.createDataFrame([(k, bytes([k] * 5)) for k in range(7)], "t int, content binary").repartition(3)
    files.write.format("netcdf").mode("append").save(str(folder))
    assert sorted(p.name for p in folder.iterdir()) == [f"{k}.nc" for k in range(7)] and (folder / "3.nc").read_bytes() == b"\3" * 5
    files.filter("t < 2").write.format("netcdf").mode("overwrite").save(f"file://{folder}")
    assert sorted(p.name for p in folder.iterdir()) == ["0.nc", "1.nc"]
    writer = NetcdfWriter(str(folder), False)
    done = writer.write(iter([{"t": 9, "content": b"x"}]))
    writer.write(iter([{"t": 9, "content": b"y"}]))  # a second attempt whose message is lost
    assert not (folder / "9.nc").exists()
    writer.commit([done, None])
    assert (folder / "9.nc").read_bytes() == b"x" and not (folder / "_temporary").exists()
    writer.write(iter([{"t": 8, "content": b"x"}]))
    writer.abort([])
    assert sorted(p.name for p in folder.iterdir()) == ["0.nc", "1.nc", "9.nc"]
