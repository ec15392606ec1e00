"""Tables whose last slice lacks rows, and tracks with rows at the same time."""

import numpy as np
import pytest

from gridskein.operators import components, tracking
from gridskein.queries import ORACLE_SQL, QUERIES
from gridskein.queries._cube import GRID

from .oracle import DATA, compare, connect
from .test_whole import _groups, _km


def _same(spark, folder, name):
    return compare(connect(folder), QUERIES[name](spark, folder).toPandas(), ORACLE_SQL[name])


@pytest.fixture(scope="module")
def unfinished(spark, tmp_path_factory):
    """A whole slice and 14 rows of the next."""
    folder = str(tmp_path_factory.mktemp("unfinished"))
    spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").filter("vec_id < 64").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["grid_rotated_to_map", "line_smear_lines", "solve_bicgstab", "solve_cg", "solve_multigrid", "sphere_irot_wind", "sphere_regrid", "sphere_sh_synthesis_ilaplace", "sphere_trunc_triangular", "diag_block_indicator"])
def test_unfinished_slice(spark, unfinished, name):
    assert _same(spark, unfinished, name) == ""


def test_track_rows_at_the_same_time(spark, tmp_path):
    rows = [(k, 1704067200 + 3600 * (k // 3), 7, float((k * 7) % 5 * 10)) for k in range(30)]
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").orderBy("value")
    frame.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "'x' AS event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert _same(spark, str(tmp_path), "cyc_trackinfo") == ""


def test_components_need_no_broadcast(spark):
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b").filter("a % 100 <> 99")
    roots = components.connected_components(links)
    assert "Join" not in roots._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in roots.collect():
        found.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [list(range(n, n + 100)) for n in range(0, 400, 100)]


def test_partitions_of_slices_do_not_grow(spark):
    from pyspark.sql import functions as F

    cube = spark.range(3200 * 200).selectExpr("cast(id div 3200 as int) AS t", "cast(id % 3200 div 64 as int) AS j", "cast(id % 64 as int) AS i")
    parts = GRID.slices(cube).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.collect_set("t").alias("ts")).collect()
    assert max(r.n for r in parts) < 3 * 65536 and sum(r.n for r in parts) == 3200 * 200
    assert sum(len(r.ts) for r in parts) == 200


def _events_at(spark, rows):
    return spark.createDataFrame(rows, "event long, s long, lon double, lat double").selectExpr("event", "timestamp_seconds(s) AS date", "lon", "lat")


def test_links_of_events_grow_with_events_and_need_no_broadcast(spark, monkeypatch):
    rng, sent, plans = np.random.default_rng(1), [], []

    def components_(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        sent.append(links.count())
        return components.connected_components(links)

    monkeypatch.setattr(tracking, "connected_components", components_)
    crowd = [(k, 1704067200 + int(rng.integers(0, 80000)), 10.0 + rng.uniform(0, 0.1), 50.0 + rng.uniform(0, 0.1)) for k in range(1500)]
    found = tracking.track_events(_events_at(spark, [*crowd, (5000, 1704067200, 90.0, 0.0)]), None, 24.0, 0.0, 60.0)
    assert {(r.event, r.label) for r in found.collect()} == {*((k, 0) for k in range(1500)), (5000, 1)}
    assert sum(sent) < 5000 and not any("Broadcast" in plan for plan in plans)


def test_linked_events_equal_all_pairs(spark):
    """Places in clusters, across the date line and over a pole, many at the same second; rows without a place or time are alone."""
    rng = np.random.default_rng(5)
    lat = np.r_[rng.normal(0, 1.5, 250), rng.normal(60, 0.7, 250), 90 - rng.uniform(0, 2.0, 100)]
    lon = np.r_[rng.normal(180, 2.5, 250), rng.normal(5, 0.7, 250), rng.uniform(0, 360, 100)]
    s = 1704067200 + 7200 * rng.integers(0, 60, 600)
    near = _km(lat[:, None], lon[:, None], lat, lon) < 60
    pairs = np.argwhere(near & (s[None] > s[:, None]) & (s[None] - s[:, None] <= 86400)).tolist()
    groups = _groups(range(604), pairs)
    rank = {g: k for k, g in enumerate(sorted(set(groups.values())))}
    odd = [(600, None, 5.0, 60.0), (601, 1704067200, None, 60.0), (602, 1704067200, float("nan"), 60.0), (603, 1704067200, 5.0, float("inf"))]
    rows = [*zip(range(600), s.tolist(), lon.tolist(), lat.tolist(), strict=True), *odd]
    found = {r.event: r.label for r in tracking.track_events(_events_at(spark, rows), None, 24.0, 0.0, 60.0).collect()}
    assert found == {e: rank[g] for e, g in groups.items()} and 20 < len(rank) < 400
