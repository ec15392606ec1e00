"""Queries read their whole tables."""

import collections

import numpy as np
import pandas as pd
import pytest

from gridskein.queries import QUERIES

from .oracle import DATA

SF = f"{DATA}/sf0.001"
FEATURES = "line_jetaxis line_jetaxis_ff_thres line_frontline_at_maxcurv line_frontline_at_maxgrad line_convline line_vorline line_defline cyc_cyclone_by_contour cyc_precip_blobs cyc_attribute_to_features".split()


@pytest.mark.parametrize("name", FEATURES)
def test_features_of_all_slices(spark, name):
    assert {r.t for r in QUERIES[name](spark, SF).select("t").distinct().collect()} == set(range(10))


def _places():
    """Event ids, users, seconds, longitudes and latitudes of all events, as the queries place them."""
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values("event_id")
    s = e["ts"].astype("datetime64[us]").astype("int64").to_numpy() // 1_000_000
    user = e["user_id"].to_numpy()
    return e["event_id"].to_numpy(), user, s, (user * 7.0 + s / 86400) % 360, user % 60 + e["value"].astype(float).to_numpy() / 100


def _km(lat, lon, lats, lons):
    a, b = np.radians(lat), np.radians(lats)
    return 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lons - lon) / 2) ** 2)))


def _groups(nodes, pairs):
    """{node: least node of its component}."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_all_events_are_tracked(spark):
    event, user, s, lon, lat = _places()
    pairs = [(event[k], event[n]) for k in range(len(event)) for n in np.flatnonzero((s > s[k]) & (s - s[k] <= 86400) & (_km(lat[k], lon[k], lat, lon) < 60))]
    groups = _groups(event.tolist(), pairs)
    rank = {g: k for k, g in enumerate(sorted(set(groups.values())))}
    assert user.max() >= 12 and len(rank) < len(event)
    assert {r.event: r.label for r in QUERIES["event_track_events"](spark, SF).collect()} == {e: rank[g] for e, g in groups.items()}


def test_all_cyclones_are_linked(spark, tmp_path):
    rows = [(60 * u + k, 1704067200 + 3600 * (6 * k + u), u, float(10 * (k % 3))) for u in (1, 2, 41, 53, 104) for k in range(30)]
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    frame.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "'x' AS event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    event, s, user, value = map(np.array, zip(*rows, strict=True))
    lon, lat = (user * 7.0 + s / 86400) % 360, 40 + (user % 60 + value / 100) / 4
    radius = lambda x: 0.13 / (2 * 7.29e-5 * np.sin(np.radians(np.abs(x))))
    near = collections.defaultdict(set)
    for k in range(len(rows)):
        for n in np.flatnonzero((user != user[k]) & (np.abs(s - s[k]) <= 129600) & (_km(lat[k], lon[k], lat, lon) / radius((lat[k] + lat) / 2) <= 1)):
            near[int(user[k]), int(user[n])].add((int(s[k]), lat[k], lon[k]))
    ends = {ab: (min(p), max(p)) for ab, p in near.items() if len(p) >= 2}
    way = {ab: float(_km(*x[1:], *y[1:]) / radius((x[1] + y[1]) / 2)) for ab, (x, y) in ends.items()}
    both = [(a, b) for a, b in ends if a < b and (b, a) in ends]
    want = {(a, b): (way[a, b] + way[b, a] >= 3) + 2 * (sum(ends[x][1][0] - ends[x][0][0] for x in ((a, b), (b, a))) >= 2 * 48 * 3600) for a, b in both}
    want = {ab: link for ab, link in want.items() if link}
    assert {(r.a, r.b): r.link for r in QUERIES["cyc_connect_cyclones"](spark, str(tmp_path)).collect()} == want
    assert any(b >= 40 for _, b in want)
    clusters = _groups(sorted(set(user.tolist())), [ab for ab, link in want.items() if link in (1, 3)])
    assert {r.id: r.cluster for r in QUERIES["cyc_cyclone_clusters"](spark, str(tmp_path)).collect()} == clusters


def test_tiles_miss_no_near_pair(spark):
    """Near the poles, the date line and anywhere else."""
    from pyspark.sql import functions as F

    from gridskein.functions.sphere_geometry import haversine, tile_of, tiles_near

    rng = np.random.default_rng(0)
    lat = np.r_[rng.uniform(-90, 90, 300), 90, -90, 89.9, -89.95, rng.uniform(88, 90, 60), rng.uniform(-2, 2, 200)]
    lon = np.r_[rng.uniform(-180, 360, 564 - 200), rng.uniform(-3, 3, 200)]
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(lat)), "lat": lat, "lon": lon}))
    for km in (60.0, 300.0, 2500.0):
        a = points.select(F.col("id").alias("a"), F.col("lat").alias("y"), F.col("lon").alias("x"), tile_of("lon", "lat", km).alias("k"))
        b = points.select(F.col("id").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"), F.explode(tiles_near("lon", "lat", km)).alias("k"))
        found = {(r.a, r.b) for r in a.join(b, "k").filter(haversine("x", "y", "x2", "y2") < km).select("a", "b").collect()}
        assert found == {(k, int(n)) for k in range(len(lat)) for n in np.flatnonzero(_km(lat[k], lon[k], lat, lon) < km)}
