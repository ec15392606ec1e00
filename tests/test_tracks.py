"""Tracks in segments of time and as a stream; links of tracks near the equator."""

from __future__ import annotations

import collections
import random

import numpy as np
import pandas as pd
import pytest

from gridskein.operators import meetings, segments
from gridskein.operators import tracking as tk
from gridskein.queries import objects
from gridskein.storage import setting
from gridskein.streaming import ROCKSDB, track_stream

LOWS = "hemis string, t int, j int, i int, kind string, lat double, lon double, msl double, prominence double, lap double"


def _lows(steps=40, seed=0):
    """Lows that wander, begin, end and pause."""
    rng, rows = random.Random(seed), []
    for hemis, sign in (("N", 1), ("S", -1)):
        for k in range(12):
            lat, lon, first = rng.uniform(30, 70), rng.uniform(0, 360), rng.randrange(steps)
            for t in range(first, min(steps, first + rng.choice([1, 3, 9, 30]))):
                lat, lon = lat + rng.uniform(-1.5, 1.5), lon + rng.uniform(0, 3)
                if t not in (11, 24) and rng.random() < 0.95:
                    rows.append((hemis, t, 1000 * k + t, int(lon), rng.choice(["open", "closed"]), sign * lat, lon % 360, 99000 + rng.uniform(-500, 500), 200.0, rng.random()))
    rng.shuffle(rows)
    return rows


def _plain(rows):
    return sorted((r.hemis, r.t, r.place, r.track_id, r.lat, r.closed, tuple(r.x_filter), tuple(r.py_filter)) for r in rows)


def _one_run(rows, config=tk.TRACKING):
    """The same links, a step after the other in plain Python."""
    out = []
    for hemis in ("N", "S"):
        by = collections.defaultdict(list)
        for r in sorted(rows):
            if r[0] == hemis:
                by[r[1]].append(dict(zip([c.split()[0] for c in LOWS.split(", ")], r, strict=True)))
        before, numbers = [], {}
        for t in sorted(by):
            before = tk.link_lows(hemis, t, sorted(by[t], key=lambda r: (r["j"], r["i"])), before if t - 1 in by else [], config)
            out += [{**r, "track_id": numbers.setdefault(r["track_id"], len(numbers))} for r in before]
    return sorted((r["hemis"], r["t"], r["place"], r["track_id"], r["lat"], r["closed"], tuple(r["x_filter"]), tuple(r["py_filter"])) for r in out)


@pytest.mark.parametrize("segment", [64, 7, 1])
def test_segments_give_the_tracks_of_one_run(spark, segment):
    rows = _lows()
    found = tk.track_cyclones(spark.createDataFrame(rows, LOWS).repartition(3), segment=segment).collect()
    assert _plain(found) == _one_run(rows) and len(found) == len(rows)
    assert len({(r.hemis, r.track_id) for r in found}) < len(rows) / 2


def test_no_lows_no_tracks(spark):
    assert tk.track_cyclones(spark.createDataFrame([], LOWS)).count() == 0


def test_segments_run_again_only_where_their_start_differs(spark):
    # A counter that starts anew with every gap.
    rows = spark.createDataFrame([("a", t) for t in range(40) if t != 17] + [("b", 3), ("b", 8)], "g string, t long")
    count = lambda g, t, part, before: [{"g": g, "t": t, "n": before[0]["n"] + 1 if before else 0}]
    found = {(r.g, r.t): r.n for r in segments.in_segments(rows, "g", "t", 5, count, "g string, t long, n long").collect()}
    assert found == {("a", t): t if t < 17 else t - 18 for t in range(40) if t != 17} | {("b", 3): 0, ("b", 8): 0}


def test_blocks_in_segments(spark):
    from gridskein.grid import Grid

    rng, g = random.Random(2), Grid(12, 36)
    rows = [(t, j, i, 35.0 + 3 * j, 10.0 * i, rng.choice([0.0, 0.0, 1.0, 2.0])) for t in range(20) for j in range(12) for i in range(36)]
    cube = spark.createDataFrame(rows, "t int, j int, i int, lat double, lon double, block double")
    runs = [sorted(map(tuple, tk.block_by_grad_rev(g, cube, min_steps=3, segment=n).collect())) for n in (64, 6)]
    assert runs[0] == runs[1] and runs[0]


def test_stream_equals_batch_over_restarts_and_goes_on_from_a_batch(spark, tmp_path):
    rows = _lows(20, 4)
    parts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 6), (6, 13), (13, 20))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda part, to: spark.createDataFrame(part, LOWS).coalesce(1).write.mode("append").parquet(to)

    def run(source, name, tracked=None):
        tracks = track_stream(spark.readStream.schema(spark.createDataFrame([], LOWS).schema).parquet(source), tracked=tracked)
        tracks.writeStream.format("parquet").option("checkpointLocation", f"{out}/{name}-state").trigger(availableNow=True).start(f"{out}/{name}").awaitTermination()
        return spark.read.parquet(f"{out}/{name}").collect()

    with setting(spark, *ROCKSDB):
        for part in parts:
            write(part, source)
            found = run(source, "restarted")  # each time a new query that resumes from the state
        assert _plain(found) == _one_run(rows)
        batch = tk.track_cyclones(spark.createDataFrame(parts[0] + parts[1], LOWS))
        write(parts[2], f"{source}-later")
        later = run(f"{source}-later", "later", batch)
    assert _plain(later) == [r for r in _one_run(rows) if r[1] >= 13]


def test_links_across_the_equator(spark):
    rng = np.random.default_rng(3)
    points = []
    for k in range(40):
        lat, lon = rng.choice([rng.uniform(-3, 3), rng.uniform(-12, 12), rng.uniform(20, 80)]), rng.uniform(0, 360) if k % 2 else rng.uniform(350, 370)
        for t in range(12):
            lat, lon = lat + rng.uniform(-1, 1), lon + rng.uniform(-2, 3)
            points.append((k, "N", 1704067200 + 21600 * (t + k % 5), float(lat), float(lon)))
    points += [(50, "N", 1704067200 + 21600 * t, 0.0, 5.0) for t in range(12)] + [(51, "N", None, 1.0, 1.0), (52, "N", 1704067200, None, 1.0)]
    near = collections.defaultdict(set)
    whole = [p for p in points if None not in p]
    km = lambda a, b: 2 * 6371 * np.arcsin(np.sqrt(np.sin(np.radians(b[3] - a[3]) / 2) ** 2 + np.cos(np.radians(a[3])) * np.cos(np.radians(b[3])) * np.sin(np.radians(b[4] - a[4]) / 2) ** 2))
    radii = lambda a, b: km(a, b) / (0.13 / (2 * 7.29e-5 * np.sin(np.radians(abs(a[3] + b[3]) / 2)))) if a[3] + b[3] else np.inf
    for a in whole:
        for b in whole:
            if a[0] != b[0] and abs(a[2] - b[2]) <= 36 * 3600 and radii(a, b) <= 1:
                near[a[0], b[0]].add(a)
    ends = {ab: (min(p, key=lambda x: x[2:]), max(p, key=lambda x: x[2:])) for ab, p in near.items() if len(p) > 1}
    want = {}
    for a, b in ends:
        if a < b and (b, a) in ends:
            two = [ends[a, b], ends[b, a]]
            ways = [radii(*e) for e in two if e[0][3] + e[1][3]]
            link = (len(ways) == 2 and sum(ways) / 2 >= 1.5) + 2 * (sum(e[1][2] - e[0][2] for e in two) / 7200 >= 48)
            if link:
                want[a, b] = link
    frame = spark.createDataFrame(points, "id long, hemis string, s long, lat double, lon double").selectExpr("id", "hemis", "timestamp_seconds(s) AS ts", "lat", "lon")
    assert {(r.a, r.b): r.link for r in tk.connect_cyclones(frame).collect()} == want and len(want) > 20


def _wandering(tracks=60, points=40, seed=8):
    rng, rows = np.random.default_rng(seed), []
    for k in range(tracks):
        lat, lon, s = rng.uniform(20, 70), rng.uniform(0, 120), 1704067200 + int(rng.integers(0, 40)) * 86400
        for _ in range(points):
            lat, lon, s = float(np.clip(lat + rng.uniform(-1, 1), -80, 80)), lon + rng.uniform(-1, 3), s + int(rng.integers(1, 6)) * 3600
            rows.append((k, "NS"[k % 5 == 0], s, lat if k % 5 else -lat, lon % 360))
    return rows


def test_parts_of_any_size_give_the_same_links(spark, monkeypatch):
    frame = spark.createDataFrame(_wandering(), "id long, hemis string, s long, lat double, lon double").selectExpr("id", "hemis", "timestamp_seconds(s) AS ts", "lat", "lon")
    found = []
    for tracks in (1000, 7, 1):
        monkeypatch.setattr(tk, "_TRACKS", tracks)
        monkeypatch.setattr(tk, "_PARTS", 1)
        found.append(sorted(map(tuple, tk.connect_cyclones(frame).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    clusters = lambda links: sorted(map(tuple, tk.cyclone_clusters(frame, links, (1, 3)).collect()))
    few = tk.connect_cyclones(frame, connecting=(1, 3))
    assert set(map(tuple, few.collect())) <= set(found[0])
    assert clusters(few) == clusters(spark.createDataFrame(found[0], "a long, b long, link int"))


def test_connected_parts_are_not_sent_again(spark, monkeypatch):
    """Links found in rounds connect what all links do, and no more are found than that takes."""
    monkeypatch.setattr(tk, "_TRACKS", 2)
    monkeypatch.setattr(tk, "_PARTS", 1)
    monkeypatch.setattr(tk, "_MEETINGS", 0, raising=False)
    together = [(k, "N", 1704067200 + 21600 * t, 45.0, 0.3 * k + t * 0.8) for k in range(20) for t in range(40)]
    apart = [(k + 20, "N", s, lat, lon + 180) for k, _, s, lat, lon in together[:120]]
    frame = spark.createDataFrame(together + apart, "id long, hemis string, s long, lat double, lon double").selectExpr("id", "hemis", "timestamp_seconds(s) AS ts", "lat", "lon")
    few = tk.connect_cyclones(frame, connecting=(1, 3)).persist()
    assert few.count() == 19 + 2
    clusters = {r.id: r.cluster for r in tk.cyclone_clusters(frame, few, (1, 3)).collect()}
    assert clusters == {k: 0 if k < 20 else 20 for k in range(23)}


def test_tracks_that_stay_together_are_not_compared_point_by_point(monkeypatch):
    """Work grows with the pairs of tracks, not with those of their points."""
    s = np.arange(2000) * 3600
    rows = pd.DataFrame({"id": np.arange(20), "s": [s] * 20, "lat": [np.full(2000, 45.0)] * 20, "lon": [s / 86400 * 0.5 + 0.1 * k for k in range(20)]})
    compared, radii = [], meetings._radii
    monkeypatch.setattr(meetings, "_radii", lambda a, k, b, m: compared.append(len(k)) or radii(a, k, b, m))
    links = meetings.links_between(rows, rows, True, meetings.Limits(129600, 1.0), 1.5, 48.0, None)
    assert len(links) == 190 and set(links["link"]) == {3} and sum(compared) < 10 * 190
    assert len(meetings.links_between(rows, rows, True, meetings.Limits(129600, 1.0), 1.5, 48.0, (3,))) == 19


def test_lows_of_a_step_are_linked_at_once(monkeypatch):
    """Distances of all lows and tracks in one call; states are those of one step of the filter after the other."""
    calls, distance = [], tk.distance_km
    monkeypatch.setattr(tk, "distance_km", lambda *a: calls.append(1) or distance(*a))
    rng, before = np.random.default_rng(6), []
    for t in range(4):
        lows = [{"kind": "open", "lat": 30 + 4.0 * (k % 10) + rng.uniform(-1, 1), "lon": 20.0 * (k // 10) + rng.uniform(-1, 1), "msl": 99000 + rng.uniform(-200, 200), "prominence": 1.0, "lap": 1.0} for k in range(150)]
        rows = tk.link_lows("N", t, lows, before)
        assert len(calls) <= t + 1
        by = {r["track_id"]: r for r in before}
        for r, low in zip(rows, lows, strict=True):
            old = by.get(r["track_id"])
            for a, z in zip("xy", tk.polar_xy(low["lat"], low["lon"], "N"), strict=True):
                start = (np.array(old[f"{a}_filter"]), np.array(old[f"p{a}_filter"]).reshape(2, 2)) if old else (np.array([z, 0.0]), np.diag(tk.TRACKING.first_variance))
                x, p = tk.kalman_step(*start, z)
                assert np.allclose(x, r[f"{a}_filter"], rtol=1e-12) and np.allclose(p.ravel(), r[f"p{a}_filter"], rtol=1e-12)
        assert not t or len(by.keys() & {r["track_id"] for r in rows}) > 50
        before = rows
    assert tk.link_lows("N", 4, [], before) == [] and len(tk.link_lows("N", 4, lows, [])) == 150


def test_the_streams_state_does_not_grow_with_the_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(objects, "shared_dir", lambda s: f"file://{tmp_path}")
    with setting(spark, "spark.sql.shuffle.partitions", "24"):
        rows = objects.QUERIES["stream_track_cyclones"](spark, "/root/testdata/sf0.01").count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    stores = [p for p in tmp_path.glob("gridskein/stream-*/state/state/0/*") if p.name.isdigit()]
    assert rows and 1 < len(stores) <= 8
