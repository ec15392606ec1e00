"""Tracking of features in time: lows, events, blocks, and clusters of tracks."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sphere_geometry import direction_on_sphere, dist_sphere, haversine, rossby_radius
from ..grid import Grid
from ..storage import materialise
from .components import connected_components
from .derivatives import ddx, ddy, lap2
from .kernels import distance_km
from .meetings import Limits, links_between
from .ranks import ranked
from .segments import in_segments


@dataclass(frozen=True)
class TrackConfig:
    """Limits of the low tracker (fixed values by default)."""

    lap_closed: float = 2.0e-9
    lap_open: float = 6.0e-9
    prominence_closed: float = 150.0
    prominence_open: float = 25.0
    min_distance: float = 750.0e3
    match_distance: float = 500.0e3
    track_distance: float = 500.0e3
    max_oro: float = 1000.0
    dp_per_dist: float = 0.003
    step_seconds: float = 10800.0
    noise: float = 90.0e3**2
    drift: float = 25.0
    first_variance: tuple[float, float] = (1.0e6, 100.0)


TRACKING = TrackConfig()


def _extreme(g: Grid, value: str, least: bool) -> Column:
    """Is a cell the least (greatest) of its 3 x 3 box? The column's neighbours must be there."""
    near = [F.col(f"{value}_{d}") for d in ("e", "w", "n", "s", "ne", "nw", "se", "sw")]
    return F.coalesce(F.col(value) < F.least(*near) if least else F.col(value) > F.greatest(*near), F.lit(False))


def locate_cyclones(g: Grid, cube: DataFrame, msl: str, oro: str, config: TrackConfig = TRACKING) -> DataFrame:
    """(t, hemis, kind, j, i, lat, lon, msl, prominence, lap, grad): closed and open lows.

    Greatest Laplacians and least pressures that are each other's nearest within
    the matching distance make closed lows; Laplacians left over match least
    gradients to open ones.  Of lows nearer than the least distance the one with
    the smaller Laplacian goes.
    """
    cube = cube.withColumns({"__lap": 4 * lap2(g, msl), "__gx": ddx(g, msl), "__gy": ddy(g, msl)})
    cube = cube.withColumn("__grad", F.sqrt(F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy")))
    box = F.avg(F.col(msl)).over(g.along_y.rowsBetween(-3, 3))
    cube = g.neighbours(cube.withColumn("__mean", box), "__lap", "__grad", msl)
    low = cube.filter((F.col(oro) <= config.max_oro) & F.col("__lap").isNotNull() & F.col("__grad").isNotNull())
    sides = low.select("t", "j", "i", "lat", "lon", F.when(F.col("lat") >= 0, "N").otherwise("S").alias("hemis"), F.col(msl).alias("msl"), (F.col("__mean") - F.col(msl)).alias("prominence"), F.col("__lap").alias("lap"), F.col("__grad").alias("grad"),
        _extreme(g, "__lap", False).alias("is_lap"), _extreme(g, msl, True).alias("is_low"), _extreme(g, "__grad", True).alias("is_flat"))
    sides = materialise(sides.filter("is_lap OR is_low OR is_flat"), "extremes")  # few of the cells, used several times
    laps = sides.filter((F.col("is_lap")) & (F.col("lap") >= config.lap_closed))
    lows, flats = sides.filter("is_low"), sides.filter("is_flat AND NOT is_low")
    closed = mutual_nearest(laps, lows, ["t", "hemis"], config.match_distance)
    closed = closed.filter((F.col("b.prominence") > config.prominence_closed))
    rest = laps.join(closed.select("t", "hemis", F.col("a.j").alias("j"), F.col("a.i").alias("i")), ["t", "hemis", "j", "i"], "left_anti")
    open_ = mutual_nearest(rest.filter(F.col("lap") >= config.lap_open), flats, ["t", "hemis"], config.match_distance).filter(F.col("b.prominence") >= config.prominence_open)
    columns = ["t", "hemis", F.col("b.j").alias("j"), F.col("b.i").alias("i"), F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"), F.col("b.msl").alias("msl"), F.col("b.prominence").alias("prominence"), F.col("a.lap").alias("lap"), F.col("b.grad").alias("grad")]
    found = closed.select(F.lit("closed").alias("kind"), *columns).unionByName(open_.select(F.lit("open").alias("kind"), *columns))
    return suppress_near(materialise(found, "lows"), ["t", "hemis"], config.min_distance)


def mutual_nearest(a: DataFrame, b: DataFrame, by: list[str], within: float) -> DataFrame:
    """(keys, a, b, d): pairs (as structs) of rows of two frames with lat and lon that are each other's nearest, closer than ``within`` metres.

    Points meet by bands of latitude of that height, so only near ones are paired.
    """
    band = within / 111111.0
    left = a.select(*by, F.struct(*[c for c in a.columns if c not in by]).alias("a"), F.floor(F.col("lat") / band).alias("__b"))
    right = b.select(*by, F.struct(*[c for c in b.columns if c not in by]).alias("b"), F.floor(F.col("lat") / band).alias("__b"))
    right = right.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    pairs = left.join(right, [*by, "__b"]).drop("__b").withColumn("d", dist_sphere("a.lon", "a.lat", "b.lon", "b.lat")).filter(F.col("d") < within)
    place = lambda s: F.struct(f"{s}.j", f"{s}.i")
    one = F.row_number().over(Window.partitionBy(*by, place("a")).orderBy("d", place("b")))
    two = F.row_number().over(Window.partitionBy(*by, place("b")).orderBy("d", place("a")))
    return pairs.withColumns({"__1": one, "__2": two}).filter("__1 = 1 AND __2 = 1").drop("__1", "__2")


def suppress_near(lows: DataFrame, by: list[str], within: float) -> DataFrame:
    """Lows without one of larger Laplacian nearer than ``within`` metres."""
    band = within / 111111.0
    here = lows.withColumn("__b", F.floor(F.col("lat") / band))
    other = lows.select(*by, F.struct("lat", "lon", "lap", "j", "i").alias("o"), F.floor(F.col("lat") / band).alias("__b"))
    other = other.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    stronger = (F.col("o.lap") > F.col("lap")) | (F.col("o.lap") == F.col("lap")) & (F.struct("o.j", "o.i") < F.struct("j", "i"))
    lost = here.join(other, [*by, "__b"]).filter(stronger & (dist_sphere("lon", "lat", "o.lon", "o.lat") < within))
    return lows.join(lost.select(*by, "j", "i").distinct(), [*by, "j", "i"], "left_anti").select(*lows.columns)


def kalman_step(x: np.ndarray, p: np.ndarray, z: float, config: TrackConfig = TRACKING) -> tuple[np.ndarray, np.ndarray]:
    """State (place, speed) and covariance after a step of constant speed and a measured place."""
    dt = config.step_seconds
    a = np.array([[1.0, dt], [0.0, 1.0]])
    q = config.drift * np.array([[dt * dt, dt], [dt, 1.0]])
    x, p = a @ x, a @ p @ a.T + q
    gain = p[:, 0] / (p[0, 0] + config.noise)
    return x + gain * (z - x[0]), p - np.outer(gain, p[0])


def kalman_steps(x: np.ndarray, p: np.ndarray, z: np.ndarray, config: TrackConfig = TRACKING) -> tuple[np.ndarray, np.ndarray]:
    """``kalman_step`` of many states (n, 2), covariances (n, 2, 2) and places at once."""
    dt = config.step_seconds
    a = np.array([[1.0, dt], [0.0, 1.0]])
    x = np.stack([x[:, 0] + dt * x[:, 1], x[:, 1]], axis=1)
    p = a @ p @ a.T + config.drift * np.array([[dt * dt, dt], [dt, 1.0]])
    gain = p[:, :, 0] / (p[:, 0, 0] + config.noise)[:, None]
    return x + gain * (z - x[:, 0])[:, None], p - gain[:, :, None] * p[:, :1, :]


def rts_step(x, p, later_x, later_p, config: TrackConfig = TRACKING):
    """State and covariance smoothed with those of the step after."""
    dt = config.step_seconds
    a = np.array([[1.0, dt], [0.0, 1.0]])
    predicted = a @ p @ a.T + config.drift * np.array([[dt * dt, dt], [dt, 1.0]])
    c = p @ a.T @ np.linalg.inv(predicted)
    return x + c @ (later_x - a @ x), p + c @ (later_p - predicted) @ c.T


def polar_xy(lat, lon, hemis: str, radius: float = 6.37e6):
    """Stereographic coordinates about a pole (sphere)."""
    sign = 1.0 if hemis == "N" else -1.0
    r = 2 * radius * np.tan(np.pi / 4 - np.radians(np.asarray(lat) * sign) / 2)
    return r * np.cos(np.radians(lon)), r * np.sin(np.radians(lon))


def polar_latlon(x, y, hemis: str, radius: float = 6.37e6):
    """The inverse of ``polar_xy``: (lat, lon)."""
    sign = 1.0 if hemis == "N" else -1.0
    return sign * np.degrees(np.pi / 2 - 2 * np.arctan2(np.hypot(x, y), 2 * radius)), np.degrees(np.arctan2(y, x)) % 360


#: Lows of a step that can be told apart in the key of a track.
_BORN = 1 << 20
TRACK_SCHEMA = "track_id long, hemis string, t long, lat double, lon double, msl double, lap double, prominence double, closed boolean, x_filter array<double>, px_filter array<double>, y_filter array<double>, py_filter array<double>, place int"


def link_lows(hemis: str, t: int, lows: list[dict], before: list[dict], config: TrackConfig = TRACKING) -> list[dict]:
    """The lows of a step in rows of TRACK_SCHEMA, linked to those of the step ``before``.

    A low and a track that are each other's nearest (by place and pressure, from
    where the filter expects the track) belong together; other lows begin tracks,
    whose id is the step and the low's place in it.
    """
    c = config
    lat, lon, msl = (np.array([low[k] for low in lows], float) for k in ("lat", "lon", "msl"))
    states = {}
    for a, z in zip("xy", polar_xy(lat, lon, hemis), strict=True):
        x, p = (np.array([old[f"{k}{a}_filter"] for old in before], float) for k in ("", "p"))
        states[a] = z, x.reshape(-1, 2), p.reshape(-1, 2, 2)
    ahead = [x[:, 0] + x[:, 1] * c.step_seconds for _, x, _ in states.values()]
    old_lat, old_lon = polar_latlon(*ahead, hemis)
    d = 1000 * distance_km(old_lat[:, None], old_lon[:, None], lat, lon)
    pressure = (msl - np.array([old["msl"] for old in before], float)[:, None]) / c.dp_per_dist
    n, m = np.nonzero(d < c.track_distance)
    cost = np.hypot(d[n, m], pressure[n, m])
    order = np.lexsort((m, n, cost))
    n, m = n[order], m[order]
    nearest_old, nearest_new = np.full(len(before), -1), np.full(len(lows), -1)
    nearest_old[n[::-1]], nearest_new[m[::-1]] = m[::-1], n[::-1]  # the last one written is the nearest
    mine = np.flatnonzero(nearest_new >= 0)
    mine = mine[nearest_old[nearest_new[mine]] == mine]
    kept = np.full(len(lows), -1)
    kept[mine] = nearest_new[mine]
    filters = {}
    for a, (z, x, p) in states.items():
        start_x, start_p = np.stack([z, np.zeros(len(z))], axis=1), np.tile(np.diag(c.first_variance), (len(z), 1, 1))
        start_x[mine], start_p[mine] = x[kept[mine]], p[kept[mine]]
        x, p = kalman_steps(start_x, start_p, z, c)
        filters[a] = x.tolist(), p.reshape(-1, 4).tolist()
    out = []
    for k, low in enumerate(lows):
        row = {"track_id": before[kept[k]]["track_id"] if kept[k] >= 0 else t * _BORN + k, "hemis": hemis, "t": t, "closed": low["kind"] == "closed", "place": k}
        row |= {c: low[c] for c in ("lat", "lon", "msl", "lap", "prominence")}
        row |= {f"{p}{a}_filter": v[k] for a, own in filters.items() for p, v in zip(("", "p"), own, strict=True)}
        out.append(row)
    return out


def track_cyclones(lows: DataFrame, config: TrackConfig = TRACKING, segment: int = 64) -> DataFrame:
    """Tracks of located lows, in rows of TRACK_SCHEMA; tracks of a hemisphere are numbered in order of their first lows.

    Linking goes through time.  Segments of ``segment`` steps are linked side by
    side and again from the seams until they agree (``in_segments``), so tasks grow
    in number with the time, not in size; the result is that of one run.
    """
    sorted_before = lambda rows: sorted(rows, key=lambda r: r["place"])
    linked = in_segments(lows, "hemis", "t", segment, lambda hemis, t, part, old: link_lows(hemis, t, part, sorted_before(old), config), TRACK_SCHEMA, ("j", "i"))
    born = linked.filter((F.col("t") == F.floor(F.col("track_id") / _BORN)) & (F.col("place") == F.pmod("track_id", F.lit(_BORN)))).select("hemis", "track_id")
    numbers = ranked(born, "track_id", within=("hemis",), name="number")
    return linked.join(numbers, ["hemis", "track_id"]).withColumn("track_id", F.col("number")).select(*[c.split()[0] for c in TRACK_SCHEMA.split(", ")])


def smooth_tracks(tracks: DataFrame, config: TrackConfig = TRACKING) -> DataFrame:
    """Adds lat_s, lon_s (smoothed places), segment_len (m), movement_speed (m/s) and movement_direction (degrees) at the later end of each segment."""
    names = ["track_id", "hemis", "t", "lat_s", "lon_s"]

    def apply(rows):
        rows, out = rows.sort_values("t"), {}
        for a in "xy":
            xs = [np.array(x) for x in rows[f"{a}_filter"]]
            ps = [np.array(p).reshape(2, 2) for p in rows[f"p{a}_filter"]]
            for k in range(len(xs) - 2, -1, -1):
                xs[k], ps[k] = rts_step(xs[k], ps[k], xs[k + 1], ps[k + 1], config)
            out[a] = np.array([x[0] for x in xs])
        lat, lon = polar_latlon(out["x"], out["y"], rows["hemis"].iloc[0])
        return pd.DataFrame({"track_id": rows["track_id"], "hemis": rows["hemis"], "t": rows["t"], "lat_s": lat, "lon_s": lon})[names]

    smoothed = tracks.groupBy("hemis", "track_id").applyInPandas(apply, "track_id long, hemis string, t long, lat_s double, lon_s double")
    w = Window.partitionBy("hemis", "track_id").orderBy("t")
    joined = tracks.join(smoothed, ["hemis", "track_id", "t"]).withColumns({"__lat": F.lag("lat_s").over(w), "__lon": F.lag("lon_s").over(w)})
    length = dist_sphere("__lon", "__lat", "lon_s", "lat_s")
    moved = {"segment_len": length, "movement_speed": length / config.step_seconds, "movement_direction": F.degrees(direction_on_sphere("__lon", "__lat", "lon_s", "lat_s"))}
    return joined.withColumns(moved).drop("__lat", "__lon")


def aggregate_trackinfo(tracks: DataFrame, step_hours: float, by: tuple[str, ...] = ("hemis", "track_id")) -> DataFrame:
    """Per track: lifetime (h), distances (m), whether ever closed, genesis, lysis, and where pressure was least and Laplacian and prominence greatest.

    Rows at the same time are taken in order of lat and lon.
    """
    w = Window.partitionBy(*by).orderBy("t", "lat", "lon")
    timed = F.when(F.col("t").isNotNull(), F.struct("t", "lat", "lon"))
    last = [-F.col(c) for c in ("t", "lat", "lon")]
    steps = tracks.withColumn("__d", dist_sphere(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"))
    at = lambda c, f, name: [f(x, c).alias(f"{x if x != 't' else 'date'}_{name}") for x in ("t", "lon", "lat")]
    found = steps.groupBy(*by).agg(
        ((F.max("t") - F.min("t")) * step_hours).cast("double").alias("lifetime"), F.sum("__d").alias("distance_traveled"), F.max("closed").alias("closed"),
        *at(timed, F.min_by, "genesis"), *at(timed, F.max_by, "lysis"),
        F.max("lap").alias("msl_maxlap"), *at(F.struct("lap", *last), F.max_by, "maxlap"), F.min("msl").alias("msl_min"), *at(F.struct("msl", "t", "lat", "lon"), F.min_by, "mslmin"), F.max("prominence").alias("msl_maxprom"), *at(F.struct("prominence", *last), F.max_by, "maxprom"),
    )
    first_last = dist_sphere("lon_genesis", "lat_genesis", "lon_lysis", "lat_lysis")
    return found.withColumns({"distance_traveled": F.coalesce("distance_traveled", F.lit(0.0)), "distance_firstlast": first_last})


def filter_tracks(info: DataFrame, last_step: int, min_hours: float = 24.0, min_distance: float = 500.0e3) -> DataFrame:
    """Adds keep (long, far and once closed) and unfinished (alive at the last step)."""
    good = (F.col("lifetime") >= min_hours) & (F.col("distance_firstlast") >= min_distance) & F.col("closed")
    return info.withColumns({"keep": good, "unfinished": F.col("date_lysis") == last_step})


#: Points and tracks of a part of the tracks at most (a longer track is alone), and parts at least.
_POINTS, _TRACKS, _PARTS = 1 << 16, 1 << 10, 6
#: Meetings of parts that are compared at once where links only need to connect, and partners of a part at most in a round of more.
_MEETINGS, _PARTNERS = 64, 8


def _in_parts(points: DataFrame, width: int) -> DataFrame:
    """(hemis, part, id, s, lat, lon, root): a row for each track with a number of its own, its points in arrays in order of time; tracks of a part begin near each other."""
    p = points.select("hemis", "id", F.unix_timestamp("ts").alias("s"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna()
    p = p.filter((F.abs("lat") < math.inf) & (F.abs("lon") < math.inf))
    tracks = p.groupBy("hemis", "id").agg(F.sort_array(F.collect_set(F.struct("s", "lat", "lon"))).alias("p"))
    tracks = materialise(tracks.select("hemis", "id", *[F.col(f"p.{c}").alias(c) for c in ("s", "lat", "lon")]), "tracks")
    sizes = tracks.agg(F.count(F.lit(1)).alias("tracks"), F.sum(F.size("s")).alias("points")).first()
    per = max(1, min(_TRACKS, -(-sizes["tracks"] // _PARTS), sizes["tracks"] * _POINTS // max(1, sizes["points"] or 0)))
    begin = tracks.select("hemis", "id", F.floor(F.col("s")[0] / (8 * width)).alias("around"), F.pmod(F.col("lon")[0], F.lit(360.0)).alias("from"))
    parts = ranked(begin, "around", "from", within=("hemis",)).select("hemis", "id", F.floor(F.col("rank") / per).alias("part"))
    return materialise(tracks.join(parts, ["hemis", "id"]).withColumn("root", F.monotonically_increasing_id()), "parts")


def _meeting_parts(parts: DataFrame, width: int, distance: float) -> DataFrame:
    """(hemis, x, y): parts (x no later than y) whose bounds in time and space leave near points possible."""
    each = parts.select("hemis", "part", F.explode(F.arrays_zip("s", "lat", "lon")).alias("p")).select("hemis", "part", "p.*")
    y, x = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(y) * F.cos(x), "y": F.cos(y) * F.sin(x), "z": F.sin(y), "s": F.col("s"), "lat": F.col("lat")}
    bounds = each.groupBy("hemis", "part").agg(*[f(v).alias(f"{c}{n}") for c, v in axes.items() for n, f in ((0, F.min), (1, F.max))])
    bounds = materialise(bounds, "bounds")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"))
    low, high = (F.col("a.lat0") + F.col("b.lat0")) / 2, (F.col("a.lat1") + F.col("b.lat1")) / 2
    least = F.greatest(F.lit(0.0), low, -high)
    angle = F.when((least > 0) & (low >= -90) & (high <= 90), F.least(F.lit(math.pi), distance * rossby_radius(least) / 6371)).otherwise(math.pi)
    chord = 2 * F.sin(angle / 2) + 1e-6
    reach = gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z") <= chord * chord
    meet = (F.col("a.hemis") == F.col("b.hemis")) & (F.col("a.part") <= F.col("b.part")) & (gap("s") <= width) & reach
    return bounds.alias("a").join(bounds.alias("b"), meet).select("a.hemis", F.col("a.part").alias("x"), F.col("b.part").alias("y"))


def connect_cyclones(points: DataFrame, hours: float = 36.0, distance: float = 1.0, min_distance: float = 1.5, min_hours: float = 48.0, connecting: tuple[int, ...] | None = None) -> DataFrame:
    """(a, b, link): tracks of a hemisphere with points near each other in time and within Rossby radii; link 1: far along, 2: long in time, 3: both.

    ``points`` has id, hemis, ts (timestamp), lat, lon. Of all points of a track near
    another one only the first and the last matter, so they are looked for from both
    ends of the tracks, which ends with the first near pair, and stretches of time
    whose bounds are too far apart are passed over. Tracks are dealt into parts of
    bounded size by time and longitude; a task has two parts, so what it holds doesn't
    grow with the table, and each pair of tracks is compared in one task. Rows without
    a time, a place or an id meet none; tracks that meet at one point only have no link.
    With ``connecting`` only links of these kinds are given, and only as many as connect
    the same tracks, found in rounds: parts that are connected already aren't sent again.
    """
    limits = Limits(int(hours * 3600), distance)
    parts = _in_parts(points, limits.seconds)
    meet = materialise(_meeting_parts(parts, limits.seconds, distance), "meetings")
    kind = points.schema["id"].dataType.simpleString()

    def compared(parts: DataFrame, meet: DataFrame) -> DataFrame:
        def links(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            same = key[1] == key[2]  # a part with itself is sent once
            return links_between(left, left if same else right, same, limits, min_distance, min_hours, connecting)

        keys = ["hemis", "x", "y"]
        names = [*keys, "id", "s", "lat", "lon", "root"]
        n = max(1, 2 * meet.count())  # few rows and much work: a task for each meeting
        side = lambda c, meet: meet.join(parts.withColumnRenamed("part", c), ["hemis", c]).select(*[F.col(x).alias(x) for x in names]).repartition(n, *keys).groupBy(*keys)
        return side("x", meet).cogroup(side("y", meet.filter("x <> y"))).applyInPandas(links, f"a {kind}, b {kind}, link int, root_a long, root_b long")

    if connecting is None:
        return compared(parts, meet).select("a", "b", "link")
    if meet.count() <= _MEETINGS:
        return compared(parts, meet).select("a", "b", "link")
    marks, partners, found = materialise(parts.select("hemis", "part", "id", "root"), "marks"), 1, None
    meet = materialise(meet.withColumn("place", F.row_number().over(Window.partitionBy("hemis", "x").orderBy("y"))), "meetings")
    done = 0
    while not meet.isEmpty():
        now = parts.drop("root").join(marks.hint("merge"), ["hemis", "part", "id"])
        links = materialise(compared(now, meet.filter(F.col("place") <= done + partners)), "links")
        found = links if found is None else found.unionByName(links)
        roots = connected_components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        marks = materialise(marks.join(roots.select(F.col("node").alias("root"), F.col("root").alias("later")).hint("merge"), "root", "left").select("hemis", "part", "id", F.coalesce("later", "root").alias("root")), "marks")
        of = marks.groupBy("hemis", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        x, y = (of.select("hemis", F.col("part").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}")) for c in ("x", "y"))
        more = meet.filter(F.col("place") > done + partners).join(x, ["hemis", "x"]).join(y, ["hemis", "y"])
        done, partners = done + partners, min(2 * partners if done else 1, _PARTNERS)
        meet = materialise(more.filter(F.least("low_x", "low_y") < F.greatest("high_x", "high_y")).select("hemis", "x", "y", "place"), "meetings")
    return (found if found is not None else compared(parts, meet)).select("a", "b", "link")


def cyclone_clusters(points: DataFrame, links: DataFrame, kinds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(id, cluster): tracks connected over links of some kinds (all; 1 and 3: Bjerknes; 2: stagnant); others are alone."""
    ids = points.select("id").distinct()
    roots = connected_components(links.filter(F.col("link").isin(*kinds)).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    joined = ids.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", F.col("id").cast("long")))
    least = joined.groupBy("root").agg(F.min("id").alias("cluster"))
    return joined.join(least, "root").select("id", "cluster")


def _sphere(lon: str, lat: str) -> list[Column]:
    """A place on the unit sphere."""
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _chord(distance: float) -> float:
    """The straight way, on the unit sphere, between places so many km apart."""
    return 2 * math.sin(min(max(distance, 0.0) / 6371.0, math.pi) / 2)


def _joined_by_boxes(places: DataFrame, width: int, distance: float) -> DataFrame:
    """``places`` (event, s, lon, lat) with ``node``: the same for events that are linked in any number of steps inside boxes.

    Boxes are cubes of space and spans of time so small that events in one are
    linked unless they are at the same second: all of a box are connected if its
    events have two times.  Every half box is in 16 of them, shifted by halves, so
    boxes chain.  Nothing grows with the pairs of events.
    """
    axes = _sphere("lon", "lat")
    half = 0.999 * _chord(distance) / math.sqrt(3) / 2
    cells = [F.floor(v / half) if half > 0 else F.lit(None).cast("long") for v in axes] + [F.floor(F.col("s") / max(1, width // 2))]
    names = ["c0", "c1", "c2", "c3"]
    there = F.col("event").isNotNull() & F.col("s").isNotNull() & (F.abs(axes[0] + axes[1] + axes[2]) < math.inf)
    boxed = places.withColumns({n: F.when(there, c) for n, c in zip(names, cells, strict=True)})
    halves = boxed.dropna(subset=names).groupBy(*names).agg(F.min("event").alias("first"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    halves = materialise(halves, "halves")
    shifted = [F.struct(F.lit(k).alias("k"), *[F.floor((F.col(n) + (k >> bit & 1)) / 2).alias(n) for bit, n in enumerate(names)]) for k in range(16)]
    boxes = halves.select("first", "s0", "s1", F.explode(F.array(*shifted)).alias("box")).groupBy("box")
    boxes = boxes.agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.collect_list("first").alias("firsts")).filter("s0 < s1")  # 16 halves at most
    links = materialise(boxes.select(F.explode("firsts").alias("a"), F.array_min("firsts").alias("b")).distinct(), "boxes")
    whole = links.select(F.col("a").alias("first")).distinct()
    roots = connected_components(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    known = whole.join(roots.withColumnRenamed("node", "first").hint("merge"), "first", "left").select("first", F.coalesce("root", F.col("first").cast("long")).alias("node"))
    known = halves.join(known.hint("merge"), "first").select(*names, "node")
    own = F.coalesce("node", F.col("event").cast("long")).alias("node")
    return boxed.join(known.hint("merge"), names, "left").select("event", "s", "lon", "lat", own)


def _links_by_distance(e: DataFrame, width: int, distance: float) -> tuple[DataFrame, DataFrame]:
    """(event, node) of events (event, s, lon, lat), and (a, b), links between nodes that connect what all links of events would.

    Events are compared pair by pair only with those of another node in a cell
    beside theirs (cubes of the distance, blocks of the time).
    """
    places = materialise(_joined_by_boxes(e, width, distance), "places")
    side, names = _chord(distance) * (1 + 1e-6) + 1e-12, ["c0", "c1", "c2", "c3"]
    cells = [F.floor(v / side) for v in _sphere("lon", "lat")] + [F.floor(F.col("s") / width)]
    celled = places.dropna().filter((F.abs("lon") < math.inf) & (F.abs("lat") < math.inf)).withColumn("cell", F.struct(*[c.alias(n) for c, n in zip(cells, names, strict=True)]))
    ends = [f(c).alias(f"{c}{n}") for c in ("s", "lat") for n, f in ((0, F.min), (1, F.max))]
    parts = materialise(celled.groupBy("cell", "node").agg(*ends), "parts")
    each = parts.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    beside = [F.struct(*[(F.col(f"cell.{n}") + k).alias(n) for n, k in zip(names, shift, strict=True)]) for shift in itertools.product((-1, 0, 1), (-1, 0, 1), (-1, 0, 1), (-1, 0))]
    later = each.select(F.explode(F.array(*beside)).alias("cell"), F.col("cell").alias("later"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = each.hint("merge").join(later, "cell").filter(F.least("low", "low2") < F.greatest("high", "high2")).select("cell", "later")
    one = parts.select("cell", F.col("node").alias("a"), "s0", "s1", "lat0", "lat1")
    two = parts.select(F.col("cell").alias("later"), F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("s0", "s1", "lat0", "lat1")])
    far = math.degrees(distance / 6371.0) * (1 + 1e-6) + 1e-9
    maybe = (F.col("a") != F.col("b")) & (F.col("s1_b") > F.col("s0")) & (F.col("s0_b") - F.col("s1") <= width)
    maybe &= (F.col("lat0_b") - F.col("lat1") <= far) & (F.col("lat0") - F.col("lat1_b") <= far)
    meet = materialise(meet.join(one.hint("merge"), "cell").join(two.hint("merge"), "later").filter(maybe).select("cell", "a", "later", "b"), "meetings")
    left = celled.select("cell", F.col("node").alias("a"), F.col("s").alias("s1"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    right = celled.select(F.col("cell").alias("later"), F.col("node").alias("b"), F.col("s").alias("s2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = meet.join(left.hint("merge"), ["cell", "a"]).join(right.hint("merge"), ["later", "b"]).filter((F.col("s2") > F.col("s1")) & (F.col("s2") - F.col("s1") <= width))
    links = pairs.filter(haversine("lon1", "lat1", "lon2", "lat2") < distance).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = places.select("event", "node").distinct()
    # An event of several rows is one.
    rows = nodes.groupBy("event").agg(F.min("node").alias("a"), F.collect_list("node").alias("b")).filter(F.size("b") > 1).select("a", F.explode("b").alias("b"))
    return nodes, links.unionByName(rows)


def _links_by_overlap(e: DataFrame, cells: DataFrame, width: int, overlap: float) -> DataFrame:
    """(a, b): events that share a cell, at steps close in time, and enough of their area."""
    keyed = e.select("event", "s", F.floor(F.col("s") / width).alias("__b")).hint("merge").join(cells.select("event", "j", "i"), "event")
    a = keyed.select("__b", "j", "i", F.col("event").alias("a"), F.col("s").alias("s1"))
    b = keyed.select(F.explode(F.array(F.col("__b") - 1, F.col("__b"))).alias("__b"), "j", "i", F.col("event").alias("b"), F.col("s").alias("s2"))
    pairs = a.hint("merge").join(b, ["__b", "j", "i"]).filter((F.col("s2") > F.col("s1")) & (F.col("s2") - F.col("s1") <= width))
    area = cells.groupBy("event").agg(F.sum("area").alias("size"))
    first, second = cells.select(F.col("event").alias("a"), "j", "i", "area"), cells.select(F.col("event").alias("b"), "j", "i")
    common = pairs.select("a", "b").distinct().join(first.hint("merge"), "a").join(second.hint("merge"), ["b", "j", "i"]).groupBy("a", "b").agg(F.sum("area").alias("both"))
    sizes = common.join(area.select(F.col("event").alias("a"), F.col("size").alias("s1")).hint("merge"), "a").join(area.select(F.col("event").alias("b"), F.col("size").alias("s2")).hint("merge"), "b")
    return sizes.filter(F.col("both") / (F.col("s1") + F.col("s2") - F.col("both")) > overlap).select("a", "b")


def track_events(events: DataFrame, cells: DataFrame | None = None, hours: float = 24.0, overlap: float = 0.0, distance: float | None = None) -> DataFrame:
    """(event, date, label): events (event, date, lon, lat) linked in time, by overlap of their cells (event, j, i, area) or distance (km) of their centres.

    Events meet by shared cells, or by boxes in which all are linked and then, where
    that leaves several groups, by blocks of time and cubes of the distance.  All
    meetings are sorted joins: a broadcast of what a small file unfolds into would
    be held by the driver.  Labels are dense from 0 in order of a group's least event.
    """
    width = int(hours * 3600)
    e = events.withColumn("s", F.unix_timestamp("date"))
    if distance is not None:
        nodes, links = _links_by_distance(e.select("event", "s", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), width, distance)
    else:
        nodes, links = events.select("event", F.col("event").cast("long").alias("node")).distinct(), _links_by_overlap(e, cells, width, overlap)
    roots = connected_components(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    rooted = nodes.join(roots.hint("merge"), "node", "left").select("event", F.coalesce("root", "node").alias("root")).distinct()
    rooted = materialise(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("event").alias("first"))
    dense = ranked(least, "first", "root", name="label").select("root", F.col("label").cast("int").alias("label"))
    labels = rooted.join(dense.hint("merge"), "root").select("event", "label")
    return events.join(labels.hint("merge"), "event").select("event", "date", "label")


def _continue_blocks(t: int, peaks: list[dict], before: list[dict], local: tuple[float, float], total: tuple[float, float]) -> list[dict]:
    """The maxima of a step as blocks: each continues the nearest of the step before that is near enough, or begins one."""
    apart = lambda a, b: abs((a - b + 180) % 360 - 180)
    out = []
    for r in peaks:
        fits = [
            (math.hypot(r["lat"] - b["lat"], apart(r["lon"], b["lon"])), b["block"], b["j"], b["i"], k)
            for k, b in enumerate(before)
            if abs(r["lat"] - b["lat"]) <= local[0] and apart(r["lon"], b["lon"]) <= local[1] and abs(r["lat"] - b["lat0"]) <= total[0] and apart(r["lon"], b["lon0"]) <= total[1]
        ]
        onset = before[min(fits)[-1]] if fits else {"block": r["id"], "lat0": r["lat"], "lon0": r["lon"]}
        out.append({"all": "all", "block": onset["block"], "t": t, "j": r["j"], "i": r["i"], "lat": r["lat"], "lon": r["lon"], "lat0": onset["lat0"], "lon0": onset["lon0"]})
    return out


def block_by_grad_rev(g: Grid, indicator: DataFrame, v: str = "block", band: tuple[float, float] = (30.0, 70.0), local: tuple[float, float] = (27.0, 36.0), total: tuple[float, float] = (40.0, 54.0), min_steps: int = 21, segment: int = 64) -> DataFrame:
    """(block, t, j, i, lat, lon): local maxima of a blocking indicator, linked in time and long enough.

    A maximum continues the nearest block of the step before that moved no more
    than ``local`` (degrees of latitude and longitude) since, and ``total`` since its
    onset, whose cell numbers the block.  Segments of time are linked side by side
    (``in_segments``).
    """
    near = g.neighbours(indicator, v)
    sides = [F.coalesce(F.col(f"{v}_{d}"), F.lit(float("-inf"))) for d in ("e", "w", "n", "s", "ne", "nw", "se", "sw")]
    peaks = near.filter((F.col(v) > 0) & (F.col(v) >= F.greatest(*sides)) & (F.col("lat") > band[0]) & (F.col("lat") < band[1])).select("t", "j", "i", "lat", "lon")
    peaks = materialise(peaks.withColumn("id", (F.col("t").cast("long") * g.ny + F.col("j")) * g.nx + F.col("i")), "peaks")
    rows = peaks.withColumn("all", F.lit("all"))
    schema = "all string, block long, t long, j int, i int, lat double, lon double, lat0 double, lon0 double"
    linked = in_segments(rows, "all", "t", segment, lambda _, t, part, before: _continue_blocks(t, part, before, local, total), schema, ("j", "i"))
    linked = materialise(linked.withColumn("t", F.col("t").cast(peaks.schema["t"].dataType)), "blocks")
    steps = linked.groupBy("block").agg(F.countDistinct("t").alias("n")).filter(F.col("n") >= min_steps)
    return linked.join(steps.select("block"), "block", "left_semi").select("block", "t", "j", "i", "lat", "lon")
