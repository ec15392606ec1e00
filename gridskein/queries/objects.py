"""Queries of objects, lines, contours, tracks, spectra and streams."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from .. import plans, sources
from ..config import Config
from ..grid import latlon_cells, local_north, unrotated
from ..operators import diagnostics as dg
from ..operators import features as ft
from ..operators import tracking as tk
from ..operators import wave_breaking as wb
from ..operators.filters import smooth_xy
from ..operators.tiled_labels import label_tiles
from ..storage import materialise, shared_dir, setting
from ..streaming import ROCKSDB, session_aggregate, track_stream, windowed_aggregate
from ._cube import CUBE_SQL, GRID, GRID_Z, LATS, LONS, cube, cube_z, rounded, rounded_sql, stages_sql, table
from .series import _events

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
DLON = 5.625
#: Limits that suit the coarse test grid.
COARSE = Config(minlen=1.0e6, frint_thres=-1.0, frspd_thres=0.0, jetint_thres=1e-12, jet_speed=1.0, vor_thres=2e-6, div_thres=-2e-6, def_thres=3e-6, cyc_mindist=300.0, cyc_minprominence=20.0)


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _cells(s):
    return latlon_cells(s, LATS, LONS)


def _smooth(s, d):
    """The cube with smooth wind, pressure (msl), height (oro) and rain."""
    return _fields(smooth_xy(GRID, smooth_xy(GRID, GRID.slices(cube(s, d)), "u", 3), "v", 3))


def _fields(c):
    return c.withColumns({"msl": 101325 + 400 * F.col("u"), "oro": F.lit(0.0), "rain": F.greatest(F.lit(0.0), F.col("v") - 1), "th": 300 + F.col("u")})


# Components. The oracle spreads labels through neighbours in a recursive query.
BASE = f"WITH RECURSIVE {CUBE_SQL}\n"
_LABELS = """, m AS (SELECT t, j, i, i * 50 + j AS id FROM s0 WHERE u > 3.5),
    e AS (SELECT a.t, a.id AS a, b.id AS b FROM m a JOIN m b ON a.t = b.t AND ((a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND (b.i = (a.i + 1) % 64 OR a.i = (b.i + 1) % 64)))),
    r AS (SELECT t, id, id AS root FROM m UNION SELECT e.t, e.b, r.root FROM r JOIN e ON e.t = r.t AND e.a = r.id),
    f AS (SELECT t, id, min(root) AS root FROM r GROUP BY ALL), l AS (SELECT t, CAST(id % 50 AS INTEGER) AS j, CAST(id // 50 AS INTEGER) AS i, CAST(dense_rank() OVER (PARTITION BY t ORDER BY root) AS INTEGER) AS label FROM f)
    """
_LABELS = _LABELS.replace(" r AS (", " rr AS (").replace("FROM r JOIN", "FROM rr r JOIN").replace("min(root) AS root FROM r ", "min(root) AS root FROM rr ")


def _labels(s, d):
    return ft.label_connected_2d(GRID, cube(s, d).withColumn("m", F.col("u") > 3.5), "m")


_add("conn_label_connected_2d", _labels, BASE + _LABELS + "SELECT t, j, i, label FROM l")
_add("conn_label_tiles", lambda s, d: label_tiles(GRID, cube(s, d).withColumn("m", F.col("u") > 3.5), "m", (16, 20)), BASE + _LABELS + "SELECT t, j, i, label FROM l")
_add("conn_label_extents", lambda s, d: ft.label_extents(_labels(s, d)), BASE + _LABELS + "SELECT t, label, count(*)::DOUBLE AS size, min(j) AS j_min, max(j) AS j_max, min(i) AS i_min, max(i) AS i_max FROM l GROUP BY ALL")
_add("conn_connect_4d_from_3d", lambda s, d: ft.connect_in_time(_labels(s, d)), BASE + _LABELS + """, x AS (SELECT DISTINCT a.t, a.label, b.label AS next FROM l a JOIN l b ON b.t = a.t + 1 AND b.j = a.j AND b.i = a.i), y AS (SELECT DISTINCT t, label FROM l), z AS (SELECT min(t) AS lo, max(t) AS hi FROM l)
    SELECT 'life' AS kind, t, label, next FROM x UNION ALL SELECT 'birth', t, label, NULL FROM y, z WHERE t > lo AND NOT EXISTS (SELECT 1 FROM x WHERE x.t + 1 = y.t AND x.next = y.label)
    UNION ALL SELECT 'death', t, label, NULL FROM y, z WHERE t < hi AND NOT EXISTS (SELECT 1 FROM x WHERE x.t = y.t AND x.label = y.label)""")
_add("conn_mask_minimum_connect", lambda s, d: ft.mask_minimum_connect(GRID, cube(s, d), "u", cube(s, d).filter("u > 5").select("t", "j", "i"), 3.5),
     BASE + _LABELS.replace("u > 3.5", "u >= 3.5") + "SELECT t, j, i FROM l WHERE (t, label) IN (SELECT t, label FROM l JOIN s0 USING (t, j, i) WHERE u > 5)")


def _labels_3d_sql(stages: list[dict[str, str]], where: str) -> str:
    """CTE l3 (t, k, j, i, label, area) of components that touch in any direction; ids have x outermost."""
    return stages_sql(stages, True).replace("WITH ", "WITH RECURSIVE ", 1) + f""", m3 AS (SELECT t, k, j, i, dx * dy / 4 AS area, (i * 10 + j) * 5 + k AS id FROM s{len(stages)} WHERE {where}),
    e3 AS (SELECT a.t, a.id AS a, b.id AS b FROM m3 a JOIN m3 b ON a.t = b.t AND a.id <> b.id AND abs(a.k - b.k) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i - b.i + 65) % 64 <= 2),
    r3 AS (SELECT t, id, id AS root FROM m3 UNION SELECT e3.t, e3.b, r3.root FROM r3 JOIN e3 ON e3.t = r3.t AND e3.a = r3.id),
    f3 AS (SELECT t, id, min(root) AS root FROM r3 GROUP BY ALL),
    l3 AS (SELECT t, k, j, i, area, CAST(dense_rank() OVER (PARTITION BY t ORDER BY root) AS INTEGER) AS label FROM f3 JOIN m3 USING (t, id))
    """


_SMOOTHED = "{0} + (({0}[e] - 2 * {0} + {0}[w]) + CASE WHEN j > 0 AND j < 9 THEN {0}[n] - 2 * {0} + {0}[s] ELSE 0 END) / 6"
_SLOPE = "sqrt(pow(({0}[e] - {0}[w]) / dx, 2) + pow(({0}[n] - {0}[s]) / dy, 2))"
_add("conn_label_connected_3d", lambda s, d: ft.label_connected_3d(GRID_Z, cube_z(s, d).withColumn("m", F.col("u") > 4), "m"), _labels_3d_sql([], "u > 4") + "SELECT t, k, j, i, label FROM l3")
_add("conn_frontalvolume_smallscale", lambda s, d: ft.frontal_volume_small(GRID_Z, GRID_Z.slices(cube_z(s, d)), "u", large=2e-6, small=1.2e-5, min_size=4e10),
     _labels_3d_sql([{"u1": _SMOOTHED.format("u"), "g": _SLOPE.format("u")}, {"u2": _SMOOTHED.format("u1")}, {"g2": _SLOPE.format("u2")}], "g > 1.2e-5 AND g2 > 2e-6") + "SELECT t, label, k, j, i FROM l3 WHERE (t, label) IN (SELECT t, label FROM l3 GROUP BY t, label HAVING sum(area) >= 2e11)")
_add("conn_frontalvolume", lambda s, d: ft.frontal_volume(GRID_Z, GRID_Z.slices(cube_z(s, d)), "u", 1e-6, 1e10))
_ARC_KM = "6371 * acos(greatest(-1, least(1, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))))"
_add("conn_atmospheric_river", lambda s, d: ft.atmospheric_river(GRID, cube(s, d), "u", "v", 3.0, 1000.0), BASE + _LABELS.replace("u > 3.5", "sqrt(u * u + v * v) > 3") + f""", pt AS (SELECT l.*, s0.lat, s0.lon FROM l JOIN s0 USING (t, j, i)), sd AS (SELECT t, label FROM pt GROUP BY ALL HAVING min(lat) > 0 OR max(lat) < 0),
    fr AS (SELECT t, label FROM (SELECT a.t, a.label, max({_ARC_KM}) AS far, max(a.lat) - min(a.lat) AS high FROM pt a JOIN pt b ON b.t = a.t AND b.label = a.label WHERE (a.t, a.label) IN (SELECT (t, label) FROM sd) GROUP BY ALL) WHERE far > 1000 OR high * 111 > 1000)
    SELECT t, label, j, i FROM l WHERE (t, label) IN (SELECT (t, label) FROM fr)""")
_add("conn_dist_from_mask", lambda s, d: rounded(ft.dist_from_mask(_cells(s), cube(s, d).filter("u > 6").select("t", "j", "i")), {"distance": 1e-6}),
     f"WITH {CUBE_SQL}, c AS (SELECT j, i, lat, lon FROM s0 WHERE t = 0), k AS (SELECT t, lat AS la, lon AS lo FROM s0 WHERE u > 6)\n" + rounded_sql({"distance": 1e-6}, "(SELECT t, j, i, min(6370000 * acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(la)) + cos(radians(lat)) * cos(radians(la)) * cos(radians(abs((lo - lon + 180 + 720) % 360 - 180))))))) AS distance FROM c, k GROUP BY ALL)"))

# Lines.
_Z = """SELECT t, i + CASE WHEN u = 0 THEN CASE WHEN b = 0 THEN 0.5 ELSE 0 END WHEN u * b < 0 THEN u / (u - b) END AS x, j * 1.0::DOUBLE AS y FROM (SELECT s.*, n.u AS b FROM s0 s LEFT JOIN s0 n ON n.t = s.t AND n.j = s.j AND n.i = (s.i + 1) % 64)
    UNION SELECT t, i * 1.0::DOUBLE AS x, j + CASE WHEN u = 0 THEN CASE WHEN b = 0 THEN 0.5 ELSE 0 END WHEN u * b < 0 THEN u / (u - b) END AS y FROM (SELECT s.*, n.u AS b FROM s0 s LEFT JOIN s0 n ON n.t = s.t AND n.j = s.j + 1 AND n.i = s.i)"""
_add("line_find_zeroloc", lambda s, d: rounded(ft.find_zeroloc(GRID, GRID.slices(cube(s, d)), "u"), {"x": 1, "y": 1}, ("t",)), f"WITH {CUBE_SQL}\n" + rounded_sql({"x": 1, "y": 1}, f"({_Z}) WHERE x IS NOT NULL AND y IS NOT NULL", ("t",)))
_add("line_find_maxloc", lambda s, d: rounded(ft.find_maxloc(GRID, GRID.slices(cube(s, d)), "u", 3.0), {"x": 1, "y": 1}, ("t",)), stages_sql([
    {"x1": "(u[e] - u[w]) / dx", "y1": "(u[n] - u[s]) / dy", "xx": "4 * (u[e] - 2 * u + u[w]) / (dx * dx)", "yy": "4 * (u[n] - 2 * u + u[s]) / (dy * dy)", "xy": "(u[ne] - u[nw] - u[se] + u[sw]) / (dx * dy)"},
    {"lo": "(xx + yy) / 2 - sqrt(greatest(0, (xx + yy) / 2 * ((xx + yy) / 2) - (xx * yy - xy * xy)))"}, {"ex": "(lo - yy) / nullif(sqrt((lo - yy) * (lo - yy) + xy * xy), 0)", "ey": "xy / nullif(sqrt((lo - yy) * (lo - yy) + xy * xy), 0)"},
    {"ds": "-(x1 * ex + y1 * ey) / nullif(lo, 0)"}, {"di": "2 * ds * ex / dx", "dj": "2 * ds * ey / dy"}]) + "\n" + rounded_sql({"x": 1, "y": 1}, "(SELECT t, i + di AS x, j + dj AS y FROM s5 WHERE u >= 3 AND lo < 0 AND sqrt(di * di + dj * dj) <= 1.5)", ("t",)))


def _drawn(s, d):
    """A line for each row, with a point for each cell that follows the field, kept inside the grid."""
    y = F.least(F.lit(49.0), F.greatest(F.lit(0.0), F.col("j") + F.col("u") * 0.1))
    return cube(s, d).select("t", F.col("j").alias("line_id"), F.col("i").alias("pt"), (F.col("i") + F.col("j") * 0.3).alias("x"), y.alias("y"))


_DRAWN = f"WITH {CUBE_SQL}, d AS (SELECT t, j AS line_id, i AS pt, i + j * 0.3::DOUBLE AS x, least(49.0::DOUBLE, greatest(0.0::DOUBLE, j + u * 0.1::DOUBLE)) AS y FROM s0)\n"
_add("line_mask_lines", lambda s, d: ft.mask_lines(GRID, _drawn(s, d)), _DRAWN + "SELECT DISTINCT t, CAST(round(y) AS INTEGER) AS j, CAST(round(x) AS INTEGER) % 64 AS i FROM d")
_add("line_normalize_lines", lambda s, d: rounded(ft.normalize_lines(GRID, _drawn(s, d), _cells(s)), {"density": 1e9}), _DRAWN + """, g AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM d WINDOW w AS (PARTITION BY t, line_id ORDER BY pt)),
    h AS (SELECT t, least(abs(x - x0), 64 - abs(x - x0)) AS di, abs(y - y0) AS dj, unnest([round(x), round(x0)]) AS cx, unnest([round(y), round(y0)]) AS cy FROM g WHERE x0 IS NOT NULL),
    c AS (SELECT j, i, dx, dy FROM s0 WHERE t = 0)
    """ + rounded_sql({"density": 1e9}, "(SELECT t, j, i, sum(sqrt(pow(dx * di / 2, 2) + pow(dy * dj / 2, 2)) / 2 / (dx * dy / 4)) AS density FROM h JOIN c ON c.j = cy AND c.i = CAST(cx AS INTEGER) % 64 GROUP BY ALL)"))


def _line_out(lines):
    return lines.select(*[c for c in lines.columns if c in ("t", "type", "line_id", "pt")], F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "payload")


_add("line_jetaxis", lambda s, d: _line_out(plans.jet_axes(GRID, _smooth(s, d), "u", "v", _cells(s), COARSE)))
_add("line_jetaxis_ff_thres", lambda s, d: _line_out(plans.jet_axes_by_speed(GRID, _smooth(s, d), "u", "v", _cells(s), COARSE)))
_add("line_frontline_at_maxcurv", lambda s, d: _line_out(plans.front_lines(GRID, _smooth(s, d), "th", "u", "v", _cells(s), True, COARSE)))
_add("line_frontline_at_maxgrad", lambda s, d: _line_out(plans.front_lines(GRID, _smooth(s, d), "th", "u", "v", _cells(s), False, Config(frint_thres=1.0, frspd_thres=0.0))))
for _kind, _name in (("convergence", "convline"), ("vorticity", "vorline"), ("deformation", "defline")):
    _add(f"line_{_name}", lambda s, d, k=_kind: _line_out(plans.wind_lines(GRID, _smooth(s, d), "u", "v", _cells(s), k, COARSE)))

# Contours and events.


def _contours(s, d):
    return materialise(ft.calculate_contours(GRID, _smooth(s, d), "u", [0.0, 1.0], DLON), "contours")  # what follows reads them twice


_add("contour_calculate_contours", _contours)
_add("contour_cutoffs", lambda s, d: ft.calculate_cutoffs(_contours(s, d), 20.0))
_add("contour_overturnings", lambda s, d: ft.calculate_overturnings(GRID, _contours(s, d), DLON, 12.0, 12.0))
_add("contour_streamers", lambda s, d: ft.calculate_streamers(GRID, _contours(s, d), LATS, DLON, 1500.0, 3000.0))


def _polygons(s, d):
    return ft.calculate_cutoffs(_contours(s, d), 20.0).withColumn("event", F.xxhash64("t", "level", "contour_id"))


_add("event_to_grid", lambda s, d: ft.rasterize(GRID, _polygons(s, d)))
_add("event_properties", lambda s, d: ft.event_properties(ft.rasterize(GRID, _polygons(s, d)), cube(s, d).withColumn("area", F.col("dx") * F.col("dy") / 4e6), "u"))


def _stars(s, d):
    """A polygon of 16 corners for each vector, as far from its middle as the components say."""
    e = table(s, d, "embeddings").select((F.col("vec_id") / 50).cast("int").alias("t"), F.col("vec_id").alias("event"), "embedding")
    turn = lambda k: k * (math.pi / 8) + 0.1
    far = lambda k: 3.0 + 12.0 * F.abs(F.get("embedding", k).cast("double"))
    corner = lambda k: F.struct((F.col("event") % 64 + far(k) * F.cos(turn(k))).alias("x"), (F.col("event") * 7 % 50 + far(k) * F.sin(turn(k))).alias("y"))
    return e.select("t", "event", F.transform(F.sequence(F.lit(0), F.lit(15)), corner).alias("geometry"))


_STARS = """WITH k AS (SELECT unnest(range(16)) AS k), c AS (SELECT vec_id, vec_id // 50 AS t, k, vec_id % 64 AS cx, vec_id * 7 % 50 AS cy, 3 + 12 * abs(CAST(embedding[k + 1] AS DOUBLE)) AS r, k * (pi() / 8) + 0.1::DOUBLE AS a FROM embeddings, k),
    q AS (SELECT *, cx + r * cos(a) AS x, cy + r * sin(a) AS y FROM c), e AS (SELECT a.vec_id, a.t, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, b.x - a.x AS dx, b.y - a.y AS dy FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.k = (a.k + 1) % 16),
    w AS (SELECT vec_id, min(x) AS lo, max(x) AS hi FROM q GROUP BY vec_id), g AS (SELECT vec_id, j, unnest(range(CAST(floor(lo) - 1 AS BIGINT), CAST(ceil(hi) + 2 AS BIGINT))) AS i FROM w, (SELECT unnest(range(50)) AS j)),
    h AS (SELECT g.vec_id, t, j, i, sum(CASE WHEN (y1 > j) <> (y2 > j) AND i < (x1 - x2) * (j - y2) / (y1 - y2) + x2 THEN 1 ELSE 0 END) % 2 = 1 AS inside,
          min(sqrt(pow(i - x1 - greatest(0, least(1, ((i - x1) * dx + (j - y1) * dy) / (dx * dx + dy * dy))) * dx, 2) + pow(j - y1 - greatest(0, least(1, ((i - x1) * dx + (j - y1) * dy) / (dx * dx + dy * dy))) * dy, 2))) AS far FROM g JOIN e USING (vec_id) GROUP BY ALL),
    p AS (SELECT DISTINCT t, vec_id AS event, j, (i % 64 + 64) % 64 AS i FROM h WHERE inside OR far < 0.5)"""
_add("event_polygon_cells", lambda s, d: ft.rasterize(GRID, _stars(s, d)), _STARS + " SELECT * FROM p")
_add("event_polygon_properties", lambda s, d: ft.event_properties(ft.rasterize(GRID, _stars(s, d)), cube(s, d).withColumn("area", F.col("dx") * F.col("dy") / 4e6), "u"), f"""
    WITH x AS ({_STARS} SELECT * FROM p), {CUBE_SQL}, m AS (SELECT *, dx * dy / 4e6 AS area FROM s0)
    SELECT t, event, round(sum(area * u) / sum(area), 2) AS mean_var, round(sum(area * lon) / sum(area), 2) AS com_lon, round(sum(area * lat) / sum(area), 2) AS com_lat, round(sum(area), 2) AS event_area FROM x JOIN m USING (t, j, i) GROUP BY t, event""")


def _points(s, d):
    """Events as places: one row for each, moving slowly for each user."""
    e = _events(s, d)
    lon = F.pmod(F.col("user_id") * 7.0 + F.unix_timestamp("ts") / 86400.0, F.lit(360.0))
    return e.select(F.col("event_id").alias("event"), "user_id", F.col("ts").alias("date"), lon.alias("lon"), (F.col("user_id") % 60 + F.col("value") / 100).alias("lat"), "value")


_PT = """WITH RECURSIVE p AS (SELECT event_id AS event, user_id, CAST(ts AS TIMESTAMP) AS date, epoch_us(ts) // 1000000 AS s, ((user_id * 7.0::DOUBLE + (epoch_us(ts) // 1000000) / 86400.0::DOUBLE) % 360) AS lon, user_id % 60 + value / 100 AS lat, value FROM events)"""
_HAV = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_add("event_track_events", lambda s, d: tk.track_events(_points(s, d), None, 24.0, 0.0, 60.0).select("event", "label"), _PT + f""", q AS (SELECT * FROM p),
    e AS (SELECT a.event AS a, b.event AS b FROM q a JOIN q b ON b.s > a.s AND b.s - a.s <= 86400 AND {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 60), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT event, event AS root FROM q UNION SELECT u.b, least(r.root, u.b) FROM r JOIN u ON u.a = r.event), f AS (SELECT event, min(root) AS root FROM r GROUP BY ALL)
    SELECT event, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label FROM f""")

# Lows and tracks.
_add("cyc_cyclone_by_contour", lambda s, d: ft.cyclone_by_contour(GRID, _smooth(s, d), "msl", "oro", COARSE).select("t", "id", "lat", "lon", "lowest", "outer", "size", F.size("cells").alias("n")))
_add("cyc_precip_blobs", lambda s, d: ft.precip_blobs(GRID, _smooth(s, d), "rain", 500.0).select("t", "id", "lat", "lon", "peak", "size", F.size("cells").alias("n")))


def _attributed(s, d):
    c = _smooth(s, d)
    blobs = ft.precip_blobs(GRID, c, "rain", 500.0)
    masks = c.filter("u > 1.5").select("t", F.lit("A").alias("name"), "j", "i").unionByName(c.filter("u < -1.5").select("t", F.lit("B").alias("name"), "j", "i"))
    return ft.attribute_to_features(blobs, masks, c, "rain")


_add("cyc_attribute_to_features", _attributed)
_add("cyc_locate_cyclones", lambda s, d: tk.locate_cyclones(GRID, _smooth(s, d), "msl", "oro", tk.TrackConfig(lap_closed=1e-12, lap_open=1e-12, prominence_closed=20, prominence_open=1)))
_LOOSE = tk.TrackConfig(lap_closed=1e-12, lap_open=1e-12, prominence_closed=20, prominence_open=1, track_distance=1.5e6)


def _tracks(s, d):
    return tk.track_cyclones(tk.locate_cyclones(GRID, _smooth(s, d), "msl", "oro", _LOOSE), _LOOSE)


_add("cyc_track_cyclones", lambda s, d: _tracks(s, d).select("track_id", "hemis", "t", "lat", "lon", "closed"))
_add("cyc_smooth_cyclone_track", lambda s, d: tk.smooth_tracks(_tracks(s, d), _LOOSE).select("track_id", "hemis", "t", "lat_s", "lon_s", "segment_len", "movement_speed", "movement_direction"))


def _walks(s, d):
    """Tracks by user: steps are hours."""
    p = _points(s, d)
    return p.select(F.col("user_id").alias("track_id"), F.unix_timestamp("date").alias("t"), "lon", "lat", F.col("value").alias("msl"), F.col("value").alias("lap"), (F.col("value") * 2).alias("prominence"), (F.col("value") > 300).alias("closed"))


_INFO = ["lifetime", "distance_traveled", "distance_firstlast", "lon_genesis", "lat_genesis", "lon_lysis", "lat_lysis", "msl_maxlap", "msl_min", "lon_maxlap", "lat_mslmin"]
_ARC = "6370000 * acos(greatest(-1, least(1, sin(radians({0})) * sin(radians({2})) + cos(radians({0})) * cos(radians({2})) * cos(radians({3}) - radians({1})))))"
_SC = {c: 1e-3 if "distance" in c else 1 for c in _INFO}
_add("cyc_trackinfo", lambda s, d: rounded(tk.filter_tracks(tk.aggregate_trackinfo(_walks(s, d), 1 / 3600, ("track_id",)), 0).withColumns({"closed": F.col("closed").cast("int"), "keep": F.col("keep").cast("int")}), _SC, ("track_id", "closed", "keep")), _PT + f""", w AS (SELECT *, lag(lon) OVER v AS lo, lag(lat) OVER v AS la FROM p WINDOW v AS (PARTITION BY user_id ORDER BY s, lat, lon)),
    g AS (SELECT user_id AS track_id, (max(s) - min(s)) * (1::DOUBLE / 3600) AS lifetime, sum({_ARC.format('la', 'lo', 'lat', 'lon')}) AS distance_traveled, max(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS closed, arg_min(lon, (s, lat, lon)) AS lon_genesis, arg_min(lat, (s, lat, lon)) AS lat_genesis, arg_max(lon, (s, lat, lon)) AS lon_lysis, arg_max(lat, (s, lat, lon)) AS lat_lysis,
        max(value) AS msl_maxlap, min(value) AS msl_min, arg_max(lon, (value, -s, -lat, -lon)) AS lon_maxlap, arg_min(lat, (value, s, lat, lon)) AS lat_mslmin FROM w GROUP BY user_id),
    k AS (SELECT *, {_ARC.format('lat_genesis', 'lon_genesis', 'lat_lysis', 'lon_lysis')} AS distance_firstlast FROM g), z AS (SELECT *, CASE WHEN lifetime >= 24 AND distance_firstlast >= 500000 AND closed = 1 THEN 1 ELSE 0 END AS keep FROM k)
    """ + rounded_sql(_SC, "z", ("track_id", "closed", "keep")))  # fmt: skip


def _storms(s, d):
    return _points(s, d).select(F.col("user_id").alias("id"), F.lit("N").alias("hemis"), F.col("date").alias("ts"), "lon", (F.lit(40.0) + F.col("lat") / 4).alias("lat"))


_ROSS = "(0.13::DOUBLE / (2 * 7.29e-5 * sin(radians(abs({0})))))"
_CL = _PT + f""", q AS (SELECT user_id AS id, s, lon, 40 + lat / 4 AS lat FROM p),
    n AS (SELECT DISTINCT a.id AS a, b.id AS b, a.s, a.lat, a.lon FROM q a JOIN q b ON a.id <> b.id AND abs(a.s - b.s) <= 129600 AND {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} / {_ROSS.format('((a.lat + b.lat) / 2)')} <= 1),
    g AS (SELECT a, b, count(*) AS n, min(s) AS s0, max(s) AS s1, arg_min(lat, s) AS la0, arg_min(lon, s) AS lo0, arg_max(lat, s) AS la1, arg_max(lon, s) AS lo1 FROM n GROUP BY a, b HAVING count(*) >= 2),
    o AS (SELECT a, b, {_HAV.format('la0', 'lo0', 'la1', 'lo1')} / {_ROSS.format('((la0 + la1) / 2)')} AS way, (s1 - s0) / 3600 AS tm FROM g),
    lk AS (SELECT x.a, x.b, CAST(CASE WHEN (x.way + y.way) / 2 >= 1.5 THEN 1 ELSE 0 END + CASE WHEN (x.tm + y.tm) / 2 >= 48 THEN 2 ELSE 0 END AS INTEGER) AS link FROM o x JOIN o y ON x.a = y.b AND x.b = y.a AND x.a < x.b)
    """
_add("cyc_connect_cyclones", lambda s, d: tk.connect_cyclones(_storms(s, d)), _CL + "SELECT a, b, link FROM lk WHERE link > 0")
_add("cyc_cyclone_clusters", lambda s, d: tk.cyclone_clusters(_storms(s, d), tk.connect_cyclones(_storms(s, d), connecting=(1, 3)), (1, 3)), _CL + """, u AS (SELECT a, b FROM lk WHERE link IN (1, 3) UNION SELECT b, a FROM lk WHERE link IN (1, 3)), ids AS (SELECT DISTINCT id FROM q),
    r AS (SELECT id, id AS root FROM ids UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id) SELECT id, min(root) AS cluster FROM r GROUP BY id""")
_add("cyc_block_by_grad_rev", lambda s, d: tk.block_by_grad_rev(GRID, dg.block_indicator(GRID, _smooth(s, d), "u", 5, 3), "block", (20.0, 70.0), min_steps=2))
_BI = {"b": "CASE WHEN j >= 5 AND j < 45 THEN (" + " + ".join(f"u[{'s' * k}]" for k in range(1, 6)) + " - (" + " + ".join(f"u[{'n' * k}]" for k in range(1, 6)) + ")) / 5 END"}
_add("cyc_rwb_by_contour", lambda s, d: wb.rwb_by_contour(GRID, _smooth(s, d).withColumn("pt", 330 + F.col("lat") / 2 + 8 * F.col("u")), "pt", LATS, LONS, "PT", 21))
_add("diag_block_indicator", lambda s, d: rounded(dg.block_indicator(GRID, GRID.slices(cube(s, d)), "u", 5, 2), {"block": 1}), stages_sql([_BI, {"block": "CASE WHEN j >= 5 AND j < 45 THEN coalesce((b[ww] + b[w] + b + b[e] + b[ee]) / 5, 0) ELSE 0 END"}]) + "\n" + rounded_sql({"block": 1}, "s2"))

# Spectra, eigenvalues and the rest of the levels' operators.
_add("filter_fill_nan", lambda s, d: rounded(ft.fill_nan(GRID, cube(s, d).withColumn("u", F.when(F.col("v").between(-1, 1), None).otherwise(F.col("u"))), "u"), {"u": 1}))
_HY = f"""WITH {CUBE_SQL.replace("s0 AS (", "sx AS (")}, s0 AS (SELECT t, CAST(j % 5 AS INTEGER) AS k, CAST(j // 5 AS INTEGER) AS j, i, temp, 20000.0::DOUBLE + 18000.0::DOUBLE * (j % 5) AS pr FROM sx),
    a AS (SELECT *, 287.04::DOUBLE * temp * ln(coalesce((lag(pr) OVER w + pr) / 2, 101000) / pr) AS lo, 287.04::DOUBLE * temp * ln(pr / coalesce((lead(pr) OVER w + pr) / 2, pr)) AS hi FROM s0 WINDOW w AS (PARTITION BY t, j, i ORDER BY k DESC)),
    b AS (SELECT *, 10 + coalesce(sum(lo + hi) OVER (PARTITION BY t, j, i ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + lo AS phi FROM a)
    """


def _column(s, d):
    c = cube(s, d).select("t", (F.col("j") % 5).alias("k"), F.floor(F.col("j") / 5).cast("int").alias("j"), "i", "temp", (20000.0 + 18000.0 * (F.col("j") % 5)).alias("pr"))
    return c.withColumns({"ps": F.lit(101000.0), "phis": F.lit(10.0)})


_add("diag_z_from_hydrostasy", lambda s, d: rounded(dg.z_from_hydrostasy(GRID_Z, _column(s, d), "temp", "pr", "ps", "phis"), {"phi": 1e-3}, ("t", "k", "j", "i")), _HY + rounded_sql({"phi": 1e-3}, "b", ("t", "k", "j", "i")))


def _rotated(s, d):
    north = _north(s)
    u, v = unrotated("u", "v")
    return rounded(cube(s, d).drop("lat", "lon", "dx", "dy").join(F.broadcast(north), ["j", "i"]).withColumns({"east": u, "north": v}), {"east": 1, "north": 1})  # the grid's cells


def _north(s):
    cells = _cells(s).withColumn("t", F.lit(0))
    return local_north(cells, GRID).select("j", "i", "north_x", "north_y")


_add("grid_unrotate_vector", _rotated, f"WITH {CUBE_SQL}\n" + rounded_sql({"east": 1, "north": 1}, "(SELECT t, j, i, CASE WHEN j BETWEEN 1 AND 48 THEN u END AS east, CASE WHEN j BETWEEN 1 AND 48 THEN v END AS north FROM s0)"))
_add("src_levels", lambda s, d: _levels(table(s, d, "nation")), """SELECT l, CASE n % 5 WHEN 0 THEN 'isentropic' WHEN 1 THEN 'pv' WHEN 2 THEN 'height' WHEN 3 THEN 'pressure' ELSE 'surface' END AS kind, (CASE n % 5 WHEN 0 THEN 300 + n WHEN 1 THEN (1000 + n) / 1000 WHEN 2 THEN n WHEN 3 THEN 100 * (500 + n) ELSE 0 END)::DOUBLE AS value
    FROM (SELECT CAST(n_nationkey AS INTEGER) AS n, CASE n_nationkey % 5 WHEN 0 THEN concat('pt', 300 + n_nationkey) WHEN 1 THEN concat('pv', 1000 + n_nationkey) WHEN 2 THEN concat(n_nationkey, 'm') WHEN 3 THEN concat(500 + n_nationkey, '') ELSE 'sfc' END AS l FROM nation)""")


def _levels(nation):
    n = F.col("n_nationkey")
    name = F.when(n % 5 == 0, F.concat(F.lit("pt"), 300 + n)).when(n % 5 == 1, F.concat(F.lit("pv"), 1000 + n)).when(n % 5 == 2, F.concat(n.cast("string"), F.lit("m"))).when(n % 5 == 3, (500 + n).cast("string")).otherwise("sfc")
    named = nation.select(name.alias("l"))
    return named.select("l", sources.level_kind(F.col("l")).alias("kind"), sources.level_value(F.col("l")).alias("value"))


# Streams: each reads the files of a table as a stream and runs until they are read.


def _run(stream):
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/gridskein/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _event_stream(s, d):
    schema = table(s, d, "events").schema
    rows = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("double")})


def _times(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("t_start", "t_end")}).withColumn("mean", F.round("mean", 6))


_add("stream_windowed_aggregate", lambda s, d: _times(_run(windowed_aggregate(_event_stream(s, d), "ts", "value", "1 day", "1 day", ("event_type",)))), """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS t_start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS t_end, event_type, round(avg(value), 6) AS mean, count(value) AS valid, count(*) AS cnt
    FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
_add("stream_session_aggregate", lambda s, d: _run(session_aggregate(_event_stream(s, d), "ts", "value", "6 hours", "1 day", ("user_id",))).select("user_id", F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("t_start"), "valid", "cnt"), """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS t_start, count(value) AS valid, count(*) AS cnt FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")


#: Partitions of the tracker's state, whose keys are two hemispheres: each one more opens a state store and a Python worker for nothing.
_STATES = 8


def _stream_tracks(s, d):
    """Located lows, written to files and tracked as a stream."""
    lows = tk.locate_cyclones(GRID, _smooth(s, d), "msl", "oro", _LOOSE)
    path = f"{shared_dir(s)}/gridskein/lows-{uuid.uuid4().hex}"
    materialise(lows, "lows").write.parquet(path)
    with setting(s, *ROCKSDB), setting(s, "spark.sql.shuffle.partitions", str(_STATES)):
        tracks = _run(track_stream(s.readStream.schema(lows.schema).parquet(path), _LOOSE))
    return tracks.select("track_id", "hemis", "t", "lat", "lon", "closed")


_add("stream_track_cyclones", _stream_tracks)
