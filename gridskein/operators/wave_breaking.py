"""Wave breaking where contours overturn: runs of a circumglobal contour that go west.

Contours are traced on a mesh of four triangles a box around its centre, whose
value is the mean of the corners weighted by their inverse distance.  A crossed
edge of the mesh is a node with an integer id; a crossed triangle links two of
them, so tracing compares no floating-point places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from .features import per_slice

#: Middle contour and step of each kind of field (PV, geopotential at 250 and 500 hPa, absolute vorticity, potential temperature).
CONTOURS = {"PV": (0.0, 0.5e-6), "Z2": (97500.0, 750.0), "Z5": (52500.0, 350.0), "VO": (0.0, 2.0e-5), "PT": (330.0, 5.0)}


def contour_levels(kind: str, n: int) -> list[float]:
    """The n levels of a kind of field, around its middle."""
    middle, step = CONTOURS[kind]
    return [middle + step * (p - n // 2) for p in range(n)]


def _centres(values: np.ndarray, lats: np.ndarray, dlon: float) -> np.ndarray:
    half = np.diff(lats)[:, None] / 2
    reach = [np.hypot(np.cos(np.radians(lats[k : len(lats) - 1 + k, None])) * dlon / 2, half) for k in (0, 1)]
    east = np.roll(values, -1, axis=1)
    south, north = (values[:-1] + east[:-1]) / reach[0], (values[1:] + east[1:]) / reach[1]
    return (south + north) / (2 / reach[0] + 2 / reach[1])


class _Mesh:
    """Edges of the triangles over a cyclic slice (rows from south to north): ids, ends and their places."""

    def __init__(self, values: np.ndarray, lats: np.ndarray, dlon: float):
        ny, nx = values.shape
        n = ny * nx
        j, i = np.indices((ny - 1, nx))
        here, east = j * nx + i, j * nx + (i + 1) % nx
        centre = n + here
        self.nx, self.ny, self.corners = nx, ny, n
        self.values = np.concatenate([values.ravel(), _centres(values, lats, dlon).ravel()])
        x, y = np.indices((ny, nx))[::-1]
        self.x = np.concatenate([x.ravel(), (i + 0.5).ravel()]).astype(float)
        self.y = np.concatenate([y.ravel(), (j + 0.5).ravel()]).astype(float)
        # An edge is known by its kind (along x, along y, from one of four corners to the centre) and box.
        box = [here, east, east + nx, here + nx]
        spokes = [(2 + k) * n + here for k in range(4)]
        rims = [here, n + east, here + nx, n + here]
        self.triangles = [(box[k], box[(k + 1) % 4], centre, rims[k], spokes[k], spokes[(k + 1) % 4]) for k in range(4)]

    def links(self, level: float):
        """(edge, edge) for each crossed triangle, and each crossed edge's place (x, y) in cells."""
        pairs, ids, ends = [], [], []
        for a, b, c, rim, to_a, to_b in self.triangles:
            va, vb, vc = self.values[a], self.values[b], self.values[c]
            whole = ~np.isnan(va + vb + vc)
            ha, hb, hc = va > level, vb > level, vc > level
            cut = [(rim, a, b, ha != hb), (to_a, a, c, ha != hc), (to_b, b, c, hb != hc)]
            for edge, p, q, on in cut:
                on = on & whole
                ids.append(edge[on])
                ends.append(np.stack([p[on], q[on]]))
            for (e, _, _, on), (f, _, _, too) in ((cut[0], cut[1]), (cut[0], cut[2]), (cut[1], cut[2])):
                both = on & too & whole
                pairs.append(np.stack([e[both], f[both]], axis=1))
        ids, first = np.unique(np.concatenate(ids), return_index=True)
        p, q = np.concatenate(ends, axis=1)[:, first]
        share = (level - self.values[p]) / (self.values[q] - self.values[p])
        step = (self.x[q] - self.x[p] + self.nx / 2) % self.nx - self.nx / 2
        return np.concatenate(pairs), ids, self.x[p] + share * step, self.y[p] + share * (self.y[q] - self.y[p])


def westward_runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points on runs that rise, points on runs that fall): a run lies between two westward steps each and follows a turn from east to west."""
    step = np.diff(x)
    west = np.flatnonzero((step[:-1] < 0) & (step[1:] < 0)) + 1
    rising, falling = [], []
    for run in np.split(west, np.flatnonzero(np.diff(west) > 1) + 1):
        if len(run) and run[0] >= 2 and step[run[0] - 2] > 0:
            (rising if y[run[0] - 1] <= y[run[0]] else falling).append(run)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rising]), np.concatenate([none, *falling])


def breaking_cells(values: np.ndarray, lats: np.ndarray, lons: np.ndarray, levels: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Masks (anticyclonic, cyclonic) of a slice that wraps in x.

    Rows may run either way, and the first longitude may be any.  Contours that
    touch the first or last row, or don't go around, don't count.  Missing values
    end a contour.
    """
    ny, nx = values.shape
    flip = slice(None, None, -1) if lats[0] > lats[-1] else slice(None)
    lat = np.asarray(lats, float)[flip]
    dlon = float(lons[1] - lons[0])
    turn = int(np.argmin(np.mod(np.asarray(lons) + 180, 360)))  # tracing starts at 180 W
    mesh = _Mesh(np.roll(values[flip], -turn, axis=1), lat, dlon)
    rising, falling = np.zeros((ny, nx), bool), np.zeros((ny, nx), bool)
    for level in levels:
        if not (np.nanmin(values, initial=np.inf) <= level < np.nanmax(values, initial=-np.inf)):
            continue
        pairs, ids, px, py = mesh.links(level)
        near: dict[int, list[int]] = {}
        for a, b in np.searchsorted(ids, pairs).tolist():
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        column = ids % nx
        spoke = ids >= 2 * mesh.corners
        edge = (ids < mesh.corners) & ((ids < nx) | (ids >= mesh.corners - nx))  # along x in the first or last row
        seen: set[int] = set()
        for start in np.flatnonzero((ids >= mesh.corners) & ~spoke & (column == 0)).tolist():
            ahead = [e for e in near[start] if spoke[e] and column[e] == 0]
            if start in seen or not ahead:
                continue
            line, before, now = [start], start, ahead[0]
            while True:
                line.append(now)
                onward = [e for e in near[now] if e != before]
                if now == start or not onward:
                    break
                before, now = now, onward[0]
            seen.update(line)
            at = np.array(line)
            x = px[start] + np.r_[0.0, np.cumsum((np.diff(px[at]) + nx / 2) % nx - nx / 2)]
            if edge[at].any() or round(x[-1] - x[0]) == 0:
                continue
            for mask, points in zip((rising, falling), westward_runs(x, py[at]), strict=True):
                mask[np.floor(py[at][points]).astype(int), np.floor(x[points]).astype(int) % nx] = True
    south = lat[:, None] < 0
    anticyclonic, cyclonic = np.where(south, rising, falling), np.where(south, falling, rising)
    return np.roll(anticyclonic, turn, axis=1)[flip], np.roll(cyclonic, turn, axis=1)[flip]


def rwb_by_contour(g: Grid, cube: DataFrame, v: str, lats: list[float], lons: list[float], kind: str = "PV", contours: int = 21) -> DataFrame:
    """(t, j, i, beta_a, beta_c) of cells on overturned parts of contours: 1 where they break anticyclonically, cyclonically; others have no row.

    ``kind`` names the contours' levels (``CONTOURS``).  A contour that breaks in
    the northern hemisphere by falling back from north to south is anticyclonic,
    in the southern one cyclonic.  The grid must be cyclic.
    """
    if not g.cyclic:
        raise ValueError("contours around the globe need a cyclic grid")
    levels, lat, lon = contour_levels(kind, contours), np.asarray(lats, float), np.asarray(lons, float)

    def kernel(a):
        anticyclonic, cyclonic = breaking_cells(a["v"], lat, lon, levels)
        j, i = np.nonzero(anticyclonic | cyclonic)
        return pd.DataFrame({"j": j.astype("int32"), "i": i.astype("int32"), "beta_a": anticyclonic[j, i].astype("int32"), "beta_c": cyclonic[j, i].astype("int32")})

    return per_slice(g, cube.select("t", "j", "i", F.col(v).alias("v")), kernel, "j int, i int, beta_a int, beta_c int")
