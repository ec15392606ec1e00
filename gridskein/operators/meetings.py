"""Which tracks come near each other: the kernel of a task that has two parts of the tracks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Pairs of points whose distance is found together, and tracks that are compared with others by common bounds first.
_PAIRS, _STRIPE = 1 << 20, 64
_HALF_WIDTHS = 2 * 7.29e-5 / (0.013 * 10.0)  # the sine of the latitude times this is 1 / Rossby radius (km)


@dataclass(frozen=True)
class Limits:
    """Seconds, and Rossby radii, that points near each other are apart at most."""

    seconds: int
    radii: float


class _Tracks:
    """Points of tracks, one track after the other and each in order of time."""

    def __init__(self, rows: pd.DataFrame, limits: Limits, origin: int, span: int):
        rows = rows.iloc[np.argsort([x[0] % 360 for x in rows["lon"]], kind="stable")]  # neighbours beside each other
        self.ids = rows["id"].to_numpy()
        self.roots = (rows["root"] if "root" in rows else rows["id"]).to_numpy()
        sizes = np.array([len(s) for s in rows["s"]])
        self.s, self.lat, self.lon = (np.concatenate(rows[c].to_list()) for c in ("s", "lat", "lon"))
        self.first = np.cumsum(sizes) - sizes
        self.track = np.repeat(np.arange(len(sizes)), sizes)
        self.block = self.s // limits.seconds
        self.origin, self.span = origin, span
        self.key = self.track * span + (self.s - origin)
        y, x = np.radians(self.lat), np.radians(self.lon)
        self.y, self.cos = y, np.cos(y)
        self.around = np.stack([self.cos * np.cos(x), self.cos * np.sin(x), np.sin(y), self.lat], axis=1)

    def during(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Tracks with points in some blocks of time: their numbers, first point and the one after the last, and the bounds of place and latitude."""
        at = np.flatnonzero((self.block >= first) & (self.block <= last))
        cut = np.flatnonzero(np.r_[True, self.track[at[1:]] != self.track[at[:-1]]]) if len(at) else at
        if not len(at):
            return at, at, at, self.around[at], self.around[at]
        begin = at[cut]
        end = at[np.r_[cut[1:], len(at)] - 1] + 1
        own = self.around[at]
        return self.track[begin], begin, end, np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)


def _chord2(low: np.ndarray, high: np.ndarray, radii: float) -> np.ndarray:
    """The greatest squared chord (of the unit sphere) of near points whose mean latitude is within these bounds."""
    least = np.maximum(np.maximum(low, -high), 0)
    known = (least > 0) & (low >= -90) & (high <= 90)
    angle = np.full(np.shape(least), np.pi)
    angle[known] = np.minimum(np.pi, radii / (np.sin(np.radians(least[known])) * _HALF_WIDTHS) / 6371.0)
    return (2 * np.sin(angle / 2)) ** 2 * (1 + 1e-9) + 1e-12


def _apart2(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squares of the least distances (of the unit sphere) that bounds of two lists leave."""
    apart = np.zeros((len(low_a), len(low_b)))
    for axis in range(3):
        gap = np.maximum(low_a[:, None, axis] - high_b[:, axis], low_b[:, axis] - high_a[:, None, axis])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        apart += gap
    return apart


def _may_meet(low_a, high_a, low_b, high_b, wanted: np.ndarray, radii: float):
    """Wanted pairs of bounds that aren't too far apart for near points, some rows at a time: stripes of neighbours are compared first."""
    cut = np.arange(0, len(low_b), _STRIPE)
    low_s, high_s = np.minimum.reduceat(low_b, cut), np.maximum.reduceat(high_b, cut)
    for row in range(0, len(low_a), _STRIPE):
        mine = slice(row, row + _STRIPE)
        low, high = low_a[mine], high_a[mine]
        one, two = low.min(axis=0)[None], high.max(axis=0)[None]
        near = _apart2(one, two, low_s, high_s)[0] <= _chord2((one[:, 3] + low_s[:, 3]) / 2, (two[:, 3] + high_s[:, 3]) / 2, radii)
        columns = np.flatnonzero(np.repeat(near, _STRIPE)[: len(low_b)] & wanted[mine].any(axis=0))
        if not len(columns):
            continue
        low_c, high_c = low_b[columns], high_b[columns]
        apart = _apart2(low, high, low_c, high_c)
        widest = _chord2((low[:, 3] + low_c[:, 3].min()) / 2, (high[:, 3] + high_c[:, 3].max()) / 2, radii)
        a, c = np.nonzero((apart <= widest[:, None]) & wanted[mine][:, columns])
        good = apart[a, c] <= _chord2((low[a, 3] + low_c[c, 3]) / 2, (high[a, 3] + high_c[c, 3]) / 2, radii)
        yield a[good] + row, columns[c[good]]


def _radii(a: _Tracks, k: np.ndarray, b: _Tracks, m: np.ndarray) -> np.ndarray:
    """Distances of points in Rossby radii of their mean latitude; NaN where that is on the equator."""
    s, t = np.sin((b.y[m] - a.y[k]) / 2), np.sin(np.radians(b.lon[m] - a.lon[k]) / 2)
    km = 2 * 6371.0 * np.arcsin(np.clip(np.sqrt(s * s + a.cos[k] * b.cos[m] * t * t), -1, 1))
    inverse = np.sin(np.radians(np.abs((a.lat[k] + b.lat[m]) / 2))) * _HALF_WIDTHS
    return np.where(inverse != 0, km * inverse, np.nan)


def _has_near(a: _Tracks, at: np.ndarray, b: _Tracks, other: np.ndarray, limits: Limits) -> np.ndarray:
    """Is a point of ``a`` near any point of the track of ``b`` beside it?"""
    key = other * b.span + (a.s[at] - a.origin)
    low, high = np.searchsorted(b.key, key - limits.seconds), np.searchsorted(b.key, key + limits.seconds, "right")
    hit = np.zeros(len(at), bool)
    some = np.flatnonzero(low < high)
    hit[some] = _radii(a, at[some], b, (low[some] + high[some]) // 2) <= limits.radii  # mostly settles it
    rest = some[~hit[some]]
    ends = np.cumsum(high[rest] - low[rest])
    p = 0
    while p < len(rest):
        q = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + _PAIRS)))
        part = rest[p:q]
        n = high[part] - low[part]
        pair = np.repeat(np.arange(len(part)), n)
        m = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + low[part][pair]
        hit[part[pair[_radii(a, at[part][pair], b, m) <= limits.radii]]] = True
        p = q
    return hit


def _first_near(a: _Tracks, b: _Tracks, wanted: np.ndarray, limits: Limits, last: bool) -> np.ndarray:
    """For each wanted pair of tracks the first (or last) point of ``a`` near any of ``b``; -1: none."""
    found = np.full(wanted.shape, -1, np.int32)
    if not wanted.any():
        return found
    wanted = wanted.copy()  # those not yet found
    for t in np.unique(a.block)[:: -1 if last else 1]:
        tracks, begin, end, *bounds = a.during(t, t)
        others, _, _, *theirs = b.during(t - 1, t + 1)
        if not len(others):
            continue
        still = wanted[np.ix_(tracks, others)]
        if not still.any():
            continue
        for run, other in _may_meet(*bounds, *theirs, still, limits.radii):
            mine, other = tracks[run], others[other]
            at = end[run] - 1 if last else begin[run]
            while len(at):
                hit = _has_near(a, at, b, other, limits)
                found[mine[hit], other[hit]] = at[hit]
                wanted[mine[hit], other[hit]] = False
                at = at - 1 if last else at + 1
                more = ~hit & (at >= begin[run] if last else at < end[run])
                run, mine, other, at = run[more], mine[more], other[more], at[more]
    return found


def _tree(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links between numbers below ``n`` are enough to connect what all of them do."""
    x, y, which = np.r_[a, b], np.r_[b, a], np.tile(np.arange(len(a)), 2)
    order = np.argsort(x, kind="stable")
    y, which, starts = y[order], which[order], np.searchsorted(x[order], np.arange(n + 1))
    seen, kept = np.zeros(n, bool), []
    for start in np.unique(x):
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            node = queue.pop()
            part = slice(starts[node], starts[node + 1])
            new = ~seen[y[part]]
            seen[y[part][new]] = True
            queue += y[part][new].tolist()
            kept += which[part][new].tolist()
    return np.array(sorted(kept), int)


def links_between(left: pd.DataFrame, right: pd.DataFrame, same: bool, limits: Limits, min_distance: float, min_hours: float, connecting: tuple[int, ...] | None) -> pd.DataFrame:
    """(a, b, link, root_a, root_b) of the tracks (id, s, lat, lon: arrays in order, root) of two parts, or of one with itself.

    ``connecting``: links of these kinds, and of them only as many as connect what all do, with tracks of the same root connected.
    """
    low = min(int(s[0]) for rows in (left, right) for s in rows["s"])
    high = max(int(s[-1]) for rows in (left, right) for s in rows["s"])
    origin, span = low - limits.seconds, high - low + 3 * limits.seconds
    a, b = (_Tracks(rows, limits, origin, span) for rows in (left, right))
    wanted = np.asarray(a.ids[:, None] < b.ids) if same else np.ones((len(a.ids), len(b.ids)), bool)
    if connecting is None:
        return _table(a, b, *_compared(a, b, wanted, limits, min_distance, min_hours))
    # Tracks known to be connected aren't compared again: some rows first, then ever more.
    first = 0 if same else len(a.ids)
    _, group = np.unique(a.roots if same else np.r_[a.roots, b.roots], return_inverse=True)
    out, row, many = [], 0, _STRIPE
    while row < len(a.ids):
        some = np.zeros_like(wanted)
        mine = slice(row, row + many)
        some[mine] = wanted[mine] & (group[: len(a.ids)][mine][:, None] != group[first:])
        x, y, link = _compared(a, b, some, limits, min_distance, min_hours)
        kept = np.flatnonzero(np.isin(link, [k for k in connecting if k > 0]))
        ends = np.sort(np.stack([group[x[kept]], group[first + y[kept]]]), axis=0)
        kept = kept[np.sort(np.unique(ends, axis=1, return_index=True)[1])]  # one of those between the same two
        kept = kept[_tree(group[x[kept]], group[first + y[kept]], len(group))]
        out.append((x[kept], y[kept], link[kept]))
        for one, two in zip(x[kept], first + y[kept], strict=True):
            group[group == group[two]] = group[one]
        row, many = row + many, 2 * many
    return _table(a, b, *map(np.concatenate, zip(*out, strict=True)))


def _compared(a: _Tracks, b: _Tracks, wanted: np.ndarray, limits: Limits, min_distance: float, min_hours: float) -> tuple[np.ndarray, ...]:
    """Numbers of tracks of ``a`` and of ``b``, of wanted pairs that have a link, and its kind."""
    k0 = _first_near(a, b, wanted, limits, False)
    wanted = k0 >= 0
    k1 = _first_near(a, b, wanted, limits, True)
    m0, m1 = (_first_near(b, a, wanted.T, limits, last).T for last in (False, True))
    x, y = np.nonzero((k0 < k1) & (m0 < m1))
    k0, k1, m0, m1 = (k[x, y] for k in (k0, k1, m0, m1))
    way = (_radii(a, k0, a, k1) + _radii(b, m0, b, m1)) / 2
    hours = ((a.s[k1] - a.s[k0]) / 3600 + (b.s[m1] - b.s[m0]) / 3600) / 2
    link = np.where(way >= min_distance, 1, 0) + np.where(hours >= min_hours, 2, 0)
    kept = np.flatnonzero(link > 0)
    return x[kept], y[kept], link[kept]


def _table(a: _Tracks, b: _Tracks, x: np.ndarray, y: np.ndarray, link: np.ndarray) -> pd.DataFrame:
    """(a, b, link, root_a, root_b) of tracks by their numbers; a is the lesser id."""
    one, two = a.ids[x], b.ids[y]
    turned = np.asarray(one > two, bool)
    return pd.DataFrame({"a": np.where(turned, two, one), "b": np.where(turned, one, two), "link": link.astype("int32"), "root_a": a.roots[x], "root_b": b.roots[y]})
