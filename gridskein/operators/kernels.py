"""Numpy kernels on single horizontal slices, without Spark.

Arrays have the shape (ny, nx); x wraps if ``cyclic``.
"""

from __future__ import annotations

import numpy as np

NEAR4 = ((0, 1), (1, 0), (0, -1), (-1, 0))
NEAR8 = (*NEAR4, (1, 1), (1, -1), (-1, 1), (-1, -1))


def shifted(a: np.ndarray, dj: int, di: int, cyclic: bool, fill) -> np.ndarray:
    """a[j + dj, i + di] at [j, i]; ``fill`` beyond the edges."""
    out = np.roll(a, (-dj, -di), (-2, -1)).copy()
    if dj:
        out[..., slice(-dj, None) if dj > 0 else slice(0, -dj), :] = fill
    if di and not cyclic:
        out[..., slice(-di, None) if di > 0 else slice(0, -di)] = fill
    return out


def label(mask: np.ndarray, cyclic: bool, diagonal: bool = False) -> np.ndarray:
    """Components of a mask of two or three dimensions, numbered from 1 by their first cell with x outermost.

    Four neighbours in a slice, or all that touch (26 with levels) if ``diagonal``.
    """
    cube = mask if mask.ndim == 3 else mask[None]
    nz, ny, nx = cube.shape
    order = np.transpose(np.arange(cube.size).reshape(nx, ny, nz), (2, 1, 0))  # places with x outermost
    parent = np.where(cube, order, -1).ravel()
    first = np.full(cube.size, -1)
    first[order.ravel()] = np.arange(cube.size)
    root = {int(order.ravel()[c]): int(order.ravel()[c]) for c in np.flatnonzero(cube)}

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    steps = [(0, *s) for s in NEAR4[:2]] + ([(1, 0, 0)] if nz > 1 else [])
    if diagonal:
        steps = [(k, j, i) for k in (-1, 0, 1) for j in (-1, 0, 1) for i in (-1, 0, 1) if (k, j, i) > (0, 0, 0)]
    for dk, dj, di in steps:
        near = shifted(np.where(cube, order, -1), dj, di, cyclic, -1)
        if dk:
            near = np.concatenate([near[dk:], np.full((dk, ny, nx), -1)])
        both = cube & (near >= 0)
        for a, b in zip(order[both].tolist(), near[both].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = np.array([find(int(p)) if p >= 0 else -1 for p in parent])
    kinds = np.unique(found[found >= 0])
    out = np.where(found >= 0, np.searchsorted(kinds, found) + 1, 0).reshape(cube.shape)
    return out.reshape(mask.shape)


def flood_from(values: np.ndarray, seeds: list[tuple[int, int]], threshold: float, cyclic: bool) -> np.ndarray:
    """Cells of at least ``threshold`` that four-neighbours connect with seeds; a seed below it is an error."""
    if any(not values[s] >= threshold for s in seeds):
        raise ValueError("a seed lies below the threshold")
    parts = label(np.nan_to_num(values, nan=-np.inf) >= threshold, cyclic)
    return np.isin(parts, [parts[s] for s in seeds]) & (parts > 0)


def fill_missing(values: np.ndarray, cyclic: bool = True, sweeps: int = 300, omega: float = 1.5) -> np.ndarray:
    """Missing cells by successive over-relaxation of Laplace's equation, from zero; y edges mirror.

    Sweeps are in red-black order, so a sweep is four array operations.
    """
    gone = np.isnan(values)
    out = np.where(gone, 0.0, values)
    jj, ii = np.indices(values.shape)
    for _ in range(sweeps):
        for colour in (0, 1):
            up = np.vstack([out[1:], out[-2:-1]])
            down = np.vstack([out[1:2], out[:-1]])
            mean = (shifted(out, 0, 1, cyclic, 0.0) + shifted(out, 0, -1, cyclic, 0.0) + up + down) / 4
            here = gone & ((jj + ii) % 2 == colour)
            out[here] += omega * (mean[here] - out[here])
    return out


def distance_km(lat1, lon1, lat2, lon2, radius: float = 6370.0):
    """Great-circle distance, the cosine clipped."""
    a, b = np.radians(lat1), np.radians(lat2)
    c = np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(np.subtract(lon2, lon1)))
    return radius * np.arccos(np.clip(c, -1, 1))


def _around(j: int, i: int, ny: int, nx: int):
    for dj, di in NEAR8:
        if 0 <= j + dj < ny:
            yield j + dj, (i + di) % nx


def cyclones_by_contour(msl, oro, lat, lon, area, min_size, max_size, max_oro, min_distance, min_prominence):
    """(labels, table) of lows by growing regions in order of pressure; table rows: id, lat, lon, lowest, outermost, size.

    A cell without labelled neighbours that is a strict minimum over low ground
    starts a low, or joins one whose centre is near; a cell between regions, or
    beyond the largest size, ends those it touches.
    """
    ny, nx = msl.shape
    labels = np.zeros((ny, nx), int)
    lows: list[dict] = []
    for cell in np.lexsort((np.tile(np.arange(nx), ny), np.repeat(np.arange(ny), nx), msl.ravel())):
        j, i = divmod(int(cell), nx)
        value = msl[j, i]
        if np.isnan(value):
            continue
        near = list(_around(j, i, ny, nx))
        seen = {int(labels[c]) for c in near} - {0}
        join = None
        if not seen:
            if value < min(msl[c] for c in near) and oro[j, i] < max_oro:
                close = [k for k, low in enumerate(lows) if distance_km(lat[j, i], lon[j, i], low["lat"], low["lon"]) < min_distance]
                if close:
                    join = close[0]
                else:
                    lows.append({"lat": float(lat[j, i]), "lon": float(lon[j, i]), "lowest": float(value), "outer": float(value), "size": float(area[j, i]), "done": False})
                    labels[j, i] = len(lows)
                    continue
        elif len(seen) == 1 and -1 not in seen:
            join = seen.pop() - 1
        else:
            for k in seen - {-1}:
                lows[k - 1]["done"] = True
        labels[j, i] = -1
        if join is not None and not lows[join]["done"]:
            low = lows[join]
            if low["size"] + area[j, i] > max_size:
                low["done"] = True
            else:
                low["outer"], low["size"] = float(value), low["size"] + float(area[j, i])
                labels[j, i] = join + 1
    labels[labels < 0] = 0
    table = []
    for k, low in enumerate(lows, 1):
        if low["outer"] - low["lowest"] < min_prominence or low["size"] < min_size:
            labels[labels == k] = 0
        else:
            table.append((k, low["lat"], low["lon"], low["lowest"], low["outer"], low["size"]))
    return labels, table


def blobs(rain, lat, lon, area, min_distance):
    """(labels, table) of rain objects by a watershed from the peaks; table rows: id, lat, lon, peak, size.

    A peak nearer than ``min_distance`` to an earlier one's joins that object.
    """
    ny, nx = rain.shape
    labels = np.zeros((ny, nx), int)
    peaks: list[list] = []
    for cell in np.lexsort((np.tile(np.arange(nx), ny), np.repeat(np.arange(ny), nx), -np.nan_to_num(rain.ravel()))):
        j, i = divmod(int(cell), nx)
        if not rain[j, i] > 0:
            break
        near = list(_around(j, i, ny, nx))
        best = max(int(labels[c]) for c in near)
        if best:
            labels[j, i] = best
        elif rain[j, i] > max(np.nan_to_num(rain[c]) for c in near):
            far = [float(distance_km(lat[j, i], lon[j, i], p[0], p[1])) for p in peaks]
            if far and min(far) <= min_distance:
                labels[j, i] = int(np.argmin(far)) + 1
            else:
                peaks.append([float(lat[j, i]), float(lon[j, i]), float(rain[j, i]), 0.0])
                labels[j, i] = len(peaks)
        if labels[j, i]:
            peaks[labels[j, i] - 1][3] += float(area[j, i])
    return labels, [(k, *p) for k, p in enumerate(peaks, 1)]


def join_line(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, nx: int, cyclic: bool, radius: float, min_length: float) -> list[np.ndarray]:
    """Lines through points in grid coordinates: one for each cluster of points within ``radius``.

    A line is the longest of the shortest paths between the cluster's points over
    steps of at most ``radius``; lengths come from the cells' double spacing.
    """
    n = len(x)
    if not n:
        return []
    di = np.abs(x[:, None] - x[None])
    di = np.minimum(di, nx - di) if cyclic else di
    dj = np.abs(y[:, None] - y[None])
    close = np.hypot(di, dj) <= radius
    jj, ii = np.clip(y.astype(int), 0, dx.shape[0] - 1), x.astype(int) % nx
    length = np.hypot(dx[jj, ii][None] * di / 2, dy[jj, ii][None] * dj / 2)
    left, out = set(range(n)), []
    while left:
        cluster, todo = [], [min(left)]
        left.discard(todo[0])
        while todo:
            a = todo.pop()
            cluster.append(a)
            new = [b for b in np.flatnonzero(close[a]).tolist() if b in left]
            left.difference_update(new)
            todo += new
        at = np.array(sorted(cluster))
        # Shortest ways between all points of the cluster, through one more point at a time.
        way = np.where(close[np.ix_(at, at)], length[np.ix_(at, at)], np.inf)
        way = np.where(np.tri(len(at), dtype=bool), way.T, way)  # the later point's cell gives the length
        np.fill_diagonal(way, 0.0)
        step = np.broadcast_to(np.arange(len(at)), way.shape).copy()  # the next point on the way
        for k in range(len(at)):
            to, on = np.flatnonzero(way[:, k] < np.inf), np.flatnonzero(way[k] < np.inf)  # at first few
            some = np.ix_(to, on)
            known = way[some]
            through = way[to, k, None] + way[None, k, on]
            shorter = through < known
            if shorter.any():
                way[some] = np.where(shorter, through, known)
                step[some] = np.where(shorter, step[to, k, None], step[some])
        start, end = divmod(int(way.argmax()), len(at))
        path = [start]
        while path[-1] != end:
            path.append(int(step[path[-1], end]))
        best = (float(way[start, end]), at[path].tolist())
        if best[0] >= min_length:
            out.append(np.array(best[1]))
    return out


def contour_lines(values: np.ndarray, level: float) -> list[np.ndarray]:
    """Contours (y, x) of a slice by marching squares; closed ones end where they begin. Saddles separate what is low."""
    ny, nx = values.shape
    low = values[:-1, :-1], values[:-1, 1:], values[1:, :-1], values[1:, 1:]
    code = sum((np.nan_to_num(v, nan=-np.inf) > level).astype(int) << k for k, v in enumerate(low))
    code[np.isnan(sum(low))] = 0
    edges: dict[tuple, list[tuple]] = {}

    def point(e):
        kind, j, i = e
        a, b = values[j, i], values[j, i + 1] if kind == "h" else values[j + 1, i]
        f = (level - a) / (b - a)
        return (float(j), i + f) if kind == "h" else (j + f, float(i))

    for j, i in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        j, i, c = int(j), int(i), int(code[j, i])
        top, bottom, left, right = ("h", j, i), ("h", j + 1, i), ("v", j, i), ("v", j, i + 1)
        a, b, d, e = c & 1, c >> 1 & 1, c >> 2 & 1, c >> 3 & 1
        cut = [s for s, on in ((top, a != b), (bottom, d != e), (left, a != d), (right, b != e)) if on]
        if len(cut) == 2:
            pairs = [cut]
        else:  # a saddle: each high corner stays by itself
            pairs = [(top, left), (bottom, right)] if a else [(top, right), (bottom, left)]
        for p, q in pairs:
            edges.setdefault(p, []).append(q)
            edges.setdefault(q, []).append(p)
    out, used = [], set()
    ends = [e for e, near in edges.items() if len(near) == 1]
    for start in sorted(ends) + sorted(edges):
        if start in used:
            continue
        line, here = [start], start
        used.add(start)
        while nxt := [e for e in edges[here] if e not in used]:
            here = nxt[0]
            used.add(here)
            line.append(here)
        if len(line) > 2 and start in edges[here]:
            line.append(start)
        out.append(np.array([point(e) for e in line]))
    return out


def conjugate_gradient(op, b: np.ndarray, x0: np.ndarray | None = None, steps: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Solution of op(x) = b for a symmetric positive operator, and the squared residual."""
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - op(x)
    p, rr = r.copy(), float((r * r).sum())
    for _ in range(steps):
        if rr <= tolerance:
            break
        ap = op(p)
        alpha = rr / float((p * ap).sum())
        x += alpha * p
        r -= alpha * ap
        new = float((r * r).sum())
        p = r + new / rr * p
        rr = new
    return x, rr


def bicgstab(op, b: np.ndarray, x0: np.ndarray | None = None, steps: int = 100, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Solution of op(x) = b for any regular operator, and the squared residual."""
    x = np.zeros_like(b) if x0 is None else x0.copy()
    r = b - op(x)
    first, p = r.copy(), r.copy()
    rho = float((first * r).sum())
    for _ in range(steps):
        if float((r * r).sum()) <= tolerance or rho == 0:
            break
        v = op(p)
        alpha = rho / float((first * v).sum())
        s = r - alpha * v
        t = op(s)
        tt = float((t * t).sum())
        omega = float((t * s).sum()) / tt if tt else 0.0
        x += alpha * p + omega * s
        r = s - omega * t
        new = float((first * r).sum())
        p = r + (new / rho) * (alpha / omega if omega else 0.0) * (p - omega * v)
        rho = new
    return x, float((r * r).sum())


def varimax(loadings: np.ndarray, gamma: float = 1.0, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """Rotated loadings (variables x factors) whose squares vary most."""
    n, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(steps):
        now = loadings @ turn
        u, s, w = np.linalg.svd(loadings.T @ (now**3 - gamma / n * now @ np.diag((now**2).sum(axis=0))))
        turn = u @ w
        if before and s.sum() < before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ turn


def legendre_order(m: int, degree: int, sin_lat: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions P[n - m, lat] of one order, n from m to a degree (integral of the square over sin(lat): 1)."""
    p = np.zeros((degree + 1 - m, len(sin_lat)))
    p[0] = np.sqrt(0.5) * np.prod([np.sqrt((2 * k + 1) / (2 * k)) for k in range(1, m + 1)]) * np.sqrt(1 - sin_lat**2) ** m
    for n in range(m + 1, degree + 1):
        a = np.sqrt((4 * n * n - 1) / (n * n - m * m))
        b = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1)) if n > m + 1 else 0.0
        p[n - m] = a * (sin_lat * p[n - m - 1] - b * (p[n - m - 2] if n > m + 1 else 0))
    return p


def legendre(degree: int, sin_lat: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions P[m, n, lat] up to a degree."""
    p = np.zeros((degree + 1, degree + 1, len(sin_lat)))
    for m in range(degree + 1):
        p[m, m:] = legendre_order(m, degree, sin_lat)
    return p


def harmonics(values: np.ndarray, lats: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients c[m, n] of a field on a regular grid, by Fourier sums in x and least squares over the rows."""
    nx = values.shape[1]
    waves = np.fft.rfft(values, axis=1)[:, : degree + 1].T / nx
    p = legendre(degree, np.sin(np.radians(lats)))
    weight = np.sqrt(np.maximum(np.cos(np.radians(lats)), 1e-6))
    out = np.zeros((degree + 1, degree + 1), complex)
    for m in range(min(degree, nx // 2) + 1):
        out[m, m:] = np.linalg.lstsq((p[m, m:] * weight).T, waves[m] * weight, rcond=None)[0]
    return out


def synthesis(c: np.ndarray, lats: np.ndarray, nx: int) -> np.ndarray:
    """The field of coefficients c[m, n]."""
    degree = c.shape[1] - 1
    waves = np.einsum("mn,mnl->ml", c, legendre(degree, np.sin(np.radians(lats))))
    angles = 2 * np.pi * np.arange(nx) / nx
    m = np.arange(degree + 1)
    basis = np.exp(1j * m[:, None] * angles)
    scale = np.where(m > 0, 2.0, 1.0)
    return np.einsum("ml,mx,m->lx", waves, basis, scale).real


def truncated(c: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients up to a degree."""
    out = c.copy()
    out[:, degree + 1 :] = 0
    out[degree + 1 :] = 0
    return out


def inverse_laplacian(c: np.ndarray, radius: float = 6.37e6) -> np.ndarray:
    """Coefficients of the field whose Laplacian is given."""
    n = np.arange(c.shape[1])
    return c * np.where(n > 0, -(radius**2) / np.maximum(n * (n + 1), 1), 0.0)


def gradient(c: np.ndarray, lats: np.ndarray, nx: int, radius: float = 6.37e6) -> tuple[np.ndarray, np.ndarray]:
    """The gradient (east, north) of coefficients' field, exact for each harmonic; at the poles its component east is zero."""
    degree = c.shape[1] - 1
    phi = np.radians(lats)
    cos = np.cos(phi)
    inverse = np.where(np.abs(cos) > 1e-9, 1 / np.where(cos == 0, 1, cos), 0.0)
    m, n = np.arange(degree + 1)[:, None], np.arange(degree + 2)[None, :]
    p = legendre(degree + 1, np.sin(phi))[: degree + 1]
    e = np.sqrt(np.maximum(n**2 - m**2, 0) / np.maximum(4 * n**2 - 1, 1))
    slope = -n[:, :-1, None] * e[:, 1:, None] * p[:, 1:]
    slope[:, 1:] += (n[:, 1:-1, None] + 1) * e[:, 1:-1, None] * p[:, :-2]
    basis = np.exp(2j * np.pi * m * np.arange(nx) / nx) * np.where(m > 0, 2.0, 1.0)
    north = np.einsum("mn,mnl,mx->lx", c, slope, basis, optimize=True).real
    return synthesis(1j * m * c, lats, nx) * inverse[:, None] / radius, north * inverse[:, None] / radius


def gaussian_latitudes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes in degrees, from south to north, and weights of Gaussian quadrature."""
    x, w = np.polynomial.legendre.leggauss(n)
    return np.degrees(np.arcsin(x)), w


def multigrid(operator, b: np.ndarray, cycles: int = 20, before: int = 2, after: int = 2, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Solution of operator(x, level) = b on a doubly periodic grid by V-cycles, and the squared residual.

    ``operator`` applies the discretised operator on a grid that is 2**level times
    coarser.  Damped Jacobi sweeps smooth; the diagonal comes from the operator
    on an impulse, so it must be the same for all cells.  Grids halve while both
    sizes are even.
    """
    def diagonal(shape, level: int) -> float:
        impulse = np.zeros(shape)
        impulse[0, 0] = 1.0
        return float(operator(impulse, level)[0, 0])

    def cycle(x, rhs, level: int):
        scale = 0.8 / diagonal(rhs.shape, level)
        halves = not any(size % 2 or size < 4 for size in rhs.shape)
        for _ in range(before if halves else 50):
            x = x + scale * (rhs - operator(x, level))
        if not halves:
            return x
        r = rhs - operator(x, level)
        coarse = sum(w * np.roll(r, s, (0, 1)) for w, s in ((0.25, (0, 0)), *((0.125, s) for s in NEAR4), *((0.0625, s) for s in NEAR8[4:])))[::2, ::2]
        fix = np.repeat(np.repeat(cycle(np.zeros_like(coarse), coarse, level + 1), 2, axis=0), 2, axis=1)
        fix[1::2] = (fix[1::2] + np.roll(fix, -1, axis=0)[1::2]) / 2
        fix[:, 1::2] = (fix[:, 1::2] + np.roll(fix, -1, axis=1)[:, 1::2]) / 2
        x = x + fix
        for _ in range(after):
            x = x + scale * (rhs - operator(x, level))
        return x

    x = np.zeros_like(b)
    for _ in range(cycles):
        x = cycle(x, b, 0)
        if float(((b - operator(x, 0)) ** 2).sum()) <= tolerance:
            break
    return x, float(((b - operator(x, 0)) ** 2).sum())


def flow_axes(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Matrices (n, 3, 3) that turn vectors into coordinates along the flow, level to its left, and across both."""
    level, speed = np.hypot(u, v), np.sqrt(u * u + v * v + w * w)
    zero = np.zeros_like(u)
    rows = [[u / speed, v / speed, w / speed], [-v / level, u / level, zero], [-u * w / (level * speed), -v * w / (level * speed), level / speed]]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def deformation_axes(gradient: np.ndarray, part: str, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n, 3), greatest first, and eigenvectors (n, 3, 3; by row) of velocity gradients' deformation."""
    if not len(gradient):
        return np.zeros((0, 3)), np.zeros((0, 3, 3))
    if turn is not None:
        gradient = turn @ gradient
    s = (gradient + gradient.transpose(0, 2, 1)) / 2
    s = s - np.trace(s, axis1=1, axis2=2)[:, None, None] / 3 * np.eye(3)
    if part != "all":
        s = s * (np.eye(3) if part == "stretch" else 1 - np.eye(3))
    e, x = np.linalg.eigh(s)
    x = x[:, :, ::-1].transpose(0, 2, 1)
    if turn is not None:
        x = x @ turn  # the inverse of a rotation is its transpose
    largest = np.take_along_axis(x, np.abs(x).argmax(axis=2)[:, :, None], axis=2)
    return e[:, ::-1], x * np.where(largest < 0, -1.0, 1.0)


def clipped(points: np.ndarray, x: float, right: bool) -> np.ndarray:
    """A polygon's part on one side of a meridian; its edges are cut there."""
    if (points[0] == points[-1]).all():
        points = points[:-1]
    side = points[:, 0] >= x if right else points[:, 0] <= x
    out = []
    for k in range(len(points)):
        a, b = points[k - 1], points[k]
        if side[k - 1] != side[k]:
            out.append(a + (b - a) * ((x - a[0]) / (b[0] - a[0])))
        if side[k]:
            out.append(b)
    return np.array(out + out[:1]).reshape(-1, 2)


def spread_km(j: np.ndarray, i: np.ndarray, lat: np.ndarray, lon: np.ndarray, nx: int, cyclic: bool) -> float:
    """The greatest distance between two cells of an object that lies on one side of the equator; only its rim can have it."""
    own = set(zip(j.tolist(), i.tolist(), strict=True))
    at = (lambda c: c % nx) if cyclic else (lambda c: c)
    rim = [k for k, (b, a) in enumerate(zip(j.tolist(), i.tolist(), strict=True)) if not {(b + 1, a), (b - 1, a), (b, at(a + 1)), (b, at(a - 1))} <= own]
    y, x = np.radians(lat[rim]), np.radians(lon[rim])
    most = 1.0
    for s in range(0, len(rim), 256):
        part = slice(s, s + 256)
        cosine = np.sin(y[part, None]) * np.sin(y) + np.cos(y[part, None]) * np.cos(y) * np.cos(x - x[part, None])
        most = min(most, float(cosine.min()))
    return 6371 * float(np.arccos(max(-1.0, most)))


def long_objects(label, j, i, lat, lon, v, nx: int, cyclic: bool, min_length: float, min_poleward: float | None = None) -> np.ndarray:
    """Which cells, sorted by label, belong to an object on one side of the equator that is longer than ``min_length`` (km), with a mean of ``v`` of that size if asked for.

    Bounds of all objects at once leave few whose cells must be compared.
    """
    starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, bool)
    ends = np.r_[starts[1:], len(label)]
    low, high = np.fmin.reduceat(lat, starts), np.fmax.reduceat(lat, starts)
    good = (low > 0) | (high < 0)
    if min_poleward is not None:
        some = ~np.isnan(v)
        good &= ~(np.abs(np.add.reduceat(np.where(some, v, 0.0), starts) / np.maximum(np.add.reduceat(some.astype(int), starts), 1)) < min_poleward)
    far = (high - low) * 111 > min_length
    y, x = np.radians(lat), np.radians(lon)
    around = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)
    widest = np.sqrt(((np.fmax.reduceat(around, starts) - np.fmin.reduceat(around, starts)) ** 2).sum(axis=1))
    unsure = good & ~far & ~(2 * 6371 * np.arcsin(np.minimum(widest / 2, 1)) < min_length * (1 - 1e-9) - 1e-3)
    for k in np.flatnonzero(unsure):
        own = slice(starts[k], ends[k])
        far[k] = spread_km(j[own], i[own], lat[own], lon[own], nx, cyclic) > min_length
    return np.repeat(good & far, ends - starts)


def distance_from(lat: np.ndarray, lon: np.ndarray, mask_lat: np.ndarray, mask_lon: np.ndarray, r: float = 6.37e6) -> np.ndarray:
    """Distance (m) from each point to the nearest marked one; degrees."""
    y, best = np.radians(lat), np.full(len(lat), -1.0)
    around = np.mod(lon, 360)
    for row in np.unique(mask_lat):
        lons = np.unique(np.mod(mask_lon[mask_lat == row], 360))
        after = np.searchsorted(lons, around)
        apart = np.minimum(*(np.abs(np.mod(lons[k % len(lons)] - around + 180, 360) - 180) for k in (after, after - 1)))
        m = np.radians(row)
        best = np.maximum(best, np.sin(y) * np.sin(m) + np.cos(y) * np.cos(m) * np.cos(np.radians(apart)))
    return r * np.arccos(np.clip(best, -1, 1))
