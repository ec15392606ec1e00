"""Finite differences on cubes; dx, dy and dz are double spacings.

All functions take a Grid and column names and return Columns (NULL beyond edges
that aren't cyclic).  Second derivatives divide by the square of the double
spacing, a quarter of the textbook value, which the thresholds are tuned to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import Grid, ratio


def ddx(g: Grid, v: str, dx: str = "dx") -> Column:
    """First derivative in x."""
    return ratio(g.x(v, 1) - g.x(v, -1), F.col(dx))


def ddy(g: Grid, v: str, dy: str = "dy") -> Column:
    """First derivative in y."""
    return ratio(g.y(v, 1) - g.y(v, -1), F.col(dy))


def ddz(g: Grid, v: str, dz: str = "dz") -> Column:
    """First derivative in z."""
    return ratio(g.z(v, 1) - g.z(v, -1), F.col(dz))


def _fourth_order(near: Column, far: Column, d: Column) -> Column:
    return ratio(8 * near - far, 6 * d)


def ddx_o4(g: Grid, v: str, dx: str = "dx") -> Column:
    """First derivative in x, of fourth order."""
    return _fourth_order(g.x(v, 1) - g.x(v, -1), g.x(v, 2) - g.x(v, -2), F.col(dx))


def ddy_o4(g: Grid, v: str, dy: str = "dy") -> Column:
    """First derivative in y, of fourth order."""
    return _fourth_order(g.y(v, 1) - g.y(v, -1), g.y(v, 2) - g.y(v, -2), F.col(dy))


def ddx2(g: Grid, v: str, dx: str = "dx") -> Column:
    """Second difference in x."""
    return ratio(g.x(v, 1) - 2 * F.col(v) + g.x(v, -1), F.col(dx) * F.col(dx))


def ddy2(g: Grid, v: str, dy: str = "dy") -> Column:
    """Second difference in y."""
    return ratio(g.y(v, 1) - 2 * F.col(v) + g.y(v, -1), F.col(dy) * F.col(dy))


def ddxy(g: Grid, v: str) -> Column:
    """Mixed derivative of a variable whose neighbours ``Grid.neighbours`` has added."""
    c = {d: F.col(f"{v}_{d}") for d in ("ne", "nw", "se", "sw")}
    return ratio(c["ne"] - c["nw"] - c["se"] + c["sw"], F.col("dx") * F.col("dy"))


def ddz_on_q(g: Grid, v: str, q: str) -> Column:
    """Derivative with respect to q across unevenly spaced levels."""
    up, low = F.col(q) - g.z(q, 1), g.z(q, -1) - F.col(q)
    below, above = g.z(v, -1) - F.col(v), F.col(v) - g.z(v, 1)
    return ratio(ratio(up, low) * below + ratio(low, up) * above, up + low)


def ddx_on_q(g: Grid, v: str, q: str) -> Column:
    """x derivative along surfaces of q: without the part that the slope of q brings in."""
    return ddx(g, v) - ddz_on_q(g, v, q) * ddx(g, q)


def ddy_on_q(g: Grid, v: str, q: str) -> Column:
    """y derivative along surfaces of q."""
    return ddy(g, v) - ddz_on_q(g, v, q) * ddy(g, q)


def grad(g: Grid, v: str) -> tuple[Column, Column]:
    """(x, y) gradient, NULL where either part is."""
    x, y = ddx(g, v), ddy(g, v)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def grad_3d(g: Grid, v: str) -> tuple[Column, Column, Column]:
    """(x, y, z) gradient."""
    x, y = grad(g, v)
    return x, y, ddz(g, v)


def lap2(g: Grid, v: str) -> Column:
    """Sum of the second differences."""
    return ddx2(g, v) + ddy2(g, v)


def antilap2(g: Grid, v: str) -> Column:
    """Difference of the second differences."""
    return ddx2(g, v) - ddy2(g, v)
