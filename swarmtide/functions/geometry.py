"""Column expressions for periodic geometry. All run inside generated code; none needs Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def min_image(dx: Column, box: float | None) -> Column:
    """Nearest image of a separation, wrapped once; bounds are strict. No box: as it is."""
    if box is None:
        return dx
    half = box / 2
    return F.when(dx > half, dx - box).when(dx < -half, dx + box).otherwise(dx)


def wrap(x: Column, box: float) -> Column:
    """Position in [0, box)."""
    inside = x - F.floor(x / box) * box
    return F.when((x >= 0) & (x < box), x).when(inside >= box, F.lit(0.0)).otherwise(inside)


def squared(columns) -> Column:
    return reduce(lambda a, b: a + b, (c * c for c in columns))


def separation(a: tuple, b: tuple, box: float | None) -> list[Column]:
    return [min_image(x - y, box) for x, y in zip(a, b)]


def distance2(a: tuple, b: tuple, box: float | None = None) -> Column:
    return squared(separation(a, b, box))


def distance(a: tuple, b: tuple, box: float | None = None) -> Column:
    return F.sqrt(distance2(a, b, box))


def relative_velocity(v: tuple, v0: tuple, x: tuple, x0: tuple, hubble: float, scale: float, box: float | None) -> list[Column]:
    """v - v0 + H a (x - x0), the last at nearest image."""
    return [a - b + hubble * scale * d for a, b, d in zip(v, v0, separation(x, x0, box))]


def cell(x: Column, step: float, cells: int, periodic: bool) -> Column:
    """Grid index of a coordinate: modulo the grid if periodic, else clamped to it."""
    i = F.floor(x / step)
    return (F.pmod(i, F.lit(cells)) if periodic else F.least(F.greatest(i, F.lit(0)), F.lit(cells - 1))).cast("long")


def cell_index(i: Column, j: Column, k: Column, cells: int) -> Column:
    return i + j * cells + k * cells * cells


def neighbour_range(n: Column, density: Column) -> Column:
    """Radius of a sphere that holds n points at a density."""
    return F.pow(3 * n / (4 * F.pi() * density), F.lit(1 / 3))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def spherical_basis(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Unit vectors outward, along the azimuth and along the meridian, as arrays.

    The meridian's vector leans inward: upward above the plane, downward below it, straight up in it. On the axis the
    azimuth points along x and the meridian along y; at the origin ``radial`` is null.
    """
    p2 = x * x + y * y
    p, r = F.sqrt(p2), F.sqrt(p2 + z * z)
    axis = p2 == 0

    def vector(*parts: tuple[float, Column]) -> Column:
        return F.array(*(F.when(axis, F.lit(at_axis)).otherwise(c) for at_axis, c in parts))

    lean = F.abs(z) / (p * r)
    up = F.when(z < 0, -p / r).otherwise(p / r)
    return {
        "radial": F.when(r > 0, F.array(x / r, y / r, z / r)),
        "azimuth": vector((1.0, -y / p), (0.0, x / p), (0.0, F.lit(0.0))),
        "meridian": vector((0.0, -x * lean), (1.0, -y * lean), (0.0, up)),
    }


def kernel(r: Column, h: Column) -> Column:
    """Cubic spline of compact support h, normalised in three dimensions."""
    u = r / h
    inner = 8 / F.pi() * (1 + 6 * (u - 1) * u * u)
    return F.when(u < 0.5, inner).otherwise(16 / F.pi() * F.pow(1 - u, F.lit(3))) / F.pow(h, F.lit(3))
