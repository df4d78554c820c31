"""Space-filling-curve cell codes as Spark expressions and numpy twins.

Morton codes interleave the bits of grid coordinates. A code shifted right by
``k`` bits per axis names the aligned block of ``2^k`` cells per axis, which is
one contiguous range of codes; joining on shifted codes is therefore a join of
points with ranges of sorted codes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from roadframe.model import EARTH_RADIUS_M

#: Levels of the longitude/latitude quadtree: 2^16 columns and rows, about 600 m at the equator.
LEVELS = 16


#: Shifts and masks that move bit i to bit 2i (16 bits) and to bit 3i (21 bits).
_BY_TWO = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))
_BY_THREE = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(values: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """Spread the bits of every array entry; one array step per shift keeps the expression linear in size."""
    def step(shift: int, mask: int) -> Callable[[Column], Column]:
        return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))

    for shift, mask in steps:
        values = F.transform(values, step(shift, mask))
    return values


def spread2(*values: Column) -> Column:
    return _spread(F.array(*[v.cast("long") for v in values]), _BY_TWO)


def spread3(*values: Column) -> Column:
    return _spread(F.array(*[v.cast("long") for v in values]), _BY_THREE)


def interleave(*spread: Column) -> Column:
    """Morton code of coordinates whose bits are already spread."""
    code = spread[0]
    for k, s in enumerate(spread[1:], 1):
        code = code.bitwiseOR(F.shiftleft(s, k))
    return code


def morton2_int(x: int, y: int) -> int:
    code = 0
    for i in range(LEVELS):
        code |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
    return code


def grid_index(value: Column, low: float, span: float) -> Column:
    """Column or row of the finest quadtree level; the upper border belongs to the last one."""
    n = 1 << LEVELS
    return F.least(F.greatest(F.floor((value - low) * (n / span)), F.lit(0)), F.lit(n - 1))


def lonlat_spread(lon: Column, lat: Column) -> Column:
    """Array of two: the spread column and row of the finest quadtree level."""
    return spread2(grid_index(lon, -180.0, 360.0), grid_index(lat, -90.0, 180.0))


def sphere_xyz(lon: Column, lat: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column, Column]:
    """Cartesian coordinates in metres; no seam at the poles or at longitude 180."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b) * radius, F.cos(a) * F.sin(b) * radius, F.sin(a) * radius


def segments_meet_box(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which segments touch the closed box (x0, y0, x1, y1): bounding boxes overlap and the corners are not all on one side."""
    bx0, by0, bx1, by1 = box
    near = (np.minimum(x1, x2) <= bx1) & (np.maximum(x1, x2) >= bx0) & (np.minimum(y1, y2) <= by1) & (np.maximum(y1, y2) >= by0)
    dx, dy = x2 - x1, y2 - y1
    side = [dx * (cy - y1) - dy * (cx - x1) for cx, cy in ((bx0, by0), (bx1, by0), (bx0, by1), (bx1, by1))]
    return near & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def odd_crossings(px: float, py: float, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> bool:
    """Whether a point lies inside closed rings given as segments (even-odd rule, so holes are outside)."""
    straddle = (y1 <= py) != (y2 <= py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (py - y1) / (y2 - y1) * (x2 - x1)
    return bool(np.count_nonzero(straddle & (at > px)) % 2)
