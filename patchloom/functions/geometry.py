"""Expressions over pixel arrays, affine transforms and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_index(angle: int, r: Column, c: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """Where a pixel lands after a clockwise turn by 90, 180 or 270 degrees."""
    return {90: (c, h - 1 - r), 180: (h - 1 - r, w - 1 - c), 270: (w - 1 - c, r)}[check_angle(angle)]


def rotate_array(angle: int, data: Column, h: Column, w: Column) -> Column:
    """A row-major array turned clockwise, by index arithmetic; null stays null."""
    new_w = w if check_angle(angle) == 180 else h

    def old(i: Column) -> Column:
        r, c = F.floor(i / new_w), i % new_w
        row, col = {90: (h - 1 - c, r), 180: (h - 1 - r, w - 1 - c), 270: (c, w - 1 - r)}[angle]
        return row * w + col

    return F.when(data.isNotNull(), F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: F.element_at(data, (old(i) + 1).cast("int"))))


def check_angle(angle: int) -> int:
    if angle not in (90, 180, 270):
        raise ValueError(f"angle must be 90, 180 or 270, not {angle}")
    return angle


def rotate_transform(angle: int, t: list[Column], h: Column, w: Column, compat: bool = False) -> list[Column]:
    """The affine transform (a, b, c, d, e, f) after a turn. Offsets keep the footprint of a corner
    origin; compat gives those of pixel centres, which shift the result by one pixel."""
    a, b, c, d, e, f = t
    k = 1 if compat else 0
    hh, ww = h - k, w - k
    if check_angle(angle) == 90:
        return [-b, a, a * 0 + b * hh + c, -e, d, e * hh + f]
    if angle == 180:
        return [-a, -b, a * ww + b * hh + c, -d, -e, d * ww + e * hh + f]
    return [b, -a, a * ww + c, e, -d, d * ww + f]


def window_origin(t: list[Column], row: Column, col: Column) -> list[Column]:
    a, b, c, d, e, f = t
    return [a, b, c + col * a + row * b, d, e, f + col * d + row * e]


def normalize_box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> list[Column]:
    """Inclusive pixel boxes to [0, 1], right and lower edges exclusive; reversed ends are swapped and
    empty sides widened by a millionth. No pixels at all give an error."""
    eps = 1e-6
    sure = lambda n: F.when(n > 0, n.cast("double")).otherwise(F.raise_error("a box needs a patch with pixels").cast("double"))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    out = []
    for lo, hi, n in ((x1, x2, sure(w)), (y1, y2, sure(h))):
        p, q = clip(lo / n), clip((hi + 1) / n)
        p, q = F.least(p, q), F.greatest(p, q)
        thin = q <= p
        out.append((F.when(thin & (p >= 1), 1.0 - eps).otherwise(p), F.when(thin & (p < 1), F.least(F.lit(1.0), p + eps)).otherwise(q)))
    (nx1, nx2), (ny1, ny2) = out
    return [nx1, ny1, nx2, ny2]


def is_close(v: Column, to: Column) -> Column:
    return F.abs(v - to) <= 1e-8 + 1e-5 * F.abs(to)


def any_band_valid(bands: Column, nodata: Column) -> Column:
    """A pixel counts if any band differs from nodata, or from 0 where nodata is null."""
    return F.exists(bands, lambda v: F.when(nodata.isNull(), v != 0).otherwise(~is_close(v, nodata) | F.isnan(nodata)))


def ring_area(xs: Column, ys: Column) -> Column:
    """Planar area of a closed ring by the shoelace sum."""
    n = F.size(xs)
    at = lambda a, i: F.element_at(a, (i % n + 1).cast("int"))
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i))
    return F.abs(twice) / 2


def inside_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd crossings of a ray to the right."""
    n = F.size(xs)
    at = lambda a, i: F.element_at(a, (i % n + 1).cast("int"))

    def crossing(i: Column) -> Column:
        x0, y0, x1, y1 = at(xs, i), at(ys, i), at(xs, i + 1), at(ys, i + 1)
        return ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / F.when(y1 != y0, y1 - y0) + x0)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crossing(i), F.lit(False)))) % 2 == 1


def boxes_meet(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    return (ax1 <= bx2) & (bx1 <= ax2) & (ay1 <= by2) & (by1 <= ay2)


def point_box(x: Column, y: Column, side_km: float) -> list[Column]:
    half = side_km * 1000 / 2
    return [x - half, y - half, x + half, y + half]


def area_threshold(valid: Column, min_px: int, min_frac: float) -> Column:
    return F.greatest(F.lit(min_px), F.ceil(F.lit(min_frac) * F.greatest(valid, F.lit(1))))


LN5 = math.log(5)
