"""Points, segments and directions, as column expressions on plain coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x0, y0, x1, y1) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def along(px, py, x0, y0, x1, y1) -> Column:
    """Where on the segment, 0 to 1, its closest point to (px, py) lies; 0 for a segment without length."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = ((px - x0) * dx + (py - y0) * dy) / F.when(square == 0, 1.0).otherwise(square)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def segment_distance(px, py, x0, y0, x1, y1) -> Column:
    t = along(px, py, x0, y0, x1, y1)
    return length(px, py, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


def acute_angle(ax, ay, bx, by) -> Column:
    """Degrees between two unit directions, whichever way they point; null if either is."""
    cosine = F.abs(ax * bx + ay * by)
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), cosine))))


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """The direction of a vector; null for none."""
    n = F.sqrt(x * x + y * y)
    return F.when(n > 0, x / n), F.when(n > 0, y / n)


def perpendicular(x: Column, y: Column) -> tuple[Column, Column]:
    return -y, x


def truncate(x: Column) -> Column:
    """Toward zero, as an int conversion does."""
    return x.cast("int")


def to_world(row, col, a, e, c, f) -> tuple[Column, Column]:
    """A pixel corner's place under x = a col + c, y = e row + f."""
    return col * a + c, row * e + f


def to_pixel(x, y, a, e, c, f) -> tuple[Column, Column]:
    """(row, col), fractional."""
    return (y - f) / e, (x - c) / a


def utm_32(lon: Column, lat: Column) -> tuple[Column, Column]:
    """ETRS89 / UTM zone 32 N by the Krueger series to the third order in n (GRS 80)."""
    import math

    f = 1 / 298.257222101
    n = f / (2 - f)
    big_a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(e) * F.atanh(F.lit(e) * sin_lat))
    d = F.radians(lon - 9.0)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * big_a * east, 0.9996 * big_a * north
