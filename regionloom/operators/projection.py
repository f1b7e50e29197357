"""Map projections and framing as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import wrap_longitude

#: The authalic radius in metres and the Equal Earth polynomial.
RADIUS = 6_371_007.181
A1, A2, A3, A4 = 1.340264, -0.081106, 0.000893, 0.003796


def _clip0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def laea(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area."""
    s0, c0 = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    lam, phi = F.radians(wrap_longitude(lon - lon0)), F.radians(lat)
    towards = F.cos(phi) * F.cos(lam)
    k = F.sqrt(F.lit(2.0) / F.greatest(F.lit(1.0) + F.sin(phi) * s0 + towards * c0, F.lit(2.220446049250313e-16))) * RADIUS
    return k * F.cos(phi) * F.sin(lam), k * (F.sin(phi) * c0 - towards * s0)


def _cone(lon: Column, lon0: float, n: float, r: Column, r0: float) -> tuple[Column, Column]:
    theta = F.radians(wrap_longitude(lon - lon0)) * n
    return r * F.sin(theta), F.lit(r0) - r * F.cos(theta)


def albers(lon: Column, lat: Column, lon0: float, lat0: float, south: float, north: float) -> tuple[Column, Column]:
    """Albers equal-area conic."""
    s1, s2 = math.sin(math.radians(south)), math.sin(math.radians(north))
    n = (s1 + s2) / 2
    c = math.cos(math.radians(south)) ** 2 + 2 * n * s1
    r0 = RADIUS * math.sqrt(max(c - 2 * n * math.sin(math.radians(lat0)), 0)) / n
    return _cone(lon, lon0, n, F.sqrt(_clip0(F.lit(c) - F.sin(F.radians(lat)) * (2 * n))) * (RADIUS / n), r0)


def lambert_conic(lon: Column, lat: Column, lon0: float, lat0: float, south: float, north: float) -> tuple[Column, Column]:
    """Lambert conformal conic; latitudes stop half a degree before the poles."""
    a, b = math.radians(south), math.radians(north)
    half = lambda x: math.tan(math.pi / 4 + x / 2)
    n = math.sin(a) if abs(a - b) < 1e-10 else math.log(math.cos(a) / math.cos(b)) / math.log(half(b) / half(a))
    f = RADIUS * math.cos(a) * half(a) ** n / n
    edge = math.radians(89.5)
    phi = F.least(F.greatest(F.radians(lat), F.lit(-edge)), F.lit(edge))
    r = F.lit(f) / F.pow(F.tan(F.lit(math.pi / 4) + phi / 2.0), F.lit(n))
    return _cone(lon, lon0, n, r, f / half(max(-edge, min(edge, math.radians(lat0)))) ** n)


def equal_earth(lon: Column, lat: Column, lon0: float) -> tuple[Column, Column]:
    """Equal Earth; +-180 degrees from the centre stay on their own side."""
    d = lon - lon0
    near = F.abs(d) <= 180.0 + 1e-6
    lam = F.radians(F.when(near, F.least(F.greatest(d, F.lit(-180.0)), F.lit(180.0))).otherwise(wrap_longitude(d)))
    theta = F.asin(F.sin(F.radians(lat)) * (math.sqrt(3) / 2))
    t2 = theta * theta
    t6 = t2 * t2 * t2
    x = lam * F.cos(theta) * (2 * math.sqrt(3) * RADIUS) / ((t6 * t2 * (9 * A4) + t6 * (7 * A3) + t2 * (3 * A2) + A1) * 3.0)
    return x, theta * (t2 * A2 + A1 + t6 * (t2 * A4 + A3)) * RADIUS


def one_sixth_parallels(south: float, north: float) -> tuple[float, float]:
    """Standard parallels a sixth of the range from its ends, kept off the equator's symmetry."""
    sixth = (north - south) / 6
    low, high = south + sixth, north - sixth
    if abs(low + high) < 1:
        low = max(low, 1.0)
        high = max(high, low + 1)
    return low, high


def choose_projection(span: float | None, lat0: float, is_box: bool = False) -> str:
    """'equal_earth' without extent or beyond 200 degrees; 'albers' for wide middle latitudes; else 'laea'."""
    if span is None or span > 200:
        return "equal_earth"
    return "albers" if span >= 45 and 20 <= abs(lat0) <= 70 and not is_box else "laea"


def fit(frame: tuple[float, float, float, float], width: float, height: float, margin: float = 0.0) -> tuple[float, float, float]:
    """Scale and offsets that centre a frame (x0, y0, x1, y1) in a viewport."""
    x0, y0, x1, y1 = frame
    scale = min((width - 2 * margin) / (x1 - x0), (height - 2 * margin) / (y1 - y0))
    return scale, width / 2 - scale * (x0 + x1) / 2, height / 2 + scale * (y0 + y1) / 2


def to_pixels(x: Column, y: Column, scale: float, dx: float, dy: float) -> tuple[Column, Column]:
    return x * scale + dx, F.lit(dy) - y * scale


def near_extent(lon: Column, lat: Column, start: float, length: float, south: float, north: float, pad_lat: float = 5.0) -> Column:
    """Inside a circular longitude window padded by half its span plus 5 degrees, and the latitudes."""
    pad = length / 2 + 5
    inside = F.pmod(lon - (start - pad), F.lit(360.0)) <= min(length + 2 * pad, 360.0)
    return inside & lat.between(south - pad_lat, north + pad_lat)


def context_box(west: Column, south: Column, east: Column, north: Column) -> tuple[Column, ...]:
    """The subject's box widened by half its size plus 5 degrees and clamped; null if over 180 degrees wide."""
    px, py = (east - west) * 0.5 + 5.0, (north - south) * 0.5 + 5.0
    clamp = lambda c, a: F.least(F.greatest(c, F.lit(-a)), F.lit(a))
    ok = east - west <= 180.0
    return tuple(F.when(ok, x) for x in (clamp(west - px, 180.0), clamp(south - py, 90.0), clamp(east + px, 180.0), clamp(north + py, 90.0)))


def inset_size(width: float, height: float, share: Column, aspect: Column) -> tuple[Column, Column]:
    """Inset width and height: a quarter of the short side by 1.6 * share^(1/4) within .55 and 1."""
    side = F.lit(0.25 * min(width, height)) * F.least(F.greatest(F.pow(share, F.lit(0.25)) * 1.6, F.lit(0.55)), F.lit(1.0))
    a = F.least(F.greatest(aspect, F.lit(0.4)), F.lit(2.5))
    return F.when(a >= 1, side).otherwise(side * a), F.when(a >= 1, side / a).otherwise(side)
