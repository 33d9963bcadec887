"""Geographic functions: column expressions where arithmetic suffices, numpy over Arrow batches for projections and geodesics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
#: Central meridians and false origins (x, y) of the regional systems, Krassovsky ellipsoid.
OLD_ZONES = {
    "мск162": (78, 62728.20, -7546013.80), "мск163": (81, 65425.70, -7434483.20), "мск164": (84, 86209.80, -6542783.50), "мск165": (87, 105295.80, -5652185.00), "мск166": (90, 107543.30, -5540944.50),
    "мск167": (93, 106797.80, -5578022.50), "мск168": (96, 108285.20, -5503868.60), "мск169": (99, 117308.60, -5503868.60), "мск170": (102, 90338.90, -6357146.10), "мск171": (105, 87870.50, -6468522.70),
}
#: The six-degree zones share their false northing; the easting is 1,500,000 m and a million more per zone.
WIDE_ZONES = {f"мск24зона{k}": (75.51666667 + 6 * k, 500_000 + 1_000_000 * k, -5416586.442) for k in range(1, 7)}
ZONES = OLD_ZONES | WIDE_ZONES
#: Krassovsky to WGS84: shifts in metres, rotations in arc seconds, scale in parts per million.
HELMERT = (23.57, -140.95, -79.8, 0.0, 0.35, 0.79, -0.22)
KRASSOVSKY, WGS84 = (6378245.0, 1 / 298.3), (6378137.0, 1 / 298.257223563)


def dms(text: Column) -> Column:
    """Degrees, minutes and seconds as signed decimal degrees; S, W, Ю, З make it negative; null unless all three are there."""
    t = F.replace(text, F.lit(","), F.lit("."))
    part = lambda k: F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*°\s*(\d+(?:\.\d+)?)\s*['′’]\s*(\d+(?:\.\d+)?)", k).try_cast("double")
    size = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(F.upper(t).rlike("[SWЮЗ]"), -size).otherwise(size)


def normal_dms(text: Column) -> Column:
    """'" 55 45 30 "' as '55"45"30' (GEO-03): blanks become quotes, leading zeros of each part go."""
    bare = F.trim(F.replace(F.trim(text), F.lit('"'), F.lit("")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"(^| )0(?=\d)", "$1"), " ", '"')


def zone(lat: Column, lon: Column) -> Column:
    """The regional system of a point: three-degree zones at latitudes 50 to 60, else six-degree zones, else wgs84."""
    old = F.floor((lon - 76.5) / 3).cast("int")
    wide = F.floor((lon - 78) / 6).cast("int")
    return (
        F.when(lat.between(50, 60) & (lon >= 76.5) & (lon < 106.5), F.concat(F.lit("мск"), (old + 162).cast("string")))
        .when((lon >= 78) & (lon < 114), F.concat(F.lit("мск24зона"), (wide + 1).cast("string")))
        .otherwise("wgs84")
    )


def ring_area(ring: Column) -> Column:
    """Signed area in m² of array<struct<lat,lon>> by a local equirectangular shoelace; 0.0 below three points.

    The sign tells the orientation. Origin is the first point.
    """
    scale = 2 * math.pi * RADIUS / 360
    first = F.element_at(ring, 1)
    flat = F.transform(ring, lambda p: F.struct(((p["lon"] - first["lon"]) * scale * F.cos(F.radians(p["lat"]))).alias("x"), ((p["lat"] - first["lat"]) * scale).alias("y")))
    pairs = F.zip_with(F.slice(flat, 1, F.size(flat) - 1), F.slice(flat, 2, F.size(flat) - 1), lambda a, b: (a["y"] * b["x"] - a["x"] * b["y"]) / 2)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))


def planar_area(ring: Column) -> Column:
    """Signed trapezoid area of array<struct<x,y>>, the ring closed; 0.0 below three points."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, shifted, lambda a, b: (b["x"] + a["x"]) * (b["y"] - a["y"]) / 2)
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def closed(ring: Column) -> Column:
    """A ring of more than two points with its first point repeated at the end (GEO-17)."""
    return F.when(F.size(ring) > 2, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def crosses(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether segments ab and cd cross (GEO-12)."""
    return (_turn(*a, *c, *d) != _turn(*b, *c, *d)) & (_turn(*a, *b, *c) != _turn(*a, *b, *d))


def uncrossed(ring: Column) -> Column:
    """GEO-12: a ring array<struct<lat,lon>> of four points whose opposite sides cross, with its last two points swapped."""
    p = [(F.get(ring, F.lit(k))["lat"], F.get(ring, F.lit(k))["lon"]) for k in range(4)]
    bad = crosses(p[0], p[1], p[2], p[3]) | crosses(p[1], p[2], p[3], p[0])
    return F.when((F.size(ring) == 4) & bad, F.concat(F.slice(ring, 1, 2), F.slice(ring, 4, 1), F.slice(ring, 3, 1))).otherwise(ring)


def inside(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in a polygon array<struct<lat,lon>>, by crossing number; fewer than three points hold nothing."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, shifted, lambda p, q: F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]), 1).otherwise(0))
    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on a sphere of 6,371.0088 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Geodesic distance in km on WGS84, by Vincenty's inverse; nearly antipodal points that do not converge give nan."""
    a, f = WGS84
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((cu2 * sl) ** 2 + (cu1 * su2 - su1 * cu2 * cl) ** 2)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / np.where(ss == 0, 1.0, ss))
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1.0, c2a))
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        k = c2a * (a**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        out = b * big * (sigma - delta) / 1000
    return np.where(done, out, np.nan)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty(*[s.to_numpy(dtype="float64") for s in (a, b, c, d)]))

    return distance(lat1, lon1, lat2, lon2)


def _to_xyz(lat: np.ndarray, lon: np.ndarray, ellipsoid: tuple[float, float]) -> np.ndarray:
    a, f = ellipsoid
    e2 = f * (2 - f)
    phi, lam = np.radians(lat), np.radians(lon)
    n = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    return np.stack([n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - e2) * np.sin(phi)])


def _to_geodetic(xyz: np.ndarray, ellipsoid: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    a, f = ellipsoid
    e2 = f * (2 - f)
    x, y, z = xyz
    p = np.hypot(x, y)
    phi = np.arctan2(z, p * (1 - e2))
    for _ in range(8):
        n = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + e2 * n * np.sin(phi), p)
    return np.degrees(phi), np.degrees(np.arctan2(y, x))


def _rotation() -> tuple[np.ndarray, np.ndarray, float]:
    dx, dy, dz, rx, ry, rz, scale = HELMERT
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    return np.array([[dx], [dy], [dz]]), np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]), 1 + scale * 1e-6


def _series(f: float) -> tuple[float, list[float], list[float]]:
    """Krüger's series to the fourth power of the third flattening: rectifying radius factor, forward and inverse terms."""
    n = f / (2 - f)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, inverse


def to_zone(lat: np.ndarray, lon: np.ndarray, system: str) -> tuple[np.ndarray, np.ndarray]:
    """WGS84 degrees to easting and northing of a regional system."""
    shift, turn, scale = _rotation()
    local = np.linalg.solve(turn, (_to_xyz(lat, lon, WGS84) - shift) / scale)
    phi, lam = (np.radians(v) for v in _to_geodetic(local, KRASSOVSKY))
    meridian, x0, y0 = ZONES[system]
    a, f = KRASSOVSKY
    e = math.sqrt(f * (2 - f))
    radius, forward, _ = _series(f)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    span = lam - math.radians(meridian)
    xi, eta = np.arctan2(t, np.cos(span)), np.arctanh(np.sin(span) / np.sqrt(1 + t**2))
    north = xi + sum(c * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, c in enumerate(forward, 1))
    east = eta + sum(c * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, c in enumerate(forward, 1))
    return x0 + a * radius * east, y0 + a * radius * north


def from_zone(east: np.ndarray, north: np.ndarray, system: str) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing of a regional system to WGS84 degrees."""
    meridian, x0, y0 = ZONES[system]
    a, f = KRASSOVSKY
    e = math.sqrt(f * (2 - f))
    radius, _, inverse = _series(f)
    xi, eta = (north - y0) / (a * radius), (east - x0) / (a * radius)
    x = xi - sum(c * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, c in enumerate(inverse, 1))
    y = eta - sum(c * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, c in enumerate(inverse, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    phi = chi.copy()
    for _ in range(10):
        phi = np.arcsin(np.tanh(np.arctanh(np.sin(chi)) + e * np.arctanh(e * np.sin(phi))))
    lam = math.radians(meridian) + np.arctan2(np.sinh(y), np.cos(x))
    shift, turn, scale = _rotation()
    return _to_geodetic(shift + scale * (turn @ _to_xyz(np.degrees(phi), np.degrees(lam), KRASSOVSKY)), WGS84)


def projected(lat: Column, lon: Column, system: Column) -> Column:
    """struct<x,y> of a point in its regional system, null for wgs84 and unknown systems."""

    @F.pandas_udf("x double, y double")
    def project(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"x": np.full(len(a), np.nan), "y": np.full(len(a), np.nan)})
        for name in s.dropna().unique():
            if name in ZONES:
                at = (s == name).to_numpy()
                x, y = to_zone(a[at].to_numpy(dtype="float64"), b[at].to_numpy(dtype="float64"), name)
                out.loc[at, "x"], out.loc[at, "y"] = x, y
        return out

    return project(lat, lon, system)


def unprojected(x: Column, y: Column, system: Column) -> Column:
    """struct<lat,lon> of a point of a regional system (GEO-04, the way back); null for unknown systems."""

    @F.pandas_udf("lat double, lon double")
    def back(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lat": np.full(len(a), np.nan), "lon": np.full(len(a), np.nan)})
        for name in s.dropna().unique():
            if name in ZONES:
                at = (s == name).to_numpy()
                lat, lon = from_zone(a[at].to_numpy(dtype="float64"), b[at].to_numpy(dtype="float64"), name)
                out.loc[at, "lat"], out.loc[at, "lon"] = lat, lon
        return out

    return back(x, y, system)
