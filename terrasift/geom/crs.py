"""Coordinate systems in closed form: longitude/latitude, spherical Mercator and UTM."""

from __future__ import annotations

import re

import numpy as np

#: WGS 84 axis and flattening, UTM scale and false origins, codes of geographic systems.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, NORTH_OF_SOUTH = 0.9996, 500_000.0, 10_000_000.0
GEOGRAPHIC = frozenset((4326, 4258, 4269, 4267, 4230, 4277, 4283, 4612, 4979, 6318, 7844))

_N = FLATTENING / (2 - FLATTENING)
_A = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger's series in the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)


def epsg_of(crs: str | None) -> int | None:
    """The code in EPSG:n, urn:ogc:def:crs:EPSG::n, an OGC name of WGS 84 longitude/latitude, or WKT's outermost authority."""
    if not crs:
        return None
    text = crs.strip()
    if re.search(r"CRS84(?!\d)", text, re.I):
        return 4326
    if m := re.fullmatch(r"(?:EPSG:|urn:ogc:def:crs:EPSG:[\d.]*:|https?://www\.opengis\.net/def/crs/EPSG/\d+/|http://www\.opengis\.net/gml/srs/epsg\.xml#)?(\d+)", text, re.I):
        return int(m[1])
    if found := re.findall(r'(?:AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?|ID\s*\[\s*"EPSG"\s*,\s*)(\d+)', text, re.I):
        return int(found[-1])
    if re.match(r'GEOGCS\["(?:GCS_)?WGS[_ ](?:19)?84"', text, re.I):
        return 4326
    if m := re.match(r'PROJCS\["WGS[_ ](?:19)?84[_ /]*UTM[_ ]zone[_ ](\d+)([NS])"', text, re.I):
        return (32600 if m[2].upper() == "N" else 32700) + int(m[1])
    return 3857 if re.match(r'PROJCS\["WGS[_ ](?:19)?84[_ /]*(?:Pseudo-Mercator|Web_Mercator)', text, re.I) else None


def is_geographic(crs: str | None) -> bool:
    code = epsg_of(crs)
    return code in GEOGRAPHIC if code is not None else bool(crs and re.match(r"\s*(GEOGCS|GEOGCRS|GEODCRS)\b", crs, re.I))


def utm_zone(bounds: tuple[float, float, float, float]) -> int:
    """EPSG code of the zone at the centre of longitude/latitude bounds."""
    lon, lat = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
    zone = min(60, max(1, int(np.floor((lon + 180) / 6)) + 1))
    return (32600 if lat >= 0 else 32700) + zone


def _utm(code: int) -> tuple[float, float] | None:
    """Central meridian and false northing."""
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return np.radians((code % 100) * 6 - 183), NORTH_OF_SOUTH if code > 32700 else 0.0
    return None


def supported(code: int | None) -> bool:
    return code in (4326, 3857) or code is not None and _utm(code) is not None


def to_lonlat(xy: np.ndarray, code: int) -> np.ndarray:
    if code == 4326:
        return xy
    if code == 3857:
        return np.degrees(np.stack([xy[:, 0] / AXIS, 2 * np.arctan(np.exp(xy[:, 1] / AXIS)) - np.pi / 2], 1))
    meridian, north = _utm(code)
    xi, eta = (xy[:, 1] - north) / (SCALE * _A), (xy[:, 0] - EAST) / (SCALE * _A)
    x, e = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        x -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        e -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    ecc = np.sqrt(FLATTENING * (2 - FLATTENING))
    tau1 = np.sin(x) / np.hypot(np.sinh(e), np.cos(x))
    tau = tau1.copy()
    for _ in range(6):
        sigma = np.sinh(ecc * np.arctanh(ecc * tau / np.hypot(1, tau)))
        t = tau * np.hypot(1, sigma) - sigma * np.hypot(1, tau)
        tau += (tau1 - t) / np.hypot(1, t) * (1 + (1 - ecc**2) * tau**2) / ((1 - ecc**2) * np.hypot(1, tau))
    return np.degrees(np.stack([meridian + np.arctan2(np.sinh(e), np.cos(x)), np.arctan(tau)], 1))


def from_lonlat(ll: np.ndarray, code: int) -> np.ndarray:
    if code == 4326:
        return ll
    lon, lat = np.radians(ll[:, 0]), np.radians(ll[:, 1])
    if code == 3857:
        return np.stack([AXIS * lon, AXIS * np.arcsinh(np.tan(lat))], 1)
    meridian, north = _utm(code)
    ecc = np.sqrt(FLATTENING * (2 - FLATTENING))
    tau = np.tan(lat)
    sigma = np.sinh(ecc * np.arctanh(ecc * tau / np.hypot(1, tau)))
    t = tau * np.hypot(1, sigma) - sigma * np.hypot(1, tau)
    d = lon - meridian
    xi, eta = np.arctan2(t, np.cos(d)), np.arcsinh(np.sin(d) / np.hypot(t, np.cos(d)))
    x, e = xi.copy(), eta.copy()
    for j, a in enumerate(_ALPHA, 1):
        x += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        e += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return np.stack([EAST + SCALE * _A * e, north + SCALE * _A * x], 1)


def transform(xy: np.ndarray, source: int, target: int) -> np.ndarray:
    # Other geographic systems differ from WGS 84 by metres at most, which no measure here resolves.
    source, target = (4326 if c in GEOGRAPHIC else c for c in (source, target))
    if source == target:
        return xy
    if not supported(source) or not supported(target):
        raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")
    return from_lonlat(to_lonlat(xy, source), target)
