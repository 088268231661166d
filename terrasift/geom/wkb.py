"""Geometries as small tuples, and their well-known binary form.

A geometry is (kind, data): Point an array of 2 or None, LineString an array [n, 2], Polygon a list of such rings,
collections a list of geometries. Z and M are read and dropped, an embedded SRID is skipped.
"""

from __future__ import annotations

import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}
KINDS = {v: k for k, v in NAMES.items()}
Geometry = tuple[int, object]


def decode(raw: bytes) -> Geometry:
    try:
        return _read(raw, 0)[0]
    except (struct.error, IndexError) as e:
        raise ValueError(f"broken WKB: {e}") from e


def _read(raw: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if raw[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0) if code >= 1000 else 0
    kind = code % 1000
    if kind not in NAMES:
        raise ValueError(f"unknown WKB type {code}")

    def coords(at: int, n: int) -> tuple[np.ndarray, int]:
        end = at + 8 * dims * n
        if end > len(raw):
            raise ValueError("broken WKB: too short")
        return np.frombuffer(raw, f"{order}f8", dims * n, at).reshape(n, dims)[:, :2].astype(float), end

    if kind == POINT:
        xy, at = coords(at, 1)
        return (POINT, None if np.isnan(xy).all() else xy[0]), at
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at += 4
    if kind == LINE:
        xy, at = coords(at, n)
        return (LINE, xy), at
    parts = []
    for _ in range(n):
        if kind == POLYGON:
            (m,) = struct.unpack_from(f"{order}I", raw, at)
            part, at = coords(at + 4, m)
        else:
            part, at = _read(raw, at)
        parts.append(part)
    return (kind, parts), at


def encode(g: Geometry) -> bytes:
    kind, data = g
    head = struct.pack("<BI", 1, kind)
    if kind == POINT:
        return head + (struct.pack("<dd", np.nan, np.nan) if data is None else np.asarray(data, "<f8").tobytes())
    if kind == LINE:
        return head + struct.pack("<I", len(data)) + np.asarray(data, "<f8").tobytes()
    if kind == POLYGON:
        return head + struct.pack("<I", len(data)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in data)
    return head + struct.pack("<I", len(data)) + b"".join(encode(p) for p in data)


def is_empty(g: Geometry) -> bool:
    kind, data = g
    if kind == POINT:
        return data is None
    if kind == LINE:
        return len(data) == 0
    if kind == POLYGON:
        return not data or len(data[0]) == 0
    return all(is_empty(p) for p in data)


def parts(g: Geometry) -> list[Geometry]:
    """Its non-empty points, lines and polygons."""
    if g[0] in (POINT, LINE, POLYGON):
        return [] if is_empty(g) else [g]
    return [q for p in g[1] for q in parts(p)]


def dimension(g: Geometry) -> int:
    return max(({POINT: 0, LINE: 1, POLYGON: 2}[p[0]] for p in parts(g)), default=-1)


def coordinates(g: Geometry) -> np.ndarray:
    out = []
    for kind, data in parts(g):
        out += [np.asarray(data).reshape(1, 2)] if kind == POINT else [data] if kind == LINE else list(data)
    return np.concatenate(out) if out else np.empty((0, 2))


def bounds(g: Geometry) -> tuple[float, float, float, float] | None:
    xy = coordinates(g)
    return None if not len(xy) else (*xy.min(0), *xy.max(0))


def mapped(g: Geometry, f) -> Geometry:
    """f over all coordinate arrays [n, 2]."""
    kind, data = g
    if kind == POINT:
        return kind, None if data is None else f(np.asarray(data).reshape(1, 2))[0]
    if kind == LINE:
        return kind, f(data) if len(data) else data
    if kind == POLYGON:
        return kind, [f(r) if len(r) else r for r in data]
    return kind, [mapped(p, f) for p in data]


def from_geojson(obj: dict | None) -> Geometry | None:
    if obj is None:
        return None
    kind = KINDS[obj["type"]]
    if kind == COLLECTION:
        return kind, [from_geojson(p) for p in obj["geometries"]]
    c = obj["coordinates"]
    pts = lambda v: np.array([p[:2] for p in v], float).reshape(-1, 2)
    if kind == POINT:
        return kind, np.array(c[:2], float) if c else None
    if kind == LINE:
        return kind, pts(c)
    if kind == POLYGON:
        return kind, [pts(r) for r in c]
    one = {MULTIPOINT: "Point", MULTILINE: "LineString", MULTIPOLYGON: "Polygon"}[kind]
    return kind, [from_geojson({"type": one, "coordinates": p}) for p in c]


def to_geojson(g: Geometry) -> dict:
    kind, data = g
    name = NAMES[kind]
    if kind == COLLECTION:
        return {"type": name, "geometries": [to_geojson(p) for p in data]}
    if kind == POINT:
        c = [] if data is None else [float(v) for v in data]
    elif kind == LINE:
        c = np.asarray(data).tolist()
    elif kind == POLYGON:
        c = [np.asarray(r).tolist() for r in data]
    else:
        c = [to_geojson(p)["coordinates"] for p in data]
    return {"type": name, "coordinates": c}
