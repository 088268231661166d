"""Vector file formats. Each reader gives (DataFrame, geometry column, coordinate system)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from terrasift.geom import wkb
from terrasift.sources import geopackage
from terrasift.sources.rows import frame_of, numbered

Loaded = tuple[DataFrame, str | None, str | None]
LONLAT = "EPSG:4326"


def load(spark: SparkSession, file: Path, layer: str | None = None) -> Loaded:
    kind = file.suffix.lower()
    if kind == ".parquet":
        return geoparquet(spark, file)
    if kind == ".gpkg":
        return geopackage.read(spark, file, layer)
    if kind in READERS:
        rows, crs = READERS[kind](file, layer)
        return frame_of(spark, rows, "geometry", crs)
    raise ValueError(f"'{file}' is not in a format that can be read ({', '.join(sorted([*READERS, '.gpkg', '.parquet']))})")


def sublayers(file: Path) -> list[str]:
    kind = file.suffix.lower()
    if kind == ".gpkg":
        return geopackage.tables(file)
    names = _kml_layers(file) if kind == ".kml" else _gml_layers(file)
    return list(names) if len(names) > 1 else []


def geoparquet(spark: SparkSession, file: Path) -> Loaded:
    """Spark reads the columns; the geometry column and its system come from the footer's geo entry."""
    df = spark.read.parquet(str(file))
    meta = _geo_entry(spark, file)
    geom = meta.get("primary_column") or next((c for c in ("geometry", "geom", "wkb_geometry") if c in df.columns), None)
    own = (meta.get("columns") or {}).get(geom, {})
    if own.get("encoding", "WKB") != "WKB":
        raise ValueError(f"geometry encoding {own['encoding']} is not WKB")
    crs = LONLAT if meta and "crs" not in own else _projjson(own.get("crs"))
    return numbered(df), geom, crs


def _geo_entry(spark: SparkSession, file: Path) -> dict[str, Any]:
    import pyarrow.parquet as pq

    part = file if file.is_file() else next(iter(sorted(file.rglob("*.parquet"))), None)
    meta = pq.read_schema(part).metadata if part else None
    return json.loads(meta[b"geo"]) if meta and b"geo" in meta else {}


def _projjson(crs: Any) -> str | None:
    if isinstance(crs, dict):
        own = crs.get("id") or {}
        return f"EPSG:{own['code']}" if own.get("authority") == "EPSG" else LONLAT if own.get("authority") == "OGC" else crs.get("name")
    return crs


def geojson(file: Path, layer: str | None) -> tuple[list[dict], str | None]:
    doc = json.loads(file.read_text(encoding="utf-8-sig"))
    if not isinstance(doc, dict) or "type" not in doc:
        raise ValueError("not a GeoJSON document")
    if doc["type"] == "FeatureCollection":
        features = doc["features"]
    elif doc["type"] == "Feature":
        features = [doc]
    else:
        features = [{"geometry": doc, "properties": {}}]
    rows = []
    for f in features:
        g = wkb.from_geojson(f.get("geometry"))
        props = {k: json.dumps(v) if isinstance(v, dict | list) else v for k, v in (f.get("properties") or {}).items()}
        rows.append(({"id": f["id"]} if "id" in f and "id" not in props else {}) | props | {"geometry": None if g is None else wkb.encode(g)})
    named = ((doc.get("crs") or {}).get("properties") or {}).get("name")
    return rows, named or LONLAT


def shapefile(file: Path, layer: str | None) -> tuple[list[dict], str | None]:
    raw = file.read_bytes()
    if len(raw) < 100 or struct.unpack_from(">i", raw)[0] != 9994:
        raise ValueError("not a shapefile")
    shapes, at = [], 100
    while at + 8 <= len(raw):
        (size,) = struct.unpack_from(">i", raw, at + 4)
        shapes.append(_shape(raw, at + 8))
        at += 8 + 2 * size
    rows = list(_dbf(file.with_suffix(".dbf"))) if file.with_suffix(".dbf").exists() else [{} for _ in shapes]
    if len(rows) != len(shapes):
        raise ValueError(f"{len(shapes)} shapes but {len(rows)} records")
    prj = file.with_suffix(".prj")
    crs = prj.read_text(encoding="utf-8", errors="replace").strip() if prj.exists() else None
    from terrasift.geom.crs import epsg_of

    code = epsg_of(crs)
    return [r | {"geometry": None if g is None else wkb.encode(g)} for r, g in zip(rows, shapes, strict=True)], f"EPSG:{code}" if code else crs


def _shape(raw: bytes, at: int) -> wkb.Geometry | None:
    from terrasift.geom.kernel import polygons_of, ring_area

    (kind,) = struct.unpack_from("<i", raw, at)
    kind %= 10
    pts = lambda at, n: np.frombuffer(raw, "<f8", 2 * n, at).reshape(n, 2).astype(float)
    if kind == 0:
        return None
    if kind == 1:
        return wkb.POINT, pts(at + 4, 1)[0]
    if kind == 8:
        (n,) = struct.unpack_from("<i", raw, at + 36)
        return wkb.MULTIPOINT, [(wkb.POINT, p) for p in pts(at + 40, n)]
    n_parts, n = struct.unpack_from("<ii", raw, at + 36)
    cut = [*struct.unpack_from(f"<{n_parts}i", raw, at + 44), n]
    xy = pts(at + 44 + 4 * n_parts, n)
    runs = [xy[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    if kind == 3:
        return (wkb.LINE, runs[0]) if len(runs) == 1 else (wkb.MULTILINE, [(wkb.LINE, r) for r in runs])
    if len(runs) == 1:
        return wkb.POLYGON, runs
    # Shells run clockwise here.
    return polygons_of([r[::-1] for r in runs]) if any(ring_area(r) < 0 for r in runs) else (wkb.POLYGON, runs)


def _dbf(file: Path) -> Iterator[dict]:
    raw = file.read_bytes()
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    cpg = file.with_suffix(".cpg")
    code = cpg.read_text().strip() if cpg.exists() else "utf-8"
    fields, at, pos = [], 32, 1
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(raw[at + 11]), pos, raw[at + 16], raw[at + 17]))
        pos += raw[at + 16]
        at += 32
    for i in range(n):
        row, out = raw[head + i * size : head + (i + 1) * size], {}
        for name, kind, pos, width, decimals in fields:
            text = row[pos : pos + width].decode(code, "replace").strip("\0 ")
            if kind in "NF":
                out[name] = None if not text or text.startswith("*") else int(text) if not decimals and "." not in text and "e" not in text.lower() else float(text)
            elif kind == "L":
                out[name] = {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
            else:
                out[name] = text or None
        yield out


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in (text or "").replace(",", " ").split()]


# KML


def _kml_groups(file: Path) -> dict[str, list[ET.Element]]:
    root = ET.parse(file).getroot()
    out: dict[str, list[ET.Element]] = {}

    def walk(e: ET.Element, name: str) -> None:
        for x in e:
            if _local(x) in ("Folder", "Document"):
                own = next((c.text for c in x if _local(c) == "name" and c.text), None)
                walk(x, own or name)
            elif _local(x) == "Placemark":
                out.setdefault(name, []).append(x)

    walk(root, file.stem)
    return out


def _kml_layers(file: Path) -> list[str]:
    return list(_kml_groups(file))


def _kml_geometry(e: ET.Element) -> wkb.Geometry | None:
    kind = _local(e)

    def ring(x: ET.Element) -> np.ndarray:
        text = next((c.text for c in x.iter() if _local(c) == "coordinates"), "")
        return np.array([[float(v) for v in p.split(",")[:2]] for p in (text or "").split()], float).reshape(-1, 2)

    if kind == "Point":
        return wkb.POINT, ring(e)[0]
    if kind in ("LineString", "LinearRing"):
        return wkb.LINE, ring(e)
    if kind == "Polygon":
        outer = [ring(x) for x in e if _local(x) == "outerBoundaryIs"]
        return wkb.POLYGON, outer + [ring(x) for x in e if _local(x) == "innerBoundaryIs"]
    if kind == "MultiGeometry":
        return wkb.COLLECTION, [g for x in e if (g := _kml_geometry(x))]
    return None


def kml(file: Path, layer: str | None) -> tuple[list[dict], str | None]:
    groups = _kml_groups(file)
    if layer is not None and layer not in groups:
        raise ValueError(f"no layer '{layer}'")
    rows = []
    for x in groups[layer] if layer is not None else [p for g in groups.values() for p in g]:
        row: dict[str, Any] = {"Name": None, "Description": None}
        g = None
        for c in x:
            tag = _local(c)
            if tag in ("name", "description"):
                row[tag.capitalize()] = c.text
            elif tag == "ExtendedData":
                for d in c.iter():
                    if _local(d) == "SimpleData":
                        row[d.get("name")] = d.text
                    elif _local(d) == "Data":
                        row[d.get("name")] = next((v.text for v in d if _local(v) == "value"), None)
            else:
                g = g or _kml_geometry(c)
        rows.append(row | {"geometry": None if g is None else wkb.encode(g)})
    return rows, LONLAT


# GML


def _gml_groups(file: Path) -> dict[str, list[ET.Element]]:
    out: dict[str, list[ET.Element]] = {}
    for e in ET.parse(file).getroot().iter():
        if _local(e) in ("featureMember", "featureMembers", "member"):
            for f in e:
                out.setdefault(_local(f), []).append(f)
    if not out:
        raise ValueError("no features in GML")
    return out


def _gml_layers(file: Path) -> list[str]:
    return list(_gml_groups(file))


def _gml_geometry(e: ET.Element) -> wkb.Geometry | None:
    kind = _local(e)

    def pts(x: ET.Element) -> np.ndarray:
        for c in x.iter():
            if _local(c) in ("posList", "pos", "coordinates"):
                if _local(c) == "pos":
                    return np.array([_numbers(p.text)[:2] for p in x.iter() if _local(p) == "pos"])
                if _local(c) == "coordinates":
                    return np.array([[float(v) for v in p.split(",")[:2]] for p in (c.text or "").split()])
                dims = int(c.get("srsDimension") or x.get("srsDimension") or 2)
                return np.array(_numbers(c.text)).reshape(-1, dims)[:, :2]
        return np.empty((0, 2))

    if kind == "Point":
        return wkb.POINT, pts(e)[0]
    if kind in ("LineString", "Curve"):
        return wkb.LINE, pts(e)
    if kind in ("Polygon", "Surface"):
        rings = [x for x in e.iter() if _local(x) in ("exterior", "outerBoundaryIs")] + [x for x in e.iter() if _local(x) in ("interior", "innerBoundaryIs")]
        return wkb.POLYGON, [pts(x) for x in rings]
    many = {"MultiPoint": wkb.MULTIPOINT, "MultiLineString": wkb.MULTILINE, "MultiCurve": wkb.MULTILINE, "MultiPolygon": wkb.MULTIPOLYGON, "MultiSurface": wkb.MULTIPOLYGON, "MultiGeometry": wkb.COLLECTION}
    if kind in many:
        return many[kind], [g for m in e for x in ([m] if _local(m) in ("Point",) else m) if (g := _gml_geometry(x))]
    return None


def gml(file: Path, layer: str | None) -> tuple[list[dict], str | None]:
    groups = _gml_groups(file)
    if layer is not None and layer not in groups:
        raise ValueError(f"no layer '{layer}'")
    rows, crs = [], None
    for f in groups[layer] if layer is not None else [x for g in groups.values() for x in g]:
        row: dict[str, Any] = {}
        g = None
        for c in f:
            inner = next((x for x in c if _gml_geometry(x) is not None), None)
            if inner is not None:
                g, crs = _gml_geometry(inner), crs or inner.get("srsName")
            elif _local(c) != "boundedBy" and not len(c):
                row[_local(c)] = c.text
        rows.append(row | {"geometry": None if g is None else wkb.encode(g)})
    return rows, crs


# GPX


def gpx(file: Path, layer: str | None) -> tuple[list[dict], str | None]:
    """waypoints, routes, tracks or track_points; without a layer the first kind that the file has."""
    root = ET.parse(file).getroot()
    at = lambda e: [float(e.get("lon")), float(e.get("lat"))]
    plainly = lambda e: {_local(c): c.text for c in e if not len(c) and c.text and c.text.strip()}
    found: dict[str, list[dict]] = {"waypoints": [], "routes": [], "tracks": [], "track_points": []}
    for e in root.iter():
        kind = _local(e)
        if kind in ("wpt", "trkpt"):
            found["waypoints" if kind == "wpt" else "track_points"].append(plainly(e) | {"geometry": wkb.encode((wkb.POINT, np.array(at(e))))})
        elif kind == "rte":
            found["routes"].append(plainly(e) | {"geometry": wkb.encode((wkb.LINE, np.array([at(p) for p in e if _local(p) == "rtept"]).reshape(-1, 2)))})
        elif kind == "trk":
            lines = [(wkb.LINE, np.array([at(p) for p in s if _local(p) == "trkpt"]).reshape(-1, 2)) for s in e if _local(s) == "trkseg"]
            found["tracks"].append(plainly(e) | {"geometry": wkb.encode((wkb.MULTILINE, lines))})
    if layer is not None and layer not in found:
        raise ValueError(f"no layer '{layer}'")
    return found[layer or next((k for k, v in found.items() if v), "waypoints")], LONLAT


READERS = {".shp": shapefile, ".geojson": geojson, ".json": geojson, ".kml": kml, ".gml": gml, ".gpx": gpx}
