"""geo_* functions over WKB columns, vectorised through Arrow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.geom import crs as systems
from terrasift.geom import batch, kernel, wkb

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def geo_type(g: Column) -> Column:
    """The type's name from the WKB header, without Python: little- and big-endian, ISO and EWKB codes."""
    little = F.hex(F.substring(g, 1, 1)) == "01"
    code = F.when(little, F.concat(F.hex(F.substring(g, 3, 1)), F.hex(F.substring(g, 2, 1)))).otherwise(F.hex(F.substring(g, 4, 2)))
    kind = F.conv(code, 16, 10).cast("int") % 1000
    return F.element_at(F.create_map(*[F.lit(x) for k, v in wkb.NAMES.items() for x in (k, v)]), kind)


def lazily(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        return lambda *columns: F.pandas_udf(f, returns)(*columns)

    return wrap


def _one(returns: str, f: Callable, simple: Callable | None = None) -> Callable[[Column], Column]:
    """A function of one geometry; null for null. simple: the same over an array of simple ones. The UDF is made when it is called: importing this needs no session."""

    def run(col: pd.Series) -> pd.Series:
        return pd.Series(batch.each(col.tolist(), simple or (lambda kind, xy: None), f), dtype=object)

    return lazily(returns)(run)


def _pairs(a: list, b: list, f: Callable, rows: Iterator[int]) -> Iterator[tuple[int, object]]:
    # Neighbouring rows of a join often repeat a side.
    seen: dict[bytes, wkb.Geometry] = {}

    def read(x: bytes) -> wkb.Geometry:
        x = bytes(x)
        if x not in seen:
            if len(seen) > 2000:
                seen.clear()
            seen[x] = wkb.decode(x)
        return seen[x]

    for i in rows:
        yield i, None if a[i] is None or b[i] is None else f(read(a[i]), read(b[i]))


def _two(returns: str, f: Callable) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([v for _, v in _pairs(a.tolist(), b.tolist(), f, range(len(a)))], dtype=object)

    return lazily(returns)(run)


geo_is_empty = _one("boolean", lambda g: bool(wkb.is_empty(g)), batch.empty)
geo_validity = _one("string", kernel.invalid_reason, batch.reason)
geo_area = _one("double", lambda g: float(kernel.area(g)), batch.area)
geo_make_valid = _one("binary", lambda g: wkb.encode(kernel.made_valid(g)), batch.repaired)
geo_repair = _one("binary", lambda g: wkb.encode(kernel.made_valid(g)), batch.repaired)
geo_normal = _one("binary", lambda g: None if wkb.is_empty(g) else wkb.encode(kernel.normalized(g)), batch.normal)
geo_ends = _one("array<struct<x:double,y:double>>", lambda g: [{"x": float(x), "y": float(y)} for x, y in kernel.ends(g)], batch.ends)
geo_json = _one("string", lambda g: json.dumps(wkb.to_geojson(g)))
geo_distance = _two("double", lambda a, b: float(kernel.distance(a, b)))


@lazily("double")
def geo_intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    a, b = a.tolist(), b.tolist()
    return pd.Series(batch.shared_area(a, b, lambda rows: _pairs(a, b, lambda x, y: float(kernel.intersection_area(x, y)), rows)), dtype=object)


@lazily(BOX)
def geo_box(col: pd.Series) -> pd.DataFrame:
    """Bounds; nulls for null and empty geometries."""
    found = batch.bounds(col.tolist())
    return pd.DataFrame(found, columns=["xmin", "ymin", "xmax", "ymax"]).astype(object).where(~np.isnan(found), None)


def geo_related(predicate: str) -> Callable[[Column, Column], Column]:
    if predicate not in kernel.PREDICATES:
        raise ValueError(f"`{predicate}` is not a known predicate; known: {', '.join(kernel.PREDICATES)}")
    return _two("boolean", lambda a, b: bool(kernel.related(predicate, a, b)))


def geo_transform(source: int, target: int) -> Callable[[Column], Column]:
    systems.transform(np.zeros((1, 2)), source, target)
    return _one("binary", lambda g: wkb.encode(wkb.mapped(g, lambda xy: systems.transform(xy, source, target))))


@lazily("struct<empty:boolean,reason:string>")
def geo_state(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Whether a geometry is empty and why it is not valid, in one pass over the column."""

    def simple(kind: int, xy: np.ndarray) -> tuple[list, np.ndarray]:
        found, known = batch.reason(kind, xy)
        return [(False, x) for x in found], known

    def one(g: wkb.Geometry) -> tuple[bool, str | None]:
        empty = bool(wkb.is_empty(g))
        return empty, None if empty else kernel.invalid_reason(g)

    for col in parts:
        out = [x or (None, None) for x in batch.each(col.tolist(), simple, one)]
        yield pd.DataFrame(out, columns=["empty", "reason"], dtype=object)


def _built(kind: int, points: list) -> list:
    """WKB of flat coordinate arrays, rows of one length at once; null for null."""
    out: list = [None] * len(points)
    sizes = np.fromiter((-1 if p is None else len(p) for p in points), np.int64, len(points))
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size).tolist()
        if not size:
            made = [wkb.encode((kind, [] if kind == wkb.POLYGON else np.empty((0, 2))))] * len(rows)
        else:
            made = batch.encoded(kind, np.array([points[i] for i in rows], float).reshape(len(rows), -1, 2))
        for i, x in zip(rows, made, strict=True):
            out[i] = x
    return out


@lazily("binary")
def ring_polygon(points: pd.Series) -> pd.Series:
    """WKB of a polygon from a flat array x, y, x, y ... of its closed ring; an empty array is POLYGON EMPTY."""
    return pd.Series(_built(wkb.POLYGON, points.tolist()), dtype=object)


@lazily("binary")
def line_string(points: pd.Series) -> pd.Series:
    """WKB of a line from a flat array x, y, x, y ..."""
    return pd.Series(_built(wkb.LINE, points.tolist()), dtype=object)


@lazily("binary")
def point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(batch.encoded(wkb.POINT, np.stack([x.to_numpy(float), y.to_numpy(float)], 1)[:, None, :]), dtype=object)


@lazily("double")
def round_half_even(x: pd.Series) -> pd.Series:
    """To six decimals as Python's round() does."""
    return pd.Series([None if v is None else round(float(v), 6) for v in x], dtype=float)
