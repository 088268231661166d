"""Whole columns of simple geometries at once.

Most layers hold rows of few shapes: points, lines, and polygons of one ring with finite coordinates. Rows of one kind
and size are read as one array [rows, points, 2], and measures, normal forms and relations are array operations over
it. What is not simple (collections, holes, Z, other byte orders, empty ones) goes to the kernel row by row; results
are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from terrasift.geom import wkb
from terrasift.geom.arrangement import cross
from terrasift.geom.wkb import LINE, POINT, POLYGON

#: Bytes before the coordinates, by kind.
HEAD = {POINT: 5, LINE: 9, POLYGON: 13}


def grouped(col: Sequence[bytes | None]) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """(kind, rows, coordinates [m, k, 2]) of simple geometries, and the rows of the others (but for nulls)."""
    sizes = np.fromiter((-1 if x is None else len(x) for x in col), np.int64, len(col))
    found, rest = [], []
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        if size < 21:
            rest.append(rows)
            continue
        raw = np.frombuffer(b"".join([col[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), size)
        left = np.ones(len(rows), bool)
        for kind, head in HEAD.items():
            points, odd = divmod(size - head, 16)
            if odd or points < 1 or kind == POINT and points != 1:
                continue
            fields = [kind] if kind == POINT else [kind, points] if kind == LINE else [kind, 1, points]
            want = np.frombuffer(b"\x01" + np.array(fields, "<u4").tobytes(), np.uint8)
            own = np.flatnonzero((raw[:, :head] == want).all(1))
            if not len(own):
                continue
            xy = np.ascontiguousarray(raw[own, head:]).view("<f8").reshape(len(own), points, 2)
            fine = np.isfinite(xy).all((1, 2))
            left[own[fine]] = False
            found.append((kind, rows[own[fine]], xy[fine]))
        rest.append(rows[left])
    return found, np.concatenate(rest) if rest else np.empty(0, np.int64)


def encoded(kind: int, xy: np.ndarray) -> list[bytes]:
    """WKB of [m, k, 2]: points, lines or polygons of one ring."""
    m, k = xy.shape[:2]
    fields = [kind] if kind == POINT else [kind, k] if kind == LINE else [kind, 1, k]
    head = np.frombuffer(b"\x01" + np.array(fields, "<u4").tobytes(), np.uint8)
    raw = np.concatenate([np.broadcast_to(head, (m, len(head))), np.frombuffer(np.ascontiguousarray(xy, "<f8").tobytes(), np.uint8).reshape(m, 16 * k)], 1)
    size, whole = raw.shape[1], raw.tobytes()
    return [whole[i * size : (i + 1) * size] for i in range(m)]


def each(col: Sequence[bytes | None], simple: Callable[[int, np.ndarray], list | np.ndarray | None], one: Callable[[wkb.Geometry], object]) -> np.ndarray:
    """Results of a column: simple(kind, xy) gives those of simple rows, or None to leave them to one(geometry); null for null."""
    out = np.full(len(col), None, object)
    found, rest = grouped(col)
    left = [rest]
    for kind, rows, xy in found:
        got = simple(kind, xy) if len(rows) else None
        if got is None:
            left.append(rows)
        elif isinstance(got, tuple):
            values, known = got
            for i, v in zip(rows[known].tolist(), values, strict=True):
                out[i] = v
            left.append(rows[~known])
        else:
            for i, v in zip(rows.tolist(), got, strict=True):
                out[i] = v
    for i in np.concatenate(left).tolist():
        out[i] = one(wkb.decode(bytes(col[i])))
    return out


def closed(xy: np.ndarray) -> np.ndarray:
    return (xy[:, 0] == xy[:, -1]).all(1)


def boxes(xy: np.ndarray) -> np.ndarray:
    """Which rings are axis-aligned rectangles."""
    if xy.shape[1] != 5:
        return np.zeros(len(xy), bool)
    d = np.diff(xy, axis=1) != 0
    return closed(xy) & (d.sum(2) == 1).all(1) & (d[:, 0] != d[:, 1]).all(1) & (d[:, 0] == d[:, 2]).all(1)


def doubled_area(xy: np.ndarray) -> np.ndarray:
    q = xy - xy[:, :1]
    return cross(q[:, :-1], q[:, 1:]).sum(1)


def empty(kind: int, xy: np.ndarray) -> list:
    return [False] * len(xy)


def area(kind: int, xy: np.ndarray) -> list:
    if kind != POLYGON or xy.shape[1] < 3:
        return [0.0] * len(xy)
    return np.abs(doubled_area(xy) / 2).tolist()


def reason(kind: int, xy: np.ndarray) -> tuple[list, np.ndarray]:
    """Why a geometry is not valid: points, lines of two places and rectangles are."""
    known = np.ones(len(xy), bool) if kind == POINT else (xy != xy[:, :1]).any((1, 2)) if kind == LINE else boxes(xy)
    return [None] * int(known.sum()), known


def ends(kind: int, xy: np.ndarray) -> list:
    if kind != LINE or xy.shape[1] < 2:
        return [[] for _ in range(len(xy))]
    return [[{"x": a, "y": b}, {"x": c, "y": d}] for (a, b), (c, d) in zip(xy[:, 0].tolist(), xy[:, -1].tolist(), strict=True)]


def normal(kind: int, xy: np.ndarray) -> tuple[list, np.ndarray] | list:
    """WKB of the normal form; rings that repeat a vertex in a row, and closed lines, are left to the kernel."""
    if kind == POINT:
        return encoded(kind, xy)
    if kind == LINE:
        known = ~closed(xy) if xy.shape[1] > 3 else np.ones(len(xy), bool)
        own = xy[known]
        flat, back = own.reshape(len(own), 2 * xy.shape[1]), own[:, ::-1].reshape(len(own), 2 * xy.shape[1])
        differ = flat != back
        at = differ.argmax(1)[:, None]
        turn = (np.take_along_axis(flat, at, 1) > np.take_along_axis(back, at, 1))[:, 0]
        return encoded(kind, np.where(turn[:, None, None], own[:, ::-1], own)), known
    if xy.shape[1] < 4:
        return [], np.zeros(len(xy), bool)
    known = closed(xy) & (xy[:, 1:] != xy[:, :-1]).any(2).all(1)
    q = xy[known][:, :-1]
    turn = ~(doubled_area(xy[known]) < 0)
    q = np.where(turn[:, None, None], q[:, ::-1], q)
    low = q[:, :, 0] == q[:, :, 0].min(1, keepdims=True)
    first = np.where(low, q[:, :, 1], np.inf).argmin(1)
    order = (first[:, None] + np.arange(q.shape[1] + 1)) % q.shape[1]
    return encoded(kind, np.take_along_axis(q, order[:, :, None], 1)), known


def bounds(col: Sequence[bytes | None]) -> np.ndarray:
    """[n, 4]: xmin, ymin, xmax, ymax; NaN for null and empty geometries."""
    out = np.full((len(col), 4), np.nan)
    found, rest = grouped(col)
    for _, rows, xy in found:
        out[rows] = np.concatenate([xy.min(1), xy.max(1)], 1)
    for i in rest.tolist():
        if (b := wkb.bounds(wkb.decode(bytes(col[i])))) is not None:
            out[i] = b
    return out


def rectangles(col: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row is an axis-aligned rectangle, and its bounds."""
    out, is_box = np.full((len(col), 4), np.nan), np.zeros(len(col), bool)
    for kind, rows, xy in grouped(col)[0]:
        if kind == POLYGON:
            own = boxes(xy)
            is_box[rows[own]] = True
            out[rows[own]] = np.concatenate([xy[own].min(1), xy[own].max(1)], 1)
    return is_box, out


def shared_area(a: Sequence[bytes | None], b: Sequence[bytes | None], rest: Callable[[Iterator[int]], Iterator[tuple[int, object]]]) -> np.ndarray:
    """Areas of intersections: of rectangles at once, of the other pairs by rest(rows)."""
    (box_a, p), (box_b, q) = rectangles(a), rectangles(b)
    out = np.full(len(a), None, object)
    both = box_a & box_b
    size = np.minimum(p[both, 2:], q[both, 2:]) - np.maximum(p[both, :2], q[both, :2])
    out[both] = np.where((size > 0).all(1), size.prod(1), 0.0).tolist()
    for i, v in rest(np.flatnonzero(~both).tolist()):
        out[i] = v
    return out


def repaired(kind: int, xy: np.ndarray) -> tuple[list, np.ndarray]:
    """WKB of geometries that need no repair."""
    _, known = reason(kind, xy)
    return encoded(kind, xy[known]), known

