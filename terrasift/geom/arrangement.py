"""The planar arrangement of segments: nodes, edges, faces, and the rings around chosen faces."""

from __future__ import annotations

import numpy as np

CHUNK = 2_000_000


def close_pairs(s: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of segments [n, 4] whose boxes meet, by a sweep over the wider axis."""
    lo, hi = np.minimum(s[:, :2], s[:, 2:]) - slack, np.maximum(s[:, :2], s[:, 2:]) + slack
    if len(s) and np.ptp(lo[:, 1]) > np.ptp(lo[:, 0]):
        lo, hi = lo[:, ::-1], hi[:, ::-1]
    order = np.argsort(lo[:, 0], kind="stable")
    lo, hi = lo[order], hi[order]
    last = np.searchsorted(lo[:, 0], hi[:, 0], "right")
    count = last - np.arange(len(s)) - 1
    out_i, out_j = [], []
    start = 0
    while start < len(s):
        sums = np.cumsum(count[start:])
        n = max(1, int(np.searchsorted(sums, CHUNK, "right")))
        own = np.arange(start, min(len(s), start + n))
        c = count[own]
        i = np.repeat(own, c)
        j = i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        meet = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
        a, b = order[i[meet]], order[j[meet]]
        out_i.append(np.minimum(a, b))
        out_j.append(np.maximum(a, b))
        start += n
    none = [np.empty(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


class Arrangement:
    """Nodes [m, 2] and unique undirected edges [k, 2] of all segments, split where they meet."""

    def __init__(self, segments: np.ndarray) -> None:
        s = np.asarray(segments, float).reshape(-1, 4)
        s = s[(s[:, :2] != s[:, 2:]).any(1)]
        self.origin = s.reshape(-1, 2).min(0) if len(s) else np.zeros(2)
        s = s - np.tile(self.origin, 2)
        span = float(np.abs(s).max()) if len(s) else 1.0
        self.eps = max(span, 1e-300) * 2.0**-40
        points, owner = [s[:, :2], s[:, 2:]], [np.arange(len(s))] * 2
        if len(s):
            i, j = close_pairs(s, self.eps)
            p, r, q, t = s[i, :2], s[i, 2:] - s[i, :2], s[j, :2], s[j, 2:] - s[j, :2]
            den = cross(r, t)
            scale = np.hypot(*r.T) * np.hypot(*t.T)
            slanted = np.abs(den) > 1e-14 * scale
            with np.errstate(divide="ignore", invalid="ignore"):
                u, v = cross(q - p, t) / den, cross(q - p, r) / den
            slack_u, slack_v = self.eps / np.hypot(*r.T), self.eps / np.hypot(*t.T)
            hit = slanted & (u >= -slack_u) & (u <= 1 + slack_u) & (v >= -slack_v) & (v <= 1 + slack_v)
            at = p[hit] + np.clip(u[hit], 0, 1)[:, None] * r[hit]
            points += [at, at]
            owner += [i[hit], j[hit]]
            # Ends of one on the other: covers touching and overlapping segments of one direction.
            for a, b in ((i, j), (j, i)):
                d = s[b, 2:] - s[b, :2]
                size = np.hypot(*d.T)
                for k in (0, 2):
                    w = s[a, k : k + 2] - s[b, :2]
                    along = (w * d).sum(1) / size**2
                    on = (np.abs(cross(d, w)) <= self.eps * size) & (along >= 0) & (along <= 1)
                    points.append(s[a[on], k : k + 2])
                    owner.append(b[on])
        pts, own = np.concatenate(points), np.concatenate(owner)
        cell = np.round(pts / (4 * self.eps)).astype(np.int64)
        _, first, node = np.unique(cell, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        self.xy = pts[first] if len(pts) else np.empty((0, 2))
        along = ((pts - s[own, :2]) * (s[own, 2:] - s[own, :2])).sum(1) if len(pts) else np.empty(0)
        order = np.lexsort((along, own))
        o, n = own[order], node[order]
        pair = np.stack([n[:-1], n[1:]], 1)[(o[:-1] == o[1:]) & (n[:-1] != n[1:])] if len(n) else np.empty((0, 2), int)
        self.edges = np.unique(np.sort(pair, 1), axis=0) if len(pair) else np.empty((0, 2), int)
        self._trace()

    def _trace(self) -> None:
        """Half-edges 2e (as stored) and 2e + 1 (turned); after[h]: the next along the face on the left."""
        e = self.edges
        self.start = np.stack([e[:, 0], e[:, 1]], 1).ravel()
        self.stop = np.stack([e[:, 1], e[:, 0]], 1).ravel()
        d = self.xy[self.stop] - self.xy[self.start]
        self.angle = np.arctan2(d[:, 1], d[:, 0])
        self.around = np.lexsort((self.angle, self.start))
        self.rank = np.empty(len(self.around), int)
        self.rank[self.around] = np.arange(len(self.around))
        self.first = np.searchsorted(self.start[self.around], np.arange(len(self.xy) + 1))
        twin = np.arange(len(self.start)) ^ 1
        # From the way back, the next half-edge clockwise keeps the face on the left.
        r = self.rank[twin]
        low, high = self.first[self.start[twin]], self.first[self.start[twin] + 1]
        self.after = self.around[np.where(r == low, high - 1, r - 1)] if len(r) else np.empty(0, int)
        self.face = np.full(len(self.start), -1)
        self.cycles: list[np.ndarray] = []
        for h in range(len(self.start)):
            if self.face[h] < 0:
                own, at = [], h
                while self.face[at] < 0:
                    self.face[at] = len(self.cycles)
                    own.append(at)
                    at = self.after[at]
                self.cycles.append(np.array(own))
        xs, ys = self.xy[self.start], self.xy[self.stop]
        twice = cross(xs, ys)
        self.cycle_area = np.bincount(self.face, twice, len(self.cycles)) / 2 if len(self.face) else np.empty(0)

    def samples(self) -> np.ndarray:
        """A point close to the left of the longest edge of each cycle, in the segments' coordinates."""
        out = np.empty((len(self.cycles), 2))
        for k, own in enumerate(self.cycles):
            a, b = self.xy[self.start[own]], self.xy[self.stop[own]]
            d = b - a
            size = np.hypot(*d.T)
            i = int(size.argmax())
            normal = np.array([-d[i, 1], d[i, 0]]) / size[i]
            # A thin face is sampled closer than half its width.
            wide = abs(self.cycle_area[k]) / size.sum()
            out[k] = (a[i] + b[i]) / 2 + normal * max(4 * self.eps, min(size[i] * 1e-3, wide * 0.2))
        return out + self.origin

    def rings(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Closed rings around the chosen cycles' faces (a bool per cycle), which lie on the left: shells run counterclockwise, holes clockwise."""
        edge_in = chosen[self.face]
        border = edge_in & ~edge_in[np.arange(len(edge_in)) ^ 1]
        done = np.zeros(len(border), bool)
        out = []
        for h in np.flatnonzero(border):
            if done[h]:
                continue
            nodes, at = [], h
            while not done[at]:
                done[at] = True
                nodes.append(int(self.start[at]))
                node, r = self.stop[at], self.rank[at ^ 1]
                low, high = self.first[node], self.first[node + 1]
                while True:
                    r = high - 1 if r == low else r - 1
                    if border[self.around[r]]:
                        break
                at = self.around[r]
            out += self._simple(nodes)
        return out

    def _simple(self, nodes: list[int]) -> list[np.ndarray]:
        """A ring that meets itself in points, cut there."""
        stack, place, out = [], {}, []
        for n in [*nodes, nodes[0]]:
            if n in place:
                i = place[n]
                loop = stack[i:]
                if len(loop) > 2:
                    out.append(self.xy[[*loop, n]] + self.origin)
                for m in loop:
                    del place[m]
                del stack[i:]
            place[n] = len(stack)
            stack.append(n)
        return out
