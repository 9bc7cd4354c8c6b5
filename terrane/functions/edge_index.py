"""Which edges of a geometry can meet which, and which a ray from a point can
cross, without comparing all with all.

Geometries of few edges are compared whole.  Others get a grid of their own, of
cells as wide and as high as the edges are on average (on each axis apart, so
that a comb of long teeth has narrow, high cells): each edge is entered in the
cells that it passes through, about three, and edges meet in a cell.  A ray is
horizontal, so it needs bands of that height only.  Pairs are made in blocks of
``PRODUCT``, which bounds the memory whatever the shapes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Pairs of edges that are compared at once.
PRODUCT = 1_000_000
#: A row is compared whole up to so many pairs for each of its edges.
WHOLE = 24
#: Cells on one axis of a row's grid, at most.
CELLS = 1 << 20


@dataclass
class Edges:
    """Edges of a batch of geometries: ends, and first edge of each row."""

    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    first: np.ndarray  # rows + 1

    def slice(self, lo: int, hi: int) -> Edges:
        a, b = self.first[lo], self.first[hi]
        return Edges(self.ax[a:b], self.ay[a:b], self.bx[a:b], self.by[a:b], self.first[lo : hi + 1] - a)

    def take(self, rows: np.ndarray) -> Edges:
        size = np.diff(self.first)[rows]
        i = ranges(self.first[rows], size)
        return Edges(self.ax[i], self.ay[i], self.bx[i], self.by[i], np.concatenate([[0], np.cumsum(size)]))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def box(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.minimum(self.ax, self.bx), np.minimum(self.ay, self.by), np.maximum(self.ax, self.bx), np.maximum(self.ay, self.by)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each range, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def blocks(sizes: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes together stay near the limit."""
    limit = PRODUCT if limit is None else limit
    total = np.concatenate([[0], np.cumsum(sizes)])
    at, n = 0, len(sizes)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1))
        yield at, to
        at = to


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


def _least(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, np.inf)
    np.minimum.at(out, row, values)
    return out


class Grid:
    """Origin and cell size of each row's grid, from all edges that use it."""

    def __init__(self, sides: list[Edges], pad: np.ndarray):
        rows = len(pad)
        count, wide, high = np.zeros(rows), np.zeros(rows), np.zeros(rows)
        self.x0, self.y0, x1, y1 = (np.full(rows, np.inf) for _ in range(4))
        for e in sides:
            row = e.row
            count += np.diff(e.first)
            wide += _sums(np.abs(e.bx - e.ax), e.first)
            high += _sums(np.abs(e.by - e.ay), e.first)
            box = e.box()
            self.x0, self.y0 = (np.minimum(o, _least(v, row, rows)) for o, v in ((self.x0, box[0]), (self.y0, box[1])))
            x1, y1 = (np.minimum(o, _least(-v, row, rows)) for o, v in ((x1, box[2]), (y1, box[3])))
        self.pad = pad
        self.x0, self.y0 = self.x0 - 2 * pad, self.y0 - 2 * pad
        count = np.maximum(count, 1)
        size = lambda total, span: np.maximum(np.maximum(total / count, span / CELLS), 1e-300)
        self.cw, self.ch = size(wide, -x1 - self.x0 + 2 * pad), size(high, -y1 - self.y0 + 2 * pad)

    def band(self, y: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - self.y0[row]) / self.ch[row]), -1, CELLS + 1).astype(np.int64)

    def bands(self, e: Edges) -> tuple[np.ndarray, np.ndarray]:
        """(edge, band) of all edges."""
        row = e.row
        _, low, _, high = e.box()
        lo, hi = self.band(low - self.pad[row], row), self.band(high + self.pad[row], row)
        return np.repeat(np.arange(len(row)), hi - lo + 1), ranges(lo, hi - lo + 1)

    def cells(self, e: Edges) -> tuple[np.ndarray, np.ndarray]:
        """(edge, key of row and cell): the cells that edges pass through."""
        edge, band = self.bands(e)
        row = e.row[edge]
        left, low, right, high = (v[edge] for v in e.box())
        pad, ay, dy = self.pad[row], e.ay[edge], (e.by - e.ay)[edge]
        slope = (e.bx - e.ax)[edge] / np.where(dy == 0, 1.0, dy)
        # Where an edge enters and leaves the band; nearly level edges cannot say so exactly.
        vague = pad + 1e-15 * np.abs(slope) * (np.abs(low) + np.abs(high))
        at = lambda y: e.ax[edge] + (np.clip(y, low, high) - ay) * slope
        bottom = self.y0[row] + band * self.ch[row]
        p, q = at(bottom - pad), at(bottom + self.ch[row] + pad)
        level = dy == 0
        x0 = np.maximum(np.where(level, left, np.minimum(p, q)) - vague, left - pad)
        x1 = np.minimum(np.where(level, right, np.maximum(p, q)) + vague, right + pad)
        cell = lambda x: np.clip(np.floor((x - self.x0[row]) / self.cw[row]), -1, CELLS + 1).astype(np.int64)
        lo = cell(x0)
        n = np.maximum(cell(x1) - lo + 1, 0)
        again = np.repeat(np.arange(len(edge)), n)
        key = (row[again] << 43) + ((band[again] + 1) << 21) + ranges(lo, n) + 1
        return edge[again], key


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows that are compared whole; a, b: first item of each row."""
    na, nb = np.diff(a), np.diff(b)
    return na * nb <= WHOLE * (na + nb)


def _products(a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of items of the given rows, in blocks."""
    na, nb = np.diff(a)[rows], np.diff(b)[rows]
    for lo, hi in blocks(na * nb):
        n, m, r = na[lo:hi], nb[lo:hi], rows[lo:hi]
        yield np.repeat(ranges(a[r], n), np.repeat(m, n)), ranges(np.repeat(b[r], n), np.repeat(m, n))


def _part(e: Edges, keep: np.ndarray) -> tuple[Edges, np.ndarray]:
    """The edges of some rows, others empty, and their places in e."""
    at = np.flatnonzero(keep[e.row])
    return Edges(e.ax[at], e.ay[at], e.bx[at], e.by[at], np.concatenate([[0], np.cumsum(np.where(keep, np.diff(e.first), 0))])), at


def _joined(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in left, place in right) of equal keys, in blocks."""
    order = np.argsort(right, kind="stable")
    right = right[order]
    lo, hi = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    for a, b in blocks(hi - lo):
        n = hi[a:b] - lo[a:b]
        yield np.repeat(np.arange(a, b), n), order[ranges(lo[a:b], n)]


def near_pairs(a: Edges, b: Edges, near: np.ndarray, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(edge of a, edge of b) of equal rows whose boxes lie within ``near`` of
    one another, in order and without repeats; once (of a side with itself): only
    pairs whose first edge comes first."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    box_a, box_b, pad = a.box(), b.box(), 2 * near

    def close(s: np.ndarray, t: np.ndarray) -> None:
        if once:
            first = s < t
            s, t = s[first], t[first]
        # What one axis parts is not looked at on the other.
        for k in (0, 1):
            p = pad[a_row[s]]
            ok = (box_a[k][s] <= box_b[k + 2][t] + p) & (box_a[k + 2][s] >= box_b[k][t] - p)
            s, t = s[ok], t[ok]
        found.append((s, t))

    a_row = a.row
    whole = _whole(a.first, b.first)
    for s, t in _products(a.first, b.first, np.flatnonzero(whole)):
        close(s, t)
    if not whole.all():
        (large_a, of_a), (large_b, of_b) = _part(a, ~whole), _part(b, ~whole)
        grid = Grid([large_a, large_b], pad)
        (edge_a, key_a), (edge_b, key_b) = grid.cells(large_a), grid.cells(large_b)
        for s, t in _joined(key_a, key_b):
            close(of_a[edge_a[s]], of_b[edge_b[t]])
    s, t = (np.concatenate(x) for x in zip(*found, strict=True))
    if whole.all():
        return s, t
    code = np.sort(s * max(1, len(b.ax)) + t)
    code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
    return code // max(1, len(b.ax)), code % max(1, len(b.ax))


def rays(x: np.ndarray, y: np.ndarray, first: np.ndarray, e: Edges, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, edge) of equal rows where the edge is not wholly left of, above or
    below the point, in blocks that hold all edges of their points."""
    _, low, right, high = e.box()
    row, pad = np.repeat(np.arange(len(first) - 1), np.diff(first)), 2 * near

    def reached(i: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, at = pad[row[i]], y[i]
        ok = (at >= low[t] - p) & (at <= high[t] + p)
        i, t = i[ok], t[ok]
        ok = x[i] <= right[t] + pad[row[i]]
        return i[ok], t[ok]

    whole = _whole(first, e.first)
    for i, t in _products(first, e.first, np.flatnonzero(whole)):
        yield reached(i, t)
    if not whole.all():
        large, of = _part(e, ~whole)
        grid = Grid([large], pad)
        edge, band = grid.bands(large)
        points = np.flatnonzero(~whole[row])
        for i, t in _joined((row[points] << 21) + grid.band(y[points], row[points]) + 1, (large.row[edge] << 21) + band + 1):
            yield reached(points[i], of[edge[t]])
