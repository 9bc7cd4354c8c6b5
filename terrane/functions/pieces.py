"""How the edges of two geometries lie to one another, for batches of pairs.

Both sides' edges are cut where they meet, and each piece is inside, outside or
on the border of the other side.  Predicates and overlays only read that table:
a piece lies wholly on one side, so its middle speaks for it, and neighbouring
edges that meet nothing of the other side share one answer.  The numpy code
below works on all pairs of an Arrow batch at once (in runs of ``EDGES`` edges,
so memory is bounded by that and by one pair of features); which edges are
compared is the matter of ``edge_index``.

Polygons are oriented first: outer rings counter-clockwise, holes clockwise, so
that the inside is on the left of every edge whatever order a source has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from terrane.functions.edge_index import Edges, blocks, near_pairs, ranges, rays

#: Edges of pairs that are worked on at once.
EDGES = 200_000
#: Nearer than this share of the largest coordinate is on a line.
NEAR = 1e-11
#: How a piece lies to the other side (on a border: run the same way, or against it).
OUTSIDE, INSIDE, SAME, AGAINST = range(4)


def vertices(shapes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gtype, first part of each row, first vertex of each part, x, y; null rows
    have no parts."""
    if isinstance(shapes, pa.ChunkedArray):
        shapes = shapes.combine_chunks()
    parts = shapes.flatten()[1]  # with the struct's own nulls
    lengths = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rings = parts.flatten()
    sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    points = rings.flatten()
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
    kind = shapes.field("gtype").fill_null(0).to_numpy(zero_copy_only=False)
    return kind, np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(sizes)]), x, y


def repeats(shapes: pa.StructArray) -> np.ndarray:
    """Rows whose geometry is that of the row before, vertex by vertex."""
    kind, part_of_row, vertex, x, y = vertices(shapes)
    rows = len(kind)
    out = np.zeros(rows, bool)
    first = vertex[part_of_row]
    parts, size, known = np.diff(part_of_row), np.diff(first), shapes.is_valid().to_numpy(zero_copy_only=False)
    out[1:] = (kind[1:] == kind[:-1]) & (parts[1:] == parts[:-1]) & (size[1:] == size[:-1]) & (known[1:] == known[:-1])
    # What precedes a row is a row of as many parts and vertices.
    for start, count, columns in ((part_of_row, parts, (np.diff(vertex),)), (first, size, (x, y))):
        like = np.flatnonzero(out)
        at, of = ranges(start[like], count[like]), np.repeat(like, count[like])
        for v in columns:
            out[of[v[at] != v[at - count[of]]]] = False
    return out


def edges(shapes: pa.StructArray, polygons: tuple[int, ...] = (3, 6)) -> Edges:
    """Edges of all parts, polygons oriented; edges without length are left out."""
    kind, part_of_row, vertex, x, y = vertices(shapes)
    size = np.diff(vertex)
    part = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero((part[1:] == part[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
    ax, ay, bx, by, part = x[start], y[start], x[start + 1], y[start + 1], part[start]
    # Signed areas from each part's first vertex, which keeps digits.
    x0, y0 = (v[np.minimum(vertex[:-1], max(0, len(v) - 1))][part] if len(v) else v for v in (x, y))
    area = np.bincount(part, (ax - x0) * (by - y0) - (bx - x0) * (ay - y0), minlength=len(size))
    row = np.repeat(np.arange(len(kind)), np.diff(part_of_row))
    leading = part_of_row[:-1][row]
    outer = np.where(kind[row] == polygons[1], np.sign(area) == np.sign(area[leading]) if len(area) else True, np.arange(len(size)) == leading)
    turn = (np.isin(kind[row], polygons) & (np.where(outer, area < 0, area > 0)))[part]
    ax, bx = np.where(turn, bx, ax), np.where(turn, ax, bx)
    ay, by = np.where(turn, by, ay), np.where(turn, ay, by)
    return Edges(ax, ay, bx, by, np.searchsorted(row[part], np.arange(len(kind) + 1)))


def cut_edges(e: Edges, at: np.ndarray, u: np.ndarray) -> tuple[Edges, np.ndarray]:
    """Edges cut at places 0 < u < 1 along them, and each piece's edge."""
    n = len(e.ax)
    edge = np.concatenate([at, np.arange(n), np.arange(n)])
    u = np.concatenate([u, np.zeros(n), np.ones(n)])
    order = np.lexsort((u, edge))
    edge, u = edge[order], u[order]
    new = np.ones(len(edge), bool)
    new[1:] = (edge[1:] != edge[:-1]) | (u[1:] > u[:-1] + 1e-12)
    edge, u = edge[new], u[new]
    piece = np.flatnonzero(edge[1:] == edge[:-1])
    of, p, q = edge[piece], u[piece], u[piece + 1]
    dx, dy = (e.bx - e.ax)[of], (e.by - e.ay)[of]
    ends = np.where(q == 1, e.bx[of], e.ax[of] + q * dx), np.where(q == 1, e.by[of], e.ay[of] + q * dy)
    row = e.row[of]
    return Edges(e.ax[of] + p * dx, e.ay[of] + p * dy, *ends, np.searchsorted(row, np.arange(len(e.first)))), of


def _scale(a: Edges, b: Edges) -> np.ndarray:
    """Largest coordinate of each row."""
    out = np.zeros(len(a.first) - 1)
    for e in (a, b):
        np.maximum.at(out, e.row, np.maximum(np.maximum(np.abs(e.ax), np.abs(e.ay)), np.maximum(np.abs(e.bx), np.abs(e.by))))
    return out


@dataclass
class Meeting:
    """Pieces of both sides and how they lie, and the points where edges meet."""

    a: Edges
    a_side: np.ndarray
    b: Edges
    b_side: np.ndarray
    x: np.ndarray
    y: np.ndarray
    row: np.ndarray


@dataclass
class Crossings:
    """Where edges of two sides meet: places along the edges of each (also
    outside 0 to 1, on shared lines), and the points."""

    a: tuple[np.ndarray, np.ndarray]  # edge, place
    b: tuple[np.ndarray, np.ndarray]
    x: np.ndarray
    y: np.ndarray
    row: np.ndarray


def crossings(a: Edges, b: Edges, s: np.ndarray, t: np.ndarray, near: np.ndarray) -> Crossings:
    """Where edge s[i] of a and edge t[i] of b meet."""
    row = a.row[s]
    dx, dy, ex, ey = (a.bx - a.ax)[s], (a.by - a.ay)[s], (b.bx - b.ax)[t], (b.by - b.ay)[t]
    fx, fy = b.ax[t] - a.ax[s], b.ay[t] - a.ay[s]
    den = dx * ey - dy * ex
    long_s, long_t = np.hypot(dx, dy), np.hypot(ex, ey)
    slant = np.abs(den) > 1e-12 * long_s * long_t
    safe = np.where(slant, den, 1.0)
    u, v = (fx * ey - fy * ex) / safe, (fx * dy - fy * dx) / safe
    tu, tv = near[row] / long_s, near[row] / long_t
    hit = slant & (u >= -tu) & (u <= 1 + tu) & (v >= -tv) & (v <= 1 + tv)
    # Along a shared line the ends of the one are the cuts of the other.
    line = np.flatnonzero(~slant & (np.abs(fx * dy - fy * dx) <= near[row] * long_s))
    sq, tq = (long_s * long_s)[line], (long_t * long_t)[line]
    along = lambda px, py: ((px * dx[line] + py * dy[line]) / sq)
    back = lambda px, py: ((px * ex[line] + py * ey[line]) / tq)
    u0, u1 = along(fx[line], fy[line]), along(fx[line] + ex[line], fy[line] + ey[line])
    v0, v1 = back(-fx[line], -fy[line]), back(dx[line] - fx[line], dy[line] - fy[line])
    touch = np.concatenate([np.flatnonzero(hit), *[line[(w >= 0) & (w <= 1)] for w in (u0, u1)]])
    place = np.concatenate([u[hit], *[w[(w >= 0) & (w <= 1)] for w in (u0, u1)]])
    return Crossings(
        (np.concatenate([s[hit], s[line], s[line]]), np.concatenate([u[hit], u0, u1])),
        (np.concatenate([t[hit], t[line], t[line]]), np.concatenate([v[hit], v0, v1])),
        a.ax[s[touch]] + place * dx[touch],
        a.ay[s[touch]] + place * dy[touch],
        row[touch],
    )


def inner(of: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that cut an edge."""
    cut = (w > 1e-12) & (w < 1 - 1e-12)
    return of[cut], w[cut]


def meet(a: Edges, b: Edges) -> Meeting:
    near = NEAR * _scale(a, b)
    c = crossings(a, b, *near_pairs(a, b, near), near)
    pieces_a, of_a = cut_edges(a, *inner(*c.a))
    pieces_b, of_b = cut_edges(b, *inner(*c.b))
    met_a, met_b = np.zeros(len(a.ax), bool), np.zeros(len(b.ax), bool)
    met_a[c.a[0]] = met_b[c.b[0]] = True
    return Meeting(pieces_a, sides(pieces_a, b, near, met_a[of_a]), pieces_b, sides(pieces_b, a, near, met_b[of_b]), c.x, c.y, c.row)


def sides(p: Edges, other: Edges, near: np.ndarray, met: np.ndarray) -> np.ndarray:
    """How the middle of each piece lies to the other side's edges; pieces that
    meet none of them and follow one another lie alike."""
    if not len(p.ax):
        return np.zeros(0, np.int64)
    row = p.row
    shared = ((p.bx[:-1] == p.ax[1:]) & (p.by[:-1] == p.ay[1:])) | ((p.ax[:-1] == p.bx[1:]) & (p.ay[:-1] == p.by[1:]))
    alike = shared & ~met[1:] & ~met[:-1] & (row[1:] == row[:-1])
    lead = np.flatnonzero(np.append(True, ~alike))
    x, y = ((p.ax + p.bx) / 2)[lead], ((p.ay + p.by) / 2)[lead]
    inside, border = locate(x, y, np.searchsorted(row[lead], np.arange(len(p.first))), other, near, (p.bx - p.ax)[lead], (p.by - p.ay)[lead])
    side = np.where(border > 0, SAME, np.where(border < 0, AGAINST, inside.astype(np.int64)))
    return np.repeat(side, np.diff(np.append(lead, len(row))))


def locate(x: np.ndarray, y: np.ndarray, first: np.ndarray, other: Edges, near: np.ndarray, dx: np.ndarray | None = None, dy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inside by the even-odd rule, on the border) of points; the border is 1
    where it runs as (dx, dy) does (or none is given), -1 where it runs against it."""
    odd, border = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    other_row = other.row
    for i, t in rays(x, y, first, other, near):
        close = near[other_row[t]]
        ax, ay, bx, by = other.ax[t], other.ay[t], other.bx[t], other.by[t]
        px, py = x[i], y[i]
        ex, ey = bx - ax, by - ay
        size = np.hypot(ex, ey)
        cross, dot = ex * (py - ay) - ey * (px - ax), ex * (px - ax) + ey * (py - ay)
        on = (np.abs(cross) <= close * size) & (dot >= -close * size) & (dot <= (size + close) * size)
        spans = (ay > py) != (by > py)
        at = ax + (py - ay) * ex / np.where(ey == 0, 1.0, ey)
        odd ^= np.bincount(i[spans & (px < at)], minlength=len(x)) % 2 == 1
        way = np.ones(len(i)) if dx is None else ex * dx[i] + ey * dy[i]
        # Where a border runs both ways (two parts that touch), the same way is named.
        for sign in (-1, 1):
            border[i[on & (way * sign > 0)]] = sign
    return odd, border


#: For each overlay, the pieces of the first and of the second polygon that bound it.
KEPT = {"intersection": ((INSIDE, SAME), (INSIDE,)), "union": ((OUTSIDE, SAME), (OUTSIDE,)), "difference": ((OUTSIDE, AGAINST), (INSIDE,))}


def bounding(m: Meeting, how: str) -> Edges:
    """Directed edges that bound an overlay, the inside on their left."""
    own, others = KEPT[how]
    k, j = np.isin(m.a_side, own), np.isin(m.b_side, others)
    b = (m.b.ax, m.b.ay, m.b.bx, m.b.by)
    if how == "difference":
        b = (b[2], b[3], b[0], b[1])
    row = np.concatenate([m.a.row[k], m.b.row[j]])
    order = np.argsort(row, kind="stable")
    ends = [np.concatenate([x[k], z[j]])[order] for x, z in zip((m.a.ax, m.a.ay, m.a.bx, m.a.by), b, strict=True)]
    return Edges(*ends, np.searchsorted(row[order], np.arange(len(m.a.first))))


def enclosed(e: Edges) -> np.ndarray:
    """Area that each row's directed edges bound."""
    row = e.row
    has = np.minimum(e.first[:-1], max(0, len(e.ax) - 1))[row]
    x0, y0 = e.ax[has], e.ay[has]
    return np.bincount(row, (e.ax - x0) * (e.by - y0) - (e.bx - x0) * (e.ay - y0), minlength=len(e.first) - 1) / 2


def convex(e: Edges) -> np.ndarray:
    """Rows that are one closed ring, turning left at every corner and once around."""
    has = np.diff(e.first) > 2
    if not len(e.ax):
        return has
    after = np.arange(1, len(e.ax) + 1)
    live = np.flatnonzero(np.diff(e.first))
    after[e.first[live + 1] - 1] = e.first[live]
    dx, dy = e.bx - e.ax, e.by - e.ay
    ex, ey = dx[after], dy[after]
    turn = dx * ey - dy * ex
    bent = (turn < 0) | ((turn == 0) & (dx * ex + dy * ey <= 0)) | (e.bx != e.ax[after]) | (e.by != e.ay[after])
    # Directions that pass from the lower half to the upper one: once in a turn.
    up = (dy > 0) | ((dy == 0) & (dx > 0))
    row = e.row
    return has & (np.bincount(row[bent], minlength=len(has)) == 0) & (np.bincount(row[~up & up[after]], minlength=len(has)) == 1)


def convex_shared(a: Edges, b: Edges) -> np.ndarray:
    """Areas that two convex rings of each row share: the first is cut by the
    second's edges, one after the other.  What is thinner than ``NEAR`` is nothing."""
    rows = len(a.first) - 1
    out, long = np.zeros(rows), np.zeros(rows)
    steps = np.diff(b.first)
    # From each row's first corner, which keeps digits.
    x0, y0 = a.ax[a.first[:-1]], a.ay[a.first[:-1]]
    row = a.row
    x, y = a.ax - x0[row], a.ay - y0[row]
    for k in range(int(steps.max(initial=0)) + 1):
        if not len(row):
            break
        new = np.flatnonzero(row[1:] != row[:-1]) + 1
        after = np.arange(1, len(row) + 1)
        after[np.append(new - 1, len(row) - 1)] = np.append(0, new)
        full = steps[row] == k
        if full.any():
            i, j, of = np.flatnonzero(full), after[full], row[full]
            out += np.bincount(of, x[i] * y[j] - x[j] * y[i], minlength=rows) / 2
            long += np.bincount(of, np.hypot(x[j] - x[i], y[j] - y[i]), minlength=rows)
            # What is left begins anew: whole rows are gone.
            x, y, row = x[~full], y[~full], row[~full]
            if not len(row):
                break
            after = after[~full] - np.cumsum(full)[after[~full]]
        at = np.minimum(b.first[:-1] + k, len(b.ax) - 1)
        px, py, dx, dy = b.ax[at] - x0, b.ay[at] - y0, (b.bx - b.ax)[at], (b.by - b.ay)[at]
        d = dx[row] * (y - py[row]) - dy[row] * (x - px[row])
        inside = d >= 0
        cut = inside != inside[after]
        if not cut.any():
            x, y, row = x[inside], y[inside], row[inside]
            continue
        count = inside.astype(np.int64) + cut
        to = np.cumsum(count) - count
        i = np.flatnonzero(cut)
        j = after[i]
        u = d[i] / (d[i] - d[j])
        keep = np.flatnonzero(inside)
        total = int(count.sum())
        nx, ny, nrow = np.empty(total), np.empty(total), np.empty(total, np.int64)
        nx[to[keep]], ny[to[keep]], nrow[to[keep]] = x[keep], y[keep], row[keep]
        place = to[i] + inside[i]
        nx[place], ny[place], nrow[place] = x[i] + u * (x[j] - x[i]), y[i] + u * (y[j] - y[i]), row[i]
        x, y, row = nx, ny, nrow
    return np.where(out > NEAR * _scale(a, b) * long, out, 0.0)


def shared(a: Edges, b: Edges) -> np.ndarray:
    """Area that the two polygons of each row share."""
    out = np.zeros(len(a.first) - 1)
    plain = convex(a) & convex(b)
    for rows, measure in ((np.flatnonzero(plain), convex_shared), (np.flatnonzero(~plain), lambda p, q: enclosed(bounding(meet(p, q), "intersection")))):
        if not len(rows):
            continue
        p, q = (e if len(rows) == len(out) else e.take(rows) for e in (a, b))
        for lo, hi in blocks(np.diff(p.first) + np.diff(q.first), EDGES):
            out[rows[lo:hi]] = measure(p.slice(lo, hi), q.slice(lo, hi))
    return out


def in_runs(a: Edges, b: Edges) -> Iterator[tuple[int, int, Meeting]]:
    for lo, hi in blocks(np.diff(a.first) + np.diff(b.first), EDGES):
        yield lo, hi, meet(a.slice(lo, hi), b.slice(lo, hi))


def _any(row: np.ndarray, where: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, bool)
    out[row[where]] = True
    return out


def relations(a: pa.StructArray, b: pa.StructArray) -> dict[str, np.ndarray]:
    """``contains`` (b in a), ``overlaps`` and ``crosses`` of each pair; masked
    where a side is a collection or null."""
    ea, eb = edges(a), edges(b)
    rows = len(ea.first) - 1
    kinds = [np.select([np.isin(k, (3, 6)), np.isin(k, (2, 5)), np.isin(k, (1, 4))], [2, 1, 0], -1) for k in (vertices(a)[0], vertices(b)[0])]
    out = {k: np.zeros(rows, bool) for k in ("contains", "overlaps", "crosses")}
    for lo, hi, m in in_runs(ea, eb):
        n = hi - lo
        has = {("a", s): _any(m.a.row, m.a_side == s, n) for s in range(4)} | {("b", s): _any(m.b.row, m.b_side == s, n) for s in range(4)}
        ka, kb = kinds[0][lo:hi], kinds[1][lo:hi]
        on = lambda k: has[k, SAME] | has[k, AGAINST]  # noqa: B023, E731
        # Polygon and polygon.
        both = (ka == 2) & (kb == 2)
        share = has["b", INSIDE] | has["a", INSIDE] | has["b", SAME]
        own_a = has["a", OUTSIDE] | has["b", INSIDE] | has["a", AGAINST]
        own_b = has["b", OUTSIDE] | has["a", INSIDE] | has["b", AGAINST]
        out["overlaps"][lo:hi] = both & share & own_a & own_b
        out["contains"][lo:hi] = both & share & ~own_b
        # A line in a polygon, and a line that passes through its border.
        out["contains"][lo:hi] |= (ka == 2) & (kb == 1) & has["b", INSIDE] & ~has["b", OUTSIDE]
        out["crosses"][lo:hi] |= (ka == 2) & (kb == 1) & has["b", INSIDE] & has["b", OUTSIDE]
        out["crosses"][lo:hi] |= (kb == 2) & (ka == 1) & has["a", INSIDE] & has["a", OUTSIDE]
        # Line and line: a shared stretch, or a point that is an end of neither.
        lines = (ka == 1) & (kb == 1)
        outer = lambda k: has[k, OUTSIDE] | has[k, INSIDE]  # noqa: B023, E731
        out["overlaps"][lo:hi] |= lines & on("a") & outer("a") & outer("b")
        out["contains"][lo:hi] |= lines & on("b") & ~outer("b")
        if lines.any():
            near = NEAR * _scale(ea.slice(lo, hi), eb.slice(lo, hi))[m.row] * 10
            inside = ~_at_ends(m.x, m.y, m.row, a.slice(lo, n), near) & ~_at_ends(m.x, m.y, m.row, b.slice(lo, n), near)
            out["crosses"][lo:hi] |= lines & _any(m.row, inside, n) & ~on("a")
    for (ka, kb), flip in (((kinds[0], kinds[1]), False), ((kinds[1], kinds[0]), True)):
        # Points against lines and polygons.
        points, shape = (b, ea) if not flip else (a, eb)
        pick = (kb == 0) & (ka > 0)
        if not pick.any():
            continue
        _, part, vertex, x, y = vertices(points)
        first = vertex[part]
        near = NEAR * np.maximum(_scale(shape, shape), 1e-300)
        within, border = locate(x, y, first, shape, near)
        on_line = border != 0
        within &= ~on_line
        row = np.repeat(np.arange(rows), np.diff(first))
        polygon = ka == 2
        interior = np.where(polygon[row], within, on_line & ~_at_ends(x, y, row, a if not flip else b))
        covered = np.where(polygon[row], within | on_line, on_line)
        some, free = _any(row, interior, rows), _any(row, ~covered, rows)
        out["crosses"] |= pick & some & free
        if not flip:
            out["contains"] |= pick & some & ~free
    both = (kinds[0] == 0) & (kinds[1] == 0)
    if both.any():
        # Points and points: as sets.
        sets = []
        for shapes in (a, b):
            _, part, vertex, x, y = vertices(shapes)
            row = np.repeat(np.arange(rows), np.diff(vertex[part]))
            sets.append(np.unique(np.stack([row, x, y], axis=1), axis=0) if len(row) else np.zeros((0, 3)))
        every, times = np.unique(np.concatenate(sets), axis=0, return_counts=True)
        shared = np.bincount(every[times > 1][:, 0].astype(np.int64), minlength=rows)
        own = [np.bincount(v[:, 0].astype(np.int64), minlength=rows) for v in sets]
        out["contains"] |= both & (own[1] > 0) & (shared == own[1])
        out["overlaps"] |= both & (shared > 0) & (shared < own[0]) & (shared < own[1])
    known = (kinds[0] >= 0) & (kinds[1] >= 0)
    return {name: np.ma.array(v, mask=~known) for name, v in out.items()}


def _ends(shapes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) of the ends of lines: the first and last vertices of parts
    that occur an odd number of times among them."""
    _, part, vertex, x, y = vertices(shapes)
    row = np.repeat(np.arange(len(part) - 1), np.diff(part))
    has = np.diff(vertex) > 0
    at = np.concatenate([vertex[:-1][has], vertex[1:][has] - 1])
    ends = np.stack([np.tile(row[has], 2), x[at], y[at]], axis=1) if len(at) else np.zeros((0, 3))
    ends, times = np.unique(ends, axis=0, return_counts=True)
    ends = ends[times % 2 == 1]
    return ends[:, 0].astype(np.int64), ends[:, 1], ends[:, 2]


def _by_row(row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in row, place in other) of equal rows; other is sorted."""
    lo, hi = np.searchsorted(other, row, "left"), np.searchsorted(other, row, "right")
    return np.repeat(np.arange(len(row)), hi - lo), ranges(lo, hi - lo)


def _at_ends(x: np.ndarray, y: np.ndarray, row: np.ndarray, shapes: pa.StructArray, near: np.ndarray | float = 0.0) -> np.ndarray:
    """Points that are ends of their row's lines."""
    of, ex, ey = _ends(shapes)
    i, k = _by_row(row, of)
    out = np.zeros(len(x), bool)
    out[i[np.hypot(x[i] - ex[k], y[i] - ey[k]) <= (near if np.isscalar(near) else near[i])]] = True
    return out


def chained(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, snap: float = 1e-9) -> list[np.ndarray]:
    """Closed rings (n x 2 arrays) of one row's directed edges.

    Ends within ``snap`` of the edges' extent (or what doubles can tell apart at
    their coordinates) are one point: points are joined to the nearest earlier
    one in order of x, so no rounding border parts them.  Where several ways lead on, the leftmost turn is taken, which keeps
    rings that touch in a point apart.  Edges that close no ring raise an error.
    """
    n = len(ax)
    if not n:
        return []
    x, y = np.concatenate([ax, bx]), np.concatenate([ay, by])
    near = max(1e-300, snap * float(max(np.ptp(x), np.ptp(y))), 2e-15 * float(max(np.abs(x).max(), np.abs(y).max())))
    order = np.argsort(x, kind="stable")
    node = np.full(2 * n, -1)
    for k, i in enumerate(order):
        if node[i] < 0:
            node[i] = i
            for j in order[k + 1 :]:
                if x[j] - x[i] > near:
                    break
                if node[j] < 0 and abs(y[j] - y[i]) <= near:
                    node[j] = i
    ways: dict[int, list[int]] = {}
    for i in range(n):
        if node[i] != node[n + i]:
            ways.setdefault(int(node[i]), []).append(i)
    angle = np.arctan2(by - ay, bx - ax)
    out = []
    while ways:
        start = next(iter(ways))
        at, before, ring = start, None, []
        while True:
            if at not in ways:
                raise ValueError("edges do not close a ring")
            turn = lambda i: 0.0 if before is None else np.remainder(angle[i] - before + np.pi, 2 * np.pi)  # noqa: B023, E731
            i = max(ways[at], key=turn)
            ways[at].remove(i)
            if not ways[at]:
                del ways[at]
            ring.append(int(node[i]))
            at, before = int(node[n + i]), angle[i]
            if at == start:
                break
        if len(ring) > 2:
            ring.append(ring[0])
            out.append(np.stack([x[ring], y[ring]], axis=1))
    return out


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons of rings in any order and direction: each outer ring, turned
    counter-clockwise, followed by its holes, turned clockwise.  A ring that an
    even number of others holds is outer."""
    area = [ring_area(r) for r in rings]
    rings = [r for r, a in zip(rings, area, strict=True) if a]
    area = [abs(a) for a in area if a]
    holders: list[list[int]] = []
    for i, r in enumerate(rings):
        # The middle of an edge is on no other ring's corner; touching rings meet in corners.
        mid = (r[0] + r[1]) / 2
        held = []
        for j, q in enumerate(rings):
            if area[j] > area[i]:
                spans = (q[:-1, 1] > mid[1]) != (q[1:, 1] > mid[1])
                rise = np.where(q[1:, 1] == q[:-1, 1], 1.0, q[1:, 1] - q[:-1, 1])
                x = q[:-1, 0] + (mid[1] - q[:-1, 1]) * (q[1:, 0] - q[:-1, 0]) / rise
                if (spans & (mid[0] < x)).sum() % 2:
                    held.append(j)
        holders.append(held)
    turned = lambda r, left: r if (ring_area(r) > 0) == left else r[::-1]
    outer = [i for i in range(len(rings)) if len(holders[i]) % 2 == 0]
    out = {i: [turned(rings[i], True)] for i in outer}
    for i in range(len(rings)):
        if i not in out:
            own = min((j for j in holders[i] if j in out), key=lambda j: area[j])
            out[own].append(turned(rings[i], False))
    return [out[i] for i in outer]


def vertex_distances(points: pa.StructArray, shapes: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each vertex of a row's points from the vertices and edges of
    its other geometry (infinite from none), and the rows' first vertices."""
    _, of_points, vertex, x, y = vertices(points)
    first = vertex[of_points]
    _, of_shapes, vertex, u, v = vertices(shapes)
    last = np.zeros(len(u), bool)
    last[vertex[1:][np.diff(vertex) > 0] - 1] = True
    begin, far = vertex[of_shapes], np.full(len(x), np.inf)
    # An edge from every vertex: the last of a part leads to itself.
    to = np.arange(len(u)) + ~last
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    count = np.diff(begin)[row]
    for lo, hi in blocks(count):
        n = count[lo:hi]
        i, t = lo + np.repeat(np.arange(hi - lo), n), ranges(begin[row[lo:hi]], n)
        ex, ey, px, py = u[to[t]] - u[t], v[to[t]] - v[t], x[i] - u[t], y[i] - v[t]
        size = ex * ex + ey * ey
        along = np.clip((px * ex + py * ey) / np.where(size > 0, size, 1.0), 0, 1)
        live = np.flatnonzero(n)
        if len(live):
            far[lo + live] = np.minimum.reduceat(np.hypot(px - along * ex, py - along * ey), (np.cumsum(n) - n)[live])
    return far, first


def border_distance(x: np.ndarray, y: np.ndarray, first: np.ndarray, e: Edges) -> np.ndarray:
    """Distance of points from the edges of their row, negative outside."""
    out = np.empty(len(x))
    count = np.diff(e.first)[np.repeat(np.arange(len(first) - 1), np.diff(first))]
    start = np.repeat(e.first[:-1], np.diff(first))
    for a, b in blocks(count):
        i, t = np.repeat(np.arange(b - a), count[a:b]), ranges(start[a:b], count[a:b])
        px, py = x[a:b][i] - e.ax[t], y[a:b][i] - e.ay[t]
        ex, ey = (e.bx - e.ax)[t], (e.by - e.ay)[t]
        u = np.clip((px * ex + py * ey) / (ex * ex + ey * ey), 0, 1)
        far = np.hypot(px - u * ex, py - u * ey)
        spans = ((e.ay[t] > py + e.ay[t]) != (e.by[t] > py + e.ay[t])) & (px < py * ex / np.where(ey == 0, 1.0, ey))
        begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        odd = np.bincount(i[spans], minlength=b - a) % 2 == 1
        out[a:b] = np.minimum.reduceat(far, begin) * np.where(odd, 1, -1)
    return out


def label_points(shapes: pa.StructArray, cells: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The point of each polygon's grid that is farthest inside, found from
    coarse cells down to fine ones; cells that cannot hold a better point than
    the best so far are dropped."""
    e = edges(shapes)
    rows = len(e.first) - 1
    has = np.flatnonzero(np.diff(e.first))
    out_x, out_y = np.full(rows, np.nan), np.full(rows, np.nan)
    if not len(has):
        return out_x, out_y
    e = Edges(e.ax, e.ay, e.bx, e.by, np.append(e.first[has], len(e.ax)))
    begin = e.first[:-1]
    x0, y0 = (np.minimum.reduceat(v, begin) for v in (e.ax, e.ay))
    w, h = (np.maximum.reduceat(v, begin) - o for v, o in ((e.ax, x0), (e.ay, y0)))
    n = len(has)
    best = np.full(n, -np.inf)
    best_i, best_j = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # Points of the finest grid, as whole numbers; the first step has every eighth of them.
    step = max(1, cells // 8)
    side = np.arange(step // 2 if step > 1 else 1, cells, step)
    row = np.repeat(np.arange(n), len(side) ** 2)
    i, j = (np.tile(v.reshape(-1), n) for v in np.meshgrid(side, side, indexing="ij"))
    while True:
        d = border_distance(x0[row] + w[row] * i / cells, y0[row] + h[row] * j / cells, np.searchsorted(row, np.arange(n + 1)), e)
        # Of equal distances the one with least (i, j).
        order = np.lexsort((j, i, -d, row))
        lead = order[np.append(True, row[order][1:] != row[order][:-1])]
        better = d[lead] > best[row[lead]]
        k = lead[better]
        best[row[k]], best_i[row[k]], best_j[row[k]] = d[k], i[k], j[k]
        if step == 1:
            break
        reach = np.hypot(w[row], h[row]) / cells * step
        live = d + reach >= np.maximum(best[row], 0)
        row, i, j = row[live], i[live], j[live]
        # The points around each, half as far apart.
        half = max(1, step // 2)
        moves = np.array([(a, b) for a in range(-step, step + 1, half) for b in range(-step, step + 1, half)])
        row = np.repeat(row, len(moves))
        i, j = (np.repeat(v, len(moves)) + np.tile(moves[:, m], len(v)) for m, v in ((0, i), (1, j)))
        ok = (i > 0) & (i < cells) & (j > 0) & (j < cells)
        place = np.unique((row[ok] * cells + i[ok]) * cells + j[ok])
        row, i, j, step = place // (cells * cells), place // cells % cells, place % cells, half
    px, py = x0 + w * best_i / cells, y0 + h * best_j / cells
    for r in np.flatnonzero(best <= 0):
        px[r], py[r] = _middle_of_line(e.slice(r, r + 1))
    out_x[has], out_y[has] = px, py
    return out_x, out_y


def _middle_of_line(e: Edges) -> tuple[float, float]:
    """Middle of the longest stretch inside, of lines halfway between corners."""
    levels = np.unique(e.ay)
    best = (0.0, np.nan, np.nan)
    for y in (levels[1:] + levels[:-1]) / 2:
        spans = (e.ay > y) != (e.by > y)
        x = np.sort(e.ax[spans] + (y - e.ay[spans]) * (e.bx - e.ax)[spans] / (e.by - e.ay)[spans])
        for a, b in zip(x[::2], x[1::2], strict=False):
            if b - a > best[0]:
                best = (b - a, (a + b) / 2, y)
    return best[1], best[2]
