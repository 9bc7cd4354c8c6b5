"""Area that boxes cover together: a numpy function over streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: So many boxes are counted on the grid of their edges.
GRID_BOXES = 48


def _on_grid(b: np.ndarray) -> float:
    xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
    i0, j0, i1, j1 = (np.searchsorted(s, b[:, k]) for k, s in enumerate((xs, ys, xs, ys)))
    n = np.zeros((len(xs), len(ys)), np.int32)
    for i, j, sign in ((i0, j0, 1), (i1, j1, 1), (i0, j1, -1), (i1, j0, -1)):
        np.add.at(n, (i, j), sign)
    over = n.cumsum(0).cumsum(1)[:-1, :-1] > 0
    return float(np.diff(xs) @ over @ np.diff(ys))


def _merged(y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals, in order, that cover the same as those given."""
    order = np.argsort(y0, kind="stable")
    y0, top = y0[order], np.maximum.accumulate(y1[order])
    first = np.append(True, y0[1:] > top[:-1])
    return y0[first], top[np.append(np.flatnonzero(first)[1:] - 1, len(top) - 1)]


def covered_area(boxes: np.ndarray) -> float:
    """Area of the union of boxes (rows of x0, y0, x1, y1 with an area).

    Columns of x are halved at the middle x edge.  In a column, boxes as wide as
    it leave it at once: what they cover of y is added and taken out of the other
    boxes' y.  The rest have an x edge in the column, so that time is about
    n log n however the boxes lie on one another.
    """
    area = 0.0
    todo = [(boxes, boxes[:, 0].min(), boxes[:, 2].max())] if len(boxes) else []
    while todo:
        b, low, high = todo.pop()
        wide = (b[:, 0] <= low) & (b[:, 2] >= high)
        if wide.any():
            start, end = _merged(b[wide, 1], b[wide, 3])
            gone = np.append(0.0, np.cumsum(end - start))
            area += float(gone[-1] * (high - low))
            b = b[~wide]
            for k in (1, 3):
                y = b[:, k]
                i = np.searchsorted(start, y, "right") - 1
                b[:, k] = np.where(i < 0, y, np.where(y <= end[i], start[i] - gone[i], y - gone[i + 1]))
            b = b[b[:, 1] < b[:, 3]]
        if not len(b):
            continue
        if len(b) <= GRID_BOXES:
            area += _on_grid(b)
            continue
        edges = b[:, [0, 2]].ravel()
        edges = edges[(edges > low) & (edges < high)]
        middle = np.partition(edges, len(edges) // 2)[len(edges) // 2]
        for a, z in ((low, middle), (middle, high)):
            part = b[(b[:, 0] < z) & (b[:, 2] > a)]
            part[:, 0], part[:, 2] = np.maximum(part[:, 0], a), np.minimum(part[:, 2], z)
            if len(part):
                todo.append((part, a, z))
    return area


def areas_of_runs(tile: list[str], keys: list[str], bounds: tuple[str, str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` on rows sorted by ``tile``: the keys of each tile and the
    area that its boxes cover.  One tile's boxes are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        name, mine = None, None  # of the open tile: its text, and a row with its keys
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in tile:
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            begins = np.flatnonzero(new)
            boxes = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in bounds])
            runs = np.split(boxes, begins)
            rows, areas = [], []
            if mine is not None and repr(batch.slice(0, 1).select(tile).to_pylist()) != name:
                rows, areas, held = [mine], [covered_area(np.concatenate(held))], []
            held.append(runs[0])
            if len(runs) > 1:
                # The first run may have begun in an earlier batch; the last one stays open.
                ends = np.append(0, begins[:-1])
                rows.append(pa.RecordBatch.from_arrays(batch.select(keys).take(pa.array(ends)).columns, names=keys))
                areas += [covered_area(np.concatenate(held)), *map(covered_area, runs[1:-1])]
                held = [runs[-1]]
            last = batch.slice(batch.num_rows - 1, 1)
            name, mine = repr(last.select(tile).to_pylist()), last.select(keys)
            if areas:
                yield _with_areas(rows, areas)
        if mine is not None:
            yield _with_areas([mine], [covered_area(np.concatenate(held))])

    return run


def _with_areas(rows: list[pa.RecordBatch], areas: list[float]) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows).append_column("area", pa.array(areas, pa.float64()))
    return table.combine_chunks().to_batches()[0]
