"""Scanned pages: the reading order of their lines.

A page's text has one scanned line per text line in the scanner's order, which may mix the columns. The boxes of the
lines give their column (a gap between left edges) and their height in it; boxes may have their edges exchanged. Where
a page has no boxes, or not one for each line, the order is the one, among plain and column-mixed orders, in which most
lines go on where the line before broke off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BREAKS = "-=¬­"


def _edges(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Per page the number of boxes (-1 without) and where its boxes start; per box its left and upper edge (NaN unknown)."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    n = np.diff(offsets)
    n[~np.asarray(column.is_valid())] = -1
    boxes = column.values

    def side(field: str) -> np.ndarray:
        return boxes.field(field).cast(pa.float64()).to_numpy(zero_copy_only=False)

    if not len(boxes):
        return n, offsets[:-1], np.zeros(0), np.zeros(0)
    return n, offsets[:-1], np.fmin(side("x0"), side("x1")), np.fmin(side("y0"), side("y1"))


def _unmixed(n: int, columns: int, rows: int) -> list[int]:
    """Order of ``n`` lines scanned across ``columns`` columns of equal height, ``rows`` lines of each at a time."""
    height = -(-n // columns)
    heights = [height] * (columns - 1) + [n - height * (columns - 1)]
    if heights[-1] <= 0:
        return []
    taken: list[list[int]] = [[] for _ in range(columns)]
    at = 0
    for top in range(0, height, rows):
        for c in range(columns):
            k = max(0, min(rows, heights[c] - top))
            taken[c] += range(at, at + k)
            at += k
    return [i for c in taken for i in c]


def _goes_on(a: str, b: str) -> float:
    """How well line ``b`` follows line ``a``."""
    first = b[:1]
    if a[-1:] in BREAKS and a:
        return 1.0 if first.islower() else -1.0
    if a[-1:] in ".!?":
        return 0.3 if not first.islower() else -1.0
    return 0.2 if first.islower() else 0.0


def guessed_order(lines: list[str]) -> list[int]:
    """Reading order of a page's lines (its head excluded) without boxes."""
    n = len(lines)
    plain = list(range(n))
    best, order = sum(_goes_on(lines[i], lines[i + 1]) for i in range(n - 1)), plain
    for columns in (2, 3, 4):
        for rows in range(1, 13):
            if rows * columns >= n:
                break
            other = _unmixed(n, columns, rows)
            score = sum(_goes_on(lines[i], lines[j]) for i, j in zip(other, other[1:])) if other else -1e9
            if score > best + 0.5:
                best, order = score, other
    return order


@dataclass
class Reading:
    """Lines of a batch of pages in reading order, without page heads.

    Of each line: its row in the batch, its column on the page, its number in the text as scanned, and the number of the
    reading it belongs to (a page may be read in two orders). Of each row: the text.
    """

    lines: list[str]
    row: np.ndarray
    column: np.ndarray
    number: np.ndarray
    reading: np.ndarray
    texts: list[str | None]


def read_pages(batch: pa.RecordBatch, text: str, boxes: str, both: bool = False) -> Reading:
    """The pages of the batch in reading order; with ``both``, pages whose order is guessed also as they were scanned."""
    texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
    pages = [t.split("\n") if t else [] for t in texts]
    n_lines = np.array([len(p) for p in pages], np.int64)
    n_boxes, start, x, y = _edges(batch, boxes)
    boxed = (n_boxes == n_lines) & (n_lines > 0)
    if boxed.any():
        has = np.isfinite(x) & np.isfinite(y)
        for p in np.flatnonzero(boxed):
            if not has[start[p] : start[p] + n_lines[p]].all():
                boxed[p] = False
    out_lines: list[str] = []
    out_row: list[np.ndarray] = []
    out_column: list[np.ndarray] = []
    out_number: list[np.ndarray] = []
    which = np.flatnonzero(boxed & (n_lines > 1))
    order_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(which):
        m = n_lines[which] - 1
        page = np.repeat(np.arange(len(which)), m)
        ordinal = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + 1
        at = np.repeat(start[which], m) + ordinal
        px, py = x[at], y[at]
        by_x = np.lexsort((px, page))
        sx, sp = px[by_x], page[by_x]
        new_page = np.r_[True, sp[1:] != sp[:-1]]
        head = np.flatnonzero(new_page)
        width = np.maximum.reduceat(sx, head) - np.minimum.reduceat(sx, head)
        gap = np.r_[0.0, np.diff(sx)]
        opens = new_page | (gap > np.maximum(60.0, 0.06 * np.repeat(width, np.diff(np.r_[head, len(sx)]))))
        number = np.cumsum(opens)
        number -= np.repeat(number[head], np.diff(np.r_[head, len(sx)]))
        column = np.empty(len(px), np.int64)
        column[by_x] = number
        placed = np.lexsort((ordinal, py, column, page))
        cut = np.cumsum(m)
        begin = cut - m
        for i, p in enumerate(which):
            o = placed[begin[i] : cut[i]]
            order_of[p] = (ordinal[o], column[o])
    for p, lines in enumerate(pages):
        if not lines:
            continue
        if len(lines) == 1:  # no head without anything below it
            order, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif p in order_of:
            order, column = order_of[p]
        else:
            order = np.array(guessed_order(lines[1:]), np.int64) + 1
            column = np.zeros(len(order), np.int64)
        orders = [order]
        if both and p not in order_of and (order[1:] < order[:-1]).any():
            orders.append(np.sort(order))
        for order in orders:
            out_lines += [lines[i] for i in order]
            out_row.append(np.full(len(order), p))
            out_column.append(column)
            out_number.append(order)
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Reading(out_lines, whole(out_row), whole(out_column), whole(out_number), np.repeat(np.arange(len(out_row)), [len(r) for r in out_row]), texts)
