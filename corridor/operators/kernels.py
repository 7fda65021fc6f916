"""numpy kernels for what has no relational form: neighbourhoods of two-dimensional masks, peaks, outlines.

Masks are boolean arrays (rows, columns).  Each function says what lies outside.
"""

from __future__ import annotations

import math

import numpy as np


def disk(radius: int) -> np.ndarray:
    """Offsets (row, column) within ``radius``."""
    span = np.arange(-radius, radius + 1)
    r, c = np.meshgrid(span, span, indexing="ij")
    keep = r * r + c * c <= radius * radius
    return np.stack([r[keep], c[keep]], 1)


def diamond(steps: int) -> np.ndarray:
    """Offsets reached by ``steps`` moves to one of the four neighbours."""
    span = np.arange(-steps, steps + 1)
    r, c = np.meshgrid(span, span, indexing="ij")
    keep = np.abs(r) + np.abs(c) <= steps
    return np.stack([r[keep], c[keep]], 1)


def line(length: int, degrees: float) -> np.ndarray:
    """Offsets of a centred line of odd length, rounded half-even."""
    half = (length | 1) // 2
    t = np.arange(-half, half + 1)
    a = np.deg2rad(degrees)
    return np.unique(np.stack([np.rint(t * np.sin(a)), np.rint(t * np.cos(a))], 1).astype(int), axis=0)


def dilate(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where any offset leads to a true pixel; false outside."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    for r, c in offsets:
        if abs(r) < h and abs(c) < w:
            out[max(0, r) : h + min(0, r), max(0, c) : w + min(0, c)] |= mask[max(0, -r) : h + min(0, -r), max(0, -c) : w + min(0, -c)]
    return out


def erode(mask: np.ndarray, offsets: np.ndarray, outside: bool) -> np.ndarray:
    """True where every offset leads to a true pixel."""
    pad = int(np.abs(offsets).max()) if len(offsets) else 0
    wide = np.pad(~mask, pad, constant_values=not outside)
    return ~dilate(wide, -offsets)[pad : pad + mask.shape[0], pad : pad + mask.shape[1]]


def close(mask: np.ndarray, offsets: np.ndarray, outside: bool = False) -> np.ndarray:
    """Dilation, then erosion; with ``outside`` true the border does not eat into the result."""
    return erode(dilate(mask, offsets), offsets, outside)


def spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """``dilate`` by a disc, a run of columns at a time."""
    h, w = mask.shape
    total = np.zeros((h, w + 1), np.int32)
    np.cumsum(mask, axis=1, out=total[:, 1:])
    at, out, runs = np.arange(w), np.zeros_like(mask), {}
    for r in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        half = math.isqrt(radius * radius - r * r)
        if half not in runs:
            runs[half] = total[:, np.minimum(at + half + 1, w)] > total[:, np.maximum(at - half, 0)]
        out[max(0, r) : h + min(0, r)] |= runs[half][max(0, -r) : h + min(0, -r)]
    return out


def close_disk(mask: np.ndarray, radius: int) -> np.ndarray:
    """``close`` by a disc with all that is outside false, where the disc may reach beyond the array."""
    wide = spread(np.pad(mask, 2 * radius), radius)
    return ~spread(~wide, radius)[2 * radius : mask.shape[0] + 2 * radius, 2 * radius : mask.shape[1] + 2 * radius]


def connect(mask: np.ndarray, px: int, orientations: int = 12) -> np.ndarray:
    """Gaps of up to ``px`` pixels closed along lines of several orientations; nothing for px < 3."""
    if px < 3 or not mask.any():
        return mask.copy()
    out = mask.copy()
    pad = (px | 1) // 2 + 1
    wide = np.pad(mask, pad)
    for k in range(orientations):
        closed = close(wide, line(px, 180.0 * k / orientations))
        out |= closed[pad:-pad, pad:-pad]
    return out


def edt(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance to the nearest true pixel, its row, its column); inf and -1 where there is none.

    Along the rows first, then over the rows of a column: exact, ties to the upper, then left pixel.
    """
    h, w = mask.shape
    cols = np.arange(w)
    left = np.maximum.accumulate(np.where(mask, cols, -1), axis=1)
    right = np.minimum.accumulate(np.where(mask, cols, 2 * w + h + 9)[:, ::-1], axis=1)[:, ::-1]
    take_left = (left >= 0) & ((cols - left) <= (right - cols))
    near = np.where(take_left, left, right)
    none = ~mask.any(axis=1)
    g = np.where(none[:, None], np.inf, (cols - near).astype(float) ** 2)
    best, row = np.full((h, w), np.inf), np.full((h, w), -1)
    rows = np.arange(h)[:, None]
    for k in range(h):
        if none[k]:
            continue
        d = (rows - k).astype(float) ** 2 + g[k]
        better = d < best
        best = np.where(better, d, best)
        row = np.where(better, k, row)
    col = np.where(row >= 0, np.take_along_axis(near, np.maximum(row, 0), axis=0), -1)
    return np.sqrt(best), row, col


def near(mask: np.ndarray, asked: np.ndarray, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, row, column) of each asked pixel's nearest true pixel, in the order of ``np.nonzero(asked)``; inf and -1 beyond ``reach``.

    As ``edt``, ties too.  Rows are gone through outwards from each pixel, as long as one can still hold a nearer one.
    """
    h, w = mask.shape
    rows, cols = np.nonzero(asked)
    best, near_row, near_col = np.full(len(rows), np.inf), np.full(len(rows), -1), np.full(len(rows), -1)
    at = np.arange(w)
    left = np.maximum.accumulate(np.where(mask, at, -(2 * w + h + 9)), axis=1)
    right = np.minimum.accumulate(np.where(mask, at, 3 * w + h + 9)[:, ::-1], axis=1)[:, ::-1]
    col = np.where(at - left <= right - at, left, right)
    aside = np.where(mask.any(axis=1)[:, None], (at - col).astype(float) ** 2, np.inf)
    most = h - 1 if reach is None else min(reach, h - 1)
    todo = np.arange(len(rows))
    for step in range(most + 1):
        todo = todo[best[todo] >= step**2]
        if not len(todo):
            break
        for sign in (-1, 1) if step else (1,):
            r = rows[todo] + sign * step
            ok = (r >= 0) & (r < h)
            own, r = todo[ok], r[ok]
            d = step**2 + aside[r, cols[own]]
            better = (d < best[own]) | ((d == best[own]) & (r < near_row[own]))
            own, r = own[better], r[better]
            best[own], near_row[own], near_col[own] = d[better], r, col[r, cols[own]]
    best = np.sqrt(best)
    far = best > reach if reach is not None else np.isinf(best)
    best[far], near_row[far], near_col[far] = np.inf, -1, -1
    return best, near_row, near_col


def box(x: np.ndarray, half: int) -> np.ndarray:
    """Sums over the window around each pixel."""
    for axis in (0, 1):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        at = np.arange(n)
        x = total.take(np.minimum(at + half + 1, n), axis) - total.take(np.maximum(at - half, 0), axis)
    return x


def nearest(rows: np.ndarray, cols: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, row, column) for each place of the nearest known one; ``known`` has each row's sorted columns.  inf without any.

    Rows are gone through outwards from each place, as long as a row can still hold a nearer one; ties to the upper, then left place.
    """
    best, near_row, near_col = np.full(len(rows), np.inf), np.full(len(rows), -1), np.full(len(rows), -1)
    if not known or not len(rows):
        return best, near_row, near_col
    lo, hi = min(known), max(known)
    reach = max(hi - int(rows.min()), int(rows.max()) - lo, 0)
    column, index = np.unique(cols, return_inverse=True)
    at = np.full((hi - lo + 1, len(column)), -1)  # for each known row and asked column the nearest known column
    for r, own in known.items():
        k = np.searchsorted(own, column)
        left, right = own[np.maximum(k - 1, 0)], own[np.minimum(k, len(own) - 1)]
        left = np.where(k > 0, left, right)
        at[r - lo] = np.where(np.abs(column - left) <= np.abs(right - column), left, right)
    todo = np.arange(len(rows))
    for step in range(reach + 1):
        todo = todo[best[todo] >= step**2]
        if not len(todo):
            break
        for sign in (-1, 1) if step else (1,):
            r = rows[todo] + sign * step
            ok = (r >= lo) & (r <= hi)
            own, r = todo[ok], r[ok]
            c = at[r - lo, index[own]]
            d = np.where(c >= 0, float(step**2) + (c - cols[own]).astype(float) ** 2, np.inf)
            better = (d < best[own]) | ((d == best[own]) & (r < near_row[own]))
            own = own[better]
            best[own], near_row[own], near_col[own] = d[better], r[better], c[better]
    return np.sqrt(best), near_row, near_col


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components: 0 outside, else 1 + the least row-major pixel of the component."""
    h, w = mask.shape
    start = mask.copy()
    start[:, 1:] &= ~mask[:, :-1]
    run = np.cumsum(start.ravel()).reshape(h, w) * mask  # runs along the rows, numbered from 1
    n = int(start.sum())
    parent = np.arange(n + 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    both = mask[1:] & mask[:-1]
    for pair in np.unique(run[:-1][both].astype(np.int64) * (n + 1) + run[1:][both]).tolist():
        x, y = map(find, divmod(pair, n + 1))
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(n + 1)])
    first = np.zeros(n + 1, np.int64)
    first[1:] = np.flatnonzero(start.ravel()) + 1
    return np.where(mask, first[root][run], 0)


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Along the last axis, mirrored at the ends (the end sample counts twice)."""
    radius = int(truncate * sigma + 0.5)
    t = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (t / sigma) ** 2)
    kernel /= kernel.sum()
    n = x.shape[-1]
    at = np.arange(-radius, n + radius) % (2 * n)
    wide = np.take(x, np.where(at < n, at, 2 * n - 1 - at), axis=-1)
    return np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), -1, wide)


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Centred mean with the ends repeated; an even size reaches further back."""
    wide = np.pad(np.asarray(x, float), (size // 2, size - size // 2 - 1), mode="edge")
    return np.convolve(wide, np.ones(size) / size, "valid")


def maxima(x: np.ndarray) -> list[int]:
    """Interior samples higher than both sides; of a plateau the middle one (the left of two)."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def prominence(x: np.ndarray, peak: int) -> float:
    """How far the higher of the two valleys that part the peak from higher ground lies below it."""
    left, low_left = peak, x[peak]
    while left >= 0 and x[left] <= x[peak]:
        low_left = min(low_left, x[left])
        left -= 1
    right, low_right = peak, x[peak]
    while right < len(x) and x[right] <= x[peak]:
        low_right = min(low_right, x[right])
        right += 1
    return float(x[peak] - max(low_left, low_right))


def half_width(x: np.ndarray, peak: int, prom: float) -> tuple[float, float]:
    """Interpolated places where the curve falls to the peak less half its prominence."""
    level = x[peak] - prom / 2
    i = peak
    while i > 0 and x[i] > level and x[i - 1] <= x[peak]:
        i -= 1
    left = float(i)
    if x[i] < level:
        left += (level - x[i]) / (x[i + 1] - x[i])
    j = peak
    while j < len(x) - 1 and x[j] > level and x[j + 1] <= x[peak]:
        j += 1
    right = float(j)
    if x[j] < level:
        right -= (level - x[j]) / (x[j - 1] - x[j])
    return left, right


def peaks(x: np.ndarray, least: float) -> list[tuple[int, float]]:
    """(place, prominence) of the maxima with at least that prominence."""
    return [(p, q) for p in maxima(x) if (q := prominence(x, p)) >= least]


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's polyline, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        d, inner = q - p, points[a + 1 : b] - p
        n = np.hypot(*d)
        off = np.hypot(*inner.T) if n == 0 else np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / n
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def pieces_beyond(ring: np.ndarray, axis: int, limit: float, sign: int) -> list[np.ndarray]:
    """The pieces of a simple ring on one side of a line across an axis.

    Along the line the ring's crossings bound the pieces in pairs: where the ring leaves, a
    piece goes on to that crossing's partner and follows the ring from there.
    """
    off = (ring[:, axis] - limit) * sign
    inside, n = off >= 0, len(ring)
    if inside.all():
        return [ring]
    if not inside.any():
        return []
    chains, cuts = [], []  # points from an entry to the next exit; (place along the line, chain, whether it is the entry)
    start = next(k for k in range(n) if inside[k] and not inside[k - 1])
    k = start
    while True:
        p, q = ring[k - 1], ring[k]
        enter = p + (q - p) * (off[k - 1] / (off[k - 1] - off[k]))
        points = [enter]
        while inside[k]:
            points.append(ring[k])
            k = (k + 1) % n
        p, q = ring[k - 1], ring[k]
        leave = p + (q - p) * (off[k - 1] / (off[k - 1] - off[k]))
        points.append(leave)
        cuts += [(enter[1 - axis], len(chains), True), (leave[1 - axis], len(chains), False)]
        chains.append(points)
        while not inside[k]:
            k = (k + 1) % n
        if k == start:
            break
    cuts.sort()
    partner = {}
    for a, b in zip(cuts[::2], cuts[1::2]):
        partner[a[1:]], partner[b[1:]] = b[1:], a[1:]
    out, done = [], set()
    for c in range(len(chains)):
        piece, at = [], c
        while at not in done:
            done.add(at)
            piece += chains[at]
            to, entry = partner[at, False]
            if not entry:  # crossings in one place: the ring touches itself on the line
                break
            at = to
        if piece:
            out.append(np.array(piece))
    return out


def pieces_in_box(ring: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The pieces of a simple ring (without repeated last point) inside x0, y0, x1, y1, side by side."""
    pieces = [ring] if len(ring) else []
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        pieces = [q for p in pieces for q in pieces_beyond(p, axis, limit, sign)]
    return pieces


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring.T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def bresenham(r0: int, c0: int, r1: int, c1: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of a line, one for each step along its longer side."""
    n = max(abs(r1 - r0), abs(c1 - c0))
    t = np.arange(n + 1) / max(n, 1)
    return np.rint(r0 + (r1 - r0) * t).astype(int), np.rint(c0 + (c1 - c0) * t).astype(int)

