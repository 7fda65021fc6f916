"""numpy kernels against brute force and by hand."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from corridor.config import pixels_of, pixels_of_area
from corridor.operators import kernels as K
from corridor.operators import sections

MASKS = arrays(bool, st.tuples(st.integers(2, 14), st.integers(2, 14)))


@settings(max_examples=60, deadline=None)
@given(MASKS)
def test_edt_is_exact(mask):
    d, r, c = K.edt(mask)
    at = np.argwhere(mask)
    for i in range(mask.shape[0]):
        for j in range(mask.shape[1]):
            if not len(at):
                assert d[i, j] == np.inf and r[i, j] == -1
                continue
            best = np.sqrt(((at - (i, j)) ** 2).sum(1).min())
            assert abs(d[i, j] - best) < 1e-9
            assert mask[r[i, j], c[i, j]] and abs(np.hypot(r[i, j] - i, c[i, j] - j) - best) < 1e-9


@settings(max_examples=60, deadline=None)
@given(MASKS, st.data())
def test_nearest_is_the_transform(mask, data):
    """Any places, inside the mask's box or beyond it, sparse or dense."""
    asked = np.array(data.draw(st.lists(st.tuples(st.integers(-5, 20), st.integers(-5, 20)), min_size=1, max_size=30)))
    at = np.argwhere(mask)
    d, r, c = K.nearest(asked[:, 0], asked[:, 1], {int(k): np.flatnonzero(mask[k]) for k in np.flatnonzero(mask.any(1))})
    for k, p in enumerate(asked):
        if not len(at):
            assert d[k] == np.inf and r[k] == -1
            continue
        square = ((at - p) ** 2).sum(1)
        best = at[np.lexsort((at[:, 1], at[:, 0], square))[0]]
        assert d[k] == np.sqrt(square.min()) and (r[k], c[k]) == tuple(best)


@settings(max_examples=60, deadline=None)
@given(MASKS)
def test_labels_are_components(mask):
    got = K.label(mask)
    want, n = np.zeros(mask.shape, int), 0
    for i, j in np.argwhere(mask):
        if want[i, j]:
            continue
        n = i * mask.shape[1] + j + 1
        todo = [(i, j)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not want[a, b]:
                want[a, b] = n
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (got == want).all()


@settings(max_examples=40, deadline=None)
@given(MASKS, st.integers(1, 2))
def test_morphology(mask, radius):
    o = K.disk(radius)
    big = K.dilate(mask, o)
    for i, j in np.ndindex(*mask.shape):
        near = [mask[i + r, j + c] for r, c in o if 0 <= i + r < mask.shape[0] and 0 <= j + c < mask.shape[1]]
        assert big[i, j] == any(near)
        small = all(mask[i + r, j + c] if 0 <= i + r < mask.shape[0] and 0 <= j + c < mask.shape[1] else False for r, c in o)
        assert K.erode(mask, o, False)[i, j] == small
    pad = np.pad(mask, 3 * radius)
    once = K.close(pad, o)
    assert (K.close(once, o) == once).all() and (once >= pad).all()


def test_closing_borders():
    m = np.zeros((5, 5), bool)
    m[0] = True
    assert not K.close(m, K.disk(1))[0].any()  # outside is false: the border eats
    assert K.close(m, K.disk(1), outside=True)[0].all()


def test_connect_bridges_a_line():
    m = np.zeros((9, 30), bool)
    m[4, 2:12] = m[4, 15:28] = True
    assert K.connect(m, 5)[4, 2:28].all()
    assert (K.connect(m, 2) == m).all()


def test_shapes_by_hand():
    assert len(K.disk(2)) == 13 and len(K.diamond(2)) == 13 and len(K.disk(3)) == 29 and len(K.diamond(3)) == 25
    m = np.zeros((4, 4), bool)
    m[0, 0] = m[1, 1] = True  # touch at a corner alone
    assert len(np.unique(K.label(m))) == 3


@settings(max_examples=60, deadline=None)
@given(arrays(float, st.integers(1, 40), elements=st.floats(-5, 5)))
def test_smoothing(x):
    for sigma in (1.0, 3.0):
        radius = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        w /= w.sum()
        n = len(x)

        def mirrored(j, n=n):
            j %= 2 * n
            return j if j < n else 2 * n - 1 - j

        want = [sum(w[d + radius] * x[mirrored(k + d)] for d in range(-radius, radius + 1)) for k in range(n)]
        assert np.allclose(K.gaussian(x, sigma), want)
    want = [np.mean([x[min(max(k + d, 0), len(x) - 1)] for d in range(-2, 3)]) for k in range(len(x))]
    assert np.allclose(K.moving_average(x, 5), want)


def test_peaks_by_hand():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 1, 2.5, 0.0])
    assert K.maxima(x) == [1, 4, 7, 9]
    assert K.prominence(x, 4) == 3 and K.prominence(x, 1) == 1 and K.prominence(x, 7) == 1 and K.prominence(x, 9) == 2.5
    assert K.peaks(x, 2.0) == [(4, 3.0), (9, 2.5)]
    assert K.maxima(np.ones(5)) == [] and K.maxima(np.ones(1)) == []
    left, right = K.half_width(np.array([0, 2, 4, 2, 0.0]), 2, 4.0)
    assert (left, right) == (1.0, 3.0)


def test_concave_rings_fall_into_pieces():
    comb = np.array([(0, 0), (9, 0), (9, 6), (7, 6), (7, 2), (5, 2), (5, 6), (3, 6), (3, 2), (1, 2), (1, 6), (0, 6.0)])
    pieces = K.pieces_in_box(comb, (0, 3, 9, 5))
    assert sorted(K.ring_area(p) for p in pieces) == [2, 4, 4]
    assert sorted(K.ring_area(p) for p in K.pieces_in_box(comb[::-1], (0, 3, 9, 5))) == [2, 4, 4]
    assert [K.ring_area(p) for p in K.pieces_in_box(comb, (-1, -1, 10, 1))] == [9]
    rng = np.random.default_rng(5)
    for _ in range(60):  # star-shaped rings: the area of the pieces is that of the points inside both
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        ring = np.stack([5 + rng.uniform(1, 5, 9) * np.cos(a), 5 + rng.uniform(1, 5, 9) * np.sin(a)], 1)
        x0, y0 = rng.uniform(2, 5, 2)
        x1, y1 = x0 + rng.uniform(1, 4), y0 + rng.uniform(1, 4)
        g = (np.arange(400) + 0.5) / 400
        px, py = (v.ravel() for v in np.meshgrid(x0 + g * (x1 - x0), y0 + g * (y1 - y0)))
        inside = np.zeros(len(px), bool)
        for (xa, ya), (xb, yb) in zip(ring, np.roll(ring, -1, 0)):
            cross = (ya > py) != (yb > py)
            inside ^= cross & (px < xa + (py - ya) / np.where(yb == ya, 1, yb - ya) * (xb - xa))
        pieces = K.pieces_in_box(ring, (x0, y0, x1, y1))
        assert abs(sum(map(K.ring_area, pieces)) - inside.mean() * (x1 - x0) * (y1 - y0)) < 0.02 * (x1 - x0) * (y1 - y0) + 0.01


def test_polygons_and_lines():
    ring = np.array([(0, 0), (10, 0), (10, 10), (0, 10.0)])
    assert [K.ring_area(p) for p in K.pieces_in_box(ring, (5, 5, 20, 20))] == [25] and K.pieces_in_box(ring, (11, 11, 20, 20)) == []
    p = np.array([(0, 0), (1, 0.1), (2, 0), (3, 2), (4, 0.0)])
    assert K.simplify(p, 0.5).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    r, c = K.bresenham(0, 0, 2, 4)
    assert r.tolist() == [0, 0, 1, 2, 2] and c.tolist() == [0, 1, 2, 3, 4]


def test_scaled_pixels():
    assert pixels_of(1.6, 0.1) == 16 and pixels_of(0.2, 10.0) == 1 and pixels_of_area(8.0, 0.1) == 800 and pixels_of(1.0, 0.4) == 2 and pixels_of(0.6, 0.4) == 2


def _profile(rows):
    """(dist, bands) of a profile at 0.05 m from (width in m, r, g, b, nir)."""
    parts = [np.tile(np.array(v, float)[:, None], (1, round(w / 0.05))) for w, *v in rows]
    bands = np.concatenate(parts, 1)
    return np.arange(bands.shape[1]) * 0.05 - 3.0, bands


def test_segments_of_a_step():
    dist, bands = _profile([(6.0, 100, 100, 100, 90), (1.5, 80, 120, 100, 220), (3.0, 130, 90, 80, 110)])
    runs, edges = sections.runs(dist, sections.features(bands), np.zeros(len(dist), bool))
    assert [r["label"] for r in runs] == ["asphalt", "vegetation", "red paint"]
    assert abs(sum(r["end"] - r["start"] for r in runs) - (dist[-1] - dist[0])) < 1e-9
    assert abs(edges[0][0] - 2.95) < 0.1 and abs(edges[1][0] - 4.45) < 0.1


def test_constant_and_short_profiles():
    for n in (1, 2, 50):
        bands = np.full((4, n), 100.0)
        runs, edges = sections.runs(np.arange(n) * 0.05, sections.features(bands), np.zeros(n, bool))
        assert edges == [] and len(runs) == (n > 1)


def test_branches():
    dist = np.arange(0, 8, 0.05)
    lane = (dist >= 4) & (dist <= 6)
    runs = [{"start": 0.0, "end": 2.5, "label": "asphalt"}, {"start": 2.5, "end": 4.0, "label": "vegetation"}, {"start": 4.0, "end": 8.0, "label": "red paint"}]
    dark = np.zeros(len(dist), bool)
    a = sections.by_class(dist, runs, dark, lane, 5.0, 5.5)
    assert abs(a["gap_m"] - 1.25) < 1e-9 and a["composition"] == "vegetation" and a["reliable"]
    b = sections.by_pixels(dist, runs, dark, lane, 5.0, 5.5)
    assert abs(b["gap_m"] - 1.5) < 1e-9 and b["composition"] == "vegetation"
    assert sections.by_class(dist, runs, dark, np.zeros(len(dist), bool), 5.0, 5.5) is None  # no lane at its line
    assert sections.by_pixels(dist, [runs[2] | {"start": 0.0}], dark, lane, 5.0, 5.5) is None  # no asphalt on the road
    assert sections.by_class(dist, runs, dark, lane, 5.0, 9.0)["composition"] == "contiguous"
    c = sections.by_pixels(dist, [runs[0] | {"end": 8.0}], dark, lane, 5.0, 5.5)
    assert c["gap_m"] == 0.0 and c["road_edge_m"] is None
    shady = [runs[0], runs[1] | {"label": "unknown (shadow)"}, runs[2]]
    assert not sections.by_class(dist, shady, dark, lane, 5.0, 5.5)["reliable"]


def test_near_spread_and_box():
    """As the plain kernels, ties too."""
    rng = np.random.default_rng(12)
    for k in range(40):
        h, w = rng.integers(1, 30, 2)
        mask, asked = rng.random((h, w)) < (0.0, 0.02, 0.2, 0.9)[k % 4], rng.random((h, w)) < 0.6
        d, r, c = K.edt(mask)
        for reach in (None, 0, 3, 50):
            got = K.near(mask, asked, reach)
            ok = d[asked] <= (np.inf if reach is None else reach)
            want = (np.where(ok, d[asked], np.inf), np.where(ok, r[asked], -1), np.where(ok, c[asked], -1))
            assert all((a == b).all() for a, b in zip(got, want))
        for radius in (0, 1, 2, 6):
            assert (K.spread(mask, radius) == K.dilate(mask, K.disk(radius))).all()
            wide = K.close(np.pad(mask, 2 * radius + 1), K.disk(radius))[2 * radius + 1 : -2 * radius - 1, 2 * radius + 1 : -2 * radius - 1]
            assert (K.close_disk(mask, radius) == wide).all()
        half, x = int(rng.integers(0, 9)), rng.integers(0, 9, (h, w))
        assert all(K.box(x, half)[i, j] == x[max(0, i - half) : i + half + 1, max(0, j - half) : j + half + 1].sum() for i in range(h) for j in range(w))
