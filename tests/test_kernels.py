"""Array kernels against plain definitions on small random rasters."""

import numpy as np
import pytest

from folioloom.functions import kernels as K

RNG = np.random.default_rng(3)
GRAY = RNG.integers(0, 256, (23, 31)).astype(np.uint8)
BITS = RNG.random((23, 31)) < 0.45


def plain_window(a, wh, ww, f):
    out = np.empty(a.shape, float)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            y0, x0 = y - wh // 2, x - ww // 2
            out[y, x] = f(a[max(0, y0) : y0 + wh, max(0, x0) : x0 + ww].astype(float))
    return out


@pytest.mark.parametrize(("wh", "ww"), [(1, 1), (3, 3), (5, 2), (4, 7)])
def test_windows(wh, ww):
    assert (K.sliding(GRAY, wh, ww, np.minimum) == plain_window(GRAY, wh, ww, np.min)).all()
    assert (K.sliding(GRAY, wh, ww, np.maximum) == plain_window(GRAY, wh, ww, np.max)).all()
    assert (K.window_sum(GRAY, wh, ww) == plain_window(GRAY, wh, ww, np.sum)).all()
    m, s = K.local_stats(GRAY, wh, ww)
    assert np.allclose(m, plain_window(GRAY, wh, ww, np.mean)) and np.allclose(s, plain_window(GRAY, wh, ww, np.std), atol=1e-5)


def test_morphology_is_dual():
    assert (K.dilate(BITS) == ~K.erode(~BITS)).all()
    assert (K.opened(BITS) <= BITS).all() and (K.closed(BITS)[1:-1, 1:-1] >= BITS[1:-1, 1:-1]).all()
    assert (K.dilate(GRAY) <= GRAY).all()  # the dark grows


def reachable(seed, mask, eight):
    out = seed & mask
    while True:
        grown = K.sliding(out, 3, 3, np.maximum) if eight else out | K.shifted(out, 1, 0) | K.shifted(out, -1, 0) | K.shifted(out, 0, 1) | K.shifted(out, 0, -1)
        after = grown & mask
        if (after == out).all():
            return out
        out = after


@pytest.mark.parametrize("eight", [True, False])
def test_components_and_fill(eight):
    labels, n = K.components(BITS, eight)
    assert ((labels > 0) == BITS).all() and set(np.unique(labels)) == set(range(n + 1))
    for k in range(1, n + 1, 5):
        own = labels == k
        seed = np.zeros_like(BITS)
        seed[tuple(np.argwhere(own)[0])] = True
        assert (reachable(seed, BITS, eight) == own).all()
        assert (K.seed_fill(seed, BITS, eight) == own).all()
        x0, y0, x1, y1, size = K.component_table(labels, n)[k - 1]
        ys, xs = np.nonzero(own)
        assert (x0, y0, x1, y1, size) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, own.sum())


def test_seed_mask_strip():
    seed, mask = np.zeros((2, 70), bool), np.ones((2, 70), bool)
    seed[0, 3] = True
    assert (K.seed_fill(seed, mask) == mask).all()


def test_gray_reconstruction():
    seed = np.maximum(GRAY, 255 - (np.arange(GRAY.size).reshape(GRAY.shape) % 97 == 0) * 255).astype(np.uint8)
    out = seed.astype(int)
    while True:
        after = np.maximum(K.sliding(out, 3, 3, np.minimum), GRAY)
        if (after == out).all():
            break
        out = after
    assert (K.seed_fill_gray(seed, GRAY) == out).all()


def test_distance():
    d, at = K.distance_map(BITS)
    ys, xs = np.nonzero(BITS)
    y, x = np.mgrid[0:23, 0:31]
    want = ((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(2)
    assert (d == want).all() and BITS.ravel()[at].all()
    assert np.isinf(K.distance_map(np.zeros((3, 3), bool))[0]).all()


def test_otsu():
    h = np.zeros(256, int)
    h[[10, 200]] = 50
    assert K.otsu(h) == (11 + 200) // 2
    h[:] = 0
    h[7] = 9
    assert K.otsu(h) == 0


def test_every_binarisation():
    page = np.full((60, 80), 220, np.uint8)
    page[20:30, 10:70] = 30
    page = np.clip(page + RNG.integers(-9, 9, page.shape), 0, 255).astype(np.uint8)
    for method in K.METHODS:
        b = K.binarize(page, method, 21)
        assert b.dtype == bool and b.shape == page.shape
    for method in ("otsu", "bimodal", "sauvola", "bradley", "wolf", "gatos"):
        assert K.binarize(page, method, 41)[22:28, 15:65].mean() > 0.9, method


@pytest.mark.parametrize("angle", [-3.0, 1.5, 4.0])
def test_skew(angle):
    lines = np.repeat(np.arange(200) % 14 < 5, 300).reshape(200, 300)
    found, sure = K.skew(K.shear_rows(lines, np.tan(np.radians(angle))))
    assert abs(found - angle) <= 0.15 and sure >= 2
    assert K.skew(np.zeros((50, 50), bool))[1] in (0.0, 2.0)


def test_scaling():
    assert (K.scale_to_gray(GRAY, *GRAY.shape) == GRAY).all()
    assert K.scale_to_gray(np.full((10, 10), 77, np.uint8), 3, 7).tolist() == [[77] * 7] * 3
    assert (K.transform(GRAY, np.eye(3), *GRAY.shape, over=1) == GRAY).all()
    assert K.reduce_bits(np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool), 2).tolist() == [[True]]


def test_polygon_hull_whitespace():
    square = [(1, 1), (8, 1), (8, 8), (1, 8)]
    assert K.fill_polygon(10, 10, square).sum() == 49
    assert K.fill_polygon(10, 10, square + square, winding=True).sum() == 49
    assert K.fill_polygon(10, 10, square + square).sum() == 0
    assert len(K.convex_hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])) == 4
    rects = K.whitespace(np.array([(4, 4, 6, 6)]), 10, 10, 2)
    assert rects[0][2] - rects[0][0] == 10 or rects[0][3] - rects[0][1] == 10


def test_hit_miss_replace():
    b = np.zeros((5, 5), bool)
    b[2, 2] = True
    assert not K.hit_miss_replace(b, ["...", ".-.", "..."]).any()


def test_lines_and_maps():
    pts = np.array([(i, 2 * i + 3) for i in range(40)], float)
    angle, rho, n = K.best_line(pts, (-60, 60), (0, np.pi), tolerance=0.5)
    assert n == 40 and np.abs(pts @ [np.cos(angle), np.sin(angle)] - rho).max() < 1.5
    src, dst = np.array([(0, 0), (1, 0), (1, 1), (0, 1)]), np.array([(0, 0), (2, 0), (3, 3), (0, 1)])
    m = K.homography(src, dst)
    p = m @ np.array([1, 1, 1])
    assert np.allclose(p[:2] / p[2], (3, 3))
    assert K.grid_line(0, 0, 4, 2).tolist() == [[0, 0], [1, 1], [2, 1], [3, 2], [4, 2]]
    assert np.allclose(K.polyline_meets_line(np.array([[0.0, 0], [4, 4]]), np.array([0.0, 2]), np.array([4.0, 2])), (2, 2))


def test_surface_and_smoothing():
    y, x = np.mgrid[0:20, 0:30]
    plane = 50 + 2 * y + x
    assert np.allclose(K.polynomial_surface(plane, 1, 1), plane)
    assert (K.savgol(plane.astype(np.uint8), 5, 5, 1, 1)[4:-4, 4:-4] == plane[4:-4, 4:-4]).all()
    assert (K.gauss_blur(np.full((9, 9), 40, np.uint8), 2, 2) == 40).all()


def test_dewarp_of_straight_edges_is_the_page():
    g = np.tile(np.arange(40, dtype=np.uint8) * 5, (30, 1))
    out = K.dewarp(g, np.array([(0, 0), (20, 0), (40, 0)], float), np.array([(0, 30), (20, 30), (40, 30)], float), 30, 40)
    assert np.abs(out.astype(int) - g).max() <= 1


def test_despeckle():
    page = np.zeros((80, 120), bool)
    page[20:50, 20:60] = True
    page[70, 110] = True
    out = K.despeckle(page)
    assert out[20:50, 20:60].all() and not out[70, 110]


def test_plates():
    assert not K.is_plate(np.full((60, 60), 255, np.uint8))[0]
    assert K.is_plate(RNG.integers(20, 236, (120, 120)).astype(np.uint8))[0]


def test_paper_and_tones():
    page = np.full((100, 120, 3), (240, 220, 190), np.uint8)
    page[30:60, 30:90] = 20
    assert K.margin_color(page) == (240, 220, 190) and K.has_cast(K.paper_of(page))
    assert (K.white_balance(page, (240, 220, 190))[0, 0] >= 244).all()
    assert K.compensated_evidence(page)["is_gray"]
    assert K.auto_tones(np.full((20, 20), 100, np.uint8))["exposure"] > 1
    g = RNG.integers(0, 256, (50, 90)).astype(np.uint8)
    g[:, 40:52] = 250
    found = K.spread_geometry(g)
    assert (found["b"], found["e"]) == (40, 52) and min(found["left"], found["right"]) > 50


def test_rules_worked_out_by_hand():
    g = np.array([[10, 10, 200]], np.uint8)
    m = np.array([10, 220 / 3, 105])  # windows of one row and three pixels, clipped
    v = g[0].astype(float)
    assert np.allclose(K.local_threshold(g, "singh", 3, 3, k=0.2, delta=64)[0], m * (1 - 0.1 * (1 - (np.abs(v - m) / (256 - np.abs(v - m) + 1e-6) + 0.5))))
    f = (v - m) / (256 - (v - m))
    assert np.allclose(K.local_threshold(g, "fox", 3, 3, k=0.5, delta=0)[0], (m - 10) * (1 - 0.25 * (1 - f / f[2])) + 10)
    # rounded means 10, 73, 105; contrasts 0, 63, 95; their weighted mean of the levels is (630 + 19000) / 158
    assert np.allclose(K.local_threshold(g, "grad", 3, 3, k=0.25)[0], (19630 / 158) * 0.75 + np.array([10, 73, 105]) * 0.25)
    h = np.zeros(256, np.int64)
    h[[20, 21, 200]] = 5, 6, 9
    assert K.densest_level(h) == 12  # spans of 16 from 5 hold the first two levels; the best of 8 from there is at 12, none of 4 holds any
    page = np.array([[20] * 8 + [200] * 2], np.uint8)
    assert K.mean_rule(page).tolist() == [[False] * 8 + [True] * 2]  # most are near the densest level
    assert K.mean_rule(page, 200.0).all()  # nothing is nearer than a negative reach
    flat = np.full((4, 4), 90, np.uint8)
    assert not K.mean_rule(flat).any()
    for method in ("robust", "engraving", "grain"):
        bits = K.binarize(np.pad(np.full((4, 4), 30, np.uint8), 6, constant_values=220), method, 5)
        assert bits.shape == (16, 16) and not bits[0, 0]
        assert bits[7, 7] or method == "engraving"
