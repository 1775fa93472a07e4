"""Array kernels for whole pages: gray images are uint8 arrays (h, w), bits are boolean arrays where black is true.

Windows are clipped at the edges, as in ``operators.raster``. All loops are over lines, offsets or
components, never over pixels, but for the searches that are sequential by nature.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

# --- sums, windows, morphology ---------------------------------------------------------------------


def integral(a: np.ndarray) -> np.ndarray:
    """Summed-area table with a line of zeros before the first row and column."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.float64 if a.dtype.kind == "f" else np.int64)
    out[1:, 1:] = a.cumsum(0, dtype=out.dtype).cumsum(1, dtype=out.dtype)
    return out


def window_bounds(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.arange(n) - size // 2
    return np.maximum(first, 0), np.minimum(first + size, n)


def window_sum(a: np.ndarray, wh: int, ww: int) -> np.ndarray:
    t, (y0, y1), (x0, x1) = integral(a), window_bounds(a.shape[0], wh), window_bounds(a.shape[1], ww)
    return t[np.ix_(y1, x1)] - t[np.ix_(y0, x1)] - t[np.ix_(y1, x0)] + t[np.ix_(y0, x0)]


def window_area(shape: tuple[int, int], wh: int, ww: int) -> np.ndarray:
    (y0, y1), (x0, x1) = window_bounds(shape[0], wh), window_bounds(shape[1], ww)
    return np.outer(y1 - y0, x1 - x0)


def local_stats(g: np.ndarray, wh: int, ww: int) -> tuple[np.ndarray, np.ndarray]:
    area, v = window_area(g.shape, wh, ww), g.astype(np.int64)
    m = window_sum(v, wh, ww) / area
    return m, np.sqrt(np.abs(window_sum(v * v, wh, ww) / area - m * m))


def _slide(a: np.ndarray, size: int, axis: int, f: np.ufunc) -> np.ndarray:
    """Running minimum or maximum along an axis in a logarithmic number of steps."""
    a = np.moveaxis(a, axis, 0)
    n, before = len(a), size // 2
    worst = np.full((1, *a.shape[1:]), f.reduce(a, axis=None, initial=None) if a.size else 0, a.dtype)
    worst[:] = a.max() if f is np.minimum else a.min()
    x = np.concatenate([np.repeat(worst, before, 0), a, np.repeat(worst, size - before - 1, 0)])
    have = 1
    while have * 2 <= size:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    if have < size:
        x = f(x[: len(x) - (size - have)], x[size - have :])
    return np.moveaxis(x[:n], 0, axis)


def sliding(a: np.ndarray, wh: int, ww: int, f: np.ufunc) -> np.ndarray:
    return _slide(_slide(a, wh, 0, f), ww, 1, f) if a.size else a


def dilate(a: np.ndarray, wh: int = 3, ww: int = 3) -> np.ndarray:
    """Black grows: the maximum of bits, the minimum of grays."""
    return sliding(a, wh, ww, np.maximum if a.dtype == bool else np.minimum)


def erode(a: np.ndarray, wh: int = 3, ww: int = 3) -> np.ndarray:
    return sliding(a, wh, ww, np.minimum if a.dtype == bool else np.maximum)


def opened(a: np.ndarray, wh: int = 3, ww: int = 3) -> np.ndarray:
    return dilate(erode(a, wh, ww), wh, ww)


def closed(a: np.ndarray, wh: int = 3, ww: int = 3) -> np.ndarray:
    return erode(dilate(a, wh, ww), wh, ww)


def shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """out[y, x] = a[y + dy, x + dx], ``fill`` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = a[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def hit_miss(b: np.ndarray, hits: list[tuple[int, int]], misses: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones_like(b)
    for dy, dx in hits:
        out &= shifted(b, dy, dx, False)
    for dy, dx in misses:
        out &= ~shifted(b, dy, dx, False)
    return out


def hit_miss_replace(b: np.ndarray, pattern: list[str]) -> np.ndarray:
    """Rewrite by a picture: ``X`` black and ``.`` white must match, ``-`` is black that turns white, ``+`` white that turns black, ``?`` is free."""
    cells = [(y, x, c) for y, line in enumerate(pattern) for x, c in enumerate(line)]
    found = hit_miss(b, [(y, x) for y, x, c in cells if c in "X-"], [(y, x) for y, x, c in cells if c in ".+"])
    h, w = b.shape
    found[h - len(pattern) + 1 :], found[:, w - len(pattern[0]) + 1 :] = False, False
    out = b.copy()
    for y, x, c in cells:
        if c in "+-":
            out[shifted(found, -y, -x, False)] = c == "+"
    return out


# --- components and fills ----------------------------------------------------------------------------


def components(b: np.ndarray, eight: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 in order of first pixel, by runs of each line and a union over touching runs."""
    h, w = b.shape
    edges = np.diff(np.pad(b.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x0 = np.nonzero(edges == 1)
    x1 = np.nonzero(edges == -1)[1]
    n = len(ys)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    reach = 1 if eight else 0
    for y in range(1, h):
        i, j, end_i, end_j = first[y - 1], first[y], first[y], first[y + 1]
        while i < end_i and j < end_j:
            if x0[i] < x1[j] + reach and x0[j] < x1[i] + reach:
                a, c = find(i), find(j)
                root[max(a, c)] = min(a, c)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(n)], np.int64)
    kinds, label = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (ys, x0), label + 1)
    np.add.at(out, (ys, x1), -(label + 1))
    return out.cumsum(1)[:, :w].astype(np.int32), len(kinds)


def component_table(labels: np.ndarray, n: int) -> np.ndarray:
    """x0, y0, x1, y1 (half-open) and the number of pixels of each label from 1 to n."""
    ys, xs = np.nonzero(labels)
    k = labels[ys, xs] - 1
    out = np.zeros((n, 5), np.int64)
    out[:, :2] = max(labels.shape) + 1
    np.minimum.at(out[:, 0], k, xs), np.minimum.at(out[:, 1], k, ys)
    np.maximum.at(out[:, 2], k, xs + 1), np.maximum.at(out[:, 3], k, ys + 1)
    out[:, 4] = np.bincount(k, minlength=n)
    return out


def remove_components(labels: np.ndarray, gone: set[int]) -> tuple[np.ndarray, int]:
    n = int(labels.max(initial=0))
    table = np.zeros(n + 1, np.int32)
    left = [k for k in range(1, n + 1) if k not in gone]
    table[left] = np.arange(1, len(left) + 1)
    return table[labels], len(left)


def seed_fill(seed: np.ndarray, mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """The components of the mask that the seed touches."""
    labels, n = components(mask, eight)
    hit = np.zeros(n + 1, bool)
    hit[labels[seed & mask]] = True
    hit[0] = False
    return hit[labels]


def seed_fill_gray(seed: np.ndarray, mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Gray reconstruction: the dark of the seed spreads, never below the mask. Levels are filled from dark to light."""
    out = np.maximum(seed, mask).astype(np.int32)
    h, w = out.shape
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    heap = [(int(out[y, x]), y, x) for y, x in zip(*np.nonzero(out < 255), strict=True)]
    heapq.heapify(heap)
    while heap:
        v, y, x = heapq.heappop(heap)
        if v > out[y, x]:
            continue
        for dy, dx in near:
            yy, xx = y + dy, x + dx
            if 0 <= yy < h and 0 <= xx < w:
                t = max(v, int(mask[yy, xx]))
                if t < out[yy, xx]:
                    out[yy, xx] = t
                    heapq.heappush(heap, (t, yy, xx))
    return out.astype(np.uint8)


def fill_holes(b: np.ndarray) -> np.ndarray:
    frame = np.zeros_like(b)
    frame[0], frame[-1], frame[:, 0], frame[:, -1] = True, True, True, True
    return ~seed_fill(frame & ~b, ~b, eight=False)


def distance_map(b: np.ndarray, horizontal: float = 1.0, vertical: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each pixel to the nearest black one, and the flat index of that pixel; -1 and infinity without black."""
    h, w = b.shape
    far = np.inf
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(b, rows, -1), axis=0)
    down = np.minimum.accumulate(np.where(b, rows, 4 * h)[::-1], axis=0)[::-1]
    nearest = np.where((up >= 0) & ((rows - up <= down - rows) | (down >= 4 * h)), up, np.where(down < 4 * h, down, -1))
    column = np.where(nearest >= 0, (vertical * (rows - nearest)) ** 2.0, far)
    xs = np.arange(w)
    across = (horizontal * (xs[:, None] - xs[None, :])) ** 2.0
    out, at = np.empty((h, w)), np.empty((h, w), np.int64)
    for y in range(h):
        total = across + column[y][None, :]
        best = total.argmin(1)
        out[y] = total[xs, best]
        at[y] = np.where(np.isfinite(out[y]), nearest[y][best] * w + best, -1)
    return out, at


def influence_map(labels: np.ndarray, horizontal: float = 1.0, vertical: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The label of the nearest component of each pixel, and the squared distance."""
    d, at = distance_map(labels > 0, horizontal, vertical)
    return np.where(at >= 0, labels.ravel()[np.maximum(at, 0)], 0), d


def despeckle(b: np.ndarray, dpi: int = 300, level: float = 2.0) -> np.ndarray:
    """Without specks: small components that have no component large enough for them near enough.

    Neighbours are those whose nearest areas touch; heights count double in distances. A component keeps
    what hangs on it, step by step, from the big ones down.
    """
    f = dpi / 300
    weight, reach, big = (0.05 * level + 0.075) * f, (0.25 * level * level - 4.25 * level + 14) ** 2, (5 * level + 2) * f
    labels, n = components(b)
    if not n:
        return b.copy()
    t = component_table(labels, n)
    size = t[:, 4].astype(float)
    is_big = (t[:, 2] - t[:, 0] >= big) | (t[:, 3] - t[:, 1] >= big)
    near, d = influence_map(labels, 1.0, 2.0)
    links: dict[tuple[int, int], float] = {}
    for a, c, da, dc in ((near[:, :-1], near[:, 1:], d[:, :-1], d[:, 1:]), (near[:-1], near[1:], d[:-1], d[1:])):
        ys, xs = np.nonzero(a != c)
        for p, q, x in zip(a[ys, xs].tolist(), c[ys, xs].tolist(), ((np.sqrt(da) + np.sqrt(dc)) ** 2)[ys, xs].tolist(), strict=True):
            key = (min(p, q), max(p, q))
            links[key] = min(links.get(key, np.inf), x)
    around: dict[int, list] = {}
    for (p, q), x in links.items():
        around.setdefault(p, []).append((q, x)), around.setdefault(q, []).append((p, x))
    kept, todo = set((np.flatnonzero(is_big) + 1).tolist()), (np.flatnonzero(is_big) + 1).tolist()
    while todo:
        p = todo.pop()
        for q, x in around.get(p, []):
            if q not in kept and x <= size[q - 1] * reach and (is_big[p - 1] or size[p - 1] >= size[q - 1] * weight):
                kept.add(q), todo.append(q)
    table = np.zeros(n + 1, bool)
    table[list(kept)] = True
    return table[labels]


# --- histograms and global thresholds ------------------------------------------------------------------


def histogram(g: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    return np.bincount((g if mask is None else g[mask]).ravel(), minlength=256)


def otsu(h: np.ndarray) -> int:
    below, sums = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 0
    score = np.full(256, -1.0)
    diff = sums[ok] / below[ok] - (sums[-1] - sums[ok]) / above[ok]
    score[ok] = diff * diff * below[ok] * above[ok]
    best = np.flatnonzero(score == score.max())
    return int(best[0] + 1 + best[-1] + 1) // 2


def peak_threshold(h: np.ndarray) -> int:
    """Three quarters of the way from the left to the right peak; each search stops where a bin is under two thirds of its peak."""
    def climb(bins: range) -> int:
        at, top = bins[0], h[bins[0]]
        for i in bins:
            if h[i] > top:
                at, top = i, h[i]
            elif h[i] < 0.66 * top:
                break
        return at

    right, left = climb(range(255, -1, -1)), climb(range(256))
    return int(left + 0.75 * (right - left))


def mokji(g: np.ndarray, edge: int = 3, least: int = 20) -> int:
    """Half the mean of dark and light sides over pixels whose window is darker by ``least``; 128 without any."""
    size = 2 * edge + 1
    dark = dilate(g, size, size)[edge:-edge, edge:-edge].astype(np.int64)
    own = g[edge:-edge, edge:-edge].astype(np.int64)
    steep = own - dark >= least
    return int(0.5 * (own[steep] + dark[steep]).mean() + 0.5) if steep.any() else 128


def bimodal(h: np.ndarray, delta: int = 0) -> int:
    """Two-means threshold of a histogram, in fixed point."""
    used = np.flatnonzero(h)
    if not len(used):
        return 128
    part = min(512, max(0, 256 + 2 * delta))
    low, high, v = int(used[0]) << 7, int(used[-1]) << 7, np.arange(256) << 7  # halves of the threshold's unit
    t, seen = (part * high + (512 - part) * low) >> 8, set()
    while t not in seen:
        seen.add(t)
        under = 2 * v <= t
        a = int((h[under] * v[under]).sum() // h[under].sum()) if h[under].sum() else low
        b = int((h[~under] * v[~under]).sum() // h[~under].sum()) if h[~under].sum() else high
        t = (part * b + (512 - part) * a) >> 8
    return (t + 127) >> 8


def dominant_level(h: np.ndarray, window: int = 10) -> int:
    mass = np.convolve(h, np.ones(window, np.int64), "valid")
    first = int(mass.argmax())
    return first + int(np.argmax(np.cumsum(h[first : first + window]) >= mass[first] // 2))


# --- local binarisation ----------------------------------------------------------------------------------


def local_threshold(g: np.ndarray, method: str, wh: int = 51, ww: int = 51, k: float = 0.34, delta: float = 0.0, lower: int = 1, upper: int = 254) -> np.ndarray:
    """The threshold of each pixel by the rules of ``operators.raster.local_threshold``."""
    m, s = local_stats(g, wh, ww)
    v = g.astype(float)
    if method == "sauvola":
        return m * (1 + k * ((s + delta) / 128 - 1))
    if method == "bradley":
        return m * (1 - k) if k < 1 else np.zeros_like(m)
    if method == "niblack":
        return m - k * (s - delta)
    if method == "nick":
        return m - k * np.sqrt(s * s + (50 - delta) * 0.01 * m * m)
    if method == "singh":
        d = np.abs(v - m)
        f = d / (256 - d + 1e-6)
        return m * (1 - 0.5 * k * (1 - (f + delta / 128)))
    if method == "wan":
        return (m + sliding(g, wh, ww, np.maximum)) / 2 * (1 - k * (1 - (s + delta) / 128))
    if method == "wolf":
        t = m - k * (1 - (s / max(s.max(), 1e-9) + delta / 128)) * (m - v.min())
        return np.where(v < lower, 256.0, np.where(v <= upper, t, -1.0))
    if method == "fox":
        f = (v - m) / (256 - (v - m))
        top = np.abs(f).max()
        part = f / top if top > 0 else np.ones_like(f)
        return np.clip((m - v.min()) * (1 - 0.5 * k * (1 - (part + delta / 128))) + v.min(), 0, 255)
    if method == "window":
        span = s.max() - s.min()
        kds = np.ones_like(s) if span == 0 else (s - s.min()) / span
        return m * (1 - k * ((m + 1 - delta) / (v.mean() + s + 1)) / (1 + (2 * v.mean() + 1) / (s + 1) * kds))
    if method == "grad":
        near = np.floor(np.clip(m + 0.5 + delta, 0, 255))
        weight = np.abs(near - v)  # of the whole page one mean, weighted by contrast
        whole = (weight * v).sum() / weight.sum() if weight.any() else 127.5
        t = whole * (1 - k) + near * k
        return np.where(v < lower, 256.0, np.where(v <= upper, t, -1.0))
    if method == "multiscale":
        return multiscale(g, max(wh, ww), k, delta)
    raise ValueError(f"no such rule: {method}")


def multiscale(g: np.ndarray, radius: int = 51, sensitivity: float = 0.5, delta: float = 0.0) -> np.ndarray:
    """Midway between the extremes of windows that halve, each blended with the larger ones' by sensitivity."""
    t, size = np.full(g.shape, (float(g.max()) + float(g.min())) / 2), max(1, radius)
    while size >= 1:
        mid = (sliding(g, size, size, np.maximum).astype(float) + sliding(g, size, size, np.minimum)) / 2
        t = np.clip(np.floor(t * sensitivity + mid * (1 - sensitivity) + 0.5), 0, 255)
        size //= 2
    return t + delta


def edge_div(g: np.ndarray, wh: int = 51, ww: int = 51, edge_plus: float = 0.5, blur_div: float = 0.5) -> np.ndarray:
    """Gray with its edges sharpened by the local mean and its background divided out."""
    v, (m, _) = g.astype(float), local_stats(g, wh, ww)
    if edge_plus:
        e = (v + 1) / (m + 1) - 0.5
        v = edge_plus * v * e + (1 - edge_plus) * v
    if blur_div:
        e = (m + 1) / (v + 1) - 0.5
        v = v / (blur_div * e + 1 - blur_div)
    return np.clip(v, 0, 255).astype(np.uint8)


def wiener(g: np.ndarray, wh: int = 3, ww: int = 3, sigma: float = 5.0) -> np.ndarray:
    m, s = local_stats(g, wh, ww)
    var = s * s
    out = np.where(var > 1e-6, m + (g - m) * np.maximum(0, var - sigma * sigma) / np.maximum(var, 1e-6), m)
    return np.clip(out, 0, 255).astype(np.uint8)


def wiener_color(rgb: np.ndarray, wh: int = 3, ww: int = 3, sigma: float = 5.0) -> np.ndarray:
    """Luma is denoised, and the channels follow it in proportion."""
    y = luma(rgb)
    gain = (wiener(y, wh, ww, sigma).astype(float) + 1) / (y.astype(float) + 1)
    return np.clip((rgb + 1.0) * gain[:, :, None] - 1, 0, 255).astype(np.uint8)


def gatos(g: np.ndarray, window: int = 51, sigma: float = 3.0, k: float = 0.2, q: float = 0.6, p: float = 0.5) -> np.ndarray:
    """Denoise, rough text by Niblack, background filled from around it, then a threshold on the distance to the background."""
    v = wiener(g, 5, 5, sigma).astype(float)
    rough = v < local_threshold(v.astype(np.uint8), "niblack", window, window, k)
    weight = (~rough).astype(float)
    total = window_sum(weight, window, window)
    back = np.where(rough & (total > 0), window_sum(weight * v, window, window) / np.maximum(total, 1e-9), v)
    gap = np.maximum(back - v, 0)
    delta = gap[rough].mean() if rough.any() else 0.0
    mean = back[~rough].mean() if (~rough).any() else 255.0
    t = q * delta * ((1 - p) / (1 + np.exp(-4 * back / (mean * (1 - q) + 1e-9) + 2 * (1 + q) / (1 - q))) + p)
    return gap > t


def engraving(g: np.ndarray, window: int = 51, k: float = 0.5, delta: float = 0.0) -> np.ndarray:
    """The blurred page, with bands as wide as its mean contrast overlaid on it, then one threshold by Otsu."""
    radius = window >> 1
    blur = np.floor(gauss_blur(g, radius, radius) + 0.5)
    contrast = np.abs(g - blur).mean()
    if radius and k and contrast > 0:
        band = 4 * (blur / contrast % 1 - 0.5) ** 2
        overlay = np.where(blur > 127.5, 255 - 2 * (255 - blur) * (1 - band), 2 * blur * band)
        blur = np.floor(np.clip(k * overlay + (1 - k) * blur + 0.5, 0, 255))
    e = blur.astype(np.uint8)
    return e < otsu(histogram(e)) + int(delta)


def grain(g: np.ndarray, window: int = 51, k: float = 0.5, delta: float = 0.0) -> np.ndarray:
    """The page blended with its local contrast, from which its own blur is taken once more, then the bimodal threshold."""
    radius = window >> 1
    smooth = lambda x: np.floor(gauss_blur(x, radius, radius) + 0.5)
    e = g
    if radius and k:
        local = np.clip(g - smooth(g) + 127, 0, 255)
        local = np.clip(2 * local - smooth(local), 0, 255)
        e = np.clip(k * local + (1 - k) * g + 0.5, 0, 255).astype(np.uint8)
    return e < bimodal(histogram(e), int(delta))


def densest_level(h: np.ndarray) -> int:
    """The level at which ever narrower spans, each within the one before, hold most pixels."""
    upto, low, span = np.cumsum(h), 0, 128
    while span:
        at = np.arange(low, min(low + span, 256 - span))
        mass = upto[at + span] - np.where(at > 0, upto[at], 0)
        if len(at) and mass.max() > 0:
            low = int(at[mass.argmax()])
        span //= 2
    return low


def mean_rule(g: np.ndarray, delta: float = 0.0) -> np.ndarray:
    """Black is nearer to the densest level than the root mean square distance, or farther if more than half is near."""
    d = np.abs(g.astype(float) - densest_level(histogram(g)))
    reach = math.sqrt(float((d * d).mean()))
    turned = 2 * int((d < reach).sum()) > d.size
    return (d < reach * (1 - 0.02 * delta if turned else 1 + 0.02 * delta)) != turned


def robust(g: np.ndarray, window: int = 51, k: float = 0.2, delta: float = 0.0) -> np.ndarray:
    """Each pixel's contrast to its surroundings is stretched and blended in, then one threshold by Otsu."""
    v, (m, _) = g.astype(float), local_stats(g, window, window)
    gap = m - v
    safe = np.abs(m + gap) > 1e-6
    bright = np.where(safe, 255 - (m + 255) * gap / np.where(safe, m + gap, 1), v)
    e = np.clip(k * bright + (1 - k) * v + 0.5, 0, 255).astype(np.uint8)
    return e < otsu(histogram(e)) + int(delta)


METHODS = ("otsu", "mean", "bimodal", "peak", "mokji", "sauvola", "wolf", "bradley", "niblack", "nick", "singh", "wan", "fox", "window", "grad", "robust", "engraving", "multiscale", "edge_div", "gatos", "grain")


def binarize(g: np.ndarray, method: str = "otsu", window: int = 51, k: float | None = None, delta: float = 0.0) -> np.ndarray:
    """Bits of a gray page by any of METHODS."""
    own = {} if k is None else {"k": k}
    if method == "otsu":
        return g < otsu(histogram(g)) + delta
    if method == "peak":
        return g < peak_threshold(histogram(g)) + delta
    if method == "bimodal":
        return g < bimodal(histogram(g), int(delta))
    if method == "mokji":
        return g < mokji(g) + delta
    if method == "mean":
        return mean_rule(g, delta)
    if method == "edge_div":
        e = edge_div(g, window, window)
        return e < otsu(histogram(e)) + delta
    if method == "robust":
        return robust(g, window, delta=delta, **own)
    if method == "grad":
        own = own or {"k": 0.3}
    if method == "gatos":
        return gatos(g, window, **own)
    if method == "grain":
        return grain(g, window, delta=delta, **own)
    if method == "engraving":
        return engraving(g, window, delta=delta, **own)
    return g < local_threshold(g, method, window, window, delta=delta, **own)


# --- smoothing, gradients, surfaces ------------------------------------------------------------------------


def gauss_blur(g: np.ndarray, sigma_y: float, sigma_x: float) -> np.ndarray:
    out = g.astype(float)
    for axis, sigma in ((0, sigma_y), (1, sigma_x)):
        if sigma > 0:
            r = int(math.ceil(3 * sigma))
            kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            pad = [(r, r) if i == axis else (0, 0) for i in range(out.ndim)]
            x = np.pad(out, pad, "edge")
            out = sum(wk * np.take(x, range(i, i + g.shape[axis]), axis) for i, wk in enumerate(kernel / kernel.sum()))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def savgol_kernel(wh: int, ww: int, dy: int, dx: int) -> np.ndarray:
    """Weights that give the value at the centre of the least-squares polynomial over the window."""
    y, x = np.mgrid[0:wh, 0:ww]
    y, x = y - (wh - 1) / 2, x - (ww - 1) / 2
    basis = np.stack([(y**i * x**j).ravel() for i in range(dy + 1) for j in range(dx + 1)], 1)
    return np.linalg.pinv(basis)[0].reshape(wh, ww)


def savgol(g: np.ndarray, wh: int = 5, ww: int = 5, dy: int = 2, dx: int = 2) -> np.ndarray:
    kernel = savgol_kernel(wh, ww, dy, dx)
    x = np.pad(g.astype(float), ((wh // 2, wh - wh // 2 - 1), (ww // 2, ww - ww // 2 - 1)), "edge")
    out = sum(kernel[i, j] * x[i : i + g.shape[0], j : j + g.shape[1]] for i in range(wh) for j in range(ww))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.pad(g.astype(np.int64), 1, "edge")
    row = x[:-2] + 2 * x[1:-1] + x[2:]
    col = x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]
    return row[:, 2:] - row[:, :-2], col[2:] - col[:-2]


def find_peaks(a: np.ndarray, wh: int = 5, ww: int = 5) -> np.ndarray:
    """Plateaus that are the maximum of their window and touch nothing higher."""
    top = a == sliding(a, wh, ww, np.maximum)
    higher = sliding(a, 3, 3, np.maximum) > a
    labels, n = components(top)
    spoiled = np.zeros(n + 1, bool)
    spoiled[labels[top & higher]] = True
    return top & ~spoiled[labels]


def polynomial_line(y: np.ndarray, degree: int) -> np.ndarray:
    return np.polynomial.polynomial.polyfit(np.linspace(0, 1, len(y)), y, min(degree, len(y) - 1))


def polynomial_surface(g: np.ndarray, dy: int, dx: int, mask: np.ndarray | None = None) -> np.ndarray:
    """The least-squares polynomial over the masked pixels, at every pixel."""
    h, w = g.shape
    ys, xs = np.linspace(0, 1, h), np.linspace(0, 1, w)
    by, bx = np.stack([ys**i for i in range(dy + 1)], 1), np.stack([xs**j for j in range(dx + 1)], 1)
    weight = np.ones((h, w)) if mask is None else mask.astype(float)
    left = np.einsum("yi,yk,yx,xj,xl->ijkl", by, by, weight, bx, bx, optimize=True).reshape((dy + 1) * (dx + 1), -1)
    right = np.einsum("yi,yx,xj->ij", by, weight * g, bx, optimize=True).ravel()
    c = np.linalg.lstsq(left, right, rcond=None)[0].reshape(dy + 1, dx + 1)
    return by @ c @ bx.T


def background(g: np.ndarray, scale: int = 4) -> np.ndarray:
    """The paper's gray under the content: dark content closed away on a smaller image, then a smooth surface."""
    small = scale_to_gray(g, max(1, g.shape[0] // scale), max(1, g.shape[1] // scale))
    size = max(3, min(small.shape) // 8 | 1)
    paper = dilate(erode(small, size, size), size, size)
    near = np.abs(small.astype(int) - paper) < 30
    surface = polynomial_surface(paper, 4, 4, near if near.any() else None)
    return resize(np.clip(surface, 1, 255), *g.shape)


def flatten(g: np.ndarray) -> np.ndarray:
    """The page with its illumination divided out."""
    return np.clip(g * 255.0 / np.maximum(background(g), 1), 0, 255).astype(np.uint8)


# --- scaling and transforms ----------------------------------------------------------------------------------


def luma(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int32) * (11, 16, 5)).sum(-1) >> 5).astype(np.uint8) if rgb.ndim == 3 else rgb


def _area_weights(n: int, m: int) -> np.ndarray:
    """m x n: how much of each source line lies under each target line."""
    edges = np.arange(m + 1) * n / m
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)[None]), np.minimum(edges[1:, None], np.arange(1, n + 1)[None])
    out = np.maximum(hi - lo, 0)
    return out / out.sum(1, keepdims=True)


def scale_to_gray(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Exact area average."""
    out = _area_weights(g.shape[0], h) @ g.astype(float) @ _area_weights(g.shape[1], w).T
    return np.floor(out + 0.5).astype(np.uint8)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, for smooth surfaces."""
    y, x = (np.arange(h) + 0.5) * a.shape[0] / h - 0.5, (np.arange(w) + 0.5) * a.shape[1] / w - 0.5
    return sample(a, *np.meshgrid(y, x, indexing="ij"))


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Bilinear values at real coordinates; beyond the edge the nearest pixel, or ``outside``."""
    h, w = a.shape[:2]
    yy, xx = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(yy).astype(int), np.floor(xx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = yy - y0, xx - x0
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    if outside is not None:
        away = (y < -0.5) | (y > h - 0.5) | (x < -0.5) | (x > w - 0.5)
        out = np.where(away[..., None] if a.ndim == 3 else away, outside, out)
    return out


def transform(a: np.ndarray, matrix: np.ndarray, h: int, w: int, outside: float = 255.0, over: int = 2) -> np.ndarray:
    """The image under a 3 x 3 matrix (source to target); each target pixel is the mean of ``over`` squared samples."""
    back = np.linalg.inv(matrix)
    total = 0.0
    for i in range(over):
        for j in range(over):
            y, x = np.meshgrid(np.arange(h) + (i + 0.5) / over, np.arange(w) + (j + 0.5) / over, indexing="ij")
            p = back @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
            total = total + sample(a, (p[1] / p[2]).reshape(h, w) - 0.5, (p[0] / p[2]).reshape(h, w) - 0.5, outside)
    return np.floor(total / (over * over) + 0.5).astype(np.uint8)


def shear_rows(b: np.ndarray, slope: float, fill=False) -> np.ndarray:
    """Columns shifted vertically by a whole number that grows with x from the middle."""
    out = np.full_like(b, fill)
    h, w = b.shape
    for x in range(w):
        d = math.floor(slope * (x + 0.5 - w / 2) + 0.5)
        lo, hi = max(0, d), min(h, h + d)
        out[lo:hi, x] = b[lo - d : hi - d, x]
    return out


def reduce_bits(b: np.ndarray, threshold: int) -> np.ndarray:
    h, w = b.shape[0] // 2 * 2, b.shape[1] // 2 * 2
    return b[:h, :w].reshape(h // 2, 2, w // 2, 2).sum((1, 3)) >= threshold


def skew(b: np.ndarray, most: float = 7.0, coarse: float = 1.0, fine: float = 0.1) -> tuple[float, float]:
    """Angle in degrees and confidence: the best of a coarse sweep over sheared row counts, refined by halving.

    Under a tenth of a degree it is 0 with good confidence (2); with scores of 1000 or less, 0 confidence.
    """
    def score(angle: float) -> float:
        rows = shear_rows(b, math.tan(math.radians(angle))).sum(1).astype(float)
        return float((np.diff(rows) ** 2).sum())

    angles = np.arange(-most, most + coarse / 2, coarse)
    scores = [score(a) for a in angles]
    best, top = float(angles[int(np.argmax(scores))]), max(scores)
    step = coarse / 2
    while step >= fine / 2:
        for a in (best - step, best + step):
            if abs(a) <= most and (s := score(a)) > top:
                best, top = a, s
        step /= 2
    if abs(best) < 0.1:
        return 0.0, 2.0
    return -best, 0.0 if top <= 1000 else top / (sum(scores) / len(scores)) - 1


# --- geometry and searches -----------------------------------------------------------------------------------


def fill_polygon(h: int, w: int, points: np.ndarray, winding: bool = False) -> np.ndarray:
    """Pixels whose centres lie inside a polygon of (x, y), by scan lines; odd-even or by winding."""
    out = np.zeros((h, w), bool)
    p, q = np.asarray(points, float), np.roll(np.asarray(points, float), -1, 0)
    for y in range(h):
        c = y + 0.5
        cross = (p[:, 1] <= c) != (q[:, 1] <= c)
        if not cross.any():
            continue
        a, b = p[cross], q[cross]
        xs = a[:, 0] + (c - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        turn = np.where(b[:, 1] > a[:, 1], 1, -1)
        at = np.ceil(np.clip(xs, 0, w) - 0.5).astype(int)
        count = np.zeros(w + 1, int)
        np.add.at(count, at, turn if winding else 1)
        run = np.cumsum(count)[:w]
        out[y] = run != 0 if winding else run % 2 == 1
    return out


def convex_hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(map(tuple, np.unique(np.asarray(points, float), axis=0)))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def whitespace(obstacles: np.ndarray, h: int, w: int, n: int, least: tuple[int, int] = (1, 1), rounds: int = 100_000) -> list[tuple[int, int, int, int]]:
    """The ``n`` largest rects (x0, y0, x1, y1) free of obstacles and of each other, best first by area."""
    boxes, found = [tuple(map(int, o)) for o in obstacles], []
    heap = [(-h * w, (0, 0, w, h), boxes)]
    while heap and len(found) < n and rounds:
        rounds -= 1
        area, (x0, y0, x1, y1), inside = heapq.heappop(heap)
        inside = [o for o in [*inside, *found] if o[0] < x1 and o[2] > x0 and o[1] < y1 and o[3] > y0]
        if not inside:
            found.append((x0, y0, x1, y1))
            continue
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        o = min(inside, key=lambda o: ((o[0] + o[2]) / 2 - cx) ** 2 + ((o[1] + o[3]) / 2 - cy) ** 2)
        for r in ((x0, y0, o[0], y1), (o[2], y0, x1, y1), (x0, y0, x1, o[1]), (x0, o[3], x1, y1)):
            r = (max(r[0], x0), max(r[1], y0), min(r[2], x1), min(r[3], y1))
            if r[2] - r[0] >= least[0] and r[3] - r[1] >= least[1]:
                heapq.heappush(heap, (-(r[2] - r[0]) * (r[3] - r[1]), r, inside))
    return found


def best_line(points: np.ndarray, span: tuple[float, float], angles: tuple[float, float], accuracy: float = 0.5, tolerance: float = 1.0) -> tuple[float, float, int]:
    """Angle, distance and support of the line near most points (x, y), by branch and bound over boxes of angle and distance."""
    def bound(box):
        a0, a1, r0, r1 = box
        mid, half = (a0 + a1) / 2, (a1 - a0) / 2
        d = points @ np.array([math.cos(mid), math.sin(mid)])
        slack = tolerance + np.hypot(points[:, 0], points[:, 1]) * half
        return int(((d >= r0 - slack) & (d <= r1 + slack)).sum())

    box = (*angles, *span)
    heap = [(-bound(box), box)]
    while heap:
        support, (a0, a1, r0, r1) = heapq.heappop(heap)
        wide, tall = r1 - r0 > accuracy, (a1 - a0) > 0.002
        if not wide and not tall:
            return (a0 + a1) / 2, (r0 + r1) / 2, -support
        if wide and ((r1 - r0) > 50 * (a1 - a0) or not tall):
            parts = [(a0, a1, r0, (r0 + r1) / 2), (a0, a1, (r0 + r1) / 2, r1)]
        else:
            parts = [(a0, (a0 + a1) / 2, r0, r1), ((a0 + a1) / 2, a1, r0, r1)]
        for b in parts:
            heapq.heappush(heap, (-bound(b), b))
    return 0.0, 0.0, 0


def grid_line(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """Cells (x, y) from one to another, both included."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    t = np.arange(n + 1) / max(1, n)
    return np.stack([np.floor(x0 + (x1 - x0) * t + 0.5), np.floor(y0 + (y1 - y0) * t + 0.5)], 1).astype(int)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map that takes four points (x, y) to four others."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    m = np.array(rows, float)
    return np.append(np.linalg.solve(m[:, :8], m[:, 8]), 1).reshape(3, 3)


def spline_points(points: np.ndarray, n: int, tension: float = 0.5) -> np.ndarray:
    """``n`` points on a smooth curve through control points (cardinal spline), evenly by parameter."""
    p = np.asarray(points, float)
    ext = np.concatenate([[2 * p[0] - p[1]], p, [2 * p[-1] - p[-2]]])
    t = np.linspace(0, len(p) - 1, n)
    i = np.minimum(t.astype(int), len(p) - 2)
    u = (t - i)[:, None]
    a, b, c, d = ext[i], ext[i + 1], ext[i + 2], ext[i + 3]
    m0, m1 = tension * (c - a), tension * (d - b)
    return (2 * u**3 - 3 * u**2 + 1) * b + (u**3 - 2 * u**2 + u) * m0 + (3 * u**2 - 2 * u**3) * c + (u**3 - u**2) * m1


def closest_on_polyline(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    p, q = points[:-1], points[1:]
    d = q - p
    t = np.clip(((at - p) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)[:, None]
    near = p + t * d
    gap = np.hypot(*(near - at).T)
    k = int(gap.argmin())
    return near[k], float(gap[k])


def polyline_meets_line(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The first point where a polyline crosses the line through a and b."""
    n = np.array([-(b - a)[1], (b - a)[0]])
    side = (points - a) @ n
    hit = np.flatnonzero((side[:-1] <= 0) != (side[1:] <= 0))
    if not len(hit):
        return None
    i = hit[0]
    t = side[i] / (side[i] - side[i + 1])
    return points[i] + t * (points[i + 1] - points[i])


def dewarp(g: np.ndarray, top: np.ndarray, bottom: np.ndarray, h: int, w: int, outside: float = 255.0) -> np.ndarray:
    """The page between two curves (x, y from left to right) made flat.

    Columns are spaced by arc length along the mean curve, so that what leans away from the camera
    widens; rows run straight from the top to the bottom curve.
    """
    def along(curve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = spline_points(curve, 8 * len(curve))
        length = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(fine, axis=0).T))])
        return fine, length / length[-1]

    t = (np.arange(w) + 0.5) / w
    ends = []
    for curve in (top, bottom):
        fine, s = along(np.asarray(curve, float))
        ends.append((np.interp(t, s, fine[:, 0]), np.interp(t, s, fine[:, 1])))
    v = ((np.arange(h) + 0.5) / h)[:, None]
    x = ends[0][0] * (1 - v) + ends[1][0] * v
    y = ends[0][1] * (1 - v) + ends[1][1] * v
    return np.floor(np.clip(sample(g, y - 0.5, x - 0.5, outside), 0, 255) + 0.5).astype(np.uint8)


def trace_text_lines(b: np.ndarray, least: int = 20) -> list[np.ndarray]:
    """Middles of text lines: content smeared along rows, its wide components, and their mean row by column."""
    smear = closed(b, 1, max(3, b.shape[1] // 20))
    labels, n = components(smear)
    out = []
    for k, (x0, y0, x1, y1, _) in enumerate(component_table(labels, n), 1):
        if x1 - x0 >= max(least, 3 * (y1 - y0)):
            own = labels[y0:y1, x0:x1] == k
            rows = (own * np.arange(y0, y1)[:, None]).sum(0) / np.maximum(own.sum(0), 1)
            xs = np.flatnonzero(own.any(0))
            out.append(np.stack([xs + x0 + 0.5, rows[xs] + 0.5], 1))
    return out


def page_edges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest paths across the page along strong vertical gradients, one in the upper and one in the lower half."""
    _, gy = sobel(g)
    cost = 1.0 / (1 + np.abs(gy))
    out = []
    for rows in (slice(0, g.shape[0] // 2), slice(g.shape[0] // 2, g.shape[0])):
        c = cost[rows]
        total, back = c[:, 0].copy(), []
        for x in range(1, c.shape[1]):
            near = np.stack([np.concatenate([[np.inf], total[:-1]]), total, np.concatenate([total[1:], [np.inf]])])
            step = near.argmin(0)
            back.append(step - 1)
            total = near.min(0) + c[:, x]
        y = int(total.argmin())
        path = [y]
        for step in reversed(back):
            y += int(step[y])
            path.append(y)
        out.append(np.stack([np.arange(c.shape[1]) + 0.5, np.array(path[::-1]) + rows.start + 0.5], 1))
    return out[0], out[1]


# --- detectors ------------------------------------------------------------------------------------------------


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def is_plate(g: np.ndarray) -> tuple[bool, float, float, float]:
    """Whether a page is a plate: entropy of 64 bins, midtone share and the share of 6 x 6 tiles that look like one."""
    mid = lambda a: float(((a >= 20) & (a <= 235)).mean()) if a.size else 0.0
    hist = lambda a: np.bincount((a >> 2).ravel(), minlength=64)
    ys, xs = [np.arange(7) * n // 6 for n in g.shape]
    tiles = [g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]] for i in range(6) for j in range(6)]
    votes = sum(t.size > 0 and entropy(hist(t)) >= 4.6 and mid(t) >= 0.35 for t in tiles) / 36
    e, m = entropy(hist(g)), mid(g)
    return e >= 4.05 and m >= 0.30 and votes >= 0.08 and (m < 0.93 or votes >= 0.28 or e >= 4.35), e, m, votes


def black_on_white(g: np.ndarray) -> bool:
    """Whether the lighter class around the content is the larger one."""
    b = g < otsu(histogram(g))
    return float(b.mean()) <= 0.5


def paper_color(rgb: np.ndarray) -> tuple[int, int, int] | None:
    """The brightest quarter of a grid of pixels, the upper median of each channel; none if too few or too dark."""
    step = max(1, int(math.sqrt(rgb.shape[0] * rgb.shape[1] / 32768)))
    px = rgb[::step, ::step].reshape(-1, 3).astype(int)
    px = px[px.sum(1) // 3 >= 96]
    if len(px) < 64:
        return None
    keep = max(32, len(px) // 4)
    best = px[np.argsort(-px.sum(1), kind="stable")[:keep]]
    out = np.sort(best, 0)[keep // 2]
    return tuple(map(int, out)) if out.sum() // 3 >= 120 else None


def white_balance(rgb: np.ndarray, paper: tuple[int, int, int]) -> np.ndarray:
    gain = np.clip(245.0 / np.maximum(np.array(paper), 1), 0.2, 6)
    return np.minimum(255, (rgb * gain).astype(int)).astype(np.uint8)


def posterize(rgb: np.ndarray, level: int) -> np.ndarray:
    """Channels on ``level`` evenly spaced values."""
    step = 255 / (level - 1)
    return np.floor(np.floor(rgb / step + 0.5) * step + 0.5).astype(np.uint8)


def palette(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours, and the image as their indices."""
    flat = rgb.reshape(-1, rgb.shape[-1])
    colors, index = np.unique(flat, axis=0, return_inverse=True)
    return colors, index.reshape(rgb.shape[:2])


def segment_colors(rgb: np.ndarray, b: np.ndarray, noise: int = 4) -> np.ndarray:
    """Of the black components the hue class (1 red, 2 green, 3 blue, 4 dark); specks take the class of the nearest larger one."""
    labels, n = components(b)
    out = np.zeros(b.shape, np.int32)
    if not n:
        return out
    size = np.bincount(labels.ravel(), minlength=n + 1)
    means = np.stack([np.bincount(labels.ravel(), rgb[:, :, c].ravel().astype(float), n + 1) for c in range(3)], 1) / np.maximum(size, 1)[:, None]
    kind = np.where(means.max(1) - means.min(1) >= 40, means.argmax(1) + 1, 4)
    small = size < noise
    small[0] = False
    if small.any() and not small[1:].all():
        near, _ = influence_map(np.where(small[labels], 0, labels))
        ys, xs = np.nonzero(small[labels])
        first = {}
        for k, at in zip(labels[ys, xs].tolist(), near[ys, xs].tolist(), strict=True):
            first.setdefault(k, at)
        for k, at in first.items():
            kind[k] = kind[at]
    kind[0] = 0
    return kind[labels].astype(np.int32)


def picture_mask(g: np.ndarray) -> np.ndarray:
    """Areas of pictures: a strong gradient that survives a wide opening, its holes filled."""
    lo, hi = np.percentile(g, (1, 99))
    v = np.clip((g - lo) * 255.0 / max(1.0, hi - lo), 0, 255).astype(np.uint8)
    steep = (erode(v).astype(int) - dilate(v)).astype(np.uint8)
    size = max(3, min(35, min(g.shape) // 4 | 1))
    rebuilt = 255 - seed_fill_gray(255 - sliding(steep, size, size, np.minimum), 255 - steep)
    return fill_holes(rebuilt > max(16, otsu(histogram(rebuilt))))


def content_box(g: np.ndarray, dpi: int = 150) -> tuple[int, int, int, int] | None:
    """Box (x0, y0, x1, y1) of the content: no areas that touch the border, no specks, no thin spans at the edges."""
    b = binarize(g, "sauvola", max(3, dpi // 3))
    frame = np.zeros_like(b)
    frame[0], frame[-1], frame[:, 0], frame[:, -1] = True, True, True, True
    wide = closed(b, 3, 3)
    b = b & ~seed_fill(frame & wide, wide)
    labels, n = components(b)
    if not n:
        return None
    t = component_table(labels, n)
    keep = (t[:, 4] >= max(4, (dpi // 60) ** 2)) & (t[:, 2] - t[:, 0] < 0.95 * g.shape[1]) & (t[:, 3] - t[:, 1] < 0.95 * g.shape[0])
    if not keep.any():
        return None
    return int(t[keep, 0].min()), int(t[keep, 1].min()), int(t[keep, 2].max()), int(t[keep, 3].max())


def detect_edge(black: np.ndarray, total: int, run: int = 10) -> int:
    """Last line at least 95 % black before over ``run`` lines that aren't; -1 without one."""
    last = -1
    for i, n in enumerate(black.tolist()):
        if n * 100 >= total * 95:
            last = i
        elif i - last > run:
            break
    return last


def page_box(g: np.ndarray, expected: tuple[float, float] | None = None) -> tuple[int, int, int, int]:
    """Box of the page on a dark bed: the borders that five binarisations find; width and height by the least error against what is expected."""
    found = []
    for method in ("mokji", "otsu", "bradley", "sauvola", "wolf"):
        b = binarize(g, method, 51)
        h, w = b.shape
        cols, rows = b.sum(0), b.sum(1)
        found.append((detect_edge(cols, h) + 1, detect_edge(rows, w) + 1, w - detect_edge(cols[::-1], h) - 1, h - detect_edge(rows[::-1], w) - 1))
    if expected is None:
        return found[3]

    def pick(lo: int, hi: int, size: float) -> tuple[int, int]:
        errors = [abs((f[hi] - f[lo]) - size) / size for f in found]
        k = int(np.argmin(errors))
        return (found[k][lo], found[k][hi]) if errors[k] < 1 else (found[3][lo], found[3][hi])

    (x0, x1), (y0, y1) = pick(0, 2, expected[0]), pick(1, 3, expected[1])
    return x0, y0, x1, y1


def spine(g: np.ndarray) -> tuple[int, float]:
    """Column of the fold in the middle third, and how much darker it is than its surroundings; -1 if nothing stands out."""
    dark = 255.0 - g.mean(0)
    w = len(dark)
    around = window_sum(dark[None], 1, max(3, w // 15) | 1)[0] / window_area((1, w), 1, max(3, w // 15) | 1)[0]
    gain = (dark - around)[w // 3 : w - w // 3]
    at = int(gain.argmax())
    return (at + w // 3, float(gain[at])) if gain[at] >= 14 else (-1, float(gain[at]))


def frames(g: np.ndarray, least: float = 0.08) -> list[tuple[int, int, int, int]]:
    """Rects of photographs: large components of tone, as solid as a frame."""
    labels, n = components(closed((g > 40) & (g < 216), 5, 5))
    t = component_table(labels, n)
    area = (t[:, 2] - t[:, 0]) * (t[:, 3] - t[:, 1])
    return [tuple(map(int, r[:4])) for r, a in zip(t, area, strict=True) if a >= least * g.size and r[4] >= 0.6 * a]


def tone_evidence(rgb: np.ndarray) -> dict:
    """What the colour rules look at: chroma, shares of dark, mid and light, and 9 x 9 overlapping tiles of continuous tone."""
    g = luma(rgb)
    colored = False
    if rgb.ndim == 3:
        px = rgb[::4, ::4].reshape(-1, 3).astype(int)
        use = (px.max(1) >= 10) & (px.min(1) <= 240)
        colored = bool(((px.max(1) - px.min(1) >= 50) & use).mean() >= 0.03)
    flat = flatten(g)
    h, w = g.shape
    y0, x0 = int(h * 0.04), int(w * 0.04)
    th, tw = max(1, (h - 2 * y0) // 5), max(1, (w - 2 * x0) // 5)
    tone = np.zeros((9, 9), bool)
    for i in range(9):
        for j in range(9):
            a, b = y0 + (h - 2 * y0 - th) * i // 8, x0 + (w - 2 * x0 - tw) * j // 8
            t = flat[a : a + th : 2, b : b + tw : 2]
            hist = np.bincount((t >> 4).ravel(), minlength=16)
            broad = float(((t > 40) & (t < 216)).mean()) if t.size else 0.0
            used = int((hist > 0.002 * max(1, t.size)).sum())
            tone[i, j] = broad >= 0.05 and entropy(hist) / 4 >= 0.62 and used >= 7
    labels, n = components(tone, eight=False)
    size = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    cover = np.zeros((10, 10), int)
    for i, j in zip(*np.nonzero(tone), strict=True):
        cover[i : i + 2, j : j + 2] = labels[i, j]
    largest = int(size.argmax()) + 1 if n else 0
    return {
        "is_gray": not colored, "dark": float((flat < 80).mean()), "mid": float(((flat >= 80) & (flat < 130)).mean()), "light": float((flat >= 130).mean()),
        "coverage": float((cover > 0).mean()), "largest": float((cover == largest).mean()) if n else 0.0, "tiles": int(tone.sum()), "region_tiles": int(size.max()) if n else 0,
    }


def neutral_pixels(rgb: np.ndarray, n: int = 5000, seed: int = 0) -> tuple[int, int, int] | None:
    """Median of bright pixels of little saturation among ``n`` drawn with a fixed seed; none with fewer than ten."""
    px = rgb.reshape(-1, 3)
    px = px[np.random.default_rng(seed).integers(0, len(px), min(n, len(px)))].astype(int)
    px = px[(px.min(1) >= 150) & (px.max(1) - px.min(1) <= 40)]
    return tuple(map(int, np.median(px, 0))) if len(px) >= 10 else None


def margin_color(rgb: np.ndarray, band: float = 0.05, spread: float = 12.0) -> tuple[int, int, int] | None:
    """Mean colour of the even blocks along the edges; none if they all vary."""
    h, w = rgb.shape[:2]
    size = max(2, int(min(h, w) * band))
    blocks = [rgb[y : y + size, x : x + size] for x in range(0, w - size + 1, size) for y in (0, h - size)] + [rgb[y : y + size, x : x + size] for y in range(0, h - size + 1, size) for x in (0, w - size)]
    even = [b.reshape(-1, 3).mean(0) for b in blocks if b.reshape(-1, 3).std(0).max() <= spread]
    return tuple(int(v + 0.5) for v in np.median(even, 0)) if even else None


def paper_of(rgb: np.ndarray) -> tuple[int, int, int] | None:
    """The paper's colour: from the margins, else from neutral pixels, else from the brightest."""
    return margin_color(rgb) or neutral_pixels(rgb) or paper_color(rgb)


def has_cast(color: tuple[int, int, int], threshold: int = 5) -> bool:
    mean = sum(color) // 3
    return max(abs(c - mean) for c in color) >= threshold


def compensated_evidence(rgb: np.ndarray) -> dict:
    """Tone evidence; of a tinted page once more with the paper's tint taken out, if that makes it gray."""
    found = tone_evidence(rgb)
    paper = paper_of(rgb) if rgb.ndim == 3 and not found["is_gray"] else None
    if paper and has_cast(paper):
        again = tone_evidence(white_balance(rgb, paper))
        return again if again["is_gray"] else found
    return found


def auto_tones(rgb: np.ndarray) -> dict[str, float]:
    """Settings of the tone curve that bring the darkest and lightest half percent to the ends."""
    y = (rgb.astype(int) * (299, 587, 114)).sum(-1) // 1000 if rgb.ndim == 3 else rgb.astype(int)
    upto, clip = np.cumsum(np.bincount(y.ravel(), minlength=256)), y.size // 200
    low, high = int(np.searchsorted(upto, clip + 1)), int(np.searchsorted(upto, y.size - clip))
    return {"exposure": float(np.log2(255 / max(1, high))), "blacks": -min(100.0, 400.0 * low / 255)}


def spread_geometry(g: np.ndarray, light: int = 200, even: float = 12.0) -> dict[str, float]:
    """The longest run of light, even columns, and how much the columns beside it vary: a gutter between two plates."""
    mean, std = g.mean(0), g.std(0)
    flag = np.concatenate([[0], ((mean >= light) & (std <= even)).astype(int), [0]])
    first, last = np.flatnonzero(np.diff(flag) == 1), np.flatnonzero(np.diff(flag) == -1)
    if not len(first):
        return {"b": 0, "e": 0, "left": float(std.mean()), "right": float(std.mean())}
    k = int((last - first).argmax())
    b, e = int(first[k]), int(last[k])
    return {"b": b, "e": e, "left": float(std[:b].mean()) if b else 0.0, "right": float(std[e:].mean()) if e < g.shape[1] else 0.0}
