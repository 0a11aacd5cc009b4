"""Kernels over single frames, in numpy: grey, edges, sharpness, bounds of the caption band, variants for reading.

Frames are uint8 arrays, rows by columns, with or without three channels in
the order blue, green, red. The filters follow the published definitions of
their methods; borders are mirrored without the edge pixel unless said.
"""

from __future__ import annotations

import numpy as np

from ..params import check_crop_ratio

#: Fixed values. Edges: the two thresholds of the hysteresis.
WEAK, STRONG = 80, 180
#: Fixed values. Band: part of the frame that is searched, least density of an edge row, rows added above and below,
#: least side of a frame and least number of edge rows.
SEARCH, DENSITY, ABOVE, BELOW, SIDE, EDGE_ROWS = 0.45, 8.0, 30, 35, 20, 3
#: Fixed values. Presence: least share of edge pixels, least contrast, least band, frames looked at, hits that settle it.
EDGE_SHARE, CONTRAST, PRESENCE_BAND, PRESENCE_FRAMES, PRESENCE_HITS = 0.012, 18, 0.22, 8, 2
#: Fixed values. Second look at a frame without text: it is taken below the first ratio, by the step, at most to the last.
RETRY_BELOW, RETRY_STEP, RETRY_MOST = 0.28, 0.12, 0.35

Bounds = tuple[int, int, int, int]  # x, y, width, height


def checked(frame) -> np.ndarray:
    if not isinstance(frame, np.ndarray) or frame.ndim < 2:
        raise ValueError("a frame is an array of rows and columns")
    return frame


def gray(frame: np.ndarray) -> np.ndarray:
    if checked(frame).ndim == 2:
        return frame
    return byte(frame[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def byte(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def padded(image: np.ndarray, rows: int, columns: int, mode: str = "reflect") -> np.ndarray:
    """Mirrored borders; where the image is too small to mirror, its edge is repeated."""
    if mode == "reflect" and (image.shape[0] <= rows or image.shape[1] <= columns):
        mode = "edge"
    return np.pad(image, ((rows, rows), (columns, columns)), mode=mode)


def separable(image: np.ndarray, down: np.ndarray, across: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation with the outer product of two odd kernels."""
    r, c = len(down) // 2, len(across) // 2
    p = padded(image.astype(np.float64), r, c, mode)
    h, w = image.shape
    p = sum(k * p[i : i + h] for i, k in enumerate(down) if k)
    return sum(k * p[:, i : i + w] for i, k in enumerate(across) if k)


def gaussian(sigma: float, size: int) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def sharpness(frame: np.ndarray | None) -> float:
    """Variance of the Laplacian; 0 without a frame."""
    if frame is None:
        return 0.0
    g = gray(frame)
    second, one = np.array([1.0, -2.0, 1.0]), np.array([1.0])
    return float((separable(g, second, one) + separable(g, one, second)).var())


def edges(image: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Canny's edges as a mask: gradients that are greatest across their direction, strong or joined to a strong one."""
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    dx = separable(image, smooth, slope, "edge")
    dy = separable(image, slope, smooth, "edge")
    size = np.abs(dx) + np.abs(dy)
    h, w = size.shape
    around = np.pad(size, 1)
    at = lambda r, c: around[1 + r : 1 + r + h, 1 + c : 1 + c + w]
    ax, ay, flat = np.abs(dx), np.abs(dy), np.tan(np.pi / 8)
    level, upright = ay < flat * ax, ay > (flat + 2) * ax
    falling = (dx < 0) == (dy < 0)  # the gradient runs from the upper left to the lower right
    slanted = np.where(falling, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))
    peak = np.select([level, upright], [(size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0))], slanted)
    able = np.pad(peak & (size > weak), 1)
    front = np.flatnonzero(able & np.pad(size > strong, 1))
    found = np.zeros(able.size, bool)
    found[front] = True
    able = able.ravel()
    near = np.array([r * (w + 2) + c for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    while len(front):  # every pixel enters once
        n = (front[:, None] + near).ravel()
        front = np.unique(n[able[n] & ~found[n]])
        found[front] = True
    return found.reshape(h + 2, w + 2)[1:-1, 1:-1]


def fixed_bounds(frame: np.ndarray, ratio: float = 0.15) -> Bounds:
    """The bottom band."""
    h, w = checked(frame).shape[:2]
    y = round(h * (1.0 - check_crop_ratio(ratio)))
    return 0, y, w, h - y


def dynamic_bounds(frame: np.ndarray, ratio: float = 0.15) -> Bounds:
    """The rows of the lower part that are dense with edges, with a margin; the bottom band where there are none."""
    h, w = checked(frame).shape[:2]
    band = fixed_bounds(frame, ratio)
    if min(h, w) < SIDE:
        return band
    first = int(h * (1.0 - SEARCH))
    density = edges(gray(frame)[first:]).mean(axis=1) * 255
    dense = np.flatnonzero(density > max(density.mean() + density.std(), DENSITY)) + first
    if len(dense) < EDGE_ROWS:
        return band
    top, end, least = max(0, int(dense[0]) - ABOVE), min(h, int(dense[-1]) + BELOW), int(h * ratio)
    if end - top < least:
        top = max(0, (top + end) // 2 - least // 2)
        end = min(h, top + least)
    return 0, top, w, end - top


def crop(frame: np.ndarray, bounds: Bounds) -> np.ndarray:
    x, y, width, height = bounds
    return frame[y : y + height, x : x + width]


def enlarged(image: np.ndarray, scale: int) -> np.ndarray:
    """Bicubic enlargement by a whole factor (Keys' kernel, a = -0.75), edges repeated."""

    def along(rows: np.ndarray) -> np.ndarray:
        n = len(rows)
        at = (np.arange(n * scale) + 0.5) / scale - 0.5
        base = np.floor(at).astype(int)
        out = 0.0
        for k in range(-1, 3):
            d, a = np.abs(at - base - k), -0.75
            weight = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
            out = out + weight[:, None] * rows[np.clip(base + k, 0, n - 1)]
        return out

    return byte(along(along(image.astype(np.float64)).T).T)


def equalized(image: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: a histogram for each tile, its peaks spread, blended between tiles."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    down, right = th * tiles - h, tw * tiles - w
    whole = np.pad(image, ((0, down), (0, right)), mode="reflect" if down < h and right < w else "edge")
    area = th * tw
    tile = whole.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, area).astype(np.int64)
    counts = np.bincount((tile + np.arange(tiles * tiles)[:, None] * 256).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    most = max(int(limit * area / 256), 1)
    over = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for t, left in enumerate(over % 256):
        if left:
            counts[t, np.arange(256)[:: max(256 // left, 1)][:left]] += 1
    tables = np.rint(np.cumsum(counts, axis=1) * (255 / area)).clip(0, 255).reshape(tiles, tiles, 256)

    def between(n: int, side: int):
        at = np.arange(n) / side - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (r0, r1, fr), (c0, c1, fc) = between(h, th), between(w, tw)
    take = lambda r, c: tables[r[:, None], c[None, :], image]
    fr, fc = fr[:, None], fc[None, :]
    return byte((take(r0, c0) * (1 - fc) + take(r0, c1) * fc) * (1 - fr) + (take(r1, c0) * (1 - fc) + take(r1, c1) * fc) * fr)


def smoothed(image: np.ndarray, size: int = 7, color: float = 50, space: float = 50) -> np.ndarray:
    """Bilateral filter over the disc of that diameter."""
    r, (h, w) = size // 2, image.shape
    p, own = padded(image, r, r).astype(np.float64), image.astype(np.float64)
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for y in range(-r, r + 1):
        for x in range(-r, r + 1):
            if x * x + y * y <= r * r:
                other = p[r + y : r + y + h, r + x : r + x + w]
                k = np.exp(-(x * x + y * y) / (2 * space * space) - (other - own) ** 2 / (2 * color * color))
                total += k * other
                weights += k
    return byte(total / weights)


def otsu(image: np.ndarray) -> int:
    """The threshold that parts grey values with the greatest variance between both sides; the lowest of equals."""
    p = np.bincount(image.ravel(), minlength=256) / image.size
    below, mass = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass) ** 2 / (below * (1 - below))
    return int(np.argmax(np.where((below > 1e-9) & (below < 1 - 1e-9), between, -1.0)))


def closed(image: np.ndarray) -> np.ndarray:
    """Closing by a row of two pixels: gaps of one pixel across are filled, nothing moves."""
    wide = np.maximum(image, np.pad(image, ((0, 0), (1, 0)))[:, :-1])
    return np.minimum(wide, np.pad(wide, ((0, 0), (0, 1)), constant_values=255)[:, 1:])


def variants(region: np.ndarray, names: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """The named images of a region for a reader; small regions are enlarged up to three times."""
    g = gray(region)
    scale = max(1, min(3, 900 // max(g.shape[0], 1)))
    if g.size == 0:
        return {}
    if scale > 1:
        g = enlarged(g, scale)
    even = equalized(g)
    soft = byte(separable(even, gaussian(1.6, 11), gaussian(1.6, 11)))
    clean = smoothed(byte(1.45 * even.astype(np.float64) - 0.45 * soft))
    light = np.where(clean > otsu(clean), 255, 0).astype(np.uint8)
    dark = 255 - light

    def local() -> np.ndarray:
        block = max(11, (g.shape[0] // 8) | 1)
        k = gaussian(0.3 * ((block - 1) * 0.5 - 1) + 0.8, block)
        mean = byte(separable(clean, k, k, "edge")).astype(int)
        return np.where(clean.astype(int) > mean - 4, 255, 0).astype(np.uint8)

    made = {"clahe_gray": lambda: even, "otsu": lambda: light, "inv_otsu": lambda: dark, "adaptive": local, "joined": lambda: closed(light), "inv_joined": lambda: closed(dark)}
    return {n: f() for n, f in made.items() if names is None or n in names}


def captioned(frame: np.ndarray, ratio: float = 0.15) -> bool:
    """Whether the bottom band looks like text: many edges, much contrast."""
    g = gray(crop(frame, fixed_bounds(frame, max(ratio, PRESENCE_BAND))))
    return g.size > 0 and float(edges(g).mean()) > EDGE_SHARE and float(g.std()) > CONTRAST


def retry_ratio(ratio: float) -> float | None:
    """The band of the second look, or None."""
    return min(ratio + RETRY_STEP, RETRY_MOST) if ratio < RETRY_BELOW else None
