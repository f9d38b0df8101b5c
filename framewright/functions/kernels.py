"""Image and audio measures in NumPy, without Spark: for Arrow functions and for tests.

Pictures are arrays of 8-bit grey (height, width) or RGB (height, width, 3).  Edges are thinned, double-threshold gradient
edges; they are this module's own and not bit for bit those of any imaging library.
"""

from __future__ import annotations

import numpy as np


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.round(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Every target pixel is the mean of the source area that it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo, hi = edge[:-1, None], edge[1:, None]
        k = np.arange(n)
        w = np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    a = image.astype(np.float64)
    return np.tensordot(weights(a.shape[0], height), np.moveaxis(np.tensordot(weights(a.shape[1], width), np.moveaxis(a, 1, 0), 1), 0, 1), 1)


def fit_width(image: np.ndarray, width: int) -> np.ndarray:
    """Shrunk to the width, never enlarged."""
    h, w = image.shape[:2]
    if w <= width:
        return image.copy()
    return np.clip(np.round(resize_area(image, width, max(1, round(h * width / w)))), 0, 255).astype(np.uint8)


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    p = np.pad(a, 1, mode="reflect")
    return p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]


def laplacian_variance(g: np.ndarray) -> float:
    a = g.astype(np.float64)
    if min(a.shape) < 2:
        return 0.0
    return float((_shifted(a, -1, 0) + _shifted(a, 1, 0) + _shifted(a, 0, -1) + _shifted(a, 0, 1) - 4 * a).var())


def edges(g: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Gradient maxima over ``high``, and those over ``low`` that touch them."""
    a = g.astype(np.float64)
    if min(a.shape) < 3:
        return np.zeros(a.shape, bool)
    s = lambda dy, dx: _shifted(a, dy, dx)
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    m = np.abs(gx) + np.abs(gy)
    across = np.abs(gx) >= np.abs(gy)
    t = lambda dy, dx: _shifted(m, dy, dx)
    peak = np.where(across, (m > t(0, -1)) & (m >= t(0, 1)), (m > t(-1, 0)) & (m >= t(1, 0)))
    strong, weak = peak & (m > high), peak & (m > low)
    while True:
        grown = strong.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown |= _shifted(strong, dy, dx)
        grown &= weak
        if (grown == strong).all():
            return strong
        strong = grown | strong


def frame_metrics(image: np.ndarray, low: float = 100, high: float = 200, black: int = 10) -> dict[str, float]:
    g = grey(image)
    return {
        "brightness": float(g.mean() / 255), "contrast": float(min(1.0, g.std() / 127.5)), "sharpness_score": laplacian_variance(g), "edge_density": float(edges(g, low, high).mean()), "black_pixel_ratio": float((g <= black).mean()), "entropy": entropy(g),
    }


def entropy(g: np.ndarray) -> float:
    """Of the grey levels, over 8 bits."""
    n = np.bincount(g.ravel(), minlength=256)
    p = n[n > 0] / n.sum() if n.sum() else np.ones(1)
    return float(min(1.0, max(0.0, -(p * np.log2(p)).sum() / 8)))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Structural similarity with uniform windows and sample covariance, within 0 and 1."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if min(x.shape) < window:
        return float(np.array_equal(x, y))

    def mean(v: np.ndarray) -> np.ndarray:
        c = np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        w = window
        return (c[w:, w:] - c[:-w, w:] - c[w:, :-w] + c[:-w, :-w]) / (w * w)

    n = window * window
    ux, uy = mean(x), mean(y)
    k = n / (n - 1)
    vx, vy, vxy = k * (mean(x * x) - ux * ux), k * (mean(y * y) - uy * uy), k * (mean(x * y) - ux * uy)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
    return float(min(1.0, max(0.0, s.mean())))


def dct2(a: np.ndarray) -> np.ndarray:
    n = len(a)
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m @ a @ m.T


def phash(g: np.ndarray, size: int = 8) -> np.ndarray:
    """Bits of the low frequencies above their median, the constant term aside."""
    n = max(size * 4, 32)
    low = dct2(resize_area(g, n, n))[:size, :size]
    return low > np.median(low.ravel()[1:])


def dhash(g: np.ndarray, size: int = 8) -> np.ndarray:
    s = np.round(resize_area(g, size + 1, size))
    return s[:, 1:] > s[:, :-1]


def hexed(bits: np.ndarray) -> str:
    flat = np.pad(bits.ravel().astype(np.uint8), (0, -bits.size % 4))
    return "".join(f"{int(v):x}" for v in flat.reshape(-1, 4) @ np.array([8, 4, 2, 1]))


def pair_metrics(a: np.ndarray, b: np.ndarray, low: float = 100, high: float = 200, size: int = 8) -> dict[str, float]:
    x, y = grey(a), grey(b)
    if x.shape != y.shape:
        y = np.clip(np.round(resize_area(y, x.shape[1], x.shape[0])), 0, 255).astype(np.uint8)
    s = ssim(x, y)
    return {
        "pixel_difference": float(np.abs(x.astype(int) - y.astype(int)).mean() / 255), "ssim_similarity": s, "ssim_difference": 1.0 - s,
        "phash_difference": float((phash(x, size) != phash(y, size)).mean()), "edge_difference": float((edges(x, low, high) ^ edges(y, low, high)).mean()),
    }


def thumbnail_metrics(a: np.ndarray, b: np.ndarray, changed: float = 0.08) -> dict[str, float]:
    """What a duplicate decision wants to know of two thumbnails."""
    x, y = grey(a), grey(b)
    if x.shape != y.shape:
        y = np.clip(np.round(resize_area(y, x.shape[1], x.shape[0])), 0, 255).astype(np.uint8)
    ex, ey = edges(x, 80, 180), edges(y, 80, 180)
    either = (ex | ey).sum()
    return {
        "thumbnail_ssim": ssim(x, y), "edge_similarity": float((ex & ey).sum() / either) if either else 1.0, "changed_pixel_ratio": float((np.abs(x.astype(int) - y.astype(int)) / 255 > changed).mean()),
        "addition_ab": float((ey & ~ex).sum() / max(1, ey.sum())), "addition_ba": float((ex & ~ey).sum() / max(1, ex.sum())),
    }


def audio_windows(samples: np.ndarray, rate: int, seconds: float = 1.0) -> list[dict[str, float]]:
    """Sums of each window of 16-bit samples."""
    n = max(1, int(rate * seconds))
    out = []
    for lo in range(0, len(samples), n):
        s = samples[lo : lo + n].astype(np.float64) / 32768.0
        out.append({"window_no": lo // n, "n": len(s), "sum": float(s.sum()), "sum_sq": float(s @ s), "peak": float(np.abs(s).max()), "clipped": int((np.abs(s) >= 32760 / 32768).sum())})
    return out
