"""Pixel filters on RGBA arrays (height, width, 4), and template rectangles."""

from __future__ import annotations

import numpy as np

#: BT.709 weights (fixed values).
LUMA = np.array([0.2126, 0.7152, 0.0722])


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """3 x 3 convolution with repeated edges; alpha stays."""
    rgb = np.pad(image[..., :3].astype(float), ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = image.shape[:2]
    out = sum(kernel[j, i] * rgb[j : j + h, i : i + w] for j in range(3) for i in range(3))
    return np.concatenate([np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8), image[..., 3:]], axis=2)


def transfer(image: np.ndarray, table: list[float]) -> np.ndarray:
    """Piecewise-linear curve through equally spaced values from 0 to 1."""
    curve = np.clip(np.interp(np.arange(256) / 255, np.linspace(0, 1, len(table)), table) * 255 + 0.5, 0, 255).astype(np.uint8)
    return np.concatenate([curve[image[..., :3]], image[..., 3:]], axis=2)


def luminance(image: np.ndarray) -> np.ndarray:
    grey = np.clip(np.floor(image[..., :3] @ LUMA + 0.5), 0, 255).astype(np.uint8)
    return np.concatenate([np.repeat(grey[..., None], 3, axis=2), image[..., 3:]], axis=2)


def apply(image: np.ndarray, sharpen: float = 0.0, table: list[float] | None = None, grey: bool = False) -> np.ndarray:
    """Sharpening, then the curve, then grey."""
    if sharpen:
        image = convolve(image, np.array([[0, -sharpen, 0], [-sharpen, 1 + 4 * sharpen, -sharpen], [0, -sharpen, 0]]))
    if table:
        image = transfer(image, table)
    return luminance(image) if grey else image


def multiply(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    """Product of two affine 2 x 3 matrices (a, b, c, d, e, f); ``b`` is applied first."""
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def transformed(m: tuple[float, ...], x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    """Box (x, y, w, h) of a transformed rectangle."""
    xs, ys = zip(*((m[0] * px + m[2] * py + m[4], m[1] * px + m[3] * py + m[5]) for px in (x, x + w) for py in (y, y + h)), strict=True)
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)


def rectangles(ops: list[tuple[str, tuple]]) -> list[tuple[float, float, float, float]]:
    """Rectangles of an operator list: 'save', 'restore', 'transform' (six numbers), 'rect' (x, y, w, h)."""
    now, stack, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
    for op, args in ops:
        if op == "save":
            stack.append(now)
        elif op == "restore":
            now = stack.pop() if stack else now
        elif op == "transform":
            now = multiply(now, args)
        elif op == "rect":
            out.append(transformed(now, *args))
    return out


def holds(rect: tuple[float, float, float, float], points: list[tuple[float, float]]) -> bool:
    return all(rect[0] <= x <= rect[0] + rect[2] and rect[1] <= y <= rect[1] + rect[3] for x, y in points)


def placeholder(rects: list[tuple[float, float, float, float]], marks: list[tuple[float, float]], page: tuple[float, float]) -> tuple[float, float, float, float] | None:
    """The smallest fair-sized rectangle that holds all marks, else the largest one that holds none."""
    own = [r for r in dict.fromkeys(tuple(round(v, 2) for v in r) for r in rects) if 0.02 * page[0] * page[1] <= r[2] * r[3] <= 0.95 * page[0] * page[1]]
    held = [r for r in own if marks and holds(r, marks)]
    if held:
        return min(held, key=lambda r: r[2] * r[3])
    free = [r for r in own if not any(holds(r, [m]) for m in marks)]
    return max(free, key=lambda r: r[2] * r[3]) if free else None
