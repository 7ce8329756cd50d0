"""Tap tables: which source places a target place takes, with what weight.

A linear operator along an axis is a join with such a table and a sum. Tables are made on the driver from the
length of the axis and the kernel; borders are folded in, so the join needs no special case.
"""

from __future__ import annotations

import math

import numpy as np

from ..types import Border, MatrixError

Tap = tuple[int, int, float]  # target, source, weight


def border_index(p: int, n: int, border: Border = Border.REFLECT_101) -> int:
    """The place inside [0, n) that stands for p, or -1 where the border gives none."""
    if 0 <= p < n:
        return p
    if border == Border.REPLICATE:
        return 0 if p < 0 else n - 1
    if border in (Border.REFLECT, Border.REFLECT_101):
        if n == 1:
            return 0
        period = 2 * n if border == Border.REFLECT else 2 * n - 2
        q = p % period
        return q if q < n else period - q - (border == Border.REFLECT)
    if border == Border.WRAP:
        return p % n
    return -1


def kernel_taps(n: int, kernel: list[float], anchor: int = -1, border: Border = Border.REFLECT_101) -> list[Tap]:
    """Correlation with a kernel; taps that a border leaves out have no row, taps that meet are added up."""
    k = len(kernel)
    anchor = k // 2 if anchor < 0 else anchor
    found: dict[tuple[int, int], float] = {}
    for target in range(n):
        for j, w in enumerate(kernel):
            source = border_index(target + j - anchor, n, border)
            if source >= 0:
                found[target, source] = found.get((target, source), 0.0) + float(w)
    return [(t, s, w) for (t, s), w in sorted(found.items())]


def gaussian_kernel(n: int, sigma: float = 0.0) -> list[float]:
    if n < 1 or n % 2 == 0:
        raise MatrixError("a Gaussian kernel has an odd size")
    s = sigma if sigma > 0 else 0.3 * ((n - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * s * s))
    return (w / w.sum()).tolist()


def sobel_kernels(size: int, dx: int, dy: int) -> tuple[list[float], list[float]]:
    """(along x, along y) derivative kernels of size 3 or 5, or -1 for Scharr: binomial smoothing, differences."""

    def one(order: int) -> list[float]:
        if size == -1:
            known = {0: [3.0, 10.0, 3.0], 1: [-1.0, 0.0, 1.0]}
            if order not in known:
                raise MatrixError("Scharr kernels have order 0 or 1")
            return known[order]
        if size not in (3, 5) or not 0 <= order <= 2:
            raise MatrixError("derivative kernels have size 3 or 5 and order 0 to 2")
        p = np.array([1.0])
        for _ in range(size - 1 - order):
            p = np.convolve(p, [1, 1])
        for _ in range(order):
            p = np.convolve(p, [-1, 1])
        return p.tolist()

    return one(dx), one(dy)


def half_taps(n: int, border: Border = Border.REFLECT_101) -> list[Tap]:
    """Every second place of the 5-tap binomial smoothing."""
    return [(t // 2, s, w) for t, s, w in kernel_taps(n, [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], border=border) if t % 2 == 0]


def double_taps(n: int, border: Border = Border.REFLECT_101, by_source: bool = False) -> list[Tap]:
    """Zeros between the places, then 5-tap binomial smoothing with weight 8.

    The border is that of the doubled axis, or (``by_source``) that of the source axis.
    """
    found: dict[tuple[int, int], float] = {}
    for t in range(2 * n):
        for j, w in enumerate((1, 4, 6, 4, 1)):
            p = t + j - 2
            if by_source:
                p = 2 * border_index(p // 2, n, border) if p % 2 == 0 else -1
            else:
                p = border_index(p, 2 * n, border)
            if p >= 0 and p % 2 == 0:
                found[t, p // 2] = found.get((t, p // 2), 0.0) + w / 8
    return [(t, s, w) for (t, s), w in sorted(found.items())]


def resize_taps(n: int, target: int) -> list[Tap]:
    """Linear interpolation at half-pixel centres, clamped at the edges."""
    out = []
    for t in range(target):
        p = max(0.0, (t + 0.5) * n / target - 0.5)
        s = min(int(math.floor(p)), n - 1)
        d = p - s if s < n - 1 else 0.0
        out += [(t, s, 1 - d)] + ([(t, s + 1, d)] if d > 0 else [])
    return out


def dct_taps(n: int, inverse: bool = False) -> list[Tap]:
    """The orthonormal cosine basis (type II), or its transpose."""
    b = [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]
    return [(i, k, b[k][i]) if inverse else (k, i, b[k][i]) for k in range(n) for i in range(n)]


def structuring_element(kind: str, rows: int, cols: int, anchor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Active (dy, dx) offsets from the anchor of a rect, cross or ellipse."""
    ay, ax = anchor or (rows // 2, cols // 2)
    out = []
    for y in range(rows):
        if kind == "rect":
            low, high = 0, cols
        elif kind == "cross":
            low, high = (0, cols) if y == ay else (ax, ax + 1)
        elif kind == "ellipse":
            r, c = rows // 2, cols // 2
            dy = y - r
            half = int(c * math.sqrt((r * r - dy * dy) / (r * r))) if r and abs(dy) <= r else (c if not r else -1)
            low, high = max(c - half, 0), min(c + half + 1, cols)
        else:
            raise MatrixError(f"no shape {kind}")
        out += [(y - ay, x - ax) for x in range(low, high)]
    return out


def compose(first: list[Tap], then: list[Tap]) -> list[Tap]:
    """One table for two linear operators along the same axis."""
    by_target: dict[int, list[tuple[int, float]]] = {}
    for t, s, w in first:
        by_target.setdefault(t, []).append((s, w))
    found: dict[tuple[int, int], float] = {}
    for t, m, w in then:
        for s, w2 in by_target.get(m, []):
            found[t, s] = found.get((t, s), 0.0) + w * w2
    return [(t, s, w) for (t, s), w in sorted(found.items())]
