"""Distances of descriptors, as arrays: whole tables of them, or row by row in the same order of sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..types import MatrixError


def distances(q: np.ndarray, t: np.ndarray, norm: str) -> np.ndarray:
    """(queries, trains) distances."""
    if norm == "l2":
        d = np.zeros((len(q), len(t)))
        for k in range(q.shape[1]):  # dimension by dimension: sums in a fixed order
            e = q[:, k, None] - t[None, :, k]
            d += e * e
        return np.sqrt(d)
    if norm == "hamming":
        q, t = (np.ascontiguousarray(x.astype(np.uint8)) for x in (q, t))
        kind = next(k for k in (np.uint64, np.uint32, np.uint16, np.uint8) if q.shape[1] % np.dtype(k).itemsize == 0)
        d = np.zeros((len(q), len(t)))
        for a, b in zip(q.view(kind).T, t.view(kind).T):
            d += np.bitwise_count(a[:, None] ^ b[None, :])
        return d
    raise MatrixError(f"no norm {norm}")


def rowwise(a: np.ndarray, b: np.ndarray, norm: str) -> np.ndarray:
    """The distance of each row of ``a`` to the row of ``b`` beside it; the same to the last bit as ``distances``."""
    d = np.zeros(len(a))
    if norm == "l2":
        for x, y in zip(a.T, b.T):
            e = x - y
            d += e * e
        return np.sqrt(d)
    if norm == "hamming":
        for x, y in zip(a.astype(np.uint8).T, b.astype(np.uint8).T):
            d += np.bitwise_count(x ^ y)
        return d
    raise MatrixError(f"no norm {norm}")


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
