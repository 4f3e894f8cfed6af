"""Integer vectors: finite components, exact scaling, matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: components beyond it would let a squared distance of 64 components pass a long
LARGEST = 1 << 27


def finite(vector: str | Column) -> Column:
    """True for a vector that is not null and has neither null nor non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd, F.lit(False))


def scaled(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of integer lists of one length; components beyond ``LARGEST`` raise an error."""
    out = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)
    if out.size and max(int(out.max()), -int(out.min())) >= LARGEST:
        raise ValueError(f"a scaled component reaches {LARGEST}")
    return out


def packed(rows: np.ndarray, kind: str = "<i4") -> pa.Array:
    """One binary value a row."""
    raw = np.ascontiguousarray(rows, kind)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def unpacked(values: pa.Array, dim: int, kind: str = "<i4") -> np.ndarray:
    """The rows that ``packed`` stored."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), dim).astype(np.int64)
