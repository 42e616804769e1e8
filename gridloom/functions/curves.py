"""Hilbert indices of n-dimensional cells: vectorised in numpy, and as a JVM expression.

Both follow the published transform of Skilling ("Programming the Hilbert curve", 2004) with exact 64-bit integers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of the rows of non-negative coordinates below ``2 ** bits``."""
    x = [np.array(axes[:, i], dtype=np.int64) for i in range(axes.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] >> level & 1) == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ swap ^ np.where(flip, low, 0)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ turn) >> level & 1)
    return out


def hilbert_axes(index: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The inverse: coordinates of curve positions, one row each."""
    x = [np.zeros(len(index), dtype=np.int64) for _ in range(n)]
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            x[i] |= (np.asarray(index, dtype=np.int64) >> (level * n + n - 1 - i) & 1) << level
    turn = x[-1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] = x[i] ^ x[i - 1]
    x[0] = x[0] ^ turn
    for level in range(1, bits):
        low = (1 << level) - 1
        for i in range(n - 1, -1, -1):
            flip = (x[i] >> level & 1) == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ swap ^ np.where(flip, low, 0)
            if i:
                x[i] = x[i] ^ swap
    return np.stack(x, axis=1)


def hilbert(axes: Sequence[Column], bits: int) -> Column:
    """Curve position, by an Arrow-batched function."""

    @F.pandas_udf("long")
    def position(x: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(x.to_numpy(dtype=np.int64), bits))

    return position(F.struct(*[a.cast("long").alias(f"x{i}") for i, a in enumerate(axes)]))


def hilbert_expression(axes: Sequence[Column], bits: int) -> Column:
    """The same, as an expression that stays in the JVM: folds over (bit, dimension) steps with the coordinates as an array."""
    n = len(axes)
    steps = [(1 << level, i) for level in range(bits - 1, 0, -1) for i in range(n)]
    state = F.array(*[a.cast("long") for a in axes])
    if steps:
        todo = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])

        def turn(s: Column, step: Column) -> Column:
            low, own = step["q"] - 1, F.element_at(s, step["i"] + 1)
            flip = own.bitwiseAND(step["q"]) != 0
            swap = s[0].bitwiseXOR(own).bitwiseAND(low)
            return F.transform(s, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap)).otherwise(v))

        state = F.aggregate(todo, state, turn)
    zero = F.lit(0).cast("long")
    prefix = F.transform(state, lambda _, k: F.aggregate(F.slice(state, F.lit(1), k + 1), zero, lambda s, v: s.bitwiseXOR(v)))
    levels = F.array(*[F.lit(level) for level in range(bits - 1, -1, -1)])

    def interleave(gray: Column) -> Column:
        last = F.element_at(gray, -1)
        mixed = F.aggregate(F.slice(levels, 1, max(bits - 1, 1)) if bits > 1 else F.array().cast("array<int>"), zero, lambda t, q: F.when(_bit(last, q) == 1, t.bitwiseXOR(_shift(F.lit(1).cast("long"), q) - 1)).otherwise(t))
        return F.aggregate(levels, zero, lambda out, q: F.aggregate(gray, out, lambda o, v: o * 2 + _bit(v.bitwiseXOR(mixed), q)))

    return F.transform(F.array(prefix), interleave)[0]


def _bit(v: Column, level: Column) -> Column:
    return F.call_function("shiftright", v, level).bitwiseAND(F.lit(1).cast("long"))


def _shift(v: Column, level: Column) -> Column:
    return F.call_function("shiftleft", v, level)
