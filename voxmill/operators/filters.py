"""Filters on valued voxel fields; cells without a row are zero, and zeros are not kept.

Each pass scatters a row's values to the cells its kernel reaches and sums (or takes the extreme of) what arrives: one
shuffle with map-side aggregation, instead of a join for each tap. Separable kernels take three passes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.frame import AXES, as_integers, keys, validate
from voxmill.operators.stencil import scatter


def gaussian_kernel1d(sigma: float, radius: int) -> np.ndarray:
    """Samples of a Gaussian that sum to 1."""
    at = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (at / sigma) ** 2) if sigma > 0 else (at == 0).astype(float)
    return w / w.sum()


def _prepare(df: DataFrame, values: list[str]) -> DataFrame:
    """One row for each voxel, its values as doubles and summed, without rows of zeros."""
    df = validate(df)
    out = df.groupBy(*keys(df)).agg(*(F.sum(F.col(v).cast("double")).alias(v) for v in values))
    return _nonzero(out, values, 0.0)


def _nonzero(df: DataFrame, values: list[str], epsilon: float) -> DataFrame:
    size = [F.abs(v) for v in values]
    return df.where((F.greatest(*size) if len(size) > 1 else size[0]) > epsilon)


def _check_epsilon(epsilon) -> float:
    if not epsilon >= 0:
        raise ValueError(f"epsilon has to be 0 or more, not {epsilon}")
    return float(epsilon)


def _taps(df: DataFrame, values: list[str], offsets: list[tuple], weights: list[float], epsilon: float) -> DataFrame:
    """out[m] = sum of w[j] in[m + j]: what is at j before m is sent on by -j."""
    sent = scatter(df, [tuple(-c for c in o) for o in offsets], weights)
    out = sent.groupBy(*keys(df)).agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in values))
    return _nonzero(out, values, epsilon)


def _along(axis: int, j: int) -> tuple[int, int, int]:
    return tuple(j if a == axis else 0 for a in range(3))


def correlate(df: DataFrame, weights, values: list[str], epsilon: float = 0.0) -> DataFrame:
    """Correlation with three odd 1-D kernels (of x, y and z) or one odd 3-D kernel."""
    epsilon, df = _check_epsilon(epsilon), _prepare(df, values)
    try:
        dense = np.asarray(weights, float)
    except ValueError:
        dense = None
    if dense is not None and dense.ndim == 3:
        if any(n % 2 == 0 for n in dense.shape):
            raise ValueError("a kernel has to have an odd number of weights along each axis")
        taps = [(tuple(int(i) - n // 2 for i, n in zip(at, dense.shape, strict=True)), dense[tuple(at)]) for at in np.argwhere(dense != 0)]
        return _taps(df, values, [t[0] for t in taps], [t[1] for t in taps], epsilon) if taps else df.limit(0)
    kernels = [np.asarray(k, float) for k in weights] if len(weights) == 3 and not np.isscalar(weights[0]) else [np.asarray(weights, float)] * 3
    if any(k.ndim != 1 or len(k) % 2 == 0 for k in kernels):
        raise ValueError("weights have to be three odd 1-D kernels or one odd 3-D kernel")
    for axis, k in enumerate(kernels):
        if len(k) == 1 and k[0] == 1:
            continue
        at = [j for j in range(len(k)) if k[j] != 0]
        df = _taps(df, values, [_along(axis, j - len(k) // 2) for j in at], [k[j] for j in at], epsilon) if at else df.limit(0)
    return df


def smooth(df: DataFrame, values: list[str], sigma=1.0, truncate: float = 4.0, radius=None, epsilon: float = 0.0) -> DataFrame:
    """Gaussian smoothing; the window reaches int(truncate * sigma + 0.5) cells, or `radius`."""
    s = (float(sigma),) * 3 if isinstance(sigma, (int, float)) else tuple(float(v) for v in sigma)
    if len(s) != 3 or any(not v >= 0 or math.isinf(v) for v in s):
        raise ValueError(f"sigma has to be one or three numbers of 0 or more, not {sigma}")
    r = as_integers(radius, "radius", 0) if radius is not None else tuple(int(truncate * v + 0.5) for v in s)
    kernels = [gaussian_kernel1d(v, k if v > 0 else 0) for v, k in zip(s, r, strict=True)]
    return correlate(df, kernels, values, epsilon)


def _rank(df: DataFrame, values: list[str], size, extreme, fold) -> DataFrame:
    n, df = as_integers(size, "size", odd=True), _prepare(df, values)
    for axis, k in enumerate(n):
        if k == 1:
            continue
        sent = scatter(df, [_along(axis, j - k // 2) for j in range(k)])
        got = sent.groupBy(*keys(df)).agg(F.count("*").alias("n"), *(extreme(v).alias(v) for v in values))
        got = got.select(*keys(df), *(F.when(F.col("n") < k, fold(F.col(v), F.lit(0.0))).otherwise(F.col(v)).alias(v) for v in values))
        df = _nonzero(got, values, 0.0)
    return df


def maximum(df: DataFrame, values: list[str], size=3) -> DataFrame:
    """The largest value in a box around each cell, absent cells counting as 0."""
    return _rank(df, values, size, F.max, F.greatest)


def minimum(df: DataFrame, values: list[str], size=3) -> DataFrame:
    return _rank(df, values, size, F.min, F.least)


__all__ = ["AXES", "correlate", "gaussian_kernel1d", "maximum", "minimum", "smooth"]
