"""Measurements: one-row frames, or one row for each object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.frame import AXES, as_spacing, keys, validate, voxels
from voxmill.operators.sets import _tagged
from voxmill.operators.stencil import exposed_faces


def _by(df: DataFrame) -> list[str]:
    return ["object_id"] if "object_id" in df.columns else []


def volume(df: DataFrame, spacing=None) -> DataFrame:
    """volume: the number of distinct voxels times that of one; 0 for none."""
    sx, sy, sz = as_spacing(spacing)
    return voxels(df).groupBy(*_by(df)).agg((F.count("*") * F.lit(sx * sy * sz)).alias("volume"))


def surface_area(df: DataFrame, spacing=None) -> DataFrame:
    """surface_area: exposed faces, each with the area of its axis."""
    sx, sy, sz = as_spacing(spacing)
    area = F.element_at(F.array(F.lit(sy * sz), F.lit(sx * sz), F.lit(sx * sy)), F.col("axis") + 1)
    return exposed_faces(df).groupBy(*_by(df)).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("surface_area"))


def bounding_box(df: DataFrame) -> DataFrame:
    """Inclusive bounds. ValueError for an empty frame, so this runs a job."""
    df = validate(df)
    if df.isEmpty():
        raise ValueError("an empty set has no bounding box")
    return df.groupBy(*_by(df)).agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES))


def centroid(df: DataFrame, spacing=None) -> DataFrame:
    """Mean of the distinct voxels. ValueError for an empty frame, so this runs a job."""
    df = validate(df)
    if df.isEmpty():
        raise ValueError("an empty set has no centroid")
    return voxels(df).groupBy(*_by(df)).agg(*((F.avg(a) * s).alias(f"c{a}") for a, s in zip(AXES, as_spacing(spacing), strict=True)))


def _overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    every = _tagged(a, b)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return every.groupBy(*_by(a)).agg(n(F.col("tags") == 3).alias("both"), n(F.col("tags") == 1).alias("only_a"), n(F.col("tags") == 2).alias("only_b"))


def iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of the distinct voxels; 1 for two empty sets."""
    total = F.col("both") + F.col("only_a") + F.col("only_b")
    return _overlap(a, b).select(*_by(a), F.when(total == 0, 1.0).otherwise(F.col("both") / F.nullif(total, F.lit(0))).alias("iou"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    total = 2 * F.col("both") + F.col("only_a") + F.col("only_b")
    return _overlap(a, b).select(*_by(a), F.when(total == 0, 1.0).otherwise(2 * F.col("both") / F.nullif(total, F.lit(0))).alias("dice"))
