"""Pooling to a coarser lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.frame import AXES, as_integers, floor_div, keys, validate

AGGREGATES = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def coarse(df: DataFrame, factor) -> DataFrame:
    """df with each coordinate divided by the factor, rounded down."""
    return df.withColumns({a: floor_div(a, k) for a, k in zip(AXES, as_integers(factor, "factor"), strict=True)})


def downsample(df: DataFrame, factor, values: list[str] | None = None, agg: str = "max") -> DataFrame:
    """Distinct coarse cells; with value columns, each aggregated over all rows of its cell (integers and booleans sum and average as bigint)."""
    df = coarse(validate(df), factor)
    if not values:
        return df.select(*keys(df)).distinct()
    if agg not in AGGREGATES:
        raise ValueError(f"agg has to be one of {', '.join(AGGREGATES)}, not {agg}")
    wide = agg in ("sum", "mean")
    col = lambda v: F.col(v).cast("long") if wide and isinstance(df.schema[v].dataType, (T.IntegralType, T.BooleanType)) else F.col(v)
    return df.groupBy(*keys(df)).agg(*(AGGREGATES[agg](col(v)).alias(v) for v in values))
