"""Set algebra and lookups on voxel frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.frame import keys, validate, voxels


def union(*sets: DataFrame) -> DataFrame:
    if not sets:
        raise TypeError("union needs a set at least")
    return reduce(DataFrame.unionByName, [validate(s).select(*keys(s)) for s in sets]).distinct()


def _tagged(*sets: DataFrame) -> DataFrame:
    """The voxels of all sets with the bits of the sets that have them: one shuffle for any number of sets."""
    rows = [validate(s).select(*keys(s), F.lit(1 << k).cast("long").alias("tag")) for k, s in enumerate(sets)]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy(*keys(every)).agg(F.bit_or("tag").alias("tags"))


def intersection(*sets: DataFrame) -> DataFrame:
    if not sets:
        raise TypeError("intersection needs a set at least")
    if len(sets) > 62:
        raise ValueError("at most 62 sets")
    return _tagged(*sets).where(F.col("tags") == (1 << len(sets)) - 1).drop("tags")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _tagged(a, b).where("tags = 1").drop("tags")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _tagged(a, b).where("tags <> 3").drop("tags")


def majority(*sets: DataFrame, least: int = 2) -> DataFrame:
    """Voxels that at least `least` of the sets have."""
    return _tagged(*sets).where(F.bit_count("tags") >= least).drop("tags")


def unique_rows(df: DataFrame, first: bool = False) -> DataFrame:
    """Distinct voxels; with first, row_id is that of the first appearance."""
    df = validate(df)
    return df.groupBy(*keys(df)).agg(F.min("row_id").alias("row_id")) if first else df.select(*keys(df)).distinct()


def isin(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with is_in: whether other has the row's voxel. Rows and duplicates of df stay as they are."""
    df = validate(df)
    return df.join(voxels(other).withColumn("__hit", F.lit(True)), keys(df), "left").withColumn("is_in", F.coalesce("__hit", F.lit(False))).drop("__hit")


def index_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with index: the least row_id of other with the row's voxel, or -1."""
    df, other = validate(df), validate(other)
    found = other.groupBy(*keys(df)).agg(F.min("row_id").alias("index"))
    return df.join(found, keys(df), "left").withColumn("index", F.coalesce("index", F.lit(-1).cast("long")))
