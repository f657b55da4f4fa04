"""Stencils as one scatter and one aggregation: each voxel sends a row to every cell of its neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.frame import AXES, keys, neighbor_offsets, voxels

#: Offsets of the bits of a neighbourhood mask.
OFF26 = neighbor_offsets(26)
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def scatter(df: DataFrame, offsets: list[tuple[int, int, int]], weights: list[float] | None = None) -> DataFrame:
    """df's rows moved by each offset, with its index as k (and its weight as w)."""
    taps = [F.struct(*(F.lit(d).cast("long").alias("d" + a) for a, d in zip(AXES, o, strict=True)), F.lit(k).alias("k"), *([F.lit(float(weights[k])).alias("w")] if weights is not None else [])) for k, o in enumerate(offsets)]
    rest = [c for c in df.columns if c not in AXES]
    out = df.select(*df.columns, F.inline(F.array(*taps)))
    return out.select(*rest, *((F.col(a) + F.col("d" + a)).alias(a) for a in AXES), "k", *(["w"] if weights is not None else []))


def neighbor_mask(df: DataFrame) -> DataFrame:
    """Distinct voxels with mask: bit k is set if the voxel at OFF26[k] from it is one of them."""
    own = voxels(df)
    # a voxel that moves by -OFF26[k] arrives where it is the neighbour at OFF26[k]
    sent = scatter(own, [tuple(-c for c in o) for o in OFF26] + [(0, 0, 0)])
    bit = F.when(F.col("k") < 26, F.expr("shiftleft(1, k)")).otherwise(0)
    got = sent.groupBy(*keys(own)).agg(F.bit_or(bit).alias("mask"), F.max(F.col("k") == 26).alias("there"))
    return got.where("there").drop("there")


def exposed_faces(df: DataFrame) -> DataFrame:
    """One row for each face between a voxel and a cell that is none: the voxel, axis (0 to 2) and side (-1 or 1)."""
    own = voxels(df)
    sent = scatter(own, [tuple(-c for c in o) for o in FACES] + [(0, 0, 0)])
    bit = F.when(F.col("k") < 6, F.expr("shiftleft(1, k)")).otherwise(0)
    got = sent.groupBy(*keys(own)).agg(F.bit_or(bit).alias("near"), F.max(F.col("k") == 6).alias("there")).where("there")
    faces = got.select(*keys(own), "near", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("f")).where("(shiftright(near, f) & 1) = 0")
    return faces.select(*keys(own), F.expr("f div 2").cast("int").alias("axis"), F.expr("IF(f % 2 = 0, -1, 1)").alias("side"))


def surface_voxels(df: DataFrame) -> DataFrame:
    """Voxels with at least one exposed face."""
    faces = exposed_faces(df)
    return faces.select(*keys(faces)).distinct()


def boundary_shell(df: DataFrame) -> DataFrame:
    """Cells outside that share a face with a voxel."""
    own = voxels(df)
    sent = scatter(own, [*FACES, (0, 0, 0)])
    got = sent.groupBy(*keys(own)).agg(F.max(F.col("k") == 6).alias("there"))
    return got.where("NOT there").drop("there")
