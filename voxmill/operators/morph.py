"""Binary morphology and repair of contacts that make a surface non-manifold."""

from __future__ import annotations

import itertools
import warnings
from numbers import Integral

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.frame import AXES, keys, neighbor_offsets, voxels
from voxmill.operators.stencil import OFF26, neighbor_mask, scatter
from voxmill.sources.scratch import materialise


def _count(iterations) -> int:
    if not isinstance(iterations, Integral) or iterations < 0:
        raise ValueError(f"iterations has to be an integer of 0 or more, not {iterations}")
    return int(iterations)


def dilate(df: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """The voxels and their neighbours, `iterations` times."""
    offsets, out = neighbor_offsets(connectivity), voxels(df)
    for _ in range(_count(iterations)):
        out = scatter(out, [*offsets, (0, 0, 0)]).select(*keys(out)).distinct()
    return out


def erode(df: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """The voxels all of whose neighbours are voxels, `iterations` times; what lies outside counts as background."""
    offsets, out = neighbor_offsets(connectivity), voxels(df)
    for _ in range(_count(iterations)):
        sent = scatter(out, [*offsets, (0, 0, 0)])
        out = sent.groupBy(*keys(out)).agg(F.count("*").alias("n")).where(F.col("n") == len(offsets) + 1).drop("n")
    return out


def opening(df: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    return dilate(erode(df, iterations, connectivity), iterations, connectivity)


def closing(df: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    return erode(dilate(df, iterations, connectivity), iterations, connectivity)


def _contacts() -> list[tuple[tuple, tuple, list[tuple]]]:
    """(far cell, its first step, the cells between) of the edge and corner directions with their first step up."""
    out = []
    for far in itertools.product((-1, 0, 1), repeat=3):
        steps = [tuple(c if b == a else 0 for b in range(3)) for a, c in enumerate(far) if c]
        if len(steps) < 2 or sum(steps[0]) < 0:
            continue
        between = [tuple(map(sum, zip(*own, strict=True))) for n in range(1, len(steps)) for own in itertools.combinations(steps, n)]
        out.append((far, steps[0], between))
    return out


CONTACTS = _contacts()


def contact_fixes(df: DataFrame) -> DataFrame:
    """Cells to add: the first step of each direction whose far cell is a voxel and whose cells between are all empty."""
    masks = neighbor_mask(df)
    bit = {o: 1 << k for k, o in enumerate(OFF26)}
    fixes = []
    for far, first, between in CONTACTS:
        care = bit[far] | sum(bit[b] for b in between)
        fixes.append(F.when(F.col("mask").bitwiseAND(F.lit(care)) == bit[far], F.struct(*(F.lit(c).cast("long").alias("d" + a) for a, c in zip(AXES, first, strict=True)))))
    found = masks.select(*keys(masks), F.explode(F.array_compact(F.array(*fixes))).alias("d"))
    rest = [c for c in keys(masks) if c not in AXES]
    return found.select(*rest, *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in AXES)).distinct()


def make_manifold(df: DataFrame, max_iter: int | None = 8) -> DataFrame:
    """Voxels are added until no two touch along an edge or at a corner alone. Runs a job for each round; warns if max_iter rounds don't do.

    With max_iter None as many rounds as it takes; they end, as no voxel is added outside the bounding box.
    """
    max_iter = None if max_iter is None else int(max_iter)
    if max_iter is not None and max_iter < 0:
        raise ValueError(f"max_iter has to be 0 or more, not {max_iter}")
    now = voxels(df)
    for _ in itertools.count() if max_iter is None else range(max_iter):
        now = materialise(now, "manifold")
        fixes = materialise(contact_fixes(now), "fixes")
        if fixes.isEmpty():
            return now
        now = now.unionByName(fixes).distinct()
    if max_iter and not contact_fixes(now).isEmpty():
        warnings.warn(f"contacts are left after {max_iter} rounds", stacklevel=2)
    return now
