"""Sparse arrays in and out: a table of stored cells with the shape of the array it stands for.

A SparseArray holds a DataFrame with one integer column for each dimension (x, y, z for three) and value, and its shape.
Operators take voxel frames; sparse_aware lets one take arrays as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.frame import AXES, keys, validate, voxels


@dataclass(frozen=True)
class SparseArray:
    """cells: coordinates and value, zeros allowed; shape: one extent for each dimension."""

    cells: DataFrame
    shape: tuple[int, ...]


def is_sparse(thing: object) -> bool:
    return isinstance(thing, SparseArray)


def to_voxels(array: SparseArray) -> DataFrame:
    """The cells whose value is neither zero nor null, as a voxel frame (bigint, duplicates stay). TypeError unless there are three dimensions."""
    if len(array.shape) != 3:
        raise TypeError(f"a sparse array of voxels has three dimensions, not {len(array.shape)}")
    stored = validate(array.cells).where("value <> 0")
    return stored.select(*keys(stored))


def to_sparse_like(df: DataFrame, template: SparseArray) -> SparseArray:
    """The distinct voxels with value 1 in the template's type. Its shape is a floor: larger voxels make the array larger.

    ValueError for a negative coordinate. Runs a job for the bounds.
    """
    own = voxels(df)
    kind = template.cells.schema["value"].dataType
    ends = own.agg(*(f(a).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES)).first()
    if any(ends["lo" + a] is not None and ends["lo" + a] < 0 for a in AXES):
        raise ValueError("a sparse array has no cells at negative coordinates")
    shape = tuple(max(s, (ends["hi" + a] if ends["hi" + a] is not None else -1) + 1) for s, a in zip(template.shape, AXES, strict=True))
    return SparseArray(own.withColumn("value", F.lit(True) if isinstance(kind, T.BooleanType) else F.lit(1).cast(kind)), shape)


def sparse_aware(mirror: bool = False) -> Callable:
    """Lets an operator take sparse arrays wherever it takes voxel frames.

    With mirror, a frame that it returns becomes an array like the first of them; a tuple or another result is returned as it is.
    """

    def wrap(operator: Callable) -> Callable:
        @wraps(operator)
        def call(*args, **more):
            template = next((a for a in (*args, *more.values()) if is_sparse(a)), None)
            if template is None:
                return operator(*args, **more)
            plain = lambda a: to_voxels(a) if is_sparse(a) else a
            out = operator(*map(plain, args), **{k: plain(a) for k, a in more.items()})
            whole = isinstance(out, DataFrame) and set(AXES) <= set(out.columns) and all(isinstance(out.schema[a].dataType, T.IntegralType) for a in AXES)
            return to_sparse_like(out, template) if mirror and whole else out

        return call

    return wrap
