"""The voxel frame: a DataFrame with integer columns x, y, z, optionally object_id, row_id and value columns.

Every operator takes and returns such frames and is lazy unless its docstring says otherwise. Coordinates are bigint
throughout. With an object_id column each object is worked on by itself. Rows with a null coordinate are no voxels
and are left out; duplicates count once unless stated.
"""

from __future__ import annotations

import itertools
from numbers import Integral

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z")
_INTEGER = (T.ShortType, T.IntegerType, T.LongType)


def keys(df: DataFrame) -> list[str]:
    """The columns that identify a voxel."""
    return (["object_id"] if "object_id" in df.columns else []) + list(AXES)


def validate(df: DataFrame) -> DataFrame:
    """df with bigint coordinates and without null ones; TypeError if they are missing or no integers of 2 to 8 bytes."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for a in AXES:
        if not isinstance(kinds.get(a), _INTEGER):
            raise TypeError(f"column {a} has to be smallint, int or bigint, it is {kinds.get(a)}")
    known = df.where(" AND ".join(f"{a} IS NOT NULL" for a in AXES))
    return known.withColumns({a: F.col(a).cast("long") for a in AXES})


def voxels(df: DataFrame) -> DataFrame:
    """The distinct voxels alone."""
    df = validate(df)
    return df.select(*keys(df)).distinct()


def from_points(spark: SparkSession, points) -> DataFrame:
    """A frame of (x, y, z) tuples or an (N, 3) integer array."""
    return spark.createDataFrame([tuple(int(c) for c in p) for p in points], "x long, y long, z long")


def as_spacing(spacing) -> tuple[float, float, float]:
    s = (1.0,) * 3 if spacing is None else (spacing,) * 3 if isinstance(spacing, (int, float)) else tuple(spacing)
    if len(s) != 3 or any(not v > 0 for v in s):
        raise ValueError(f"spacing has to be one or three positive numbers, not {spacing}")
    return tuple(float(v) for v in s)


def as_integers(value, name: str, least: int = 1, odd: bool = False) -> tuple[int, int, int]:
    s = (value,) * 3 if isinstance(value, Integral) else value
    if isinstance(s, (str, float)) or len(s) != 3 or any(not isinstance(v, Integral) or isinstance(v, bool) for v in s):
        raise ValueError(f"{name} has to be one or three integers, not {value}")
    if any(v < least or odd and v % 2 == 0 for v in s):
        raise ValueError(f"{name} has to be {'odd and ' if odd else ''}at least {least}, not {value}")
    return tuple(int(v) for v in s)


def neighbor_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Steps to the 6, 18 or 26 neighbours, in lexicographic order."""
    if connectivity not in (6, 18, 26):
        raise ValueError(f"connectivity has to be 6, 18 or 26, not {connectivity}")
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d for d in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= reach]


def floor_div(column: str, k: int) -> Column:
    """Division that rounds down, also for negative numbers."""
    return F.expr(f"({column} - pmod({column}, {k}L)) div {k}L")


def _bits(bits) -> tuple[int, int, int]:
    b = as_integers(bits, "bits")
    if sum(b) > 63:
        raise ValueError(f"bits have to be 63 in sum at most, not {bits}")
    return b


def pack(df: DataFrame, bits=21) -> DataFrame:
    """df with packed: x, y and z as one bigint, in bits (one number or three) from the highest; of the coordinates' order if none is negative.

    A coordinate outside 0 to 2^bits - 1 of its axis packs to null.
    """
    b = _bits(bits)
    df = validate(df)
    fits = [F.col(a).between(0, (1 << n) - 1) for a, n in zip(AXES, b, strict=True)]
    key = F.shiftleft(F.col("x"), b[1] + b[2]).bitwiseOR(F.shiftleft(F.col("y"), b[2])).bitwiseOR(F.col("z"))
    return df.withColumn("packed", F.when(fits[0] & fits[1] & fits[2], key))


def unpack(df: DataFrame, bits=21) -> DataFrame:
    """df with x, y and z from packed, as pack makes it."""
    b = _bits(bits)
    part = lambda shift, n: F.shiftrightunsigned(F.col("packed"), shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return df.withColumns({"x": part(b[1] + b[2], b[0]), "y": part(b[2], b[1]), "z": part(0, b[2])})
