"""Exact Euclidean distance to the background, axis by axis along runs of the object.

Along an axis, a cell's squared distance is the least of g(q) + (s * (p - q))^2 over its run and of the two background cells at
the run's ends. A farther cell never helps, since the end of the run is background and nearer. So each pass needs
only whole lines: rows are dealt by line, sorted along it, and streamed through NumPy run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.kernels.lattice import run_pass
from voxmill.operators.frame import AXES, as_spacing, keys, validate, voxels


def _pass(df: DataFrame, axis: str, step: float) -> DataFrame:
    names = df.columns
    line = [k for k in keys(df) if k != axis]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cols = {c: np.asarray(table.column(c)) for c in (*line, axis)}
            new = np.ones(table.num_rows, bool)
            if table.num_rows > 1:
                new[1:] = np.diff(cols[axis]) != 1
                for c in line:
                    new[1:] |= np.diff(cols[c]) != 0
            cuts = np.flatnonzero(new)
            done = int(cuts[-1]) if len(cuts) else 0  # the last run may go on
            held = table.slice(done)
            if done:
                yield from solved(table.slice(0, done), cuts[:-1], cols[axis][:done])
        if held is not None and held.num_rows:
            yield from solved(held, np.array([0]), np.asarray(held.column(axis)))

    def solved(table, cuts, u):
        g = np.asarray(table.column("g"))
        out = np.empty(len(g))
        for a, b in zip(cuts, [*cuts[1:], len(g)], strict=True):
            out[a:b] = run_pass(g[a:b], step)
        table = table.set_column(names.index("g"), "g", pa.array(out))
        yield from table.combine_chunks().to_batches()

    return df.repartition(*line).sortWithinPartitions(*line, axis).mapInArrow(run, df.schema)


def squared_distance(df: DataFrame, spacing=None) -> DataFrame:
    """Distinct voxels with g, the squared distance to the nearest background cell."""
    out = voxels(df).withColumn("g", F.lit(float("inf")))
    for axis, step in zip(AXES, as_spacing(spacing), strict=True):
        out = _pass(out, axis, step)
    return out


def distance_transform(df: DataFrame, spacing=None) -> DataFrame:
    """df with distance; rows and duplicates stay."""
    df = validate(df)
    return df.join(squared_distance(df, spacing).select(*keys(df), F.sqrt("g").alias("distance")), keys(df))
