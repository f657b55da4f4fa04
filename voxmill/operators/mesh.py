"""Surface meshes of voxel sets: vertices (vid, x, y, z) and faces (fid, a, b, c), with object_id if the voxels have it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.ids import dense_id
from voxmill.operators.frame import AXES, as_spacing, keys, voxels
from voxmill.operators.pool import coarse
from voxmill.operators.stencil import exposed_faces
from voxmill.sources.scratch import materialise

#: The two axes of a face, right-handed with its own.
OTHERS = {0: (1, 2), 1: (2, 0), 2: (0, 1)}


def _cycle(axis: int, side: int) -> list[tuple[int, int]]:
    """Corners of a unit face as steps along its two axes, counter-clockwise seen from outside."""
    ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    return ring if side > 0 else ring[::-1]


def _by_case(make):
    """A column chosen by axis and side."""
    out = None
    for axis in range(3):
        for side in (-1, 1):
            hit = (F.col("axis") == axis) & (F.col("side") == side)
            out = F.when(hit, make(axis, side)) if out is None else out.when(hit, make(axis, side))
    return out


def _corner_mesh(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of quads with column ring: four structs of coordinates, counter-clockwise."""
    quads = materialise(quads.withColumn("quad", F.monotonically_increasing_id()), "quads")
    by = [c for c in quads.columns if c == "object_id"]
    corners = quads.select(*by, "quad", F.posexplode("ring").alias("n", "v"))
    vertices = dense_id(corners.select(*by, "v").distinct(), [*by, "v"], "vid")
    ids = corners.join(vertices, [*by, "v"]).groupBy(*by, "quad").agg(F.array_sort(F.collect_list(F.struct("n", "vid"))).alias("r"))  # four rows each
    at = lambda k: F.col("r")[k]["vid"]
    tri = ids.select(*by, F.inline(F.array(*[F.struct((2 * F.col("quad") + h).alias("t"), at(0).alias("a"), at(i).alias("b"), at(j).alias("c")) for h, (i, j) in enumerate(((1, 2), (2, 3)))])))
    faces = dense_id(tri, ["t"], "fid").select(*by, "fid", "a", "b", "c")
    return vertices.select(*by, "vid", "v.x", "v.y", "v.z"), faces


def culled_quads(df: DataFrame) -> DataFrame:
    """One quad for each exposed face; corners of voxel i are at i and i + 1."""
    faces = exposed_faces(df)

    def ring(axis, side):
        def corner(s, t):
            step = [0, 0, 0]
            step[axis] = 1 if side > 0 else 0
            for a, v in zip(OTHERS[axis], (s, t), strict=True):
                step[a] = v
            return F.struct(*((F.col(c) + d).alias(c) for c, d in zip(AXES, step, strict=True)))

        return F.array(*[corner(*st) for st in _cycle(axis, side)])

    by = [c for c in keys(faces) if c not in AXES]
    return faces.select(*by, "axis", "side", _by_case(ring).alias("ring"))


def greedy_rectangles(df: DataFrame) -> DataFrame:
    """Exposed faces merged: strips along the first axis, then equal strips along the second (gaps and islands twice).

    Columns: axis, side, plane (place along the axis), u0, u1, v0, v1 (inclusive).
    """
    faces = exposed_faces(df)
    by = [c for c in keys(faces) if c not in AXES] + ["axis", "side", "plane"]
    pick = lambda order: _by_case(lambda axis, side: F.col(AXES[order(axis)]))
    flat = faces.select(*by[:-1], pick(lambda a: a).alias("plane"), pick(lambda a: OTHERS[a][0]).alias("u"), pick(lambda a: OTHERS[a][1]).alias("v"))
    strip = flat.withColumn("island", F.col("u") - F.row_number().over(Window.partitionBy(*by, "v").orderBy("u")))
    strips = strip.groupBy(*by, "v", "island").agg(F.min("u").alias("u0"), F.max("u").alias("u1")).drop("island")
    stack = strips.withColumn("island", F.col("v") - F.row_number().over(Window.partitionBy(*by, "u0", "u1").orderBy("v")))
    return stack.groupBy(*by, "u0", "u1", "island").agg(F.min("v").alias("v0"), F.max("v").alias("v1")).drop("island")


def greedy_quads(df: DataFrame) -> DataFrame:
    rects = greedy_rectangles(df)

    def ring(axis, side):
        a1, a2 = OTHERS[axis]

        def corner(s, t):
            at = {axis: F.col("plane") + (1 if side > 0 else 0), a1: F.col("u1") + 1 if s else F.col("u0"), a2: F.col("v1") + 1 if t else F.col("v0")}
            return F.struct(*(at[k].alias(AXES[k]) for k in range(3)))

        return F.array(*[corner(*st) for st in _cycle(axis, side)])

    by = [c for c in rects.columns if c == "object_id"]
    return rects.select(*by, "axis", "side", _by_case(ring).alias("ring"))


def culled_faces(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _corner_mesh(culled_quads(df))


def greedy_faces(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _corner_mesh(greedy_quads(df))


def surface_net_quads(df: DataFrame) -> DataFrame:
    """For each exposed face its doubled midpoint and, as ring, the four dual cells around it."""
    faces = exposed_faces(df)

    def ring(axis, side):
        def cell(s, t):
            # the dual cell at c has the voxels c to c + 1 for corners; around the edge between voxel and neighbour there are four
            step = [0, 0, 0]
            step[axis] = 0 if side > 0 else -1
            for a, v in zip(OTHERS[axis], (s - 1, t - 1), strict=True):
                step[a] = v
            return F.struct(*((F.col(c) + d).alias(c) for c, d in zip(AXES, step, strict=True)))

        return F.array(*[cell(*st) for st in _cycle(axis, side)])

    mid = F.array(*[2 * F.col(c) + F.when(F.col("axis") == k, F.col("side")).otherwise(0) for k, c in enumerate(AXES)])
    by = [c for c in keys(faces) if c not in AXES]
    return faces.select(*by, "axis", "side", mid.alias("mid"), _by_case(ring).alias("ring"))


def _net_vertices(quads: DataFrame) -> DataFrame:
    by = [c for c in quads.columns if c == "object_id"]
    cells = quads.select(*by, F.explode("ring").alias("v"), "mid")
    return cells.groupBy(*by, "v").agg(*((F.sum(F.col("mid")[k]) / (2 * F.count("*"))).alias(c) for k, c in enumerate(AXES)))


def surface_net_vertices(df: DataFrame) -> DataFrame:
    """One vertex for each dual cell: the mean of the midpoints of the crossings around it."""
    return _net_vertices(surface_net_quads(df))


def surface_nets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    quads = materialise(surface_net_quads(df), "net")  # the exposed faces are found once for vertices and faces
    cells, faces = _corner_mesh(quads.drop("mid"))
    by = [c for c in cells.columns if c == "object_id"]
    placed = _net_vertices(quads).select(*by, *(F.col(f"v.{c}").alias("c" + c) for c in AXES), *AXES)
    ids = cells.select(*by, "vid", *(F.col(c).alias("c" + c) for c in AXES))
    return ids.join(placed, [*by, "cx", "cy", "cz"]).select(*by, "vid", *AXES), faces


def mesh(df: DataFrame, spacing=None, step_size: int = 1, smooth: bool = True, simplify: bool = False) -> tuple[DataFrame, DataFrame]:
    """Smooth (surface nets) or blocky (one quad a face, or merged ones with simplify), scaled by spacing."""
    if step_size < 1:
        raise ValueError(f"step_size has to be 1 or more, not {step_size}")
    if smooth and simplify:
        warnings.warn("simplify is for blocky meshes; it is ignored with smooth", stacklevel=2)
    own = voxels(df)
    s = as_spacing(spacing)
    if step_size > 1:
        own, s = coarse(own, step_size).distinct(), tuple(v * step_size for v in s)
    vertices, faces = surface_nets(own) if smooth else greedy_faces(own) if simplify else culled_faces(own)
    if spacing is not None or step_size > 1:
        vertices = vertices.withColumns({a: F.col(a) * F.lit(v) for a, v in zip(AXES, s, strict=True)})
    return vertices, faces


def dual_contour(df: DataFrame, interpolate: bool = True, **options):
    warnings.warn("dual_contour is now mesh", DeprecationWarning, stacklevel=2)
    return mesh(df, smooth=interpolate, **options)


def marching_cubes(df: DataFrame, interpolate: bool = True, **options):
    warnings.warn("marching_cubes is now mesh", DeprecationWarning, stacklevel=2)
    return mesh(df, smooth=interpolate, **options)
