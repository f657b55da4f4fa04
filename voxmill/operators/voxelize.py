"""Meshes to voxels: an exact surface test, and a fill of each column between its crossings.

Voxel i covers [(i - 0.5) s, (i + 0.5) s) along an axis of spacing s. In cell units, with 0.5 added, cell i is [i, i + 1).
Candidate cells of a triangle's bounds are generated by explode and decided by column expressions on doubles.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.frame import AXES, as_spacing
from voxmill.operators.sets import majority
from voxmill.sources.scratch import materialise

CORNERS = ("a", "b", "c")


def triangles(vertices: DataFrame, faces: DataFrame, spacing=None) -> DataFrame:
    """One row for each face: fid and a_x to c_z in cell units. ValueError for a face with an unknown vertex, so this runs a job."""
    v = vertices.select("vid", *((F.col(x).cast("double") / s + 0.5).alias(x) for x, s in zip(AXES, as_spacing(spacing), strict=True)))
    out = faces.select("fid", *CORNERS)
    for c in CORNERS:
        out = out.join(v.select(F.col("vid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in AXES)), c, "left")
    out = materialise(out, "triangles")
    if not out.where(F.col("a_x").isNull() | F.col("b_x").isNull() | F.col("c_x").isNull()).isEmpty():
        raise ValueError("a face refers to a vertex that is not there")
    return out.select("fid", *(f"{c}_{x}" for c in CORNERS for x in AXES))


def _normal() -> list[Column]:
    e = {x: F.col(f"b_{x}") - F.col(f"a_{x}") for x in AXES}
    f = {x: F.col(f"c_{x}") - F.col(f"b_{x}") for x in AXES}
    cross = lambda p, q: e[p] * f[q] - e[q] * f[p]
    return [cross("y", "z"), cross("z", "x"), cross("x", "y")]


def _dot(n: dict[str, Column], corner: str) -> Column:
    return sum(n[x] * F.col(f"{corner}_{x}") for x in n)


def surface_cells(tris: DataFrame) -> DataFrame:
    """Cells that a triangle touches, by separating axes: none of the triangle's normal, the three axes and the nine cross products
    of an axis with an edge parts the triangle from the cell. Triangles without area are left out.

    Columns (x, y) of the bounds are generated, and of each only the cells between the least and greatest height that the
    triangle's plane takes over the column; so a slanted triangle costs its bounds' area, not their volume.
    """
    t = tris.withColumns({f"n_{x}": n for x, n in zip(AXES, _normal(), strict=True)}).where("n_x <> 0 OR n_y <> 0 OR n_z <> 0")
    bound = lambda f, x: f(*[f"{c}_{x}" for c in CORNERS])
    for x in ("x", "y"):
        t = t.withColumn(f"p{x}", F.explode(F.sequence(F.floor(bound(F.least, x)), F.floor(bound(F.greatest, x)))))
    flat = {x: -F.col(f"n_{x}") / F.col("n_z") for x in ("x", "y")}
    middle = F.col("a_z") + sum(flat[x] * (F.col(f"p{x}") + 0.5 - F.col(f"a_{x}")) for x in flat)
    # a cell's height more than half the plane's rise over a column, so that rounding loses nothing
    half = sum(F.abs(flat[x]) for x in flat) / 2 + 1
    steep = F.col("n_z") == 0
    low = F.when(steep, bound(F.least, "z")).otherwise(F.greatest(bound(F.least, "z"), middle - half))
    high = F.when(steep, bound(F.greatest, "z")).otherwise(F.least(bound(F.greatest, "z"), middle + half))
    t = t.withColumns({"zl": F.floor(low), "zh": F.floor(high)}).where("zl <= zh").withColumn("pz", F.explode(F.sequence("zl", "zh")))

    def apart(n: dict[str, Column]) -> Column:
        """Whether the axis n parts the cell from the triangle."""
        ends = [_dot(n, c) for c in CORNERS]
        corner = sum(n[x] * F.col(f"p{x}") for x in n)
        low, high = (sum(F.when(n[x] * side > 0, n[x]).otherwise(0.0) for x in n) for side in (-1, 1))
        return (F.greatest(*ends) < corner + low) | (F.least(*ends) > corner + high)

    tests = [apart({x: F.col(f"n_{x}") for x in AXES})]
    for c, d in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True):
        edge = {x: F.col(f"{d}_{x}") - F.col(f"{c}_{x}") for x in AXES}
        for k in range(3):
            p, q = AXES[(k + 1) % 3], AXES[(k + 2) % 3]
            tests.append(apart({p: -edge[q], q: edge[p]}))
    touching = t.where(~reduce(Column.__or__, tests))
    return touching.select(*(F.col(f"p{x}").alias(x) for x in AXES)).distinct()


def crossings(tris: DataFrame, axes: tuple[str, str, str] = AXES) -> DataFrame:
    """u, v (column), z and sign of each crossing of a column's centre line with a triangle; axes name the two columns' axes and the line's.

    A centre on an edge belongs to one triangle: the sign of the edge function as the centre moves by (eps, eps^2). Edges
    are taken from their lexicographically lower end in both triangles, so that the two values are exactly opposite.
    """
    u, v, w = axes
    t = tris.select("fid", *(F.col(f"{c}_{x}").alias(f"{c}_{n}") for c in CORNERS for x, n in ((u, "x"), (v, "y"), (w, "z"))))
    t = t.withColumns({f"n_{x}": n for x, n in zip(AXES, _normal(), strict=True)}).where("n_z <> 0")
    down = F.col("n_z") < 0
    second, third = ({x: F.when(down, F.col(f"{p}_{x}")).otherwise(F.col(f"{q}_{x}")) for x in ("x", "y")} for p, q in (("c", "b"), ("b", "c")))
    first = {x: F.col(f"a_{x}") for x in ("x", "y")}
    t = t.select("*", *(e[x].alias(f"w{k}_{x}") for k, e in enumerate((first, second, third)) for x in ("x", "y")))
    for x in ("x", "y"):
        lo, hi = F.ceil(F.least(*[f"w{k}_{x}" for k in range(3)]) - 0.5), F.floor(F.greatest(*[f"w{k}_{x}" for k in range(3)]) - 0.5)
        t = t.where(lo <= hi).withColumn("q" + x, F.explode(F.sequence(lo, hi)))
    t = t.withColumns({"qx": F.col("qx").cast("double") + 0.5, "qy": F.col("qy").cast("double") + 0.5})
    # Twice the signed area that an edge spans with the centre, taken from the edge's lower end (by x, then y) so that the two
    # triangles of an edge get exactly opposite values. An area of zero goes to one side as if the centre were moved by (eps, eps^2).
    sides = []
    for p, q in ((0, 1), (1, 2), (2, 0)):
        ends = [F.struct(F.col(f"w{k}_x").alias("x"), F.col(f"w{k}_y").alias("y")) for k in (p, q)]
        low, high = F.least(*ends), F.greatest(*ends)
        dx, dy = high["x"] - low["x"], high["y"] - low["y"]
        area = dx * (F.col("qy") - low["y"]) - dy * (F.col("qx") - low["x"])
        moved = F.when(area != 0, F.signum(area)).when(dy != 0, -F.signum(dy)).otherwise(F.signum(dx))
        sides.append(F.when(ends[0] == low, moved).otherwise(-moved))
    inside = [side > 0 for side in sides]
    inv = 1.0 / F.col("n_z")
    flat = sum(F.col(f"n_{x}") * F.col(f"a_{x}") for x in AXES) * inv
    z = flat + (-F.col("n_x") * inv) * F.col("qx") + (-F.col("n_y") * inv) * F.col("qy")
    hit = t.where(reduce(Column.__and__, inside))
    return hit.select(F.floor("qx").alias("u"), F.floor("qy").alias("v"), z.alias("z"), F.when(down, -1).otherwise(1).alias("sign"))


def _spans(cross: DataFrame) -> DataFrame:
    """Crossings with what the two rules make of the span up to the next one of their column."""
    line = Window.partitionBy("u", "v").orderBy("z", "sign")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = cross.select("*", F.lead("z").over(line).alias("z1"), F.row_number().over(line).alias("k"), F.sum("sign").over(so_far).alias("turns"))
    return s.withColumns({"parity": F.col("z1").isNotNull() & (F.col("k") % 2 == 1), "winding": F.col("z1").isNotNull() & (F.col("turns") != 0)})


def fill(tris: DataFrame, rule: str = "parity", axes: tuple[str, str, str] = AXES) -> DataFrame:
    """Cells whose centres lie between paired crossings (parity), or where the crossings so far don't cancel (winding)."""
    spans = _spans(crossings(tris, axes)).where(rule)
    lo, hi = F.ceil(F.col("z") - 0.5), F.floor(F.col("z1") - 0.5)
    cells = spans.where(lo <= hi).select("u", "v", F.explode(F.sequence(lo, hi)).alias("w"))
    names = dict(zip(axes, ("u", "v", "w"), strict=True))
    return cells.select(*(F.col(names[a]).alias(a) for a in AXES)).distinct()


def diagnose(tris: DataFrame) -> DataFrame:
    """One row: columns, columns whose crossings don't cancel (open), odd ones, and spans on which the rules disagree."""
    s = _spans(crossings(tris))
    columns = s.groupBy("u", "v").agg((F.sum("sign") != 0).alias("open"), (F.count("*") % 2 == 1).alias("odd"), F.max(F.col("parity") != F.col("winding")).alias("ambiguous"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return columns.agg(F.count("*").alias("columns"), n("open"), n("odd"), n("ambiguous"))


def voxelize(vertices: DataFrame, faces: DataFrame, spacing=1.0, solid: bool = True, rule: str = "parity", axes: int = 1) -> DataFrame:
    """The voxels of a mesh: its surface, and with solid its inside, by one sweep or by the vote of three. Warns about open or ambiguous columns."""
    if rule not in ("parity", "winding"):
        raise ValueError(f"rule has to be parity or winding, not {rule}")
    if axes not in (1, 3):
        raise ValueError(f"axes has to be 1 or 3, not {axes}")
    tris = triangles(vertices, faces, spacing)
    out = surface_cells(tris)
    if not solid:
        return out
    sweeps = [AXES, ("y", "z", "x"), ("z", "x", "y")][:axes]
    inner = [fill(tris, rule, a) for a in sweeps]
    d = diagnose(tris).first()
    if d["open"] or d["odd"]:
        warnings.warn(f"{max(d['open'], d['odd'])} of {d['columns']} columns are open: volume may be missing", stacklevel=2)
    if d["ambiguous"]:
        warnings.warn(f"parity and winding disagree on {d['ambiguous']} columns", stacklevel=2)
    return out.union(inner[0] if axes == 1 else majority(*inner)).distinct()
