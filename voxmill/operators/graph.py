"""Adjacency graphs and connected components."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.functions.ids import dense_id
from voxmill.kernels.lattice import roots
from voxmill.operators.frame import AXES, keys, neighbor_offsets, validate, voxels
from voxmill.operators.pool import coarse
from voxmill.operators.stencil import scatter
from voxmill.sources.scratch import materialise, release

#: Pairs that a task contracts at once; this bounds its memory and changes no result.
BLOCK = 4_000_000

#: A component with more than this part of all voxels is met by broadcast; this bounds what one task reads and changes no result.
SHARE = 1000


def _key(df: DataFrame, prefix: str = ""):
    return F.struct(*(F.col(prefix + c).alias(c) for c in keys(df)))


def adjacent(df: DataFrame, connectivity: int = 26) -> DataFrame:
    """Pairs a < b (structs of coordinates) of adjacent distinct voxels, each once: a self-join on the offsets that go up."""
    own = voxels(df)
    up = [o for o in neighbor_offsets(connectivity) if o > (0, 0, 0)]
    steps = F.array(*[F.struct(*(F.lit(d).cast("long").alias("d" + a) for a, d in zip(AXES, o, strict=True))) for o in up])
    sent = own.select(_key(own).alias("a"), F.inline(steps))
    moved = [F.col(f"a.{c}") + F.col("d" + c) if c in AXES else F.col(f"a.{c}") for c in keys(own)]
    sent = sent.select("a", F.struct(*(m.alias(c) for m, c in zip(moved, keys(own), strict=True))).alias("b"))
    return sent.join(own.select(_key(own).alias("b")), "b", "left_semi").select("a", "b")


def nodes(df: DataFrame) -> DataFrame:
    """Distinct voxels with node_id, their rank in the order of the coordinates."""
    own = voxels(df)
    return dense_id(own, keys(own), "node_id")


def edges(df: DataFrame, connectivity: int = 26) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, coordinates) and edges (src < dst).

    Each node sends its id to the neighbours that are higher up; one join on the coordinates (packed into a bigint where they fit) then finds
    the ids there.
    """
    n = materialise(nodes(df), "nodes")
    up = [o for o in neighbor_offsets(connectivity) if o > (0, 0, 0)]
    steps = F.array(*[F.struct(*(F.lit(d).cast("long").alias("d" + a) for a, d in zip(AXES, o, strict=True))) for o in up])
    sent = n.select(F.col("node_id").alias("src"), *keys(n), F.inline(steps))
    there = sent.select("src", *(F.col(c) + F.col("d" + c) if c in AXES else F.col(c) for c in keys(n)))
    there = there.toDF("src", *keys(n))
    packed = packer(n, margin=1)
    key = (lambda d: packed[0](_key(d))) if packed else _key
    found = there.select("src", key(there).alias("k")).join(n.select(key(n).alias("k"), F.col("node_id").alias("dst")), "k")
    return n, found.select("src", "dst")


def downsample_graph(df: DataFrame, factor) -> tuple[DataFrame, DataFrame]:
    """Nodes of the coarse cells and the fine 26-edges lifted to them, without loops, each once."""
    fine = voxels(df)
    cells = nodes(coarse(fine, factor))
    ids = cells.select(_key(cells).alias("k"), "node_id")
    found = adjacent(fine, 26)
    lift = lambda side: coarse(found.select("a", "b", *(F.col(f"{side}.{c}").alias(c) for c in keys(fine))), factor)
    a = lift("a").select("a", "b", _key(fine).alias("ka"))
    kb = coarse(a.select("ka", *(F.col(f"b.{c}").alias(c) for c in keys(fine))), factor).select("ka", _key(fine).alias("kb"))
    pairs = kb.where("ka <> kb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    src = pairs.join(ids.select(F.col("k").alias("ka"), F.col("node_id").alias("src")), "ka")
    both = src.join(ids.select(F.col("k").alias("kb"), F.col("node_id").alias("dst")), "kb")
    return cells, both.select("src", "dst")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of longs of one partition as stars: (node, least node of its tree), at most BLOCK pairs at a time."""
    held: list[np.ndarray] = []
    size = 0

    def stars():
        both = np.concatenate(held, axis=1)
        nodes, place = np.unique(both, return_inverse=True)
        root = roots(len(nodes), place.reshape(2, -1).T)
        apart = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[root[apart]])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(c)) for c in ("a", "b")]))
        size += batch.num_rows
        if size >= BLOCK:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def star_components(pairs: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) of all nodes of pairs (a, b) but the roots, which are the least of their components; any orderable type.

    Alternating large and small stars (Kiveris et al., 2014): each round is two aggregations and two equi-joins. Pairs of
    longs are first contracted within ranges of a, so that only what crosses ranges needs rounds. Runs jobs. No more than
    at_once pairs of longs (BLOCK at most; they are counted first, so they had better be written) are joined by one task without rounds.
    """

    def star(p: DataFrame) -> DataFrame:
        least = p.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return p.join(least, "u")

    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if isinstance(pairs.schema["a"].dataType, T.LongType):
        if at_once and pairs.count() <= min(at_once, BLOCK - 1):
            return materialise(pairs.coalesce(1).mapInArrow(forest, "a long, b long").toDF("node", "root"), "stars")
        pairs = pairs.repartitionByRange("a").mapInArrow(forest, "a long, b long")
    now, mark = materialise(pairs.distinct(), "pairs"), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = star(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, materialise(small.select(F.col("u").alias("a"), F.col("v").alias("b")), "pairs")
        release(last)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def packer(df: DataFrame, margin: int = 0):
    """Functions from a struct of coordinates (or its column's name) to one bigint in the same order and back; None for objects or extents of 2^21 cells.

    Coordinates up to `margin` outside the bounds of df fit as well.
    """
    if len(keys(df)) > 3:
        return None
    b = df.agg(*(f(a).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES)).first()
    if b["lox"] is None or any(b["hi" + a] - b["lo" + a] + 2 * margin >= 2**21 for a in AXES):
        return None
    low = {a: b["lo" + a] - margin for a in AXES}

    def to(c):
        part = lambda a: (F.col(f"{c}.{a}") if isinstance(c, str) else c[a]) - F.lit(low[a]).cast("long")
        return F.shiftleft(part("x"), 42).bitwiseOR(F.shiftleft(part("y"), 21)).bitwiseOR(part("z"))

    back = lambda c: F.expr(f"named_struct('x', shiftright({c}, 42) + {low['x']}L, 'y', (shiftright({c}, 21) & 2097151) + {low['y']}L, 'z', ({c} & 2097151) + {low['z']}L)")
    return to, back


def component_roots(df: DataFrame, connectivity: int = 26) -> DataFrame:
    """Distinct voxels with root (struct): the least voxel of their component. Runs jobs."""
    own = materialise(voxels(df), "voxels")
    pairs, packed = adjacent(own, connectivity), packer(own)
    if packed:
        to, back = packed
        roots = star_components(pairs.select(to("a").alias("a"), to("b").alias("b")))
        rooted = own.withColumn("k", _key(own)).withColumn("node", to("k")).join(roots, "node", "left")
        return rooted.select(*keys(own), F.when(F.col("root").isNull(), F.col("k")).otherwise(back("root")).alias("root"))
    roots = star_components(pairs)
    return own.withColumn("node", _key(own)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def _rooted(df: DataFrame, connectivity: int) -> DataFrame:
    if connectivity not in (6, 26):
        raise ValueError(f"connectivity has to be 6 or 26, not {connectivity}")
    return materialise(component_roots(df, connectivity), "rooted")


def by_root(rooted: DataFrame, facts: DataFrame) -> DataFrame:
    """rooted with the columns of facts (a row for each root, with voxels: its number in rooted); voxels of other roots go.

    Roots with more than 1 / SHARE of all voxels, fewer than SHARE, are broadcast and only the others meet by root: no task gets a whole large
    component. Runs a job.
    """
    most = (facts.agg(F.sum("voxels")).first()[0] or 0) // SHARE
    large, small = facts.where(F.col("voxels") > most), facts.where(F.col("voxels") <= most)
    rest = rooted.join(F.broadcast(large.select("root")), "root", "left_anti")
    return rooted.join(F.broadcast(large), "root").unionByName(rest.join(small, "root"))


def connected_components(df: DataFrame, connectivity: int = 26) -> DataFrame:
    """df with label: 0 to n - 1 in the order of the components' least voxels (with object_id, over all objects)."""
    df = validate(df)
    rooted = _rooted(df, connectivity)
    labels = dense_id(rooted.groupBy("root").agg(F.count("*").alias("voxels")), ["root"], "label")
    return df.join(by_root(rooted, labels).drop("root", "voxels"), keys(df))


def component_sizes(df: DataFrame, connectivity: int = 26) -> tuple[DataFrame, DataFrame]:
    """The distinct voxels with root, and root with voxels and n: the numbers of voxels and of rows (duplicates count)."""
    df = validate(df)
    counted = materialise(df.groupBy(*keys(df)).agg(F.count("*").alias("rows")), "counted")
    rooted = _rooted(counted.drop("rows"), connectivity)
    sizes = rooted.join(counted, keys(df), "left").groupBy("root").agg(F.count("*").alias("voxels"), F.sum("rows").alias("n"))
    return rooted, materialise(sizes, "sizes")


def _rows_on(df: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of df on the voxels of own. Rows meet voxels by coordinates, never by component."""
    df = validate(df)
    return df.join(own.select(*keys(df)), keys(df), "left_semi").select(*keys(df), *(c for c in df.columns if c not in keys(df)))


def largest_component(df: DataFrame, connectivity: int = 26) -> DataFrame:
    """The rows of the component with the most rows; of several the one with the least voxel."""
    rooted, sizes = component_sizes(df, connectivity)
    best = sizes.orderBy(F.desc("n"), "root").limit(1)
    return _rows_on(df, rooted.join(F.broadcast(best.select("root")), "root", "left_semi"))


def remove_small_objects(df: DataFrame, min_size: int, connectivity: int = 26) -> DataFrame:
    """The rows of the components with min_size rows or more."""
    rooted, sizes = component_sizes(df, connectivity)
    return _rows_on(df, by_root(rooted, sizes).where(F.col("n") >= min_size))


def fill_cavities(df: DataFrame, mode: str = "exact", max_depth: int | None = 8, max_cavity_size: int | None = None) -> DataFrame:
    """The voxels with enclosed voids filled.

    A band of background cells up to max_depth steps from the object is labelled (6-connected). A component is a void if it
    neither reaches depth max_depth nor leaves the object's bounds, has at most max_cavity_size cells, and its lining
    belongs to one 26-component of the object. Warns if a component was cut off by the depth alone. Runs a job for each step.
    """
    from voxmill.operators.morph import closing
    from voxmill.operators.stencil import FACES, boundary_shell

    own = materialise(voxels(df), "voxels")
    if mode == "closing":
        return closing(own, 1, 6)
    if mode != "exact":
        raise ValueError(f"mode has to be exact or closing, not {mode}")
    by, bounds = keys(own)[:-3], None
    if own.isEmpty():
        return own
    bounds = own.groupBy(*by).agg(*(f(a).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES))
    if max_depth is None:
        r = bounds.agg(*(F.max(F.col("hi" + a) - F.col("lo" + a) + 1) for a in AXES)).first()
        max_depth = min(r) // 2 + 1
    front = materialise(boundary_shell(own).withColumn("depth", F.lit(0)), "front")
    band, before = front, None
    for d in range(1, max_depth + 1):
        grown = scatter(front.drop("depth"), FACES).select(*keys(own)).distinct()
        # a layer's neighbours are voxels, of the layer itself, of the one before it, or new
        old = own.unionByName(front.drop("depth"))
        old = old if before is None else old.unionByName(before.drop("depth"))
        before, front = front, materialise(grown.join(old, keys(own), "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        band = band.unionByName(front)
    band = materialise(band, "band")
    rooted = component_roots(band.drop("depth"), 6)
    cells = materialise(rooted.join(band, keys(own)), "cells")
    out_of = " OR ".join(f"{a} < lo{a} OR {a} > hi{a}" for a in AXES)
    placed = cells.join(F.broadcast(bounds), by) if by else cells.crossJoin(F.broadcast(bounds))  # one row of bounds
    state = placed.groupBy("root").agg(F.count("*").alias("n"), F.max(F.col("depth") >= max_depth).alias("cut"), F.max(F.expr(out_of)).alias("out"))
    state = materialise(state, "state")
    enclosed = state.where("NOT cut AND NOT out" + (f" AND n <= {int(max_cavity_size)}" if max_cavity_size is not None else "")).select("root")
    unresolved = state.where("cut AND NOT out").count()
    if unresolved:
        warnings.warn(f"{unresolved} regions reach max_depth={max_depth} inside the bounds and stay open", stacklevel=2)
    inside = materialise(cells.join(enclosed, "root", "left_semi"), "inside")
    if inside.isEmpty():
        return own
    lining = scatter(inside.select("root", *keys(own)), FACES).drop("k")
    owner = component_roots(own, 26).withColumnRenamed("root", "owner")
    good = lining.join(owner, keys(own)).groupBy("root").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo = hi").select("root")
    return own.unionByName(inside.join(good, "root", "left_semi").select(*keys(own)))
