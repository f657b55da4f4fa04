"""Thinning, skeletons and tube profiles. Each 26-component is one task's work: it has to fit in a task's memory.

A skeleton is two frames: nodes (node_id, component, x, y, z in index space, radius, n_voxels) and edges (src < dst). node_id
is dense, in the order of the components' least voxels and then of the nodes. Functions here run jobs to find components.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.ids import dense_id
from voxmill.kernels import lattice, skeletons, thinning, tubes
from voxmill.operators import graph
from voxmill.operators.frame import AXES, as_integers, as_spacing, keys, voxels
from voxmill.sources.scratch import materialise

ROWS = "kind int, i long, j long, x double, y double, z double, radius double, n_voxels long"
RADIUS_AGGREGATES = ("volume", "mean", "median", "max", "min", "percentile25", "percentile75")


def by_component(df: DataFrame) -> DataFrame:
    """The voxels with cx, cy, cz: the least voxel of their component."""
    rooted = graph.component_roots(df, 26)
    return rooted.select(*keys(rooted), *(F.col(f"root.{a}").alias("c" + a) for a in AXES))


def _group(df: DataFrame) -> list[str]:
    return [c for c in ("object_id", "cx", "cy", "cz") if c in df.columns]


def _head(by: list[str]) -> str:
    return "".join(f"{c} long, " for c in by)


def thin(df: DataFrame, preserve_endpoints: bool = True, max_iterations: int | None = None, fill_cavities: bool = False) -> DataFrame:
    """A subset of the voxels, one cell thick, with the same components, tunnels and voids, and with the ends of curves."""
    own = by_component(graph.fill_cavities(df) if fill_cavities else df)
    names = keys(own)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left = pd.DataFrame(thinning.thin(part[list(AXES)].to_numpy(), preserve_endpoints, max_iterations), columns=AXES)
        if "object_id" in names:
            left.insert(0, "object_id", part["object_id"].iloc[0])
        return left[names]

    return own.groupBy(*_group(own)).applyInPandas(run, ", ".join(f"{c} long" for c in names))


def _rows(found, head: dict) -> pd.DataFrame:
    nodes, pairs, radii, counts = found
    n, e = len(nodes), len(pairs)
    none = np.full(e, np.nan)
    out = {"kind": np.r_[np.zeros(n), np.ones(e)].astype(np.int32), "i": np.r_[np.arange(n), pairs[:, 0]], "j": np.r_[np.full(n, -1), pairs[:, 1]]}
    out |= {a: np.r_[nodes[:, k], none] for k, a in enumerate(AXES)} | {"radius": np.r_[radii, none], "n_voxels": np.r_[counts, np.zeros(e, np.int64)]}
    return pd.DataFrame({**{c: np.full(n + e, v) for c, v in head.items()}, **out})


def skeletonize(df: DataFrame, kernel: Callable) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a kernel's skeleton of each component; the kernel gets the component's sorted voxels."""
    own = by_component(df)
    by = _group(own)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _rows(kernel(lattice.sort_rows(part[list(AXES)].to_numpy())), {c: part[c].iloc[0] for c in by})

    return _split(materialise(own.groupBy(*by).applyInPandas(run, _head(by) + ROWS), "skeleton"), by)


def _split(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    nodes = dense_id(rows.where("kind = 0").drop("kind", "j"), [*by, "i"], "node_id")
    ids = nodes.select(*by, "i", "node_id")
    pairs = rows.where("kind = 1").select(*by, "i", "j")
    src = pairs.join(ids.withColumnRenamed("node_id", "s"), [*by, "i"])
    both = src.join(ids.select(*by, F.col("i").alias("j"), F.col("node_id").alias("d")), [*by, "j"])
    return nodes.select("node_id", *by, *AXES, "radius", "n_voxels"), both.select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))


def _spacing(spacing) -> np.ndarray:
    return np.array(as_spacing(spacing))


def thin_skeleton_kernel(spacing=None, min_branch_length: float = 0.0, preserve_endpoints: bool = True) -> Callable:
    s = _spacing(spacing)

    def kernel(v: np.ndarray):
        far = lattice.distances(v, s)
        left = thinning.thin(v, preserve_endpoints)
        return skeletons.centerline(left, far[lattice.Lookup(v).rows(left)], s, min_branch_length)

    return kernel


def thin_skeletonize(df: DataFrame, spacing=None, min_branch_length: float = 0.0, preserve_endpoints: bool = True) -> tuple[DataFrame, DataFrame]:
    """The centre line of the thinned voxels, radii from the whole object."""
    return skeletonize(df, thin_skeleton_kernel(spacing, min_branch_length, preserve_endpoints))


def centerline(thinned: DataFrame, spacing=None, min_branch_length: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Of voxels that are thin already; their radii are their own."""
    s = _spacing(spacing)
    return skeletonize(thinned, lambda v: skeletons.centerline(v, lattice.distances(v, s), s, min_branch_length))


def teasar_kernel(spacing=None, downsample=None, scale: float = 1.5, const: float | None = None, pdrf_scale: float = 1e5, pdrf_exponent: float = 4, pdrf_ref: float | None = None, dbf_term: bool = False, branching="exact", root="geodesic", min_branch_length: float = 0.0) -> Callable:
    if not (branching in ("exact", "tree", "fast") or isinstance(branching, int) and branching > 0):
        raise ValueError(f"branching has to be exact, tree, fast or a positive number, not {branching}")
    if isinstance(root, str) and root not in ("geodesic", "dbf"):
        raise ValueError(f"root has to be geodesic, dbf or a voxel, not {root}")
    if pdrf_ref is not None and not 0 < pdrf_ref <= 1:
        raise ValueError(f"pdrf_ref has to be over 0 and at most 1, not {pdrf_ref}")
    factor = np.array(as_integers(downsample, "downsample")) if downsample is not None else None
    s = _spacing(spacing)
    step = s * factor if factor is not None and spacing is not None else s
    more = {"scale": scale, "const": const, "pdrf_scale": pdrf_scale, "pdrf_exponent": pdrf_exponent, "pdrf_ref": pdrf_ref, "dbf_term": dbf_term, "branching": branching, "root": root, "min_branch": min_branch_length}

    def kernel(v: np.ndarray):
        pairs = None
        if factor is not None:  # cells of the component, joined where its voxels are
            fine = lattice.edges_of(lattice.neighbour_table(v))
            cells, cell = np.unique(v // factor, axis=0, return_inverse=True)
            lifted = np.sort(cell.ravel()[fine], axis=1)
            v, pairs = cells, np.unique(lifted[lifted[:, 0] != lifted[:, 1]], axis=0).reshape(-1, 2)
        return skeletons.teasar(v, lattice.distances(v, step), step, pairs=pairs, **more)

    return kernel


def teasar_skeletonize(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Tree-shaped skeletons along the middle; options as of teasar_kernel."""
    return skeletonize(df, teasar_kernel(**options))


def wavefront_kernel(spacing=None, step_size: float | None = None, radius_agg: str = "volume", tree: bool = True, preserve_backbone: bool = True, min_branch_length: float = 0.0) -> Callable:
    s = _spacing(spacing)
    if radius_agg not in RADIUS_AGGREGATES:
        raise ValueError(f"radius_agg has to be one of {', '.join(RADIUS_AGGREGATES)}, not {radius_agg}")
    if step_size is not None and step_size < np.linalg.norm(s) * (1 + 1e-6):
        raise ValueError(f"step_size {step_size} is below the longest step of the graph")
    return lambda v: skeletons.wavefront(v, s, step_size, radius_agg, tree, preserve_backbone, min_branch_length)


def wavefront_skeletonize(df: DataFrame, surface: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Centres of the rings of a geodesic wave; with surface, of the voxels with an exposed face alone. Options as of wavefront_kernel."""
    from voxmill.operators.stencil import surface_voxels

    kernel = wavefront_kernel(**options)
    return skeletonize(surface_voxels(df) if surface else df, kernel)


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select(F.col("dst").alias("node_id")))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def to_swc(nodes: DataFrame, edges: DataFrame, spacing=None, root: int | None = None) -> DataFrame:
    """id (from 1), type 0, x, y, z, radius, parent (-1 for roots): a breadth-first forest of each component, in node order.

    A component's root is the widest node, or `root` (a node_id) where it is one of its nodes.
    """
    s = as_spacing(spacing)
    by = _group(nodes)
    rows = nodes.select(*by, F.lit(0).alias("kind"), "node_id", F.lit(-1).cast("long").alias("other"), *((F.col(a) * v).alias(a) for a, v in zip(AXES, s, strict=True)), "radius")
    pairs = edges.join(nodes.select(*by, F.col("node_id").alias("src")), "src").select(*by, F.lit(1).alias("kind"), F.col("src").alias("node_id"), F.col("dst").alias("other"), *(F.lit(None).cast("double").alias(c) for c in (*AXES, "radius")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, e = (part[part["kind"] == k].sort_values(["node_id", "other"]) for k in (0, 1))
        ids = n["node_id"].to_numpy()
        at = np.searchsorted(ids, e[["node_id", "other"]].to_numpy().astype(np.int64)).reshape(-1, 2)
        first = int(np.searchsorted(ids, root)) if root is not None and root in set(ids) else None
        up = skeletons.swc_rows(len(ids), at, n["radius"].to_numpy(), first)
        return pd.DataFrame({"id": ids + 1, "type": 0, **{a: n[a].to_numpy() for a in (*AXES, "radius")}, "parent": np.where(up < 0, -1, ids[up] + 1)})

    out = rows.unionByName(pairs).groupBy(*by).applyInPandas(run, "id long, type int, x double, y double, z double, radius double, parent long")
    return out.orderBy("id")


def write_swc(swc: DataFrame, path: str) -> None:
    """Space-separated text in node order."""
    swc.orderBy("id").write.csv(path, sep=" ")


TUBE = "a0 float, mag array<float>, phase array<float>, frame array<float>, branch int, flags int, residual float, non_star float"


def _check_tube(k: int, n_theta: int) -> None:
    if n_theta < 4 or not 0 <= k < n_theta // 2:
        raise ValueError(f"n_theta has to be 4 or more and K from 0 to under its half, not {n_theta} and {k}")


def _tube_columns(p: dict) -> dict:
    flat = {c: p[c].astype(np.float32) for c in ("a0", "residual", "non_star")} | {c: p[c].astype(np.int32) for c in ("branch", "flags")}
    return flat | {c: list(p[c].astype(np.float32)) for c in ("mag", "phase", "frame")}


def tube_coefficients(df: DataFrame, method: str = "teasar", spacing=None, K: int = 4, n_theta: int = 64, max_radius: float | None = None, diagnostics: bool = True, star_window: float = 1.0, **options) -> tuple[DataFrame, DataFrame]:
    """Skeleton nodes with the Fourier series of the distance to the surface, and edges. method: teasar, wavefront or thin."""
    _check_tube(K, n_theta)
    kernels = {"teasar": teasar_kernel, "wavefront": wavefront_kernel, "thin": thin_skeleton_kernel}
    if method not in kernels:
        raise ValueError(f"method has to be one of {', '.join(kernels)}, not {method}")
    kernel, s = kernels[method](spacing=spacing, **options), _spacing(spacing)
    own = by_component(df)
    by = _group(own)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = lattice.sort_rows(part[list(AXES)].to_numpy())
        found = kernel(v)
        rows = _rows(found, {c: part[c].iloc[0] for c in by})
        p = _tube_columns(tubes.profile(v, found[0], found[1], found[2], s, K, n_theta, max_radius, star_window if diagnostics else None))
        pad = len(rows) - len(found[0])
        for c in (x.split()[0] for x in TUBE.split(", ")):
            rows[c] = pd.Series([*p[c], *[[] if c in ("mag", "phase", "frame") else 0] * pad], dtype=object if c in ("mag", "phase", "frame") else None)
        return rows

    rows = materialise(own.groupBy(*by).applyInPandas(run, f"{_head(by)}{ROWS}, {TUBE}"), "tubes")
    nodes, edges = _split(rows.select(*by, *(x.split()[0] for x in ROWS.split(", "))), by)
    cols = rows.where("kind = 0").select(*by, *AXES, *(x.split()[0] for x in TUBE.split(", ")))
    return nodes.join(cols, [*by, *AXES]), edges


def tube_profile(df: DataFrame, nodes: DataFrame, edges: DataFrame, spacing=None, K: int = 4, n_theta: int = 64, max_radius: float | None = None, diagnostics: bool = True, star_window: float = 1.0) -> DataFrame:
    """nodes with a profile, for a skeleton from elsewhere: of each object_id, or of all voxels, in one task."""
    _check_tube(K, n_theta)
    s, by = _spacing(spacing), "object_id" in df.columns
    key = (lambda d: d.withColumn("__o", F.col("object_id"))) if by else (lambda d: d.withColumn("__o", F.lit(0).cast("long")))
    ends = edges.join(nodes.select(F.col("node_id").alias("src"), *(["object_id"] if by else [])), "src")
    both = nodes.select("node_id", *AXES, "radius", F.lit(-1).cast("long").alias("other"), *(["object_id"] if by else [])).unionByName(ends.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), *(F.lit(None).cast("double").alias(c) for c in (*AXES, "radius")), *(["object_id"] if by else [])))

    def run(vox: pd.DataFrame, skel: pd.DataFrame) -> pd.DataFrame:
        n, e = skel[skel["other"] < 0].sort_values("node_id"), skel[skel["other"] >= 0]
        ids = n["node_id"].to_numpy()
        pairs = np.searchsorted(ids, e[["node_id", "other"]].to_numpy().astype(np.int64)).reshape(-1, 2)
        p = tubes.profile(lattice.sort_rows(vox[list(AXES)].to_numpy()), n[list(AXES)].to_numpy(float), pairs, n["radius"].to_numpy(float), s, K, n_theta, max_radius, star_window if diagnostics else None)
        return pd.DataFrame({"node_id": ids, **_tube_columns(p)})

    found = key(df).groupBy("__o").cogroup(key(both).groupBy("__o")).applyInPandas(run, f"node_id long, {TUBE}")
    return nodes.join(found, "node_id")


def radius_at(profile: DataFrame, theta: list[float], k: int | None = None, derivative: int = 0) -> DataFrame:
    """node_id, theta and r: the series at each angle, cut to k harmonics; with derivative 1 or 2 its derivative by the angle."""
    if derivative not in (0, 1, 2):
        raise ValueError(f"derivative has to be 0, 1 or 2, not {derivative}")
    at = profile.select("node_id", "a0", "mag", "phase", F.explode(F.array(*[F.lit(float(t)) for t in theta])).alias("theta"))
    mag = F.col("mag") if k is None else F.slice("mag", 1, k) if k else F.array().cast("array<float>")

    def term(m, i):
        n, turn = (i + 1).cast("double"), (i + 1) * F.col("theta") - F.col("phase")[i].cast("double")
        return m.cast("double") * (F.cos(turn), -n * F.sin(turn), -n * n * F.cos(turn))[derivative]

    mean = F.col("a0").cast("double") if derivative == 0 else F.lit(0.0)
    return at.select("node_id", "theta", (mean + F.aggregate(F.transform(mag, term), F.lit(0.0), lambda a, b: a + b)).alias("r"))


def coefficients(profile: DataFrame) -> DataFrame:
    """node_id, a0 and, for each harmonic, the weights of its cosine and its sine."""
    part = lambda f: F.transform("mag", lambda m, i: m * f(F.col("phase")[i]))
    return profile.select("node_id", "a0", part(F.cos).cast("array<float>").alias("cosine"), part(F.sin).cast("array<float>").alias("sine"))


def normals(profile: DataFrame, n_theta: int = 64, k: int | None = None) -> DataFrame:
    """node_id, theta, nx, ny, nz: unit normals of the surface that point outward, across the tube (its slope along the axis is left out).

    A point r(a) e(a) of the cross section moves by r' e + r e' with its angle a; at right angles to that is r e - r' e'.
    """
    theta = [2 * np.pi * i / n_theta for i in range(n_theta)]
    both = radius_at(profile, theta, k).join(radius_at(profile, theta, k, 1).withColumnRenamed("r", "slope"), ["node_id", "theta"]).join(frame_vectors(profile), "node_id")
    out = [F.cos("theta") * F.col("u")[i] + F.sin("theta") * F.col("v")[i] for i in range(3)]
    round_ = [F.cos("theta") * F.col("v")[i] - F.sin("theta") * F.col("u")[i] for i in range(3)]
    size = F.sqrt(F.col("r") * F.col("r") + F.col("slope") * F.col("slope"))
    return both.select("node_id", "theta", *(F.when(size > 0, (F.col("r") * e - F.col("slope") * d) / size).otherwise(e).alias("n" + a) for a, e, d in zip(AXES, out, round_, strict=True)))


def frame_vectors(profile: DataFrame) -> DataFrame:
    """node_id with the vectors u, v (across) and t (along) of the stored quaternion."""
    x, y, z, w = (F.col("frame")[k].cast("double") for k in range(4))
    u = F.array(1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w))
    v = F.array(2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w))
    t = F.array(2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y))
    return profile.select("node_id", u.alias("u"), v.alias("v"), t.alias("t"))


def evaluate(profile: DataFrame, n_theta: int = 64, k: int | None = None, spacing=None) -> DataFrame:
    """node_id, theta, px, py, pz: points of the surface around each node, in physical space."""
    s = as_spacing(spacing)
    r = radius_at(profile, [2 * np.pi * i / n_theta for i in range(n_theta)], k)
    placed = r.join(profile.select("node_id", *AXES), "node_id").join(frame_vectors(profile), "node_id")
    return placed.select("node_id", "theta", *((F.col(a) * v + F.col("r") * (F.cos("theta") * F.col("u")[i] + F.sin("theta") * F.col("v")[i])).alias("p" + a) for i, (a, v) in enumerate(zip(AXES, s, strict=True))))


def to_gpu_buffer(profile: DataFrame, form: str = "cartesian", spacing=None) -> DataFrame:
    """node_id and buffer: position (3), frame (4), a0, then K cosine and K sine weights (cartesian) or magnitudes and phases (polar)."""
    if form not in ("cartesian", "polar"):
        raise ValueError(f"form has to be cartesian or polar, not {form}")
    first, second = F.col("mag"), F.col("phase")
    if form == "cartesian":
        first = F.transform("mag", lambda m, i: m * F.cos(F.col("phase")[i]))
        second = F.transform("mag", lambda m, i: m * F.sin(F.col("phase")[i]))
    pos = F.array(*(F.col(a) * v for a, v in zip(AXES, as_spacing(spacing), strict=True)))
    whole = F.concat(*(c.cast("array<float>") for c in (pos, F.col("frame"), F.array("a0"), first, second)))
    return profile.select("node_id", whole.alias("buffer"))


def has_flag(bit: int):
    return F.col("flags").bitwiseAND(bit) != 0


def save_profile(profile: DataFrame, path: str) -> None:
    """Parquet; its own encodings take the place of hand-made delta codes."""
    profile.write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """What save_profile wrote; ValueError if a column of a profile is missing."""
    out = spark.read.parquet(path)
    missing = {"node_id", *AXES, *(c.split()[0] for c in TUBE.split(", "))} - set(out.columns)
    if missing:
        raise ValueError(f"not a profile: {', '.join(sorted(missing))} missing")
    return out


def node_volumes(nodes: DataFrame, spacing=None) -> DataFrame:
    """node_id and volume: that of the voxels which the node stands for."""
    return nodes.select("node_id", (F.col("n_voxels") * float(np.prod(as_spacing(spacing)))).alias("volume"))


def nearest_radii(nodes: DataFrame, df: DataFrame, spacing=None) -> DataFrame:
    """node_id and radius: from each node (any real place) to the nearest cell outside df; 0 for a node whose own cell is outside.

    That cell lies within a cell's diagonal of the ball that the node's own cell has to the background, so only the boundary's cells in
    cubes of that size around the node are met, by an equi-join. Runs jobs.
    """
    from voxmill.operators.distance import distance_transform
    from voxmill.operators.stencil import boundary_shell

    s = as_spacing(spacing)
    own = voxels(df)
    far = distance_transform(own, spacing).select(*(F.col(a).alias("c" + a) for a in AXES), "distance")
    at = nodes.select("node_id", *AXES, *(F.rint(a).cast("long").alias("c" + a) for a in AXES)).join(far, ["c" + a for a in AXES], "left")
    at = materialise(at.withColumn("reach", F.col("distance") + float(np.sqrt(sum(v * v for v in s)))), "reach")
    # cubes grow by powers of two with the reach: at most 27 for each node, whatever its radius
    at = at.withColumn("level", F.greatest(F.ceil(F.log2(F.col("reach") / min(s))), F.lit(0)))
    cube = lambda a, v, d=0: F.floor(F.col(a) * v / (F.pow(F.lit(2.0), F.col("level")) * min(s))) + d
    levels = F.broadcast(at.select("level").distinct().where("level IS NOT NULL"))  # one row for each power of two
    shell = boundary_shell(own).crossJoin(levels)
    shell = shell.select("level", *(cube(a, v).alias("q" + a) for a, v in zip(AXES, s, strict=True)), *(F.col(a).alias("s" + a) for a in AXES))
    steps = F.array(*[F.struct(*(F.lit(d).alias("d" + a) for a, d in zip(AXES, o, strict=True))) for o in itertools.product((-1, 0, 1), repeat=3)])
    around = at.where("level IS NOT NULL").select("*", F.inline(steps)).select("node_id", *AXES, "level", *((cube(a, v) + F.col("d" + a)).alias("q" + a) for a, v in zip(AXES, s, strict=True)))
    square = sum((F.col("s" + a) - F.col(a)) * (F.col("s" + a) - F.col(a)) * v * v for a, v in zip(AXES, s, strict=True))
    found = around.join(shell, ["level", *("q" + a for a in AXES)]).groupBy("node_id").agg(F.sqrt(F.min(square)).alias("radius"))
    return nodes.select("node_id").join(found, "node_id", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))


def to_networkx(nodes: DataFrame, edges: DataFrame):
    """A networkx graph of a skeleton that fits on the driver, with pos and radius of each node; ImportError without networkx."""
    import networkx

    graph = networkx.Graph()
    graph.add_nodes_from((r.node_id, {"pos": (r.x, r.y, r.z), "radius": r.radius}) for r in nodes.select("node_id", *AXES, "radius").collect())
    graph.add_edges_from((r.src, r.dst) for r in edges.select("src", "dst").collect())
    return graph


def to_skeleton(profile: DataFrame) -> DataFrame:
    """Nodes whose radius is a0."""
    return profile.select("node_id", *[c for c in _group(profile)], *AXES, F.col("a0").cast("double").alias("radius"), "n_voxels")
