import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import graph, mesh, morph, voxelize
from voxmill.operators.frame import from_points
from voxmill.operators.stencil import neighbor_offsets
from voxmill.sources.clouds import box_mesh, hollow_box, solid_cube


def got(df):
    return sorted((r.x, r.y, r.z) for r in df.collect())


def partition(s, c):
    left, parts = set(s), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            p = todo.pop()
            part.add(p)
            for o in neighbor_offsets(c):
                q = tuple(np.add(p, o))
                if q in left:
                    left.remove(q)
                    todo.append(q)
        parts.append(part)
    return sorted(parts, key=min)


@pytest.mark.parametrize("c", [6, 26])
def test_components(spark, c):
    pts = [tuple(map(int, p)) for p in np.random.default_rng(1).integers(0, 9, (160, 3))]
    out = graph.connected_components(from_points(spark, pts), c).collect()
    parts = partition(pts, c)
    assert len(out) == len(pts)
    assert {(r.x, r.y, r.z): r.label for r in out} == {p: k for k, part in enumerate(parts) for p in part}


def test_sizes_count_rows(spark):
    df = from_points(spark, [(0, 0, 0)] * 3 + [(5, 5, 5), (5, 5, 6)])
    assert got(graph.largest_component(df)) == [(0, 0, 0)] * 3
    assert got(graph.remove_small_objects(df, 3)) == [(0, 0, 0)] * 3
    with pytest.raises(ValueError):
        graph.connected_components(df, 18)


@pytest.fixture
def as_shuffled(spark):
    """Joins without a broadcast of the planner's own, and partitions as they were dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_large_component_is_dealt(spark, as_shuffled):
    """A component with nearly all rows goes to all tasks, small ones are told apart by their rows."""
    cube = solid_cube(spark, 12)
    specks = [(50 + 2 * k, 0, 0) for k in range(9) for _ in range(1 + k % 3)]  # single voxels with 1, 2 and 3 rows
    df = cube.union(cube).union(from_points(spark, [*specks, (90, 0, 0), (90, 0, 1), (95, 5, 5), (95, 5, 6), (95, 5, 6)]))
    kept = graph.remove_small_objects(df, 3, 6)
    solid_rows = sorted([(x, y, z) for x in range(12) for y in range(12) for z in range(12)] * 2)
    rest = [p for p in specks if specks.count(p) == 3] + [(95, 5, 5), (95, 5, 6), (95, 5, 6)]
    assert got(kept) == sorted(solid_rows + rest)
    assert most_in_a_task(kept) < kept.count() // 2
    assert got(graph.largest_component(df, 6)) == solid_rows
    assert got(graph.remove_small_objects(df.limit(0), 1)) == []
    labels = {(r.x, r.y, r.z): r.label for r in graph.connected_components(df, 6).collect()}
    parts = sorted({(0, 0, 0), (90, 0, 0), (95, 5, 5), *specks})
    assert all(labels[p] == k for k, p in enumerate(parts)) and labels[11, 11, 11] == 0 and labels[90, 0, 1] == labels[90, 0, 0] and labels[95, 5, 6] == labels[95, 5, 5]
    assert len(labels) == 12**3 + 13


def test_facts_of_a_large_component(spark, as_shuffled):
    """Voxels of a large component get its facts where they are; those of roots without facts go."""
    rooted = spark.range(0, 4000, 1, 4).selectExpr("IF(id < 3000, 0, id) AS root", "id AS x")
    sizes = rooted.where("root <> 3999").groupBy("root").agg(F.count("*").alias("voxels"))
    out = graph.by_root(rooted, sizes)
    assert sorted((r.x, r.root, r.voxels) for r in out.collect()) == [(x, 0 if x < 3000 else x, 3000 if x < 3000 else 1) for x in range(3999)]
    assert most_in_a_task(out.where("root = 0")) <= 1000


def test_rows_of_objects(spark):
    """By object, with columns beside the coordinates; of two components alike in rows the one with the least voxel stays."""
    rows = [(2, 7, 0, 0, "a"), (2, 7, 0, 1, "b"), (1, 7, 0, 0, "c"), (1, 7, 0, 0, "d"), (3, 0, 0, 0, "e"), (3, None, 0, 0, "f"), (None, 1, 1, 1, "g"), (None, 1, 1, 1, "h"), (None, 1, 1, 1, "i")]
    df = spark.createDataFrame(rows, "object_id long, x int, y int, z int, tag string").select("tag", "x", "y", "z", "object_id")
    out = graph.remove_small_objects(df, 2)
    assert out.columns == ["object_id", "x", "y", "z", "tag"] and sorted(r.tag for r in out.collect()) == ["a", "b", "c", "d"]
    assert sorted(r.tag for r in graph.largest_component(df).collect()) == ["c", "d"]


def test_edges(spark):
    nodes, edges = graph.edges(from_points(spark, [(5, 5, 5), (0, 0, 0), (1, 0, 0), (1, 0, 0)]))
    assert sorted((r.node_id, r.x) for r in nodes.collect()) == [(0, 0), (1, 1), (2, 5)]
    assert [tuple(r) for r in edges.collect()] == [(0, 1)]
    cells, lifted = graph.downsample_graph(from_points(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (4, 0, 0)]), 2)
    assert cells.count() == 3 and [tuple(r) for r in lifted.collect()] == [(0, 1)]


def test_fill_cavities(spark):
    assert graph.fill_cavities(hollow_box(spark)).count() == 343
    assert graph.fill_cavities(hollow_box(spark), max_cavity_size=26).count() == 316
    tunnel = solid_cube(spark, 5).where("NOT (x = 2 AND y = 2)")
    assert graph.fill_cavities(tunnel).count() == 120
    with pytest.warns(UserWarning):
        assert graph.fill_cavities(hollow_box(spark, 9, 7), max_depth=2).count() == 9**3 - 7**3
    assert got(graph.fill_cavities(solid_cube(spark, 3), "closing")) == got(morph.closing(solid_cube(spark, 3)))
    with pytest.raises(ValueError):
        graph.fill_cavities(tunnel, "other")


def solid(vertices, faces):
    """Volume, and whether each edge has two faces in opposite directions."""
    v = {r.vid: np.array([r.x, r.y, r.z], float) for r in vertices.collect()}
    f = [(r.a, r.b, r.c) for r in faces.collect()]
    directed = [e for t in f for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    volume = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    return len(v), len(f), volume, len(set(directed)) == len(directed) and all((b, a) in set(directed) for a, b in directed)


@pytest.mark.parametrize(("points", "n", "m"), [([(0, 0, 0)], 8, 12), ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], 16, 28), ([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], 26, 48)])
def test_surface_nets_golden(spark, points, n, m):
    nv, nf, volume, closed = solid(*mesh.mesh(from_points(spark, points)))
    assert (nv, nf) == (n, m) and closed and volume > 0


def test_blocky(spark):
    slab = from_points(spark, [(x, y, 0) for x in range(4) for y in range(4)])
    nv, nf, volume, closed = solid(*mesh.culled_faces(slab))
    assert nf == 96 and volume == pytest.approx(16) and closed
    nv, nf, volume, closed = solid(*mesh.greedy_faces(slab))
    assert (nv, nf) == (8, 12) and volume == pytest.approx(16) and closed
    assert solid(*mesh.mesh(slab, spacing=(1, 2, 3), smooth=False))[2] == pytest.approx(96)
    assert solid(*mesh.mesh(slab, step_size=2, smooth=False))[2] == pytest.approx(32)
    with pytest.warns(UserWarning):
        mesh.mesh(slab, simplify=True)
    with pytest.warns(DeprecationWarning):
        mesh.marching_cubes(slab)


def test_greedy_has_the_area_of_culled(spark):
    pts = from_points(spark, [tuple(map(int, p)) for p in np.random.default_rng(3).integers(0, 5, (60, 3))])
    rects = mesh.greedy_rectangles(pts).collect()
    assert sum((r.u1 - r.u0 + 1) * (r.v1 - r.v0 + 1) for r in rects) * 2 == mesh.culled_faces(pts)[1].count()
    assert solid(*mesh.greedy_faces(pts))[2] == pytest.approx(pts.distinct().count())


CELLS = sorted((x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3))


@pytest.mark.parametrize("options", [{}, {"rule": "winding"}, {"axes": 3}])
def test_voxelize_box(spark, options):
    assert got(voxelize.voxelize(*box_mesh(spark, -2.5, 2.5), spacing=1.3, **options)) == CELLS


def ball(spark, r=4.3, n=14):
    """A closed sphere of latitudes and longitudes."""
    rings = [[(r * np.sin(a) * np.cos(b), r * np.sin(a) * np.sin(b), r * np.cos(a)) for b in 2 * np.pi * np.arange(n) / n] for a in np.pi * np.arange(1, n) / n]
    v = [(0.0, 0.0, r)] + [tuple(map(float, p)) for ring in rings for p in ring] + [(0.0, 0.0, -r)]
    f, last = [], len(v) - 1
    for j in range(n):
        f += [(0, 1 + j, 1 + (j + 1) % n), (last, last - n + (j + 1) % n, last - n + j)]
        for i in range(n - 2):
            a, b, c, d = (1 + k * n + m % n for k, m in ((i, j), (i, j + 1), (i + 1, j), (i + 1, j + 1)))
            f += [(a, c, d), (a, d, b)]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(v)], "vid long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long")


def test_voxelize_ball(spark):
    m = ball(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        full = set(got(voxelize.voxelize(*m)))
    assert set(got(voxelize.voxelize(*m, rule="winding"))) == full
    inner = {p for p in np.ndindex(13, 13, 13) if np.linalg.norm(np.subtract(p, 6)) < 4.0}
    outer = {p for p in np.ndindex(15, 15, 15) if np.linalg.norm(np.subtract(p, 7)) < 4.3 + 0.9}
    assert {tuple(np.subtract(p, 6)) for p in inner} <= full <= {tuple(np.subtract(p, 7)) for p in outer}


def test_voxelize_open_and_bad(spark):
    v, f = box_mesh(spark, -2.5, 2.5)
    with pytest.warns(UserWarning):
        voxelize.voxelize(v, f.where("fid NOT IN (8, 9)"))
    with pytest.raises(ValueError):
        voxelize.voxelize(v, spark.createDataFrame([(0, 0, 1, 99)], "fid long, a long, b long, c long"))
    for bad in ({"rule": "x"}, {"axes": 2}, {"spacing": 0}):
        with pytest.raises(ValueError):
            voxelize.voxelize(v, f, **bad)
