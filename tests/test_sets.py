import numpy as np
import pytest

from voxmill.operators import graph, measure, morph, pool, sets, stencil
from voxmill.operators.frame import from_points, validate, voxels
from voxmill.sources.clouds import hollow_box, solid_cube

OFF6 = [o for o in stencil.neighbor_offsets(6)]


def got(df, cols="xyz"):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def cloud(seed=0, n=150, lo=-4, hi=5):
    return [tuple(map(int, p)) for p in np.random.default_rng(seed).integers(lo, hi, (n, 3))]


def grow(s, offs):
    return s | {tuple(np.add(p, o)) for p in s for o in offs}


def shrink(s, offs):
    return {p for p in s if all(tuple(np.add(p, o)) in s for o in offs)}


def test_set_algebra(spark):
    a, b = cloud(1), cloud(2)
    A, B = from_points(spark, a), from_points(spark, b)
    a, b = set(a), set(b)
    assert got(sets.union(A, B)) == sorted(a | b)
    assert got(sets.intersection(A, B)) == sorted(a & b)
    assert got(sets.difference(A, B)) == sorted(a - b)
    assert got(sets.symmetric_difference(A, B)) == sorted(a ^ b)
    with pytest.raises(TypeError):
        sets.union()
    with pytest.raises(TypeError):
        sets.intersection()


def test_types_and_nulls(spark):
    with pytest.raises(TypeError):
        validate(spark.createDataFrame([(1.0, 2, 3)], "x double, y long, z long"))
    df = spark.createDataFrame([(1, 2, 3), (None, 0, 0), (1, 2, 3)], "x int, y short, z long")
    assert got(voxels(df)) == [(1, 2, 3)]
    empty = from_points(spark, [(0, 0, 0)]).limit(0)
    assert got(morph.dilate(empty)) == [] and got(sets.union(empty, empty)) == []
    assert measure.volume(empty).first()["volume"] == 0 and measure.iou(empty, empty).first()["iou"] == 1
    for f in (measure.bounding_box, measure.centroid):
        with pytest.raises(ValueError):
            f(empty)


def test_lookups(spark):
    rows = [(0, 1, 1, 1), (1, 2, 2, 2), (2, 1, 1, 1), (3, 9, 9, 9)]
    df = spark.createDataFrame(rows, "row_id long, x long, y long, z long")
    other = spark.createDataFrame([(7, 1, 1, 1), (5, 1, 1, 1), (6, 2, 2, 2)], "row_id long, x long, y long, z long")
    assert sorted((r.row_id, r.is_in) for r in sets.isin(df, other).collect()) == [(0, True), (1, True), (2, True), (3, False)]
    found = sets.index_of(df.drop("row_id"), other)
    assert sorted((r.x, r["index"]) for r in found.collect()) == [(1, 5), (1, 5), (2, 6), (9, -1)]


@pytest.mark.parametrize("c", [6, 18, 26])
def test_morphology(spark, c):
    a = cloud(3, 300)
    offs, s = stencil.neighbor_offsets(c), set(a)
    A = from_points(spark, a)
    assert got(morph.dilate(A, 1, c)) == sorted(grow(s, offs))
    assert got(morph.erode(A, 1, c)) == sorted(shrink(s, offs))
    assert got(morph.opening(A, 1, c)) == sorted(grow(shrink(s, offs), offs))
    assert got(morph.closing(A, 2, c)) == sorted(shrink(shrink(grow(grow(s, offs), offs), offs), offs))


def test_morphology_errors(spark):
    A = from_points(spark, [(0, 0, 0)])
    with pytest.raises(ValueError):
        morph.dilate(A, -1)
    with pytest.raises(ValueError):
        morph.dilate(A, 1, 7)
    assert got(morph.dilate(A, 0)) == [(0, 0, 0)]


def contacts(s):
    out = set()
    for far, first, between in morph.CONTACTS:
        for p in s:
            at = lambda o: tuple(np.add(p, o))  # noqa: B023, E731
            if at(far) in s and not any(at(b) in s for b in between):
                out.add(at(first))
    return out


def test_manifold(spark):
    a = set(cloud(4, 80))
    now = set(a)
    for _ in range(8):
        fixes = contacts(now)
        if not fixes:
            break
        now |= fixes
    assert got(morph.make_manifold(from_points(spark, a))) == sorted(now)
    assert got(morph.make_manifold(from_points(spark, [(0, 0, 0), (1, 1, 0)]))) == [(0, 0, 0), (1, 0, 0), (1, 1, 0)]
    with pytest.warns(UserWarning):
        morph.make_manifold(from_points(spark, [(0, 0, 0), (1, 1, 1)]), max_iter=1)
    assert len(morph.CONTACTS) == 10


def test_measures(spark):
    a = cloud(5)
    s, A = set(a), from_points(spark, a)
    faces = [(p, o) for p in s for o in OFF6 if tuple(np.add(p, o)) not in s]
    area = sum({0: 2 * 3, 1: 1 * 3, 2: 1 * 2}[int(np.flatnonzero(o)[0])] for _, o in faces)
    assert stencil.exposed_faces(A).count() == len(faces)
    assert measure.surface_area(A, (1, 2, 3)).first()[0] == area
    assert measure.volume(A, 2).first()[0] == 8 * len(s)
    assert np.allclose(list(measure.centroid(A, 2).first()), 2 * np.mean(sorted(s), axis=0))
    assert got(stencil.boundary_shell(A)) == sorted(grow(s, OFF6) - s)
    b = set(cloud(6))
    B = from_points(spark, b)
    assert measure.iou(A, B).first()[0] == pytest.approx(len(s & b) / len(s | b))
    assert measure.dice(A, B).first()[0] == pytest.approx(2 * len(s & b) / (len(s) + len(b)))
    for bad in (0, -1, (1, 2)):
        with pytest.raises(ValueError):
            measure.volume(A, bad)


def test_objects_are_apart(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0)], "object_id long, x long, y long, z long")
    assert {r.object_id: r.volume for r in measure.volume(df).collect()} == {1: 2, 2: 1}
    assert {r.object_id: r.surface_area for r in measure.surface_area(df).collect()} == {1: 10, 2: 6}
    assert graph.connected_components(df, 26).select("label").distinct().count() == 2


def test_downsample(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 5), (4, 0, 0, 3), (-1, -2, -3, 7)], "x long, y long, z long, v long")
    assert got(pool.downsample(df, 2)) == [(-1, -1, -2), (0, 0, 0), (2, 0, 0)]
    for agg, want in (("max", 5), ("min", 1), ("sum", 6), ("mean", 3.0)):
        assert {(r.x, r.v) for r in pool.downsample(df, 2, ["v"], agg).collect()} == {(-1, 7), (0, want), (2, 3)}
    for bad in (0, 1.5, (1, 2)):
        with pytest.raises(ValueError):
            pool.downsample(df, bad)
    with pytest.raises(ValueError):
        pool.downsample(df, 2, ["v"], "mode")


def test_golden_faces(spark):
    assert stencil.exposed_faces(solid_cube(spark, 3)).count() == 54
    assert stencil.exposed_faces(hollow_box(spark)).count() == 6 * 49 + 6 * 9
