import numpy as np
import pytest

from voxmill.kernels import lattice, tubes
from voxmill.operators import graph, morph, skeleton, sparse
from voxmill.operators.frame import from_points, pack, unpack
from voxmill.sources.clouds import solid_cylinder


def points(df):
    return sorted(tuple(r) for r in df.select("x", "y", "z").distinct().collect())


def array(spark, rows, shape=(4, 4, 4), kind="float"):
    return sparse.SparseArray(spark.createDataFrame(rows, f"x long, y int, z long, value {kind}"), shape)


def test_arrays_to_voxels_and_back(spark):
    a = array(spark, [(0, 1, 2, 5.0), (1, 1, 1, 0.0), (2, 2, 2, None), (3, 3, 3, -1.0)])
    assert sparse.is_sparse(a) and not sparse.is_sparse(a.cells)
    assert points(sparse.to_voxels(a)) == [(0, 1, 2), (3, 3, 3)]
    back = sparse.to_sparse_like(from_points(spark, [(0, 0, 0), (0, 0, 0), (9, 1, 1)]), a)
    assert back.shape == (10, 4, 4) and back.cells.schema["value"].dataType.simpleString() == "float"
    assert sorted(map(tuple, back.cells.collect())) == [(0, 0, 0, 1.0), (9, 1, 1, 1.0)]
    with pytest.raises(ValueError):
        sparse.to_sparse_like(from_points(spark, [(0, -1, 0)]), a)
    with pytest.raises(TypeError):
        sparse.to_voxels(sparse.SparseArray(a.cells, (4, 4)))


def test_operators_on_arrays(spark):
    cube = [(x, y, z, 1.0) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4)]
    dilate, plain = sparse.sparse_aware(mirror=True)(morph.dilate), sparse.sparse_aware()(morph.dilate)
    grown = dilate(array(spark, cube))
    assert grown.shape == (5, 5, 5) and grown.cells.count() == 27 + 54
    assert points(plain(array(spark, cube))) == points(grown.cells) == points(dilate(from_points(spark, [r[:3] for r in cube])))


def test_pack_and_unpack(spark):
    rows = [(0, 0, 0), (5, 6, 7), (2**21 - 1, 0, 2**21 - 1)]
    df = pack(from_points(spark, rows))
    assert sorted(r.packed for r in df.collect()) == sorted((x << 42) | (y << 21) | z for x, y, z in rows)
    assert points(unpack(df.select("packed"))) == sorted(rows)
    assert points(unpack(pack(from_points(spark, [(30, 2, 1)]), (5, 2, 1)).select("packed"), (5, 2, 1))) == [(30, 2, 1)]
    assert [r.packed for r in pack(from_points(spark, [(-1, 0, 0), (0, 4, 0)]), (5, 2, 1)).collect()] == [None, None]
    with pytest.raises(ValueError):
        pack(df, (30, 30, 30))


def test_edges_of_large_extent_and_objects(spark):
    far = [(0, 0, 0), (1, 1, 1), (2**22, 5, 5), (2**22, 5, 6)]
    assert graph.edges(from_points(spark, far))[1].count() == 2
    two = from_points(spark, far[:2]).selectExpr("1L AS object_id", "x", "y", "z").union(from_points(spark, far[:2]).selectExpr("2L AS object_id", "x", "y", "z"))
    assert sorted(map(tuple, graph.edges(two)[1].collect())) == [(0, 1), (2, 3)]


@pytest.fixture(scope="module")
def tube(spark):
    return skeleton.tube_coefficients(solid_cylinder(spark, 5, 16), "wavefront", n_theta=32)[0]


def test_profiles_are_saved_and_loaded(spark, tube, tmp_path):
    skeleton.save_profile(tube, f"{tmp_path}/tube")
    assert sorted(map(str, skeleton.load_profile(spark, f"{tmp_path}/tube").collect())) == sorted(map(str, tube.collect()))
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        skeleton.load_profile(spark, f"{tmp_path}/other")
    swc = skeleton.to_skeleton(tube).collect()
    assert len(swc) == tube.count() and all(r.radius == pytest.approx(a.a0) for r, a in zip(sorted(swc, key=lambda r: r.node_id), sorted(tube.collect(), key=lambda r: r.node_id), strict=True))


def test_series_derivatives_and_normals(tube):
    angles = [2 * np.pi * i / 16 for i in range(16)]
    at = lambda d, shift=0.0: np.array([r.r for r in skeleton.radius_at(tube, [a + shift for a in angles], derivative=d).orderBy("node_id", "theta").collect()])
    eps = 1e-4
    assert at(1) == pytest.approx((at(0, eps) - at(0, -eps)) / (2 * eps), abs=1e-5)
    assert at(2) == pytest.approx((at(1, eps) - at(1, -eps)) / (2 * eps), abs=1e-5)
    c = {r.node_id: r for r in skeleton.coefficients(tube).collect()}
    for r in tube.collect():
        assert np.hypot(c[r.node_id].cosine, c[r.node_id].sine) == pytest.approx(r.mag, abs=1e-5)
    n = skeleton.normals(tube, 16).join(skeleton.frame_vectors(tube), "node_id").collect()
    for r in n:
        v = np.array([r.nx, r.ny, r.nz])
        out = np.cos(r.theta) * np.array(r.u) + np.sin(r.theta) * np.array(r.v)
        assert np.linalg.norm(v) == pytest.approx(1) and v @ np.array(r.t) == pytest.approx(0, abs=1e-5) and v @ out > 0
    with pytest.raises(ValueError):
        skeleton.radius_at(tube, [0.0], derivative=3)


def test_volumes_and_radii_of_nodes(spark):
    solid = solid_cylinder(spark, 4, 12)
    nodes, _ = skeleton.wavefront_skeletonize(solid)
    volume = sum(r.volume for r in skeleton.node_volumes(nodes, (1, 2, 3)).collect())
    assert volume == solid.count() * 6
    v = lattice.sort_rows([tuple(r) for r in solid.collect()])
    out = np.array([p for p in np.ndindex(15, 15, 18) if tuple(np.subtract(p, 3)) not in set(map(tuple, v))]) - 3
    place = {r.node_id: (r.x, r.y, r.z) for r in nodes.collect()}
    for r in skeleton.nearest_radii(nodes, solid, (1, 1, 2)).collect():
        assert r.radius == pytest.approx(np.sqrt((((out - place[r.node_id]) * (1, 1, 2)) ** 2).sum(1).min()))
    lone = spark.createDataFrame([(0, 50.0, 50.0, 50.0)], "node_id long, x double, y double, z double")
    assert skeleton.nearest_radii(lone, solid).first().radius == 0


def test_series_by_projection():
    r = np.random.default_rng(3).uniform(1, 5, (6, 16))
    a0, mag, phase, rest = tubes.fourier(r, 3)
    theta = 2 * np.pi * np.arange(16) / 16
    fit = a0[:, None] + sum(mag[:, k - 1, None] * np.cos(k * theta - phase[:, k - 1, None]) for k in (1, 2, 3))
    c = np.fft.rfft(r, axis=1) / 16
    assert a0 == pytest.approx(c[:, 0].real) and mag == pytest.approx(2 * np.abs(c[:, 1:4]))
    assert rest == pytest.approx(np.sqrt(((r - fit) ** 2).mean(axis=1)))
