import itertools

import numpy as np
import pytest

from voxmill.kernels import lattice, skeletons, thinning, tubes
from voxmill.operators import skeleton
from voxmill.operators.frame import from_points
from voxmill.sources.clouds import solid_cylinder


def cube(k):
    return np.array(list(itertools.product(range(k), repeat=3)))


def cylinder(r=4, length=20):
    g = np.array(list(itertools.product(range(2 * r + 1), range(2 * r + 1), range(length))))
    return g[((g[:, :2] - r) ** 2).sum(1) <= r * r]


def annulus(outer=9, inner=5):
    g = np.array(list(itertools.product(range(-outer, outer + 1), range(-outer, outer + 1), (0,))))
    d = (g**2).sum(1)
    return g[(d <= outer**2) & (d >= inner**2)]


def parts(v):
    v = lattice.sort_rows(v)
    return len(set(lattice.roots(len(v), lattice.edges_of(lattice.neighbour_table(v))).tolist()))


def test_thin_fixed_points():
    line = np.array([(i, 0, 0) for i in range(10)])
    assert (thinning.thin(line) == line).all()
    assert len(thinning.thin(np.array([(3, 3, 3)]))) == 1


@pytest.mark.parametrize("shape", [cube(5), cylinder(), annulus(), np.r_[cube(3), cube(3) + 9]])
def test_thin_keeps_topology(shape):
    left = thinning.thin(shape)
    assert set(map(tuple, left.tolist())) <= set(map(tuple, shape.tolist()))
    assert parts(left) == parts(shape)
    s = set(map(tuple, left.tolist()))
    assert not any(all(tuple(np.add(p, d)) in s for d in itertools.product((0, 1), repeat=3)) for p in s)
    pairs = skeletons.reduce_edges(left, lattice.edges_of(lattice.neighbour_table(left)))
    loops = len(pairs) - len(left) + parts(left)
    assert loops == (1 if len(shape) == len(annulus()) else 0)
    assert (thinning.thin(left) == left).all()


def test_simple_points_by_definition():
    r = np.random.default_rng(0)
    for _ in range(300):
        mask = int(r.integers(0, 1 << 26))
        near = {tuple(o) for k, o in enumerate(lattice.OFFSETS.tolist()) if mask >> k & 1}

        def count(cells, steps, start=None):
            left, n = set(cells), 0
            while left:
                todo = [left.pop()]
                part = set(todo)
                while todo:
                    p = todo.pop()
                    for q in list(left):
                        if steps(np.abs(np.subtract(p, q))):
                            left.remove(q)
                            part.add(q)
                            todo.append(q)
                n += start is None or bool(part & start)
            return n

        faces = {d for d in thinning.DIRECTIONS}
        empty = {tuple(o) for o in lattice.OFFSETS.tolist() if np.abs(o).sum() <= 2} - near
        want = count(near, lambda d: d.max() <= 1) == 1 and count(empty, lambda d: d.sum() <= 1, faces) == 1
        assert bool(thinning.is_simple(np.array([mask]))[0]) == want


def forest(n, pairs):
    return len(pairs) == n - len(set(lattice.roots(n, pairs).tolist()))


@pytest.mark.parametrize("branching", ["exact", "tree", "fast", 3])
def test_teasar(branching):
    v = lattice.sort_rows(cylinder(4, 40))
    s = np.ones(3)
    nodes, pairs, radii, _ = skeletons.teasar(v, lattice.distances(v, s), s, branching=branching)
    assert forest(len(nodes), pairs) and np.ptp(nodes[:, 2]) >= 30
    mid = nodes[(nodes[:, 2] > 10) & (nodes[:, 2] < 30)]
    assert np.abs(mid[:, :2] - 4).max() <= 2 and radii.max() == pytest.approx(lattice.distances(v, s).max())


def test_wavefront():
    v = cylinder(8, 80)
    nodes, pairs, radii, counts = skeletons.wavefront(v, np.ones(3))
    assert counts.sum() == len(v) and forest(len(nodes), pairs)
    far = nodes[:, 2].argsort()[len(nodes) // 4 : len(nodes) // 2]  # the wave is round near its start, at either end
    near = nodes[:, 2].argsort()[len(nodes) // 2 : 3 * len(nodes) // 4]
    inner = min(far, near, key=lambda k: np.abs(radii[k] - 8).max())
    assert np.abs(nodes[inner][:, :2] - 8).max() < 0.3 and radii[inner] == pytest.approx(8, abs=0.3)
    nodes, pairs, _, _ = skeletons.wavefront(annulus(), np.ones(3), tree=False)
    assert len(pairs) - len(nodes) + 1 == 1
    nodes, pairs, radii, _ = skeletons.wavefront(cube(6), np.ones(3), step=100)
    assert len(nodes) == 1 and radii[0] == pytest.approx(np.cbrt(3 * 216 / (4 * np.pi)))


def test_prune_and_groups():
    nodes = np.array([(x, 0, 0) for x in range(7)] + [(3, 1, 0)])
    pairs = np.array([(i, i + 1) for i in range(6)] + [(3, 7)])
    rows, left = skeletons.prune_spurs(nodes, pairs, 1.5, np.ones(3))
    assert rows.tolist() == list(range(7)) and len(left) == 6
    assert skeletons.group_value(np.array([1.0, 2.0, 5.0]), np.array([0, 0, 1]), 2, "percentile75").tolist() == [1.0, 5.0]


def test_tube_of_a_disc():
    v = lattice.sort_rows(cylinder(6, 12))
    nodes = np.array([(6.0, 6.0, z) for z in range(12)])
    pairs = np.array([(i, i + 1) for i in range(11)])
    p = tubes.profile(v, nodes, pairs, np.full(12, 6.0), np.ones(3), k=1, n_theta=4)
    assert p["a0"][1:-1] == pytest.approx(6.5) and p["mag"][1:-1] == pytest.approx(0)
    assert (p["flags"][[0, -1]] & tubes.BRANCH_END).all() and not (p["flags"] & tubes.NON_STAR).any()
    assert np.linalg.norm(p["frame"], axis=1) == pytest.approx(1)
    out = tubes.profile(v, nodes + 50, pairs, np.full(12, 6.0), np.ones(3))
    assert (out["flags"] & tubes.SEED_OUTSIDE).all() and (out["a0"] == 0).all()


def test_frames_are_orthonormal():
    t = np.linspace(0, 6, 40)
    pts = np.stack([np.cos(t), np.sin(t), t / 3], axis=1)
    pairs = np.array([(i, i + 1) for i in range(39)])
    tangent, u, v, branch, end = tubes.frames(pts, tubes.branches(40, pairs))
    m = np.stack([u, v, tangent], axis=2)
    assert np.allclose(np.swapaxes(m, 1, 2) @ m, np.eye(3)) and np.allclose(np.linalg.det(m), 1)
    assert end.sum() == 2 and (branch == 0).all()


def test_operators(spark):
    two = solid_cylinder(spark, 3, 14).unionAll(solid_cylinder(spark, 3, 14).selectExpr("x + 30 AS x", "y", "z"))
    left = skeleton.thin(two).count()
    assert 0 < left < two.count()
    nodes, edges = skeleton.wavefront_skeletonize(two)
    n, e = nodes.count(), edges.count()
    assert n - e == 2 and nodes.agg({"n_voxels": "sum"}).first()[0] == two.count()
    assert sorted(r.node_id for r in nodes.collect()) == list(range(n))
    swc = skeleton.to_swc(nodes, edges).collect()
    assert [r.id for r in swc] == list(range(1, n + 1)) and sum(r.parent == -1 for r in swc) == 2
    assert {r.degree for r in skeleton.node_degrees(nodes, edges).collect()} <= {1, 2}
    profile, _ = skeleton.tube_coefficients(two, "wavefront", n_theta=16)
    again = skeleton.tube_profile(two, nodes, edges, n_theta=16)
    a = {r.node_id: r.a0 for r in profile.collect()}
    assert {r.node_id: r.a0 for r in again.collect()} == pytest.approx(a)
    ring = skeleton.evaluate(profile, 8)
    assert ring.count() == 8 * n
    assert len(skeleton.to_gpu_buffer(profile).first()["buffer"]) == 8 + 2 * 4
    tn, te = skeleton.thin_skeletonize(two)
    assert tn.count() - te.count() == 2
    cn, ce = skeleton.teasar_skeletonize(two, downsample=2)
    assert cn.count() - ce.count() == 2


def test_option_errors(spark):
    df = from_points(spark, [(0, 0, 0)])
    for call in (lambda: skeleton.teasar_skeletonize(df, branching="x"), lambda: skeleton.wavefront_skeletonize(df, radius_agg="x"), lambda: skeleton.wavefront_skeletonize(df, step_size=0.1), lambda: skeleton.tube_coefficients(df, K=40), lambda: skeleton.tube_coefficients(df, "x")):
        with pytest.raises(ValueError):
            call()


def test_wave_front_distances():
    """Against relaxation until nothing changes."""
    r = np.random.default_rng(8)
    v = lattice.sort_rows(r.integers(0, 7, (120, 3)))
    pairs = lattice.edges_of(lattice.neighbour_table(v))
    points = v * np.array([1.0, 2.0, 3.5])
    far = np.full(len(v), np.inf)
    far[[3, 40]] = 0
    length = np.linalg.norm(points[pairs[:, 0]] - points[pairs[:, 1]], axis=1)
    for _ in range(len(v)):
        np.minimum.at(far, pairs[:, 1], far[pairs[:, 0]] + length)
        np.minimum.at(far, pairs[:, 0], far[pairs[:, 1]] + length)
    paths = lattice.Paths(points, pairs)
    assert paths.distances([3, 40]) == pytest.approx(far)
    assert paths.field([3, 40], np.zeros(len(v)))[0] == pytest.approx(far)


def test_roots_are_least_rows():
    r = np.random.default_rng(9)
    for n, m in ((1, 0), (50, 20), (400, 390), (300, 299)):
        pairs = np.sort(r.integers(0, n, (m, 2)), axis=1) if m != 299 else np.stack([np.arange(299), np.arange(1, 300)], axis=1)
        want = np.arange(n)
        for _ in range(n):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        assert (lattice.roots(n, pairs) == want).all()
    for seed in range(200):
        r = np.random.default_rng(seed)
        pairs = r.integers(0, 400, (int(r.integers(1, 500)), 2))
        up = list(range(400))
        for a, b in pairs.tolist():
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        want = []
        for x in range(400):
            while up[x] != x:
                x = up[x]
            want.append(x)
        assert lattice.roots(400, pairs).tolist() == want


def test_long_sides_of_triangles():
    r = np.random.default_rng(10)
    v = lattice.sort_rows(r.integers(0, 4, (30, 3)))
    pairs = lattice.edges_of(lattice.neighbour_table(v))
    size = lambda a, b: ((v[a] - v[b]) ** 2).sum()
    has = {tuple(p) for p in pairs.tolist()} | {tuple(p[::-1]) for p in pairs.tolist()}
    want = [[a, b] for a, b in pairs.tolist() if not any((a, c) in has and (c, b) in has and max(size(a, c), size(c, b)) < size(a, b) for c in range(len(v)))]
    assert skeletons.reduce_edges(v, pairs).tolist() == want


def test_straightness():
    line = np.c_[np.arange(40.0), np.zeros((40, 2))]
    blob = np.random.default_rng(1).normal(0, 3, (400, 3)) + 100
    s = skeletons.straightness(np.r_[line, blob], 6.0)
    assert s[:40].min() > 0.99 and np.median(s[40:]) < 0.5


def test_rays_against_small_steps():
    r = np.random.default_rng(12)
    v = lattice.sort_rows(np.argwhere(r.random((12, 12, 12)) < 0.75))
    look = lattice.Lookup(v)
    origin = v[r.integers(0, len(v), 60)] + r.uniform(-0.4, 0.4, (60, 3))
    way = r.normal(size=(60, 3))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    limit = np.full(60, 9.0)
    radius, escaped, again = tubes.cast(look, origin, way, limit, 1.0)
    t = np.arange(0, 9, 1e-3)
    for k in range(60):
        full = look.rows(np.rint(origin[k] + t[:, None] * way[k]).astype(np.int64)) >= 0
        if full.all():
            assert escaped[k] and radius[k] == 9
            continue
        first = t[(~full).argmax()]
        assert not escaped[k] and abs(radius[k] - first) < 2e-3
        back = full & (t > first + 2e-3) & (t < min(9, 2 * first) - 2e-3)
        assert again[k] or not back.any()
