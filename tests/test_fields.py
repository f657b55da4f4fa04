import numpy as np
import pytest

from voxmill.kernels.lattice import run_pass
from voxmill.operators import distance, filters
from voxmill.operators.frame import from_points


def field(seed=0, n=60, lo=0, hi=6):
    r = np.random.default_rng(seed)
    return [(*map(int, r.integers(lo, hi, 3)), float(r.integers(-5, 6))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "x long, y long, z long, v double")


def dense(rows, pad, hi=6):
    box = np.zeros((hi + 2 * pad,) * 3)
    for x, y, z, v in rows:
        box[x + pad, y + pad, z + pad] += v
    return box


def sparse(box, pad):
    return {tuple(int(c) - pad for c in p): box[tuple(p)] for p in np.argwhere(np.abs(box) > 1e-12)}


def collected(df):
    return {(r.x, r.y, r.z): r.v for r in df.collect() if abs(r.v) > 1e-12}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def along(box, kernel, axis):
    out, r = np.zeros_like(box), len(kernel) // 2
    for j, w in enumerate(kernel):
        out += w * np.roll(box, r - j, axis)
    return out


def test_correlate_separable(spark):
    rows, ks = field(1), ([1, 2, 0], [0.5, 1, 0.25], [1, 0, 3])
    box = dense(rows, 4)
    for axis, k in enumerate(ks):
        box = along(box, k, axis)
    same(collected(filters.correlate(frame(spark, rows), ks, ["v"])), sparse(box, 4))


def test_correlate_dense(spark):
    rows, k = field(2), np.random.default_rng(3).integers(-1, 2, (3, 3, 3)).astype(float)
    box, out = dense(rows, 3), 0
    for d in np.ndindex(3, 3, 3):
        out = out + k[d] * np.roll(box, [1 - c for c in d], (0, 1, 2))
    same(collected(filters.correlate(frame(spark, rows), k, ["v"])), sparse(out, 3))


def test_box_blur_of_one_voxel(spark):
    out = filters.correlate(frame(spark, [(0, 0, 0, 1.0)]), [[1 / 3] * 3] * 3, ["v"]).collect()
    assert len(out) == 27 and sum(r.v for r in out) == pytest.approx(1)


def test_smooth_keeps_mass_and_epsilon_prunes(spark):
    rows = [(x, y, z, abs(v) + 1) for x, y, z, v in field(4)]
    df = frame(spark, rows)
    out = collected(filters.smooth(df, ["v"], 0.7))
    assert sum(out.values()) == pytest.approx(sum(r[3] for r in rows))
    cut = collected(filters.smooth(df, ["v"], 0.7, epsilon=0.01))
    assert len(cut) < len(out)
    same(collected(filters.smooth(df, ["v"], 0)), collected(filters.correlate(df, [[1]] * 3, ["v"])))


@pytest.mark.parametrize("name", ["maximum", "minimum"])
def test_rank(spark, name):
    rows = field(5, 180)
    box = dense(rows, 2)
    f = np.maximum if name == "maximum" else np.minimum
    for axis in range(3):
        box = f(f(np.roll(box, 1, axis), box), np.roll(box, -1, axis))
    same(collected(getattr(filters, name)(frame(spark, rows), ["v"])), sparse(box, 2))


def test_filter_errors(spark):
    df = frame(spark, field())
    for call in (lambda: filters.correlate(df, [[1, 1]] * 3, ["v"]), lambda: filters.smooth(df, ["v"], -1), lambda: filters.maximum(df, ["v"], 2), lambda: filters.smooth(df, ["v"], 1, epsilon=-1)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("spacing", [None, (4, 4, 40), (3, 1, 2)])
def test_distance(spark, spacing):
    s = np.array(spacing or (1, 1, 1))
    pts = {tuple(map(int, p)) for p in np.random.default_rng(7).integers(0, 7, (400, 3))} | {(0, 0, 0)}
    back = np.array([p for p in np.ndindex(9, 9, 9) if tuple(np.subtract(p, 1)) not in pts]) - 1
    out = distance.distance_transform(from_points(spark, [*pts, (0, 0, 0), (0, 0, 0)]), spacing).collect()
    assert len(out) == len(pts) + 2
    for r in out:
        assert r.distance == pytest.approx(np.sqrt((((back - (r.x, r.y, r.z)) * s) ** 2).sum(1).min()))


@pytest.mark.parametrize("n", [1, 7, 48, 49, 300])
def test_runs_by_envelope(n):
    """Short runs by all pairs, long ones by the lower envelope: both against the definition."""
    r = np.random.default_rng(n)
    for share in (0.0, 0.3, 1.0):
        for step in (1.0, 2.5):
            g = np.where(r.random(n) < share, r.integers(1, 4 * n, n).astype(float), np.inf)
            ends = (step * np.minimum(np.arange(n) + 1, n - np.arange(n))) ** 2
            want = [min(ends[i], *(g + (step * (np.arange(n) - i)) ** 2)) for i in range(n)]
            assert run_pass(g, step) == pytest.approx(want)
