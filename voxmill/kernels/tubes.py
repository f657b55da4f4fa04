"""Tube profiles: along a skeleton, the distance to the surface all around as a Fourier series."""

from __future__ import annotations

import numpy as np

from voxmill.kernels.lattice import Lookup

#: Bits of a node's flags.
JUNCTION, NON_STAR, SEED_OUTSIDE, RAY_ESCAPED, BRANCH_END = 1, 2, 4, 8, 16


def branches(n: int, pairs: np.ndarray) -> list[list[int]]:
    """Longest paths through nodes of degree two with the nodes that end them, longest first; a cycle comes back to its start."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in pairs.tolist():
        near[a].append(b)
        near[b].append(a)
    used, out = set(), []

    def follow(path):
        while len(near[path[-1]]) == 2 and path[-1] != path[0]:
            a, b = near[path[-1]]
            path.append(b if a == path[-2] else a)
        used.update(frozenset(e) for e in zip(path[:-1], path[1:], strict=True))
        return path

    for u in range(n):
        if not near[u]:
            out.append([u])
        elif len(near[u]) != 2:
            out += [follow([u, w]) for w in sorted(near[u]) if frozenset((u, w)) not in used]
    for u in range(n):
        if len(near[u]) == 2 and frozenset((u, near[u][0])) not in used:
            out.append(follow([u, min(near[u])]))
    return sorted(out, key=len, reverse=True)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n > 0 else np.zeros(3)


def across(t: np.ndarray) -> np.ndarray:
    """A unit vector at right angles to the unit vector t, without a case of its own near any axis (Duff et al., 2017)."""
    x, y, z = t
    side = 1.0 if z >= 0 else -1.0
    share = -1 / (side + z)
    return np.array([1 + side * share * x * x, side * share * x * y, -side * x])


def carried(u: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """u, at right angles to the unit vector s, after the smallest rotation that takes s to the unit vector t."""
    turn = 1 + s @ t
    # below this the two are opposite to the accuracy of doubles, and u is at right angles to both
    new = u - (u @ t) / turn * (s + t) if turn > 1e-12 else u
    new = new - (new @ t) * t
    return unit(new)


def frames(points: np.ndarray, paths: list[list[int]]):
    """Tangent, u, v, branch and end of each node: frames that turn least along a branch. A node of several branches takes the last."""
    n = len(points)
    t, u, v = (np.zeros((n, 3)) for _ in range(3))
    branch, end = np.full(n, -1, np.int64), np.zeros(n, bool)
    for k, path in enumerate(paths):
        closed = len(path) > 2 and path[0] == path[-1]
        for i, p in enumerate(path):
            before = path[i - 1] if i else path[-2] if closed else p
            after = path[i + 1] if i + 1 < len(path) else path[1] if closed else p
            way = unit(points[after] - points[before])
            t[p] = way if way.any() else (0, 0, 1)
            branch[p] = k
            if not closed and i in (0, len(path) - 1):
                end[p] = True
    for path in paths:
        u[path[0]] = across(t[path[0]])
        for a, b in zip(path[:-1], path[1:], strict=True):
            u[b] = carried(u[a], t[a], t[b])
    v = np.cross(t, u)
    return t, u, v, branch, end


def quaternions(u: np.ndarray, v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(x, y, z, w >= 0) of the rotation with columns u, v, t."""
    m = np.stack([u, v, t], axis=2)
    q = np.zeros((len(m), 4))
    for k, a in enumerate(m):
        # the largest of the four squares first, for accuracy
        squares = np.array([1 + a[0, 0] - a[1, 1] - a[2, 2], 1 - a[0, 0] + a[1, 1] - a[2, 2], 1 - a[0, 0] - a[1, 1] + a[2, 2], 1 + a[0, 0] + a[1, 1] + a[2, 2]])
        i = int(squares.argmax())
        x, y, z = a[2, 1] - a[1, 2], a[0, 2] - a[2, 0], a[1, 0] - a[0, 1]
        row = ((squares[0], a[0, 1] + a[1, 0], a[0, 2] + a[2, 0], x), (a[0, 1] + a[1, 0], squares[1], a[1, 2] + a[2, 1], y), (a[0, 2] + a[2, 0], a[1, 2] + a[2, 1], squares[2], z), (x, y, z, squares[3]))[i]
        q[k] = np.array(row) / np.linalg.norm(row)
    return np.where(q[:, 3:] < 0, -q, q)


def cast(look: Lookup, origin: np.ndarray, way: np.ndarray, limit: np.ndarray, star: float | None):
    """First exit of each ray from the voxels, whether it reached its limit instead, and whether it comes in again by (1 + star) times the exit.

    `way` is such that a ray's parameter is the physical distance. The parameters at which a ray passes from cell to cell are known in
    advance for each axis; sorted together (x, then y, first where they tie) they give all its cells at once. Rays are read
    up to a horizon that doubles for those not settled.
    """
    n = len(origin)
    radius, escaped, again = limit.astype(float).copy(), np.ones(n, bool), np.zeros(n, bool)
    cell, speed = np.rint(origin).astype(np.int64), np.abs(way)
    turn = np.sign(way).astype(np.int64)
    horizon, live = 8 / max(float(speed.max(initial=0)), 1e-300), np.arange(n)
    while len(live):
        far = np.minimum(limit[live], horizon)
        times = []
        for axis in range(3):
            v, lead = speed[live, axis], (cell[live, axis] - origin[live, axis]) * turn[live, axis] + 0.5
            count = int(np.ceil(max(float((far * v).max()), 0.0))) + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.maximum((lead[:, None] + np.arange(count)) / v[:, None], 0)
            times.append(np.where((v[:, None] > 0) & (t <= far[:, None]), t, np.inf))
        every = np.concatenate(times, axis=1)
        axis = np.repeat(np.arange(3), [t.shape[1] for t in times])
        order = np.argsort(every, axis=1, kind="stable")
        every, axis = np.take_along_axis(every, order, axis=1), axis[order]
        steps = int(np.isfinite(every).sum(axis=1).max(initial=0))
        every, axis = every[:, :steps], axis[:, :steps]
        place = np.stack([cell[live, k, None] + turn[live, k, None] * np.cumsum(axis == k, axis=1) for k in range(3)], axis=2)
        real = np.isfinite(every)
        full = np.ones(every.shape, bool)
        full[real] = look.rows(place[real]) >= 0
        left = (~full).any(axis=1)
        at = np.where(left, (~full).argmax(axis=1), 0)
        out = every[np.arange(len(live)), at] if steps else np.zeros(len(live))
        radius[live[left]], escaped[live[left]] = out[left], False
        if star is None:
            settled = left
        else:
            reach = np.minimum(limit[live], (1 + star) * out)
            back = real & full & (np.arange(steps)[None, :] > at[:, None]) & (every <= reach[:, None])
            again[live] = left & back.any(axis=1)
            settled = left & ((reach <= far) | again[live])
        live = live[~settled & (far < limit[live])]
        horizon *= 2
    return radius, escaped, again


def fourier(r: np.ndarray, k: int):
    """Mean, magnitudes and phases of the first k harmonics, and the root mean square of what they leave.

    The samples are projected on a constant and on rows of cosines and sines; the rest is what the projection misses.
    """
    theta = 2 * np.pi * np.arange(r.shape[1]) / r.shape[1]
    order = np.arange(1, k + 1)[:, None]
    rows = np.concatenate([np.ones((1, len(theta))), np.cos(order * theta), np.sin(order * theta)])
    share = r @ np.linalg.pinv(rows)
    a, b = share[:, 1 : k + 1], share[:, k + 1 :]
    return share[:, 0], np.hypot(a, b), np.arctan2(b, a), np.sqrt(((r - share @ rows) ** 2).mean(axis=1))


def profile(voxels: np.ndarray, nodes: np.ndarray, pairs: np.ndarray, radii: np.ndarray | None, spacing: np.ndarray, k: int = 4, n_theta: int = 64, max_radius: float | None = None, star: float | None = 1.0) -> dict[str, np.ndarray]:
    """Columns of the nodes: a0, mag, phase, frame, branch, flags, residual, non_star. voxels: sorted and distinct."""
    n, look, points = len(nodes), Lookup(voxels), nodes * spacing
    paths = branches(n, pairs)
    t, u, v, branch, end = frames(points, paths)
    degree = np.bincount(pairs.ravel(), minlength=n)
    flags = np.where(end, BRANCH_END, 0)
    joint = degree > 2
    if len(pairs):
        both = np.r_[pairs, pairs[:, ::-1]]
        joint[both[joint[both[:, 0]], 1]] = True
    flags[joint] |= JUNCTION
    if max_radius is not None:
        limit = np.full(n, float(max_radius))
    elif radii is not None:
        limit = np.maximum(4 * radii, 2 * np.linalg.norm(spacing))
    else:
        limit = np.full(n, 64 * spacing.max())
    inside = look.rows(np.rint(nodes).astype(np.int64)) >= 0
    flags[~inside] |= SEED_OUTSIDE
    theta = 2 * np.pi * np.arange(n_theta) / n_theta
    r, non_star = np.zeros((n, n_theta)), np.zeros(n)
    for a in range(0, n, max(1, 200_000 // n_theta)):
        own = a + np.flatnonzero(inside[a : a + max(1, 200_000 // n_theta)])
        if not len(own):
            continue
        way = (np.cos(theta)[None, :, None] * (u[own] / spacing)[:, None] + np.sin(theta)[None, :, None] * (v[own] / spacing)[:, None]).reshape(-1, 3)
        got, escaped, again = cast(look, np.repeat(nodes[own], n_theta, 0), way, np.repeat(limit[own], n_theta), star)
        r[own] = got.reshape(-1, n_theta)
        non_star[own] = again.reshape(-1, n_theta).mean(1)
        flags[own] |= np.where(escaped.reshape(-1, n_theta).any(1), RAY_ESCAPED, 0) | np.where(non_star[own] > 0, NON_STAR, 0)
    a0, mag, phase, residual = fourier(r, k)
    return {"a0": a0, "mag": mag, "phase": phase, "frame": quaternions(u, v, t), "branch": branch, "flags": flags, "residual": residual, "non_star": non_star}
