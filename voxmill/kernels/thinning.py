"""Topological thinning of one component.

A pass visits the six border directions and in each the eight parity classes of absolute coordinates; in a class no two
voxels are neighbours, so all of its simple voxels go at once. A voxel is simple if its neighbours form one 26-component and
the empty cells of its 18-neighbourhood that reach its faces form one 6-component.
"""

from __future__ import annotations

import numpy as np

from voxmill.kernels.lattice import OFFSETS, neighbour_table, sort_rows

NORM = np.abs(OFFSETS).sum(1)
DIRECTIONS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
_BIT = {tuple(o): k for k, o in enumerate(OFFSETS.tolist())}
FACE_BITS = sum(1 << _BIT[d] for d in DIRECTIONS)
NEAR_BITS = sum(1 << k for k in range(26) if NORM[k] <= 2)


def _touching(norm: int, among: int) -> list[int]:
    """For each bit the bits within one step of the given norm (1: faces, 3: any) among a set of bits."""
    out = []
    for k in range(26):
        d = np.abs(OFFSETS - OFFSETS[k])
        near = (d.max(1) == 1) & (d.sum(1) <= norm)
        out.append(sum(1 << int(j) for j in np.flatnonzero(near)) & among)
    return out


TOUCH26, TOUCH6 = _touching(3, (1 << 26) - 1), _touching(1, NEAR_BITS)


def flood(seed: np.ndarray, allowed: np.ndarray, touch: list[int]) -> np.ndarray:
    """All bits that the seed bits reach within the allowed ones."""
    now = seed
    while True:
        new = now.copy()
        for k in range(26):
            new |= np.where((now >> k) & 1 == 1, touch[k], 0)
        new &= allowed
        if (new == now).all():
            return now
        now = new


def is_simple(mask: np.ndarray) -> np.ndarray:
    mask = mask.astype(np.int64)
    one = flood(mask & -mask, mask, TOUCH26) == mask
    empty = ~mask & NEAR_BITS
    faces = empty & FACE_BITS
    return (mask != 0) & one & (faces != 0) & (flood(faces & -faces, empty, TOUCH6) & FACE_BITS == faces)


def thin(voxels: np.ndarray, endpoints: bool = True, passes: int | None = None) -> np.ndarray:
    """The voxels that are left, sorted."""
    v = sort_rows(voxels)
    table = neighbour_table(v)
    mask = ((table >= 0).astype(np.int64) << np.arange(26)).sum(1)
    parity = ((v[:, 0] & 1) << 2) | ((v[:, 1] & 1) << 1) | (v[:, 2] & 1)
    alive, done, going = np.ones(len(v), bool), 0, True
    while going and (passes is None or done < passes):
        going = False
        for d in DIRECTIONS:
            border = np.flatnonzero(alive & ((mask >> _BIT[d]) & 1 == 0))
            for p in range(8):
                own = border[parity[border] == p]
                if endpoints:
                    own = own[np.bitwise_count(mask[own]) != 1]
                own = own[is_simple(mask[own])] if len(own) else own
                if not len(own):
                    continue
                going, alive[own] = True, False
                for k in range(26):
                    near = table[own, k]
                    near = near[near >= 0]
                    mask[near] &= ~(1 << (25 - k))  # offsets are symmetric: the opposite of bit k is bit 25 - k
        done += 1
    return v[alive]
