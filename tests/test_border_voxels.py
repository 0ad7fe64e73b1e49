"""Empty border voxels of points, found by blocks, against plain search."""

import random

import pytest

from molmill.operators import voxels as V


@pytest.mark.parametrize("side", [12, 17])
def test_empty_border_voxels(spark, side):
    """Points in the grid's corners, at edges of blocks, outside and beside a full block; voxels that are there twice in other channels."""
    rng = random.Random(side)
    points = [(m, i, rng.randrange(2), 1, *(rng.choice([-2, -1, 0, 7, 8, side - 1, side, side + 1, rng.randrange(side)]) for _ in "xyz")) for m in range(3) for i in range(30)]
    full = {(m, c, *(rng.randrange(side) for _ in "xyz")) for m in range(2) for c in range(2) for _ in range(side**3 // 3)}
    got = V._empty_border(spark.createDataFrame(points, "mol_id long, atom_idx long, channel int, n int, ix int, iy int, iz int"), spark.createDataFrame(sorted(full), "mol_id long, channel int, ix int, iy int, iz int"), side).collect()
    want = {}
    for m, i, c, _, *at in points:
        cells = {tuple(a + o for a, o in zip(at, off, strict=True)) for off in V.BORDER}
        want[m, i] = sorted(v for v in cells if all(0 <= a < side for a in v) and (m, c, *v) not in full)
    found = {(r.mol_id, r.atom_idx): sorted(map(tuple, r.empty)) for r in got}
    assert len(found) == len(got) and {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}
