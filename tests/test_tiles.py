"""Tiles of equal load: limits, ownership, halos, and kernels that give the same on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.grid import Grid
from arbora.operators import ground, joins, surfaces, terrain

GRID = Grid.from_bbox(0.0, 0.0, 90.0, 60.0, 1.0)


@pytest.fixture(scope="module")
def uneven(spark):
    """Sparse points everywhere and a dense corner; some on tile edges, some outside the lattice."""
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-5, 95, 1500), rng.uniform(-5, 65, 1500)
    dx, dy = rng.uniform(62, 70, (2, 4000))
    x, y = np.r_[x, dx, 30.0, 30.0, 0.0, 45.0], np.r_[y, dy - 40, 30.0, 60.0, 15.0, 0.0]
    z = 100 + np.sin(x / 7) + np.cos(y / 5)
    cls = np.where(rng.random(len(x)) < 0.5, 2, 5)
    z = z + np.where(cls == 5, rng.uniform(2, 9, len(x)), 0)
    rows = [(k, *map(float, v[:3]), int(v[3]), 1, 1) for k, v in enumerate(zip(x, y, z, cls, strict=True))]
    return spark.createDataFrame(rows, "id bigint, X double, Y double, Z double, Classification int, ReturnNumber int, NumberOfReturns int").cache()


def test_no_tile_over_the_limit(uneven):
    even = GRID.balanced(uneven, 30.0, 300)
    owned = even.halo(uneven, 30.0, 0.0).where("is_core")
    counts = [r["count"] for r in owned.groupBy("tile").count().collect()]
    assert max(counts) <= 300 and len(counts) > 12
    inside = uneven.where(GRID.owned())
    assert owned.count() == inside.count() == owned.select("id").distinct().count()
    assert max(r["count"] for r in GRID.halo(uneven, 30.0, 0.0).where("is_core").groupBy("tile").count().collect()) > 2000
    leaves = even.leaves.collect()
    assert sum((30.0 / 2 ** r["level"]) ** 2 for r in leaves) == 90 * 60 and len({tuple(r) for r in leaves}) == len(leaves)
    shallow = GRID.balanced(uneven, 30.0, 1, depth=1)
    assert {r["level"] for r in shallow.leaves.collect()} == {1}
    whole = GRID.balanced(uneven, 30.0, 10**6)
    assert whole.leaves.count() == 6 and whole.halo(uneven, 30.0, 0.0).where("is_core").count() == inside.count()
    with pytest.raises(ValueError):
        even.halo(uneven, 15.0, 0.0)
    with pytest.raises(ValueError):
        GRID.balanced(uneven, 30.0, 0)
    assert GRID.balanced(uneven.limit(0), 30.0, 10).leaves.count() == 6


def test_halos_are_whole(uneven):
    even, buffer = GRID.balanced(uneven, 30.0, 300), 4.0
    got = {}
    for r in even.halo(uneven.select("id", "X", "Y"), 30.0, buffer).collect():
        assert (r["tile"], r["id"]) not in got
        got[r["tile"], r["id"]] = r["is_core"]
    points = uneven.select("id", "X", "Y").collect()
    base = {r["tile"]: None for r in even.halo(uneven.select("id", "X", "Y"), 30.0, 0.0).select("tile").distinct().collect()}
    core = {}
    for (tile, i), own in got.items():
        if own:
            core.setdefault(tile, []).append(i)
    assert set(core) <= set(base) | set(core)
    where = {p["id"]: (p["X"], p["Y"]) for p in points}
    for tile, ids in list(core.items())[:15]:
        near = {i for (t, i) in got if t == tile}
        for a in ids[:20]:
            assert {b for b, (x, y) in where.items() if max(abs(x - where[a][0]), abs(y - where[a][1])) <= buffer and (-4 <= x <= 94 and -4 <= y <= 64)} <= near


def test_kernels_agree_on_equal_tiles(uneven):
    even = GRID.balanced(uneven, 30.0, 400)
    heights = lambda g: {r["id"]: r["HeightAboveGround"] for r in terrain.normalise(uneven, g, 30.0, 12.0).collect()}
    a, b = heights(GRID), heights(even)
    assert a.keys() == b.keys() and sum(abs(a[k] - b[k]) > 1e-9 for k in a) <= 0.01 * len(a)  # but where the outline of all ground is near
    cells = lambda g: {(r["row"], r["col"]): r["value"] for r in terrain.dtm(uneven, g, 30.0, 12.0).collect()}
    a, b = cells(GRID), cells(even)
    assert a.keys() == b.keys() and sum(abs(a[k] - b[k]) > 1e-9 for k in a) <= 0.01 * len(a)
    known = uneven.withColumn("HeightAboveGround", F.col("Z") - 100)
    free = lambda g: {(r["row"], r["col"]): r["value"] for r in surfaces.spike_free(known, g, 30.0, 12.0, freeze=2.0).collect()}
    a, b = free(GRID), free(even)
    assert a.keys() == b.keys() and sum((a[k] is None) != (b[k] is None) or (a[k] is not None and abs(a[k] - b[k]) > 1e-9) for k in a) <= 0.02 * len(a)
    found = ground.classify(uneven, even, 30.0, 12.0, "smrf")
    assert found.count() == uneven.where(GRID.owned()).count()


def test_nearest_on_strongly_clustered_points(spark):
    rng = np.random.default_rng(9)
    x, y = np.r_[rng.normal(0, 0.05, 3000), rng.uniform(-500, 500, 200), [7.0] * 50], np.r_[rng.normal(0, 0.05, 3000), rng.uniform(-500, 500, 200), [7.0] * 50]
    points = spark.createDataFrame([(float(a), float(b), 0.0) for a, b in zip(x, y, strict=True)], "X double, Y double, Z double").cache()
    where = [(0.0, 0.0), (0.03, -0.05), (300.0, 10.0), (7.0, 7.0), (499.0, 499.0), (0.4, 0.4)]
    centres = spark.createDataFrame([(k, *w) for k, w in enumerate(where)], "id int, cx double, cy double")
    k = 6
    mean = 1.5 * float(np.sqrt(k * 1000.0 * 1000.0 / np.pi / len(x)))
    reach = joins.first_reach(points, k, mean, 1e-3)
    near_by = joins.disc_join(centres.where("id < 2"), points, reach).groupBy("id").count().collect()
    wide = joins.disc_join(centres.where("id < 2"), points, mean).groupBy("id").count().collect()
    assert max(r["count"] for r in near_by) <= 36 * k < min(r["count"] for r in wide)
    got = {}
    for r in joins.nearest(centres, points, "id", k).collect():
        got.setdefault(r["id"], []).append(r["distance2"])
    for i, (a, b) in enumerate(where):
        assert np.allclose(sorted(got[i]), np.sort((x - a) ** 2 + (y - b) ** 2)[:k])
