"""Raster classifiers by cell: the same ground as from a tile's points, of which a task gets only the lowest by cell."""

import numpy as np
import pytest

from arbora.grid import Grid
from arbora.operators import ground


@pytest.mark.parametrize("method", ["pmf", "smrf", "csf"])
def test_ground_by_cells_is_that_of_points(spark, method):
    rng = np.random.default_rng(4)
    p = np.round(np.stack([*rng.uniform(0.02, 39.98, (2, 3000)), np.where(rng.random(3000) < 0.5, 0, rng.uniform(0, 20, 3000))], axis=1), 2)
    points = spark.createDataFrame([(k, *map(float, v), 1) for k, v in enumerate(p)], "id long, X double, Y double, Z double, Classification int")
    out = ground.classify(points, Grid.from_bbox(0, 0, 40, 40, 10.0), 40.0, 10.0, method)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [tile" in plan[plan.index("FlatMapGroupsInPandas") :]
    found = {r["id"]: r["is_ground"] for r in out.collect()}
    assert [found[k] for k in range(len(p))] == ground.METHODS[method]()(*p.T).tolist() and 500 < sum(found.values()) < 2500
