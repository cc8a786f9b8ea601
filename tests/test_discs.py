import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import discs, joins, metrics

SCHEMA = "X double, Y double, HeightAboveGround double, Classification int, ReturnNumber int"


def scene(spark, n, seed, at=(308000.0, 4688000.0)):
    """Points with ties, repeats, missing heights, some exactly on a disc's edge."""
    rng = np.random.default_rng(seed)
    rows = [(at[0] + float(x), at[1] + float(y), float(h), int(c), int(r)) for x, y, h, c, r in zip(*np.round(rng.uniform(0, 20, (2, n)), 1), np.round(rng.uniform(-1, 83, n), 1), rng.choice([1, 2, 3, 4, 5], n), rng.choice([1, 2], n))]
    rows += rows[: n // 10] + [(at[0] + 5.0, at[1] + 13.0, None, 5, 1), (at[0] + 5.0, at[1] + 13.0, float("nan"), 3, 1), (at[0] + 13.0, at[1] + 5.0, 40.0, 5, 1), (at[0] - 3.0, at[1] + 5.0, 80.0, 4, None)]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("parts", [1, 8])
def test_discs_equal_all_pairs(spark, parts):
    p = scene(spark, 600, parts)
    centres = spark.createDataFrame([(1, 308005.0, 4688005.0), (2, 308012.3, 4688011.1), (3, 309000.0, 4688000.0), (4, 308030.0, 4688010.0), (5, None, 4688000.0)], "id int, cx double, cy double")
    plain = {r["id"]: r for r in metrics.structure(joins.disc_join(centres, p, 8.0), ["id"], math.pi * 64, min_density=0.1).collect()}
    rows = {r["id"]: r for r in metrics.disc_metrics(centres, p, ["id"], 8.0, min_density=0.1, parts=parts).collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and 1 in plain
    for key, r in rows.items():
        for name in metrics.METRICS:
            assert same(r[name], plain[key][name] if key in plain else None), (key, name)
    gaps = {r["id"]: r for r in metrics.disc_gap(centres, p, ["id"], 8.0, parts=parts).collect()}
    found = joins.disc_join(centres, p, 8.0)
    for key, r in {r["id"]: r for r in metrics.gap_counts(found, ["id"], math.pi * 64).collect()}.items():
        assert r == gaps[key]
    assert len(gaps) == found.select("id").distinct().count()


def test_plots_count_all_points(spark):
    p = scene(spark, 200, 5)
    plots = spark.createDataFrame([("a", 308005.0, 4688005.0), ("b", 0.0, 0.0)], "plot string, px double, py double")
    rows = {r["plot"]: r for r in metrics.plot_metrics(plots, p, "plot", 8.0, ("h95",)).collect()}
    assert rows["a"]["n_points"] == joins.disc_join(plots, p, 8.0, "px", "py").where("plot = 'a'").count() and rows["b"]["n_points"] == 0 and rows["b"]["h95"] is None
    assert metrics.plot_metrics(plots, p.limit(0), "plot", 8.0, ("h95", "cc")).where("n_points = 0").count() == 2


def test_whole_cells_are_not_met_by_point(spark):
    dense = spark.range(40000).select((F.col("id") % 200 / 10.0).alias("X"), (F.expr("id div 200") / 10.0).alias("Y"))
    cells = discs.disc_cells(spark.createDataFrame([(1, 10.0, 10.0)], "id int, cx double, cy double"), ["id"], 8.0, parts=8)
    met = cells.where("not __whole").join(discs.celled(dense, 8.0, 8), ["__kx", "__ky"]).count()
    inside = joins.disc_join(spark.createDataFrame([(1, 10.0, 10.0)], "id int, cx double, cy double"), dense, 8.0).count()
    assert discs.disc_parts(dense, 8.0) == 16 and discs.disc_parts(dense, 8.0, 16) == 8 and discs.disc_parts(dense.where("X < 0"), 8.0) == 0
    assert met < inside / 2 and cells.count() < 300
    with pytest.raises(ValueError):
        discs.disc_cells(cells, ["id"], 0.0, parts=8)
