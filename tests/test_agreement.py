import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import columns as fn
from arbora.grid import Grid
from arbora.operators import scoring


def raster(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(values)], "row int, col int, value double")


def plain_plateaus(v):
    """Flood fill in place of runs and labels."""
    seen, firsts = set(), []
    for at in np.ndindex(v.shape):
        if at in seen or np.isnan(v[at]):
            continue
        firsts.append(at)
        stack = [at]
        while stack:
            r, c = stack.pop()
            if (r, c) in seen or not (0 <= r < v.shape[0] and 0 <= c < v.shape[1]) or v[r, c] != v[at]:
                continue
            seen.add((r, c))
            stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return firsts


def test_plateaus_equal_flood_fill(spark):
    v = np.random.default_rng(3).integers(0, 2, (14, 17)).astype(float)
    v[np.random.default_rng(4).random(v.shape) < 0.1] = np.nan
    v[2, 2:15], v[3, 14], v[4, 2:15], v[5, 2], v[6, 2:15] = 7, 7, 7, 7, 7  # a snake
    got = scoring.plateaus(raster(spark, v).where(~F.isnan("value")), 17).orderBy("row", "col").collect()
    assert [(r["row"], r["col"]) for r in got] == sorted(plain_plateaus(v))


def test_agreement_of_rasters(spark):
    a, b = np.ones((9, 9)), np.ones((9, 9))
    a[2, 2:5] = a[3, 3] = 8.0  # one plateau
    a[7, 7], a[0, 0] = 6.0, np.nan
    b[2, 2], b[8, 8] = 8.0, np.nan
    out = scoring.compare_rasters(raster(spark, a), raster(spark, b), 9, 9).first()
    assert (out["peaks"], out["found"], out["matched"], out["peak_precision"], out["peak_recall"]) == (2, 1, 1, 1.0, 0.5)
    assert out["shared_pixels"] == 79 and abs(out["candidate_coverage"] - 80 / 81) < 1e-12 and abs(out["coverage_disagreement"] - 2 / 81) < 1e-12 and abs(out["coverage"] - 79 / 80) < 1e-12
    assert abs(out["bias"] + (3 * 7 + 5) / 79) < 1e-12
    # without a least height a flat raster is one peak, and an empty one has none
    out = scoring.compare_rasters(raster(spark, np.zeros((4, 4))), raster(spark, np.full((4, 4), np.nan)), 4, 4, least_peak=None).first()
    assert (out["peaks"], out["found"], out["matched"], out["peak_precision"], out["shared_pixels"], out["bias"]) == (1, 0, 0, None, 0, None)


def test_reference_mosaic(spark):
    grid = Grid.from_bbox(0.0, 0.0, 4.0, 4.0, 1.0)
    tiles = spark.createDataFrame([("a", -2.0, 2.0, 2.0, 6.0, 1.0), ("b", 1.0, 0.0, 5.0, 4.0, 1.0), ("far", 50.3, 0.0, 54.3, 4.0, 7.0)], "tile string, min_x double, min_y double, max_x double, max_y double, resolution double")
    pixels = spark.createDataFrame([(t, r, c, None if (t, r, c) == ("b", 0, 0) else v) for t, v in (("a", 1.0), ("b", 2.0), ("far", 3.0)) for r in range(4) for c in range(4)], "tile string, row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in scoring.reference_mosaic(tiles, pixels, grid).collect()}
    want = {(r, c): 1.0 for r in range(2) for c in range(2)} | {(r, c): 2.0 for r in range(4) for c in range(1, 4) if (r, c) != (0, 1)}
    assert got == want
    for change, message in (({"min_x": 1.5, "max_x": 5.5}, "lattice"), ({"resolution": 2.0}, "resolution")):
        wrong = tiles.withColumns({c: F.when(F.col("tile") == "b", F.lit(v)).otherwise(F.col(c)) for c, v in change.items()})
        with pytest.raises(Exception, match=message):
            scoring.reference_mosaic(wrong, pixels, grid).collect()


def test_leaf_types(spark):
    codes = spark.createDataFrame([("FF1-00",), ("FP",), ("FO2",), ("FF31",), ("FF0",), ("LA4",), ("",), (None,)], "code string")
    assert [r[0] for r in codes.select(fn.leaf_code(F.col("code"))).collect()] == ["broadleaf", "broadleaf", "conifer", "mixed", None, None, None, None]
    shares = spark.createDataFrame([(0.75, 0.25, 0.0), (0.1, 0.6, 0.1), (0.4, 0.4, 0.0), (0.0, 0.0, 0.0)], "b double, c double, m double")
    assert [r[0] for r in shares.select(fn.leaf_type(F.col("b"), F.col("c"), F.col("m"))).collect()] == ["broadleaf", "conifer", "mixed", None]


def test_moments_without_spread(spark):
    pairs = spark.createDataFrame([(39.99, 39.99), (39.99, 39.99), (39.99, 38.0), (None, 1.0)], "a double, b double")
    r = scoring.moments(pairs, [], "a", "b").first()
    assert r["n"] == 3 and r["rmse"] > 1 and r["r2"] is None and r["r"] is None
    r = scoring.moments(pairs, [], "b", "a").first()
    assert r["r2"] < 0 and r["r"] is None
