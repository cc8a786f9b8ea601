"""Plots, inventories, ingest stages, results and raster tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import GRID, plane_scene, points

from arbora.operators import allometry, ground, scoring
from arbora.plans import products
from arbora.sources import catalog
from arbora.sources.catalog import RasterStore
from arbora.sources.results import append_results, export_csv, read_results


def test_plot_metrics_from_raw_points(spark):
    plots = spark.createDataFrame([(1, 5.0, 5.0), (2, 500.0, 500.0)], "plot long, px double, py double")
    rows = {r["plot"]: r for r in products.compute_plot_metrics(plots, plane_scene(spark), "plot", 3.0, ("h95", "hmax", "cc"), margin=6.0).collect()}
    assert abs(rows[1]["h95"] - 10) < 1e-9 and rows[1]["n_points"] > 20
    assert rows[2]["n_points"] == 0 and rows[2]["h95"] is None


def test_naesset_validation(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(h), float(c), float(1.3 * h**1.5 * c**0.8), 1000.0 * (k % 6), 0.0, 500, float(h), float(h) + (30.0 if k % 10 == 0 else 0.0)) for k, (h, c) in enumerate(zip(rng.uniform(3, 30, 120), rng.uniform(0.1, 1, 120), strict=True))]
    rows.append((120, None, 0.0, 0.0, 0.0, 0.0, 500, None, 0.0))
    rows.append((121, 5.0, 0.5, None, 0.0, 0.0, 500, 5.0, 5.0))
    plots = spark.createDataFrame(rows, "plot long, h95 double, cc double, agb double, px double, py double, n_points int, hmax double, height_max double")
    found = allometry.calibrate_inventory(plots, block=1000.0, count=3)
    for name, n in (("all", 121), ("screened", 109)):
        model, predictions = found[name]
        assert np.allclose((model.a, model.b, model.c), (1.3, 1.5, 0.8), rtol=1e-4)
        rows = predictions.collect()
        scores = allometry.residual_summary(predictions, "agb").first()
        assert len(rows) == scores["n"] == n
        assert all(len({r["fold"] for r in rows if r["block"] == b}) == 1 for b in {r["block"] for r in rows})
        error = np.array([r["agb"] - r["predicted"] for r in rows])
        assert abs(scores["rmse"] - np.sqrt((error**2).mean())) < 1e-6 and scores["rmse"] < 0.1 and scores["r2"] > 0.999
    with pytest.raises(ValueError):
        allometry.validate_naesset(plots, "agb", "py", 2)


def test_ingest_stages(spark):
    scene = plane_scene(spark)
    given = scene.withColumn("id", F.monotonically_increasing_id()).withColumn("Classification", F.when(F.col("Classification") == 2, F.lit(6)).otherwise(F.lit(1)))
    out = {r["id"]: r["Classification"] for r in ground.reclassify(given, GRID, 10.0, 5.0, denoise=False).collect()}
    inside = [r for r in given.collect() if 0 <= r["X"] < 10 and 0 < r["Y"] <= 10]
    assert set(out) == {r["id"] for r in inside}
    assert all(out[r["id"]] == (6 if r["Classification"] == 6 else 5) for r in inside)
    free = {r["id"]: r["Classification"] for r in ground.reclassify(given, GRID, 10.0, 5.0, denoise=False, preserve=False).collect()}
    assert {free[r["id"]] for r in inside if r["Classification"] == 6} == {2}
    low = given.union(points(spark, [(5.1, 5.1, 20, 1, 0, 1, 1)]).withColumn("Year", F.lit(2021)).withColumn("id", F.lit(-1).cast("long")))
    assert {r["id"]: r["Classification"] for r in ground.reclassify(low, GRID, 10.0, 5.0).collect()}[-1] == 7


def test_aligned_classes_must_be_the_same_points(spark):
    rows = [(0, 0, 1, 2, 0, 1, 1), (0, 0, 1, 5, 0, 1, 1), (1, 0, 1, 2, 0, 1, 1)]
    a = points(spark, rows)
    assert sorted((r["Classification"], r["found"]) for r in scoring.aligned(a, points(spark, rows[::-1])).collect()) == [(2, 2), (2, 2), (5, 5)]
    with pytest.raises(Exception, match="not the reference"):
        scoring.aligned(a, points(spark, rows[1:])).collect()


def test_blocks_need_a_full_square(spark):
    files = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 10.0)], "file_id int, min_x double, min_y double")
    assert scoring.nested_blocks(files, (1,), 10.0).count() == 1
    for levels in ((4,), (3,)):
        with pytest.raises(ValueError):
            scoring.nested_blocks(files, levels, 10.0)


def test_raster_tiles_replace_their_pixels(spark, tmp_path):
    store = RasterStore(spark, str(tmp_path / "r"))
    grid = spark.range(4).select((F.col("id") % 2).cast("int").alias("row"), F.expr("cast(id div 2 as int)").alias("col"), F.lit(1.0).alias("value"))
    for variable in ("dtm", "dsm"):
        store.upsert(grid, variable, 1.0, 2021)
    store.upsert(grid.where("row = 0").withColumn("value", F.lit(2.0)), "dtm", 1.0, 2021)
    assert sorted((r["row"], r["value"]) for r in store.read("dtm", 1.0).collect()) == [(0, 2.0), (0, 2.0), (1, 1.0), (1, 1.0)]
    assert store.read("dsm", 1.0).where("value = 1").count() == 4


def test_blocks_are_replaced_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "BLOCK", 4)
    store = RasterStore(spark, str(tmp_path / "r"))
    whole = spark.range(100).select(F.expr("cast(id div 10 as int)").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    store.write(whole, "dtm", 1.0, 2021)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "r/raster").rglob("*.parquet")}
    before = files()
    assert len(before) == 9
    tile = spark.createDataFrame([(0, 0, -1.0), (1, 3, -2.0)], "row int, col int, value double")
    store.upsert(tile, "dtm", 1.0, 2021)
    after = files()
    assert len(after) == 10 and all(after[f] == t for f, t in before.items())  # one block more, none touched
    got = {(r["row"], r["col"]): r["value"] for r in store.read("dtm", 1.0, 2021).collect()}
    assert len(got) == 100 and got[0, 0] == -1 and got[1, 3] == -2 and got[3, 3] == 33 and got[9, 9] == 99
    kept = RasterStore._append
    monkeypatch.setattr(RasterStore, "_append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    for change in (lambda: store.upsert(tile.withColumn("value", F.lit(7.0)), "dtm", 1.0, 2021), lambda: store.write(tile, "dtm", 1.0, 2021)):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.setattr(RasterStore, "_append", kept)
    assert {(r["row"], r["col"]): r["value"] for r in store.read("dtm", 1.0, 2021).collect()} == got
    store.write(tile, "dtm", 1.0, 2021)
    assert store.read("dtm", 1.0, 2021).count() == 2 and [tuple(r) for r in store.variables().collect()] == [("dtm", 1.0, 2021)]
    assert store.vacuum() == 2 and store.read("dtm", 1.0, 2021).count() == 2


def test_results_gain_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    append_results(spark.createDataFrame([("a", 1.0)], "scene string, rmse double"), path)
    append_results(spark.createDataFrame([("b", 2.0, 3)], "scene string, rmse double, n int"), path)
    rows = sorted((r["scene"], r["rmse"], r["n"]) for r in read_results(spark, path).collect())
    assert rows == [("a", 1.0, None), ("b", 2.0, 3)]
    export_csv(read_results(spark, path), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["scene", "rmse", "n"]
