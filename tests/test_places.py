"""Centres that stand on one place are worked out once, and pairs with points are summed where they meet."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arbora.operators import joins, metrics, profiles, waveform
from arbora.plans import products

MANY = "/root/testdata/sf0.01"  # 500 shots on 90 places, 100 plots on 100
QUERIES = ["canopy_cover_wave", "gap_from_waveform", "pavd_profile", "rh_from_histogram", "waveform_histogram", "waveform_weights", "footprint_profiles", "matched_gaps", "disc_join_counts", "gap_from_returns", "waveform_beam_energy"]


@pytest.mark.parametrize("name", QUERIES)
def test_shots_on_one_place_meet_points_once(spark, monkeypatch, name):
    joined = []

    def watched(centres, points, radius, x="cx", y="cy", how="inner"):
        joined.append((centres.count(), centres.select(x, y).distinct().count()))
        return plain(centres, points, radius, x, y, how)

    plain = joins.disc_join
    for module in (joins, metrics, profiles, products, waveform):
        monkeypatch.setattr(module, "disc_join", watched)
    entry.queries()[name](spark, MANY)
    assert joined and all(n == places == 90 for n, places in joined)


def test_histogram_of_discs_is_that_of_their_pairs(spark):
    rows = [(k % 7 * 1.3, k % 11 * 0.9, 100 + (k * 37 % 50) / 3.0) for k in range(300)]
    points = spark.createDataFrame(rows, "X double, Y double, Z double")
    centres = spark.createDataFrame([(1, 4.0, 4.0), (2, 5.0, 6.5), (3, 90.0, 0.0), (4, 0.0, 0.0)], "id int, cx double, cy double")
    pairs = profiles.waveform_histogram(joins.disc_join(centres, points, 3.0), ["id"], 0.5, F.col("X"))
    found = profiles.disc_histogram(centres, points, ["id"], 3.0, 0.5, {"energy": F.col("X")})
    tidy = lambda df: sorted((r["id"], r["bin"], round(r["energy"], 9), r["z_min"]) for r in df.collect())
    assert tidy(found) == tidy(pairs) and len(tidy(found)) > 50


def _plots(spark):
    points = spark.createDataFrame([(k % 20 * 1.0, k // 20 * 1.0, 100.0 + (k % 3 == 0) * (k % 11), 2 if k % 3 else 5, 1, float(k % 11)) for k in range(400)], "X double, Y double, Z double, Classification int, ReturnNumber int, HeightAboveGround double")
    return points, spark.createDataFrame([(k, 9.5, 9.5) for k in range(5)] + [(9, None, 1.0), (10, 500.0, 500.0)], "plot int, px double, py double")


def _watch(monkeypatch, module) -> list[int]:
    met, plain = [], joins.disc_join

    def watched(centres, *args, **how):
        met.append(centres.where("px is not null").count())
        return plain(centres, *args, **how)

    monkeypatch.setattr(module, "disc_join", watched)
    return met


def test_plots_on_one_place_are_worked_out_once(spark, monkeypatch):
    points, plots = _plots(spark)
    met = _watch(monkeypatch, metrics)
    rows = {r["plot"]: r for r in metrics.plot_metrics(plots, points, "plot", 4.0, ("h95", "cc"), parts=0).collect()}
    assert met == [2] and set(rows) == {0, 1, 2, 3, 4, 9, 10}
    assert len({tuple(rows[k])[1:] for k in range(5)}) == 1 and rows[0]["n_points"] > 40 and rows[9]["n_points"] == rows[10]["n_points"] == 0


def test_terrain_of_plots_on_one_place_is_made_once(spark, monkeypatch):
    points, plots = _plots(spark)
    met = _watch(monkeypatch, products)
    rows = {r["plot"]: r for r in products.compute_plot_metrics(plots, points, "plot", 4.0, ("h95", "cc")).collect()}
    assert met == [2, 2] and set(rows) == {0, 1, 2, 3, 4, 9, 10}
    assert len({tuple(rows[k])[1:] for k in range(5)}) == 1 and rows[0]["n_points"] > 40 and rows[10]["n_points"] == 0
