"""Operators with analytic answers, and properties that must hold."""

import functools
import math
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.functions import columns as fn
from arbora.functions.pulses import pulse_hash
from arbora.grid import Grid
from arbora.operators import allometry, attenuation, change, filters, ground, joins, metrics, profiles, scoring, surfaces, terrain, waveform
from arbora.plans import products, scenes

GRID = Grid.from_bbox(0.0, 0.0, 10.0, 10.0, 1.0)


def points(spark, rows):
    """x, y, z, class, height above ground, return number, number of returns."""
    names = ["X", "Y", "Z", "Classification", "HeightAboveGround", "ReturnNumber", "NumberOfReturns"]
    return spark.createDataFrame([(float(a), float(b), float(c), int(d), None if e is None else float(e), int(f), int(g)) for a, b, c, d, e, f, g in rows], "X double, Y double, Z double, Classification int, HeightAboveGround double, ReturnNumber int, NumberOfReturns int")


def plane(x, y):
    return 100 + 0.2 * x + 0.3 * y


def plane_scene(spark, year=2021):
    rows = [(x, y, plane(x, y), 2, 0, 1, 1) for x in range(-2, 13, 2) for y in range(-2, 13, 2)]
    rows += [(i + 0.5, j + 0.5, plane(i + 0.5, j + 0.5) + 10, 5, 0, 1, 1) for i in range(10) for j in range(10)]
    return points(spark, rows).withColumn("Year", F.lit(year))


def test_pixels_own_their_west_and_north_edges(spark):
    rows = GRID.bins(points(spark, [(0, 10, 0, 2, 0, 1, 1), (10, 5, 0, 2, 0, 1, 1), (5, 0, 0, 2, 0, 1, 1), (1, 9, 0, 2, 0, 1, 1), (9.999, 0.001, 0, 2, 0, 1, 1)])).collect()
    assert sorted((r["row"], r["col"]) for r in rows) == [(0, 0), (1, 1), (9, 9)]
    assert Grid.from_bbox(0, 0, 10.1, 10, 1.0).nx == 11 and Grid.from_bbox(0, 0, 0.3, 0.3, 0.1).nx == 3
    with pytest.raises(ValueError):
        GRID.per_tile(2.5)


def test_heights_on_a_plane_are_exact(spark):
    p = plane_scene(spark)
    for tile in (5.0, 10.0):
        out = terrain.normalise(p, GRID, tile, 4.0).where("Classification = 5").collect()
        assert len(out) == 100 and all(abs(r["HeightAboveGround"] - 10) < 1e-9 and not r["GroundExtrapolated"] for r in out)
    dtm = terrain.dtm(p, GRID, 5.0, 4.0).collect()
    assert len(dtm) == 100 and all(abs(r["slope"] - math.degrees(math.atan(math.hypot(0.2, 0.3)))) < 1e-9 for r in dtm)
    idw = terrain.dtm(p, GRID, 5.0, 4.0, "idw").collect()
    assert all(100 <= r["value"] <= 106 for r in idw)


def test_ground_beyond_the_triangulation_is_the_nearest(spark):
    base = points(spark, [(4, 4, 7, 2, 0, 1, 1), (5, 4, 7, 2, 0, 1, 1), (4, 5, 7, 2, 0, 1, 1)])
    far = points(spark, [(9, 9, 12, 5, 0, 1, 1)])
    out = terrain.normalise(base.union(far), GRID, 10.0, 5.0).where("Classification = 5").first()
    assert out["HeightAboveGround"] == 5.0 and out["GroundExtrapolated"]
    out = terrain.normalise(base.union(far), GRID, 10.0, 5.0, max_distance=2.0).where("Classification = 5").first()
    assert out["HeightAboveGround"] is None
    out = terrain.normalise(base.union(far), GRID, 10.0, 5.0, extrapolate=False).where("Classification = 5").first()
    assert out["HeightAboveGround"] is None
    line = points(spark, [(k, 5, 3, 2, 0, 1, 1) for k in range(5)] + [(2, 8, 9, 5, 0, 1, 1)])
    assert terrain.normalise(line, GRID, 10.0, 5.0).where("Classification = 5").first()["HeightAboveGround"] == 6.0


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(5)
    spread = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(500, 20, (40, 3)), [[9000.0, -4000.0, 3.0]]])
    places = np.concatenate([rng.normal(0, 1, (8, 3)), rng.uniform(-3000, 9000, (25, 3))])
    p = spark.createDataFrame([(int(k), *map(float, r)) for k, r in enumerate(spread)], "n long, X double, Y double, Z double")
    c = spark.createDataFrame([(int(k), *map(float, r)) for k, r in enumerate(places)], "id long, cx double, cy double, cz double")
    for z in (None, "cz"):
        got = {(r["id"], r["rank"]): r["n"] for r in joins.nearest(c, p, "id", 5, z=z).collect()}
        for k, at in enumerate(places):
            d = ((spread - at)[:, : 3 if z else 2] ** 2).sum(axis=1)
            assert [got[k, j + 1] for j in range(5)] == np.argsort(d)[:5].tolist()
    assert joins.nearest(c, p, "id", 200).count() == len(places) * len(spread)
    assert joins.nearest(c, p.where("false"), "id", 1).count() == 0 and joins.nearest(c.where("false"), p, "id", 1).count() == 0
    kept = surfaces.drop_statistical_outliers(p, "n", 4, 3.0)
    assert kept.count() == len(spread) - 1 and kept.where("n = 100").count() == 0


def plain_sweep(x, y, z, freeze, drop):
    """The spike-free sweep with a list of triangles and flips; gives triangles, frozen ones among them, and who joined."""
    n = len(x)
    px, py = [*x, -1e5, 1e5, 0.0], [*y, -1e5, -1e5, 1e5]
    turn = lambda a, b, c: (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])
    tris, locked, frozen, waiting, kept = {(n, n + 1, n + 2)}, set(), set(), [], []

    def in_circle(t, p):
        m = np.array([[px[v] - px[p], py[v] - py[p], (px[v] - px[p]) ** 2 + (py[v] - py[p]) ** 2] for v in t])
        return np.linalg.det(m) > 1e-9

    for p in range(n):
        for level, t in sorted(waiting, reverse=True):
            if level > z[p]:
                waiting.remove((level, t))
                if any(set(t) == set(s) for s in tris):
                    frozen.add(frozenset(t))
                    locked |= {frozenset(e) for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        held = next(t for t in tris if min(turn(t[0], t[1], p), turn(t[1], t[2], p), turn(t[2], t[0], p)) >= 0)
        if frozenset(held) in frozen:
            continue
        kept.append(p)
        tris.remove(held)
        todo = []
        for u, v in ((held[0], held[1]), (held[1], held[2]), (held[2], held[0])):
            tris.add((u, v, p))
            todo.append((u, v))
        while todo:
            u, v = todo.pop()
            other = [t for t in tris if {u, v} < set(t) and p not in t]
            if other and frozenset((u, v)) not in locked and in_circle(other[0], p):
                w = (set(other[0]) - {u, v}).pop()
                tris -= {other[0], (u, v, p)}
                tris |= {(u, w, p), (w, v, p)}
                todo += [(u, w), (w, v)]
        for t in [t for t in tris if p in t and max(t) < n]:
            sides = [math.hypot(px[i] - px[j], py[i] - py[j]) for i, j in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
            if max(sides) < freeze(sum(px[v] for v in t) / 3, sum(py[v] for v in t) / 3):
                waiting.append((min(z[v] for v in t) - drop, t))
    return {frozenset(t) for t in tris if max(t) < n}, frozen, kept


@pytest.mark.parametrize("freeze", [lambda a, b: 2.0, lambda a, b: 3.0 if a < 5 else 0.7])
def test_spike_free_sweep(freeze):
    rng = np.random.default_rng(2)
    n = 150
    x, y = rng.uniform(0, 10, (2, n))
    z = np.where(rng.random(n) < 0.4, rng.uniform(0, 5, n), 12 + np.sin(x))
    order = np.lexsort((y, x, -z))
    x, y, z = x[order], y[order], z[order]
    t, kept = surfaces.swept(x, y, z, freeze, 0.5)
    real, frozen, joined = plain_sweep(x, y, z, freeze, 0.5)
    assert kept == joined and len(kept) < n and len(frozen) > 10
    assert {frozenset(r) for r in t.tolist()} == real
    assert frozen <= real  # a frozen triangle never changes
    assert len(surfaces.swept(x[:0], y[:0], z[:0], freeze, 0.5)[1]) == 0


def test_local_freeze_distances_and_trimmed_edges(spark):
    canopy = lambda x0: [(x0, 0.1, 0, 5, 10.0, 1, 1), (x0 + 2, 0.1, 0, 5, 10.0, 1, 1), (x0, 2.1, 0, 5, 10.0, 1, 1), (x0 + 2, 2.1, 0, 5, 10.0, 1, 1), (x0 + 1, 1.1, 0, 5, 0.0, 1, 1)]
    p, g = points(spark, canopy(0.2) + canopy(5.2)), Grid.from_bbox(0.0, 0.0, 10.0, 2.5, 0.5)
    wide = {(r["row"], r["col"]): r["value"] for r in surfaces.spike_free(p, g, 10.0, 2.0, freeze=4.0).collect()}
    assert all(abs(wide[r, c] - 10) < 1e-6 for r in (1, 2, 3) for c in (1, 2, 3, 11, 12, 13))
    none = {(r["row"], r["col"]): r["value"] for r in surfaces.spike_free(p, g, 10.0, 2.0, freeze=0.1).collect()}
    assert none[2, 2] < 5 and none[2, 12] < 5
    # five pulses in 25 m2 count as the lowest density, of which the distance is under 4 m but over the canopy's diagonal
    local = {(r["row"], r["col"]): r["value"] for r in surfaces.spike_free(p, g, 10.0, 2.0, freeze="local").collect()}
    assert all(abs(local[r, c] - 10) < 1e-6 for r in (1, 2, 3) for c in (1, 2, 3))
    cut = {(r["row"], r["col"]): r["value"] for r in surfaces.spike_free(p, g, 10.0, 2.0, freeze=4.0, max_edge=2.9).collect()}
    assert cut[2, 2] is not None and cut[2, 7] is None and wide[2, 7] is not None
    first = surfaces.spike_free(p.withColumn("ReturnNumber", F.lit(2)), g, 10.0, 2.0, freeze=4.0, first_only=True)
    assert first.where("value is not null").count() == 0


def test_delaunay_covers_and_keeps_circles_empty():
    rng = np.random.default_rng(1)
    x, y = rng.random(150) * 100, rng.random(150) * 100
    t = terrain.delaunay(x, y)
    for a, b, c in t:
        m = np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]]) * 2
        o = np.linalg.solve(m, [x[b] ** 2 - x[a] ** 2 + y[b] ** 2 - y[a] ** 2, x[c] ** 2 - x[a] ** 2 + y[c] ** 2 - y[a] ** 2])
        assert (np.hypot(x - o[0], y - o[1]) >= np.hypot(x[a] - o[0], y[a] - o[1]) - 1e-7).all()
    gx, gy = np.meshgrid(np.arange(12.0), np.arange(12.0))
    assert len(terrain.delaunay(gx.ravel(), gy.ravel())) == 11 * 11 * 2
    assert len(terrain.delaunay(np.arange(5.0), np.arange(5.0))) == 0


def test_low_outliers(spark):
    rows = [(1, 1, z, 2, 0, 1, 1) for z in (0.0, 5.0, 5.2, 9.0)] + [(15, 1, z, 2, 0, 1, 1) for z in (3.0, 3.5)]
    low = filters.low_outliers(points(spark, rows)).where("is_low").collect()
    assert [r["Z"] for r in low] == [0.0]
    out = filters.drop_ground_outliers(points(spark, [*rows, (1, 1, -9, 5, 0, 1, 1)]))
    assert out.where("Classification = 7").count() == 1 and out.count() == 7


def test_gap_cover_and_heights(spark):
    rows = [(0.5, 0.5, 0, 2, 0, 1, 1)] * 3 + [(0.5, 0.5, 0, 5, h, 1, 1) for h in (1.0, 3.0, 5.0)] + [(0.5, 0.5, 0, 1, 4, 1, 1), (0.5, 0.5, 0, 5, None, 1, 1), (0.5, 0.5, 0, 5, 9, 2, 2)]
    m = metrics.cell_metrics(points(spark, rows), GRID).first()
    assert m["density"] == 9 and m["cc"] == 2 / 6 and m["hmax"] == 9 and m["hmean"] == 4.5 and m["h50"] == 4.0
    assert m["pv_0_2"] == 0.25 and m["pv_2_5"] == 0.5 and abs(m["crr"] - 3.5 / 8) < 1e-12
    assert abs(m["fhd"] - math.log(4)) < 1e-12 and abs(m["vci"] - math.log(4) / math.log(80)) < 1e-12
    g = metrics.gap_fraction(points(spark, rows), GRID).first()
    assert (g["gap_n_ground"], g["gap_n_classified"], g["gap_n_first"], g["gap"]) == (3, 7, 8, 3 / 7)
    assert metrics.gap_fraction(points(spark, rows), GRID, 100.0).first()["gap"] is None
    assert metrics.cell_metrics(points(spark, rows), GRID, min_density=10.0).first()["hmax"] is None
    leaf = spark.range(1).select(fn.lai(F.lit(math.exp(-1.0)), 0.5).alias("a"), fn.lai(F.lit(0.0)).alias("b"), fn.lai(F.lit(1e-9)).alias("c")).first()
    assert abs(leaf["a"] - 2) < 1e-12 and leaf["b"] is None and leaf["c"] == 15


def test_discs_equal_pixels_where_both_hold_all(spark):
    rng = np.random.default_rng(0)
    p = points(spark, [(4 + rng.random(), 4 + rng.random(), 0, int(rng.choice([2, 3, 5])), h, 1, 1) for h in rng.uniform(0, 30, 80)])
    big = Grid.from_bbox(0.0, 0.0, 10.0, 10.0, 10.0)
    names = ("cc", "hmean", "h95", "fhd", "pv_5_10")
    a = metrics.cell_metrics(p, big, names).first()
    centre = spark.createDataFrame([(1, 5.0, 5.0), (2, 500.0, 5.0)], "id int, cx double, cy double")
    b = {r["id"]: r for r in metrics.disc_metrics(centre, p, ["id"], 8.0, names).collect()}
    assert all(abs(a[n] - b[1][n]) < 1e-9 for n in names) and b[2]["cc"] is None


def test_canopy_quality(spark):
    rows = [(x, y, 0, 2, 0, 1, 1) for x in range(-2, 13, 2) for y in range(-2, 13, 2)] + [(0.5, 9.5, 12, 5, 12, 1, 1), (3.5, 9.5, 90, 5, 90, 1, 1)]
    p = points(spark, rows).withColumn("NegativeHAG", F.lit(False))
    base = terrain.dtm(p, GRID, 10.0, 5.0)
    out = {(r["row"], r["col"]): r for r in surfaces.chm_from_heights(p, GRID, base, max_height=60.0).collect()}
    assert len(out) == 100 and out[0, 0]["value"] == 12 and out[0, 0]["flags"] & surfaces.OBSERVED
    assert out[0, 3]["value"] is None and out[0, 3]["flags"] & surfaces.REJECTED
    assert out[5, 5]["flags"] & surfaces.NO_OBSERVATIONS and out[5, 5]["flags"] & surfaces.LOW_PULSE_DENSITY


def test_small_holes_are_filled(spark):
    rows = [(r, c, None if (r, c) in {(3, 3), (3, 4), (0, 7)} else float(r)) for r in range(10) for c in range(10)]
    raster = spark.createDataFrame(rows, "row int, col int, value double")
    for tile in (4, 256):
        out = {(r["row"], r["col"]): r for r in surfaces.fill_pits(raster, GRID, 4, tile).collect()}
        assert len(out) == 100 and out[3, 3]["filled"] and out[3, 3]["value"] == 3.0
        assert out[0, 7]["value"] is None and not out[0, 7]["filled"]


def test_pit_free_and_spike_free(spark):
    rng = np.random.default_rng(2)
    rows = [(x + 0.25, y + 0.25, 0, 5, 10, 1, 1) for x in np.arange(0, 10, 0.5) for y in np.arange(0, 10, 0.5)]
    pits = [(float(a), float(b), 0, 5, 1.0, 1, 1) for a, b in rng.uniform(3, 7, (12, 2))]
    p = points(spark, rows + pits)
    free = surfaces.spike_free(p, GRID, 10.0, 2.0, freeze=1.5).where("row between 2 and 7 and col between 2 and 7").collect()
    assert len(free) == 36 and all(abs(r["value"] - 10) < 1e-6 for r in free)
    layers = surfaces.chm_layers(p, GRID, 10.0, 2.0).where("row between 1 and 8 and col between 1 and 8").collect()
    assert len(layers) == 64 and all(abs(r["value"] - 10) < 1e-6 for r in layers)


def test_change(spark):
    rows = [(0, 0, 2020, 10.0), (0, 0, 2021, 12.0), (0, 1, 2020, 0.0), (0, 1, 2021, 0.5), (0, 2, 2020, 5.0), (0, 3, 2020, 5.0), (0, 3, 2021, 4.0)]
    out = {r["col"]: r for r in change.change(spark.createDataFrame(rows, "row int, col int, year int, value double"), 2020, 2021, 0.5, 1.0).collect()}
    assert out[0]["pct"] == 20.0 and out[0]["flag"] == 1 and out[1]["pct"] is None and out[1]["flag"] == 0 and out[3]["flag"] == -1 and 2 not in out


def test_plant_area_of_a_known_canopy(spark):
    density, k, top = 0.15, 0.5, 20.0
    rng = np.random.default_rng(3)
    u = rng.random(60_000)
    h = top + np.log(u) / (k * density)  # height where a beam is stopped
    rows = [(0, 0, 0, 5 if v > 0 else 2, max(v, 0), 1, 1) for v in h]
    out = profiles.pavd_profile(points(spark, rows).withColumn("id", F.lit(1)), ["id"], 1.0).collect()
    middle = [r["pavd"] for r in out if 2 <= r["z"] < 17]
    assert abs(np.mean(middle) - density) < 0.01
    assert abs(max(r["pai"] for r in out) - density * top) < 0.15
    few = points(spark, rows[:1]).withColumn("id", F.lit(1))
    assert profiles.pavd_profile(few, ["id"]).count() == 0


def test_waveform(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(-8, 8, (600, 2))
    rows = [(a, b, 20.0 if k % 2 else 0.0, 5 if k % 2 else 2, 0, 1, 1) for k, (a, b) in enumerate(xy)]
    shots = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "shot_id bigint, center_x double, center_y double")
    out = {r["shot_id"]: r for r in waveform.simulate(shots, points(spark, rows)).collect()}
    w = out[1]
    assert abs(w["z_ground"]) < 0.3 and abs(w["rh"][98] - 20) < 2.5 and abs(w["cover"] - 0.5) < 0.1 and w["ground_supported"]
    assert abs(sum(w["waveform"]) - 1) < 1e-9 and w["rh"] == sorted(w["rh"]) and w["rh"][0] < 0
    assert out[2]["n_points"] == 0 and out[2]["waveform"] is None
    assert waveform.peaks(np.array([0, 1, 0, 3, 3, 0, 1.0]), 0.5, 0.5) == [1, 3]
    assert abs(waveform.resampled_pulse(np.linspace(-3, 3, 61), np.exp(-np.linspace(-3, 3, 61) ** 2), 0.15).sum() - 1) < 1e-12


def test_waveform_weights(spark):
    shots = spark.createDataFrame([(1, 0.0, 0.0)], "shot_id long, center_x double, center_y double")
    rows = [(0.1, 0.1, 5, 5, 5, 1, 2), (0.2, 0.2, 0, 2, 0, 2, 2), (0.3, 0.3, 0, 2, 0, 3, 2), (3.1, 3.1, 4, 5, 4, 1, 3), (40, 0, 1, 2, 0, 1, 1)]
    beam = [math.exp(-(x * x + y * y) / (2 * 5.5**2)) for x, y, *_ in rows[:4]]
    got = {how: sorted(r["w"] for r in waveform.weighted_returns(shots, points(spark, rows), return_weighting=how).collect()) for how in ("count", "fractional")}
    # two last returns in the first cell, none in the other; a return numbered beyond the last counts as one
    assert np.allclose(got["count"], sorted([beam[0] / 2, beam[1] / 2, beam[2] / 2, beam[3]]))
    assert np.allclose(got["fractional"], sorted([beam[0] / 4, beam[1] / 4, beam[2] / 4, beam[3] / 3]))
    plain = sorted(r["w"] for r in waveform.weighted_returns(shots, points(spark, rows), density_cell=None).collect())
    assert np.allclose(plain, sorted(beam))
    with pytest.raises(ValueError):
        waveform.weighted_returns(shots, points(spark, rows), return_weighting="none")


def test_attenuation(spark):
    rows = [(1, c / 10, 0.8 * math.exp(-0.6 * c / 10)) for c in range(50)]
    fit = attenuation.fit_transmittance(spark.createDataFrame(rows, "key int, c double, t double"), ["key"], "c", "t").first()
    assert abs(fit["a"] - 0.8) < 1e-6 and abs(fit["b"] - 0.6) < 1e-6
    few = spark.createDataFrame(rows[:3], "key int, c double, t double")
    assert attenuation.fit_transmittance(few, ["key"], "c", "t").count() == 0


def test_published_footprint_values(spark):
    shots = [("ENT x Europe", 74.03), ("ENT × North  America", 87.068)]
    assert allometry.footprint_model(shots[1][0]).predictors == ("rh70", "rh98")
    with pytest.raises(ValueError):
        allometry.footprint_model("ENT x Moon")
    row = spark.createDataFrame([("ENT x Europe", 5.0, 5.0, 5.0, 10.0, 10.0, 20.0), ("none", 5.0, 5.0, 5.0, 10.0, 10.0, 20.0)], "stratum string, rh40 double, rh50 double, rh60 double, rh70 double, rh80 double, rh98 double")
    got = {r["stratum"]: r["agbd"] for r in allometry.footprint_biomass(row).collect()}
    by_hand = 0.963 * (-96.531 + 7.175 * math.sqrt(110) + 2.921 * math.sqrt(120)) ** 2
    assert abs(got["ENT x Europe"] - by_hand) < 1e-9 and got["none"] is None
    model = allometry.footprint_model("EBT x Europe")
    assert abs(row.select(model.biomass().alias("b")).first()["b"] - by_hand) < 1e-9


def test_linear_fit_and_intervals(spark):
    rng = np.random.default_rng(0)
    h50, h95 = rng.uniform(2, 15, 200), rng.uniform(10, 30, 200)
    agb = np.maximum(-2 + 1.5 * np.sqrt(h50) + 2.5 * np.sqrt(h95) + rng.normal(0, 0.4, 200), 0) ** 2
    plots = spark.createDataFrame(pd.DataFrame({"h50": h50, "h95": h95, "agb": agb, "block": np.arange(200) % 9}))
    model = allometry.fit_linear(plots, "agb", ("h50", "h95"))
    x = np.column_stack([np.ones(200), np.sqrt(h50), np.sqrt(h95)])
    assert np.allclose(model.coefficients, np.linalg.lstsq(x, np.sqrt(agb), rcond=None)[0], atol=1e-8)
    se, low, high = model.interval(0.95)
    inside = plots.select(((F.col("agb") >= low) & (F.col("agb") <= high)).cast("int").alias("i")).agg(F.avg("i")).first()[0]
    assert 0.9 < inside <= 1
    assert abs(allometry.student_quantile(0.975, 10) - 2.228138852) < 1e-6 and abs(allometry.student_quantile(0.95, 3) - 2.353363435) < 1e-6
    with pytest.raises(ValueError):
        allometry.fit_linear(plots.withColumn("same", F.col("h50")), "agb", ("h50", "same"))
    cv = allometry.cross_validate(plots, "agb", "block", lambda d: allometry.fit_linear(d, "agb", ("h50", "h95")), 3)
    assert cv.count() == 200
    folds = {r["block"]: r["fold"] for r in allometry.folds(plots, "block", 4).collect()}
    assert [sum(f == k for f in folds.values()) for k in range(4)] == [3, 2, 2, 2]


def test_naesset(spark):
    df = spark.createDataFrame([(15.0, 0.7), (15.0, 0.0), (0.0, 0.5), (5.0, 1.2)], "h95 double, cc double")
    got = [r[0] for r in df.select(allometry.naesset()).collect()]
    assert abs(got[0] - 0.8 * 15**1.8 * 0.7**0.5) < 1e-9 and got[1] == 0 and got[2] is None and got[3] is None
    rng = np.random.default_rng(1)
    h, c = rng.uniform(5, 30, 80), rng.uniform(0.2, 1, 80)
    plots = spark.createDataFrame(pd.DataFrame({"h95": h, "cc": c, "agb": 1.3 * h**1.5 * c**0.8}))
    assert np.allclose(allometry.fit_naesset(plots), (1.3, 1.5, 0.8), rtol=1e-4)


def test_scores(spark):
    p = spark.createDataFrame([(True, True)] * 6 + [(True, False)] * 2 + [(False, True)] * 1 + [(False, False)] * 11, "t boolean, f boolean")
    s = scoring.ground_scores(p, F.col("t"), F.col("f")).first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (6, 1, 2, 11) and s["recall"] == 0.75 and abs(s["f1"] - 12 / 15) < 1e-12 and s["total_error"] == 0.15
    a = spark.createDataFrame([(r, c, 10.0 if (r, c) == (5, 5) else 1.0) for r in range(10) for c in range(10)], "row int, col int, value double")
    b = a.withColumn("value", F.when((F.col("row") == 5) & (F.col("col") == 6), 9.0).when(F.col("value") > 5, 1.0).otherwise(F.col("value")))
    out = scoring.compare_rasters(a, b, 10, 10).first()
    assert out["coverage"] == 1 and out["peaks"] == 1 and out["found"] == 1 and out["matched"] == 1
    # two peaks of one raster near one of the other: the nearer takes it, the other takes the next
    def peaked(*at):
        return spark.createDataFrame([(r, c, 10.0 if (r, c) in at else 1.0) for r in range(12) for c in range(12)], "row int, col int, value double")

    out = scoring.compare_rasters(peaked((5, 3), (5, 7)), peaked((5, 5), (5, 9)), 12, 12, reach=2.5).first()
    assert (out["peaks"], out["found"], out["matched"]) == (2, 2, 2)
    out = scoring.compare_rasters(peaked((5, 4), (5, 7)), peaked((5, 6), (8, 8)), 12, 12, reach=3.5).first()
    assert out["matched"] == 1
    tiles = spark.createDataFrame([(x * 1.0, y * 1.0, (x, y) != (3, 1)) for x in range(4) for y in range(2)], "min_x double, min_y double, good boolean")
    assert [(r["bx"], r["by"]) for r in scoring.whole_blocks(tiles, 1.0).collect()] == [(0, 0)]


def test_functions(spark):
    df = spark.createDataFrame([("pd_00p5_a", "2020-06-03T10:00", -3.0, 40.0), ("x", "2020-12-01", -75.0, -10.0)], "name string, day string, lon double, lat double")
    got = df.select(fn.density_version(F.col("name")).alias("v"), fn.season(F.col("day")).alias("s"), fn.utm_epsg(F.col("lon"), F.col("lat")).alias("e")).collect()
    assert got[0]["v"]["density"] == 0.5 and got[0]["v"]["tag"] == "a" and got[1]["v"]["density"] is None
    assert [r["s"] for r in got] == ["leaf-on", "leaf-off"] and [r["e"] for r in got] == [32630, 32718]
    labels = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,), (None,)], "v double").select(fn.right_open_label(F.col("v"), [0, 5, 10]).alias("l")).collect()
    assert [r["l"] for r in labels] == ["0-5", "5-10", "5-10", "", ""]
    h = [r[0] for r in spark.range(2000).select(pulse_hash(F.col("id"), F.lit(64))).collect()]
    assert len(set(h)) == 2000 and abs(np.mean(h) - 0.5) < 0.03 and 0 <= min(h) and max(h) < 1


@pytest.mark.parametrize("method", sorted(ground.METHODS))
def test_ground_methods_find_the_ground(spark, method):
    grid = Grid.from_bbox(0.0, 0.0, 40.0, 40.0, 1.0)
    scene = scenes.scene(spark, grid, "slope", 400.0, 3.0, seed=1).withColumn("id", F.col("Pulse") * 10 + F.col("ReturnNumber")).cache()
    out = ground.classify(scene, grid, 40.0, 5.0, method).join(scene.select("id", "Classification"), "id")
    s = scoring.ground_scores(out, F.col("Classification") == 2, F.col("is_ground")).first()
    # the morphological filter with its small first threshold loses points on a slope of 0.3
    assert s["recall"] > (0.5 if method == "pmf" else 0.7) and s["precision"] > 0.7, s


def test_voted_ground_and_envelope(spark):
    grid = Grid.from_bbox(0.0, 0.0, 30.0, 30.0, 1.0)
    scene = scenes.scene(spark, grid, "hills", 300.0, 3.0, seed=2).withColumn("id", F.col("Pulse") * 10 + F.col("ReturnNumber")).cache()
    for found in (ground.classify_by_votes(scene, grid, 30.0, 5.0), ground.envelope(scene, grid, 30.0, 5.0)):
        s = scoring.ground_scores(found.join(scene.select("id", "Classification"), "id"), F.col("Classification") == 2, F.col("is_ground")).first()
        assert s["recall"] > 0.6 and s["precision"] > 0.8, s


def test_products(spark, tmp_path):
    from arbora.sources.catalog import RasterStore

    p = plane_scene(spark)
    chm = products.compute_chm(p, GRID, 2021, "max", tile=10.0, buffer=5.0).collect()
    assert len(chm) == 100 and all(abs(r["value"] - 10) < 1e-6 for r in chm)
    assert products.compute_dsm(p, GRID, 2021).count() == 100
    area = products.compute_area_products(p, GRID, 2021, ("h95", "cc", "hmax"), {"agb": allometry.naesset()}, tile=10.0, buffer=5.0)
    assert area.count() == 100 and area.where("agb is not null").count() == 100
    with pytest.raises(ValueError):
        products.compute_dsm(p, GRID, None)
    store = RasterStore(spark, str(tmp_path / "s"))
    dsm = products.compute_dsm(p, GRID, 2021)
    assert products.store_product(store, dsm, "dsm", GRID, 2021, {"first": True})
    assert not products.store_product(store, dsm, "dsm", GRID, 2021, {"first": True})
    with pytest.raises(ValueError):
        products.store_product(store, dsm, "dsm", GRID, 2021, {"first": False})
    assert products.store_product(store, dsm, "dsm", GRID, 2021, {"first": False}, overwrite=True)
    products.store_product(store, dsm.withColumn("value", F.col("value") + 1), "dsm", GRID, 2022, {"first": True})
    out = products.compute_change(store, "dsm", 1.0, 2021, 2022).collect()
    assert len(out) == 100 and all(abs(r["delta"] - 1) < 1e-4 for r in out)
    assert store.to_wide(GRID, ["dsm"], 2021).count() == 100
    with pytest.raises(ValueError):
        store.ensure_grid(Grid.from_bbox(5.0, 0.0, 10.0, 10.0, 1.0))
    store.mark_tiles("dsm", 1.0, 2021, [0, 1])
    assert [r["tile"] for r in store.open_tiles(GRID.tiles(spark, 5.0), "dsm", 1.0, 2021).collect()] == [2, 3]


def test_area_products_of_a_store(spark, tmp_path):
    from arbora.sources.catalog import RasterStore

    p, store = plane_scene(spark), RasterStore(spark, str(tmp_path / "s"))
    revisions = ["a"]
    make = lambda wanted, models=(), **how: products.compute_area_products(p, GRID, 2021, wanted, dict(models), tile=10.0, buffer=5.0, store=store, revision=lambda: revisions[0], **how)
    free = products.compute_area_products(p, GRID, 2021, ("h95", "cc"), {"agb": F.col("h95") * 2}, tile=10.0, buffer=5.0, chm=True)
    want = {(r["row"], r["col"]): r for r in free.collect()}
    first = make(("h95", "cc"), gap=True, chm=True)
    for r in first.collect():
        w = want[r["row"], r["col"]]
        assert all((r[c] is None) == (w[c] is None) and (r[c] is None or abs(r[c] - w[c]) < 1e-5) for c in ("h95", "cc", "chm", "gap", "lai"))
    runs = lambda: {(r["variable"], r["status"]): r["count"] for r in spark.read.parquet(str(tmp_path / "s/runs")).groupBy("variable", "status").count().collect()}
    assert runs()["h95", "complete"] == runs()["chm", "complete"] == 1
    # a model over stored metrics is worked out without the points
    p = p.where(F.raise_error(F.lit("read")).isNull())
    out = make(("h95", "cc"), {"agb": F.col("h95") * 2}.items(), features={"agb": ("h95",)}, gap=True, chm=True)
    rows = [r for r in out.collect() if r["h95"] is not None]
    assert len(rows) > 50 and all(abs(r["agb"] - 2 * r["h95"]) < 1e-4 for r in rows) and runs()["h95", "complete"] == 1
    p = plane_scene(spark)
    with pytest.raises(ValueError, match="other settings"):
        make(("h95",), gap=False, settings={"more": 1})
    with pytest.raises(ValueError, match="unknown"):
        make(("h96",))
    changing = iter(["b", "c"])
    with pytest.raises(RuntimeError, match="changed"):
        products.compute_area_products(p, GRID, 2021, ("hmax",), tile=10.0, buffer=5.0, gap=False, store=store, revision=lambda: next(changing))
    assert runs()["hmax", "failed"] == 1
    assert products.has_survey(p, GRID, 2021) and not products.has_survey(p, Grid.from_bbox(900.0, 900.0, 910.0, 910.0, 1.0), 2021)
    with pytest.raises(ValueError, match="2021"):
        products.has_survey(p, GRID, 1999)
    plan = products.area_columns(p.withColumn("HeightAboveGround", F.lit(1.0)), GRID, ("h95", "cc", "hmax"), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_scene_truth(spark):
    grid = Grid.from_bbox(0.0, 0.0, 30.0, 30.0, 1.0)
    a, b = (scenes.scene(spark, grid, seed=5).orderBy("Pulse", "ReturnNumber").collect() for _ in range(2))
    assert a == b and all(abs(r["Z"] - r["ground"]) < 1e-9 for r in a if r["Classification"] == 2)


def test_wrapped_model(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, 4.0)], "h95 double, cc double")
    model = types.SimpleNamespace(predict=functools.partial(np.dot, b=np.array([2.0, 1.0])))
    got = [r[0] for r in df.select(allometry.wrapped(spark, model, ("h95", "cc"))).collect()]
    assert got == [4.0, None, 10.0]


def test_draw_keeps_its_distance(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "ab"[k % 2], float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100, (200, 2)))]
    out = scoring.draw(spark.createDataFrame(rows, "id int, s string, x double, y double"), "s", "id", 8, 15.0).collect()
    for name in "ab":
        p = np.array([(r["x"], r["y"]) for r in out if r["s"] == name])
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + np.eye(len(p)) * 99
        assert len(p) == 8 and d.min() >= 15


def test_all_rasters_from_one_normalisation(spark):
    out = products.compute_all(plane_scene(spark), GRID, 2021, 10.0, 4.0)
    chm = {(r["row"], r["col"]): r["value"] for r in out["chm"].collect()}
    dtm = {(r["row"], r["col"]): r["value"] for r in out["dtm"].collect()}
    dsm = {(r["row"], r["col"]): r["value"] for r in out["dsm"].collect()}
    assert len(chm) == len(dtm) == 100 and all(abs(v - 10) < 1e-9 for v in chm.values())
    assert all(abs(dtm[r, c] - plane(c + 0.5, 9.5 - r)) < 1e-9 and abs(dsm[r, c] - dtm[r, c] - 10) < 1e-9 for r, c in chm)
