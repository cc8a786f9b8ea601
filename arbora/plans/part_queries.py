"""Registered queries of column functions and small operators, each beside its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora import fixtures
from arbora.functions import columns as fn
from arbora.grid import Grid
from arbora.operators import allometry, attenuation, profiles, reference, scoring, surfaces
from arbora.plans.queries import GRID, R, cleaned, cut, pts, register
from arbora.plans.queries import _cut as sql_cut
from arbora.plans.surface_queries import BUFFER, TILE, framed
from arbora.sources.catalog import with_attributes
from arbora.streaming import ingest

_FORMS = {
    "flat": "0.0e0 * u", "slope": "0.3e0 * u + 0.1e0 * v", "hills": "8 * SIN(u / 25) + 6 * COS(v / 30)", "ridge": "20 - ABS(u - 50) * 0.4e0",
    "terraces": "FLOOR(u / 20) * 3", "cliff": "CASE WHEN u > 50 THEN 15.0e0 ELSE 0.0e0 END",
}


@register("terrain_forms", f"SELECT id, {', '.join(f'{sql_cut(sql)} AS {kind}' for kind, sql in _FORMS.items())} FROM (SELECT pulse * 100 + rn AS id, x - 308000 AS u, y - 4688000 AS v FROM pts WHERE yr = 2021)")
def terrain_forms(spark, sf_dir):
    u, v = F.col("X") - 308000.0, F.col("Y") - 4688000.0
    return pts(spark, sf_dir).select((F.col("Pulse") * 100 + F.col("ReturnNumber")).alias("id"), *[cut(fn.terrain(kind, u, v)).alias(kind) for kind in _FORMS])


@register("density_versions", "SELECT plot_id, CASE WHEN plot_id % 3 = 2 THEN NULL ELSE (plot_id % 20) + CASE WHEN plot_id % 3 = 0 THEN 0.5e0 ELSE 0 END END AS density, CASE WHEN plot_id % 3 = 2 THEN 'full' ELSE 'b' || (plot_id % 4) END AS tag FROM plots")
def density_versions(spark, sf_dir):
    k = F.col("plot_id")
    whole, part, tag = F.lpad((k % 20).cast("string"), 2, "0"), F.when(k % 3 == 0, F.lit("p5")).otherwise(F.lit("")), (k % 4).cast("string")
    name = F.when(k % 3 == 2, F.lit("full")).otherwise(F.concat(F.lit("pd_"), whole, part, F.lit("_b"), tag))
    return fixtures.plots(spark, sf_dir).select("plot_id", fn.density_version(name).alias("v")).select("plot_id", "v.density", "v.tag")


@register("height_labels", "SELECT CASE WHEN hag < 2 THEN '0-20' WHEN hag < 5 THEN '20-50' WHEN hag <= 20 THEN '50-200' ELSE '' END AS label, COUNT(*) AS n FROM pts GROUP BY 1")
def height_labels(spark, sf_dir):
    label = fn.right_open_label(F.col("HeightAboveGround"), [0.0, 2.0, 5.0, 20.0], 10.0)
    return pts(spark, sf_dir, None).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


_A, _B = "RADIANS(10.0e0)", "RADIANS(30.0e0)"


@register("tilted_points", f"""WITH p AS (SELECT pulse * 100 + rn AS id, x - 308000 AS u, y - 4688000 AS v, hag FROM pts WHERE yr = 2021),
 q AS (SELECT id, (u * COS({_B}) + v * SIN({_B})) * COS({_A}) - hag * SIN({_A}) AS along, v * COS({_B}) - u * SIN({_B}) AS across, (u * COS({_B}) + v * SIN({_B})) * SIN({_A}) + hag * COS({_A}) AS up FROM p)
 SELECT id, {sql_cut(f'along * COS({_B}) - across * SIN({_B})')} AS x, {sql_cut(f'along * SIN({_B}) + across * COS({_B})')} AS y, {sql_cut('up')} AS z FROM q""")
def tilted_points(spark, sf_dir):
    turned = fn.tilt(F.col("X") - 308000.0, F.col("Y") - 4688000.0, F.col("HeightAboveGround"), 10.0, 30.0)
    return pts(spark, sf_dir).select((F.col("Pulse") * 100 + F.col("ReturnNumber")).alias("id"), *[cut(c).alias(name) for c, name in zip(turned, "xyz", strict=True)])


@register("leaf_seasons", "SELECT CASE WHEN MONTH(o_orderdate) BETWEEN 5 AND 10 THEN 'leaf-on' ELSE 'leaf-off' END AS season, COUNT(*) AS n FROM orders GROUP BY 1")
def leaf_seasons(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(fn.season(F.col("o_orderdate").cast("string")).alias("season")).agg(F.count("*").alias("n"))


@register("coordinate_units", f"SELECT plot_id, CAST(CASE WHEN plot_id % 2 = 0 THEN 32600 ELSE 32700 END + FLOOR((plot_id * 7 % 360) / 6) + 1 AS INT) AS epsg, {sql_cut('px * 0.3048006096e0')} AS us, {sql_cut('px * 0.3048e0')} AS international FROM plots")
def coordinate_units(spark, sf_dir):
    lon, lat = (F.col("plot_id") * 7 % 360 - 180).cast("double"), F.when(F.col("plot_id") % 2 == 0, 10.0).otherwise(-10.0)
    feet = [cut(fn.feet_to_metres(F.col("px"), kind)).alias(kind) for kind in ("us", "international")]
    return fixtures.plots(spark, sf_dir).select("plot_id", fn.utm_epsg(lon, lat).cast("int").alias("epsg"), *feet)


@register("attribute_view", "SELECT x AS \"X\", y AS \"Y\", cls AS \"Classification\", rn AS \"ReturnNumber\", 0 AS \"ScanAngleRank\" FROM pts")
def attribute_view(spark, sf_dir):
    return with_attributes(pts(spark, sf_dir, None), ["Classification", "ReturnNumber", "ScanAngleRank"])


def _levels(spark, sf_dir) -> DataFrame:
    """Returns by year and whole metre of height, as densities."""
    given = pts(spark, sf_dir, None).where("Classification in (3, 4, 5)")
    return given.groupBy("Year", F.floor("HeightAboveGround").cast("int").alias("level")).agg((F.count("*") / 1000.0).alias("pavd"))


_LEVELS = "l AS (SELECT yr, CAST(FLOOR(hag) AS INT) AS level, COUNT(*) / 1000.0e0 AS pavd FROM pts WHERE cls IN (3, 4, 5) GROUP BY 1, 2)"


@register("plant_area_above", f"WITH {_LEVELS} SELECT yr AS \"Year\", level, pavd, {sql_cut('COALESCE(SUM(pavd * 1.0e0) OVER (PARTITION BY yr ORDER BY level ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)')} AS above FROM l")
def plant_area_above(spark, sf_dir):
    return profiles.plant_area_above(_levels(spark, sf_dir), ["Year"]).withColumn("above", cut(F.col("above")))


@register("attenuation_ratios", f"""WITH {_LEVELS}, w AS (SELECT level, MAX(CASE WHEN yr = 2017 THEN pavd END) AS r, MAX(CASE WHEN yr = 2021 THEN pavd END) AS c FROM l GROUP BY level),
 s AS (SELECT *, SUM(r) OVER (ORDER BY level DESC) AS sr, SUM(c) OVER (ORDER BY level DESC) AS sc FROM w)
 SELECT level, {sql_cut('CASE WHEN r > 0.005e0 THEN c / r END')} AS ratio, {sql_cut('CASE WHEN sr > 0.05e0 THEN sc / sr END')} AS cumulative_ratio FROM s""")
def attenuation_ratios(spark, sf_dir):
    wide = _levels(spark, sf_dir).groupBy("level").pivot("Year", [2017, 2021]).agg(F.first("pavd")).withColumnsRenamed({"2017": "r", "2021": "c"})
    out = attenuation.ratios(wide, "r", "c")
    return out.select("level", cut(F.col("ratio")).alias("ratio"), cut(F.col("cumulative_ratio")).alias("cumulative_ratio"))


@register("block_attenuation", f"""WITH v AS (SELECT beam AS block, CAST(level AS INT) AS level, (shot_id * 13 + level * 7) % 101 / 10.0e0 AS w, (shot_id * 29 + level * 3) % 97 / 10.0e0 AS g FROM shots CROSS JOIN range(0, 101) AS r(level)),
 m AS (SELECT block, level, quantile_cont(w, 0.5) AS w, quantile_cont(g, 0.5) AS g, COUNT(*) AS n FROM v GROUP BY 1, 2), s AS (SELECT *, SUM(w) OVER (PARTITION BY block ORDER BY level DESC) AS sw, SUM(g) OVER (PARTITION BY block ORDER BY level DESC) AS sg FROM m)
 SELECT block, level, {sql_cut('CASE WHEN w > 0.005e0 THEN g / w END')} AS ratio, {sql_cut('CASE WHEN sw > 0.05e0 THEN sg / sw END')} AS cumulative_ratio FROM s""")
def block_attenuation(spark, sf_dir):
    """All blocks in one job: profiles looked up by their shot's number, medians, and ratios from the top."""
    footprints = fixtures.shots(spark, sf_dir).select(F.col("beam").alias("block"), F.col("shot_id").alias("shot_row"))
    profile = lambda a, b, m: F.transform(F.sequence(F.lit(0), F.lit(100)), lambda t: (F.col("shot_row") * a + t * b) % m / 10.0)
    stored = footprints.select("shot_row", profile(13, 7, 101).alias("wave"), profile(29, 3, 97).alias("seen"))
    medians = [profiles.attenuation_levels(attenuation.observed_levels(footprints, stored, values=v), "value", ("block",)).select("block", "level", F.col("median").alias(v)) for v in ("wave", "seen")]
    out = attenuation.ratios(medians[0].join(medians[1], ["block", "level"]), "wave", "seen", keys=("block",))
    return out.select("block", "level", *[cut(F.col(c)).alias(c) for c in ("ratio", "cumulative_ratio")])


@register("selected_shots", f"""WITH s AS (SELECT shot_id, CASE WHEN shot_id % 7 = 0 THEN -1 ELSE 0.2e0 + beam / 20.0e0 END AS rhog, 0.4e0 + (shot_id % 11) / 50.0e0 AS rhov FROM shots
 WHERE center_x BETWEEN 308025 AND 308175 AND center_y BETWEEN 4688025 AND 4688175 AND beam <> 1 AND (beam <> 3 OR (shot_id // 20) % 2 = 0) AND (shot_id // 20) % 9 <> 0), r AS (SELECT shot_id, CASE WHEN rhog > 0 THEN rhov / rhog END AS rv_rg FROM s)
 SELECT shot_id, {sql_cut('COALESCE(rv_rg, (SELECT MEDIAN(rv_rg) FROM r), 1)')} AS rv_rg FROM r""")
def selected_shots(spark, sf_dir):
    k, beam = F.col("shot_id"), F.col("beam")
    odd = F.floor(k / 20)
    given = fixtures.shots(spark, sf_dir).select(
        "*", (beam != 1).cast("int").alias("l2a_quality_flag"), F.lit(1).alias("l2b_quality_flag"), F.lit(0).alias("degrade_flag"), F.when(odd % 9 == 0, 0.9).otherwise(0.97).alias("sensitivity"), beam.alias("pft_class"),
        F.when(beam == 3, odd % 2).otherwise(F.when(beam == 4, F.lit(0)).otherwise(F.lit(1))).alias("leaf_off_flag"), F.when(k % 7 == 0, -1.0).otherwise(0.2 + beam / 20.0).alias("rhog"), (0.4 + (k % 11) / 50.0).alias("rhov"),
    )
    return attenuation.select_shots(given, fixtures.EXTENT).select("shot_id", cut(F.col("rv_rg")).alias("rv_rg"))


@register("whole_blocks", "SELECT CAST(FLOOR(min_x / 80) AS BIGINT) AS bx, CAST(FLOOR(min_y / 80) AS BIGINT) AS \"by\" FROM files GROUP BY 1, 2 HAVING COUNT(*) = 4 AND BOOL_AND(yr = 2021 OR file_id % 2 = 0)")
def whole_blocks(spark, sf_dir):
    tiles = fixtures.files(spark, sf_dir).select("min_x", "min_y", ((F.col("yr") == 2021) | (F.col("file_id") % 2 == 0)).alias("good"))
    return scoring.whole_blocks(tiles, 40.0)


@register("merged_cells", f"SELECT {R}, col, COUNT(*) AS n, {sql_cut('AVG(z)')} AS z_mean, MIN(z) AS z_min, MAX(z) AS z_max FROM cells GROUP BY {R}, col")
def merged_cells(spark, sf_dir):
    """Cells of three batches, merged into those of all points."""
    given = pts(spark, sf_dir)
    parts = [ingest.mergeable_cells(given.where(F.col("Pulse") % 3 == k), GRID) for k in range(3)]
    return ingest.merge_cells(parts[0].unionByName(parts[1]).unionByName(parts[2])).withColumn("z_mean", cut(F.col("z_mean")))


@register("event_windows", f"SELECT CAST(EPOCH(DATE_TRUNC('hour', ts)) AS BIGINT) AS start, event_type, COUNT(*) AS n, {sql_cut('SUM(value)')} AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    out = ingest.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", cut(F.col("total")).alias("total"))


_HEIGHTS = [0.5 * k for k in range(20)]


@register("matched_gaps", f"""WITH c AS (SELECT * FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)), d AS (SELECT FLOOR(x / 1.5e0) AS kx, FLOOR(y / 1.5e0) AS ky, COUNT(*) AS pulses FROM c WHERE rn = 1 GROUP BY 1, 2),
 f AS (SELECT shot_id, rn, nr, cls, CASE WHEN cls = 2 THEN 0.0e0 ELSE hag END AS h, CASE WHEN pulses > 0 THEN EXP(-(POW(x - center_x, 2) + POW(y - center_y, 2)) / 60.5e0) / pulses ELSE 0.0e0 END AS w
 FROM shots JOIN c ON POW(x - center_x, 2) + POW(y - center_y, 2) <= 156.25 LEFT JOIN d ON kx = FLOOR(x / 1.5e0) AND ky = FLOOR(y / 1.5e0) WHERE cls IN (2, 3, 4, 5)),
 e AS (SELECT CAST(k AS INT) AS level, k * 0.5e0 AS height FROM range(20) AS t(k)),
 a AS (SELECT shot_id, level, height, SUM(CASE WHEN h <= height THEN w ELSE 0 END) / SUM(w) AS g FROM f CROSS JOIN e WHERE rn = 1 GROUP BY ALL HAVING SUM(w) > 0),
 b AS (SELECT shot_id, level, SUM(CASE WHEN h <= height THEN w / GREATEST(nr, 1) ELSE 0 END) / SUM(w / GREATEST(nr, 1)) AS g FROM f CROSS JOIN e GROUP BY ALL HAVING SUM(w / GREATEST(nr, 1)) > 0)
 SELECT shot_id, level, height, {sql_cut('a.g')} AS "first", {sql_cut('b.g')} AS all_returns FROM a FULL JOIN b USING (shot_id, level)""")
def matched_gaps(spark, sf_dir):
    out = profiles.matched_gaps(fixtures.shots(spark, sf_dir), fixtures.dealt(cleaned(spark, sf_dir)), "shot_id", _HEIGHTS, 5.5, 1.5, 12.5)
    return out.select("shot_id", "level", "height", cut(F.col("first")).alias("first"), cut(F.col("all_returns")).alias("all_returns"))


def _inventory(spark, sf_dir) -> DataFrame:
    """Plots whose biomass is of the Naesset form, but for those without cover."""
    k = F.col("shot_id") / 20
    given = fixtures.shots(spark, sf_dir).select("shot_id", F.col("beam").alias("block"), (5 + (k * 37) % 300 / 10).alias("h95"), ((k * 7) % 100 / 100).alias("cc"))
    return given.withColumn("agb", F.when(F.col("cc") == 0, 0.0).otherwise(1.3 * F.pow("h95", F.lit(1.6)) * F.pow("cc", F.lit(0.7))))


@register("naesset_validation", "WITH g AS (SELECT shot_id, beam AS block, 5 + (shot_id / 20.0e0 * 37) % 300 / 10 AS h, (shot_id / 20.0e0 * 7) % 100 / 100 AS k FROM shots), b AS (SELECT block, NTILE(3) OVER (ORDER BY block) - 1 AS fold FROM (SELECT DISTINCT block FROM g)) SELECT shot_id, CAST(fold AS INT) AS fold, ROUND(CASE WHEN k = 0 THEN 0.0e0 ELSE 1.3e0 * POW(h, 1.6e0) * POW(k, 0.7e0) END, 3) AS predicted FROM g JOIN b USING (block)")
def naesset_validation(spark, sf_dir):
    return allometry.validate_naesset(_inventory(spark, sf_dir), "agb", "block", 3).select("shot_id", "fold", F.round("predicted", 3).alias("predicted"))


class Blend:
    """A model as other libraries fit them."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 2.0 * x[:, 0] - 0.25 * x[:, 1] + math.pi


@register("wrapped_model", f"SELECT plot_id, {sql_cut('2 * agb - 0.25e0 * px + PI()')} AS predicted FROM plots")
def wrapped_model(spark, sf_dir):
    return fixtures.plots(spark, sf_dir).select("plot_id", cut(allometry.wrapped(spark, Blend(), ("agb", "px"))).alias("predicted"))


@register("pit_fill", f"""WITH t AS (SELECT LEAST(CAST(FLOOR((4688200.0e0 - y) / 2) AS INT), 99) AS r, LEAST(CAST(FLOOR((x - 308000.0e0) / 2) AS INT), 99) AS c, MAX(hag) AS v FROM cells WHERE cls NOT IN (7, 18) GROUP BY 1, 2),
 g AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, v FROM range(100) AS a(i) CROSS JOIN range(100) AS b(j) LEFT JOIN t ON r = i AND c = j), e AS (SELECT r, c FROM g WHERE v IS NULL),
 s1 AS (SELECT a.r AS r, a.c AS c, b.r AS r2, b.c AS c2 FROM e a JOIN e b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
 s2 AS (SELECT DISTINCT a.r, a.c, b.r2, b.c2 FROM s1 a JOIN s1 b ON a.r2 = b.r AND a.c2 = b.c), s4 AS (SELECT DISTINCT a.r, a.c, b.r2, b.c2 FROM s2 a JOIN s2 b ON a.r2 = b.r AND a.c2 = b.c),
 h AS (SELECT r, c FROM s4 GROUP BY r, c HAVING COUNT(*) <= 4 AND MIN(LEAST(r2, c2)) > 0 AND MAX(GREATEST(r2, c2)) < 99),
 m AS (SELECT r, c, MEDIAN(v) AS v FROM (SELECT DISTINCT s4.r, s4.c, g.r AS rr, g.c AS rc, g.v FROM h JOIN s4 USING (r, c) JOIN g ON g.r BETWEEN r2 - 1 AND r2 + 1 AND g.c BETWEEN c2 - 1 AND c2 + 1 WHERE g.v IS NOT NULL) GROUP BY r, c)
 SELECT g.r AS {R}, g.c AS col, {sql_cut('COALESCE(g.v, m.v)')} AS value, m.r IS NOT NULL AS filled FROM g LEFT JOIN m ON m.r = g.r AND m.c = g.c""")
def pit_fill(spark, sf_dir):
    fine = Grid.from_bbox(*fixtures.EXTENT, 2.0)
    top = fine.bins(cleaned(spark, sf_dir)).groupBy("row", "col").agg(F.max("HeightAboveGround").alias("value"))
    return surfaces.fill_pits(top, fine).withColumn("value", cut(F.col("value")))


@register("extent_raster", f"""WITH b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM pts WHERE yr = 2021), k AS (SELECT *, CEIL((x1 - x0) / 20) AS nx, CEIL((y1 - y0) / 20) AS ny FROM b)
 SELECT CAST(ny - 1 - LEAST(FLOOR((y - y0) / ((y1 - y0) / ny)), ny - 1) AS INT) AS {R}, CAST(LEAST(FLOOR((x - x0) / ((x1 - x0) / nx)), nx - 1) AS INT) AS col, {sql_cut('AVG(z)')} AS value FROM pts CROSS JOIN k WHERE yr = 2021 GROUP BY 1, 2""")
def extent_raster(spark, sf_dir):
    return reference.extent_raster(pts(spark, sf_dir), "Z", 20.0).withColumn("value", cut(F.col("value")))


@register("mixed_density", "SELECT CASE WHEN cls IN (3, 4, 5) THEN 5 ELSE cls END AS \"Classification\", COUNT(*) AS n, MIN(x) AS west FROM pts WHERE cls IN (2, 3, 4, 5, 9) AND x BETWEEN 308000 AND 308200 AND y BETWEEN 4688000 AND 4688150 AND (((x - 308035.0e0) % 100 + 100) % 100 < 30) = (yr = 2021) GROUP BY 1")
def mixed_density(spark, sf_dir):
    box = (308000.0, 4688000.0, 308200.0, 4688150.0)
    out = reference.mixed_density(pts(spark, sf_dir, 2017), pts(spark, sf_dir, 2021), box)
    return out.groupBy("Classification").agg(F.count("*").alias("n"), F.min("X").alias("west"))


_PLANE = "800 + ({x} - 308000) / 64.0e0 + ({y} - 4688000) / 32.0e0"


@register("reference_surfaces", f"""WITH f AS (SELECT LEAST(CAST(FLOOR((4688200.0e0 - y) / 2) AS INT), 99) AS fr, LEAST(CAST(FLOOR((x - 308000.0e0) / 2) AS INT), 99) AS fc, MAX(z) AS top FROM cells WHERE cls NOT IN (7, 18) GROUP BY 1, 2),
 h AS (SELECT fr, fc, GREATEST(top - ({_PLANE.format(x='(308001 + fc * 2)', y='(4688199 - fr * 2)')}), 0) AS h FROM f),
 t AS (SELECT fr // 5 AS r, fc // 5 AS c, MAX(h) AS chm_max, MAX(CASE WHEN fr % 5 BETWEEN 1 AND 2 AND fc % 5 BETWEEN 1 AND 2 THEN h END) AS chm_centre FROM h GROUP BY 1, 2)
 SELECT CAST(i AS INT) AS {R}, CAST(j AS INT) AS col, {sql_cut(_PLANE.format(x='(308005 + j * 10)', y='(4688195 - i * 10)') + ' + 1e-8')} AS dtm, {sql_cut('chm_max + 1e-8')} AS chm_max, {sql_cut('chm_centre + 1e-8')} AS chm_centre FROM range(20) AS a(i) CROSS JOIN range(20) AS b(j) LEFT JOIN t ON r = i AND c = j""")
def reference_surfaces(spark, sf_dir):
    out = reference.reference_surfaces(framed(spark, sf_dir), GRID, TILE, BUFFER, centre=4.0, fine=2.0)
    return out.select("row", "col", *[cut(F.col(c) + 1e-8).alias(c) for c in ("dtm", "chm_max", "chm_centre")])


@register("scene_scores", f"""WITH v AS (SELECT {R} AS r, col AS c, MAX(hag) FILTER (cls <> 7) AS value, MAX(hag) FILTER (rn = 1) AS mx, MAX(hag) FILTER (rn = 1 AND cls IN (2, 5)) AS ce FROM cells GROUP BY 1, 2),
 k AS (SELECT LEAST(CAST(FLOOR((4688200.0e0 - py) / 10.0e0) AS INT), 19) AS r, CAST(FLOOR((px - 308000.0e0) / 10.0e0) AS INT) AS c FROM plots), e AS (SELECT (SELECT MAX(value) FROM v WHERE ABS(v.r - k.r) <= 1 AND ABS(v.c - k.c) <= 1) - (SELECT MAX(mx) FROM v WHERE ABS(v.r - k.r) <= 1 AND ABS(v.c - k.c) <= 1) AS e FROM k WHERE r BETWEEN 1 AND 18 AND c BETWEEN 1 AND 18),
 w AS (SELECT *, mx IS NOT NULL AND ce IS NOT NULL AS known FROM v)
 SELECT {sql_cut('AVG(CASE WHEN known THEN CAST(value IS NOT NULL AS INT) END)')} AS valid, {sql_cut('AVG(CASE WHEN known THEN value - ce END)')} AS bias_centre, {sql_cut('AVG(CASE WHEN known THEN ABS(value - ce) END)')} AS mae_centre, {sql_cut('AVG(CASE WHEN known THEN CAST(ABS(value - ce) < 0.5 AS INT) END)')} AS within05_centre,
 {sql_cut('AVG(CASE WHEN known THEN value - mx END)')} AS bias_max, {sql_cut('AVG(CASE WHEN known THEN ABS(value - mx) END)')} AS mae_max, {sql_cut('AVG(CASE WHEN known THEN CAST(ABS(value - mx) < 0.5 AS INT) END)')} AS within05_max,
 {sql_cut('AVG(value)')} AS mean_height, {sql_cut('AVG(ce)')} AS mean_height_truth, {sql_cut('AVG(CASE WHEN known THEN CAST(value > 2 AS INT) END)')} AS cover2, {sql_cut('AVG(CASE WHEN known THEN CAST(ce > 2 AS INT) END)')} AS cover2_truth,
 {sql_cut('(SELECT AVG(e) FROM e)')} AS treetop_bias, {sql_cut('(SELECT AVG(ABS(e)) FROM e)')} AS treetop_mae, {sql_cut('(SELECT AVG(CAST(ABS(e) < 1 AS INT)) FROM e)')} AS treetop_within1, (SELECT COUNT(*) FROM e) AS trees FROM w""")
def scene_scores(spark, sf_dir):
    cells = GRID.bins(pts(spark, sf_dir))
    top = lambda where, name: F.max(F.when(where, F.col("HeightAboveGround"))).alias(name)
    first = F.col("ReturnNumber") == 1
    rasters = cells.groupBy("row", "col").agg(top(F.col("Classification") != 7, "value"), top(first, "chm_max"), top(first & F.col("Classification").isin(2, 5), "chm_centre"))
    trees = fixtures.plots(spark, sf_dir).select(GRID.row("py").alias("row"), GRID.col("px").alias("col"))
    out = reference.scene_scores(rasters.drop("value"), rasters.select("row", "col", "value"), trees, GRID)
    return out.select(*[cut(F.col(c)).alias(c) for c in out.columns if c != "trees"], "trees")


_TOPS = """t AS (SELECT yr, CAST(LEAST(FLOOR((4688200.0e0 - y) / 5.0e0), 39) AS INT) AS r, CAST(LEAST(FLOOR((x - 308000.0e0) / 5.0e0), 39) AS INT) AS c, FLOOR(MAX(hag) / 4.0e0) * 4.0e0 AS v
  FROM pts WHERE cls = 5 AND x >= 308000.0e0 AND x < 308200.0e0 AND y > 4688000.0e0 AND y <= 4688200.0e0 GROUP BY 1, 2, 3),
 p AS (SELECT t.yr, t.r, t.c FROM t JOIN t n ON n.yr = t.yr AND ABS(n.r - t.r) <= 1 AND ABS(n.c - t.c) <= 1 GROUP BY t.yr, t.r, t.c, t.v HAVING t.v >= MAX(n.v) AND t.v >= 2),
 g AS (WITH RECURSIVE w AS (SELECT yr, r, c, r * 40 + c AS root FROM p UNION SELECT p.yr, p.r, p.c, w.root FROM w JOIN p ON p.yr = w.yr AND ABS(p.r - w.r) + ABS(p.c - w.c) = 1) SELECT yr, r, c, MIN(root) AS root FROM w GROUP BY yr, r, c),
 k AS (SELECT COUNT(DISTINCT CASE WHEN yr = 2017 THEN root END) AS peaks, COUNT(DISTINCT CASE WHEN yr = 2021 THEN root END) AS found FROM g),
 j AS (SELECT a.v AS rv, b.v AS cv FROM (SELECT * FROM t WHERE yr = 2017) a FULL JOIN (SELECT * FROM t WHERE yr = 2021) b ON a.r = b.r AND a.c = b.c)"""
_AGREED = f"SELECT COUNT(cv - rv) AS shared_pixels, COUNT(cv - rv) / CAST(COUNT(rv) AS DOUBLE) AS coverage, COUNT(cv) / 1600.0e0 AS candidate_coverage, COUNT(rv) / 1600.0e0 AS reference_coverage, (COUNT(*) - COUNT(cv - rv)) / 1600.0e0 AS coverage_disagreement, {sql_cut('AVG(cv - rv)')} AS bias, {sql_cut('AVG(ABS(cv - rv))')} AS mae, {sql_cut('SQRT(AVG(POW(cv - rv, 2)))')} AS rmse, quantile_cont(ABS(cv - rv), 0.95) AS p95, ANY_VALUE(peaks) AS peaks, ANY_VALUE(found) AS found FROM j, k"


@register("raster_agreement", f"WITH {_TOPS} {_AGREED}")
def raster_agreement(spark, sf_dir):
    grid = Grid.from_bbox(*fixtures.EXTENT, 5.0)
    tops = [grid.bins(pts(spark, sf_dir, year).where("Classification = 5")).groupBy("row", "col").agg((F.floor(F.max("HeightAboveGround") / 4.0) * 4.0).alias("value")) for year in (2017, 2021)]
    out = scoring.compare_rasters(*tops, grid.ny, grid.nx, reach=10.0, resolution=grid.resolution)
    return out.select(*[cut(F.col(c)).alias(c) if c in ("bias", "mae", "rmse") else c for c in out.columns if not c.startswith(("matched", "peak_"))])


_STANDS = "SELECT block, agb + 25.0e0 AS area, CASE plot_id % 4 WHEN 0 THEN 'FF' || CAST(plot_id % 5 AS VARCHAR(9)) WHEN 1 THEN 'FO' || CAST(plot_id % 3 AS VARCHAR(9)) WHEN 2 THEN 'FP' ELSE 'LA4' END AS code FROM plots"
_KINDS = {kind: " OR ".join(f"code LIKE '{c}%'" for c in codes) for kind, codes in fn.LEAF_CODES.items()}


@register("leaf_types", f"WITH s AS ({_STANDS}), b AS (SELECT block, {', '.join(f'SUM(CASE WHEN {hit} THEN area ELSE 0 END) AS {kind}' for kind, hit in _KINDS.items())} FROM s GROUP BY block) SELECT block, {', '.join(f'{sql_cut(kind)} AS {kind}' for kind in _KINDS)}, CASE WHEN broadleaf + conifer + mixed <= 0 THEN NULL WHEN broadleaf / (broadleaf + conifer + mixed) >= 0.75e0 THEN 'broadleaf' WHEN conifer / (broadleaf + conifer + mixed) >= 0.75e0 THEN 'conifer' ELSE 'mixed' END AS leaf_type FROM b")
def leaf_types(spark, sf_dir):
    stands = spark.sql(_STANDS.replace("FROM plots", "FROM {plots}"), plots=fixtures.plots(spark, sf_dir))
    kind, area = fn.leaf_code(F.col("code")), F.col("area")
    sums = stands.groupBy("block").agg(*[F.sum(F.when(kind == k, area).otherwise(0.0)).alias(k) for k in _KINDS])
    return sums.select("block", *[cut(F.col(k)).alias(k) for k in _KINDS], fn.leaf_type(*[F.col(k) for k in _KINDS]).alias("leaf_type"))
