"""Registered queries that triangulate, classify or simulate by tile or footprint.

The ground of the derived points is a plane, so heights above ground have SQL;
the others are checked by tests of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora import fixtures
from arbora.functions.lineage import written
from arbora.grid import Grid
from arbora.operators import filters, ground, metrics, profiles, scoring, surfaces, terrain, waveform
from arbora.operators.attenuation import fit_transmittance
from arbora.operators.filters import vegetation_by_height
from arbora.operators.joins import at_places
from arbora.plans import products
from arbora.plans.queries import GRID, R, cleaned, cut, pts, register
from arbora.plans.queries import _cut as sql_cut
from arbora.plans.queries import _PLACE, _footprints, _metric_sql, _tidy

TILE, BUFFER = 50.0, 10.0


def framed(spark, sf_dir) -> DataFrame:
    """Clean points and a ring of ground marks 5 m outside the extent, every 10 m, so that the whole extent is triangulated."""
    x0, y0, x1, y1 = fixtures.EXTENT
    along = F.explode(F.sequence(F.lit(0), F.lit(21))).alias("k")
    sides = [(x0 - 5.0, 0.0, y0 - 5.0, 10.0), (x1 + 5.0, 0.0, y0 - 5.0, 10.0), (x0 - 5.0, 10.0, y0 - 5.0, 0.0), (x0 - 5.0, 10.0, y1 + 5.0, 0.0)]
    ring = spark.createDataFrame(sides, "x double, dx double, y double, dy double").select("*", along).select((F.col("x") + F.col("k") * F.col("dx")).alias("X"), (F.col("y") + F.col("k") * F.col("dy")).alias("Y")).distinct()
    marks = ring.select("X", "Y", (800 + (F.col("X") - x0) / 64 + (F.col("Y") - y0) / 32).alias("Z"), F.lit(0.0).alias("HeightAboveGround"), F.lit(2).alias("Classification"))
    return written(cleaned(spark, sf_dir).unionByName(marks, allowMissingColumns=True))  # several steps read it


def _normalised(spark, sf_dir) -> DataFrame:
    return terrain.normalise(framed(spark, sf_dir), GRID, TILE, BUFFER)


@register("tin_hag", f"SELECT x AS \"X\", y AS \"Y\", pulse AS \"Pulse\", rn AS \"ReturnNumber\", {sql_cut('hag')} AS hag FROM cells WHERE cls NOT IN (7, 18)")
def tin_hag(spark, sf_dir):
    return _normalised(spark, sf_dir).select("X", "Y", "Pulse", "ReturnNumber", cut(F.col("HeightAboveGround")).alias("hag"))


@register("dtm_tin", f"SELECT CAST(r AS INT) AS {R}, CAST(c AS INT) AS col, {sql_cut('800 + (c * 10 + 5) / 64.0e0 + (195 - r * 10) / 32.0e0')} AS value, {sql_cut('DEGREES(ATAN(SQRT(1 / 4096.0e0 + 1 / 1024.0e0)))')} AS slope FROM range(20) AS a(r) CROSS JOIN range(20) AS b(c), (SELECT COUNT(*) FROM plots WHERE plot_id < 0)")
def dtm_tin(spark, sf_dir):
    out = terrain.dtm(framed(spark, sf_dir), GRID, TILE, BUFFER)
    return out.select("row", "col", cut(F.col("value") + 1e-8).alias("value"), cut(F.col("slope") + 1e-9).alias("slope"))


@register("dtm_idw", f"WITH g AS (SELECT x, y, AVG(z) AS z FROM pts WHERE yr = 2021 AND cls IN (2, 9) GROUP BY x, y), n AS (SELECT r, c, z, POW(x - 308005 - c * 10, 2) + POW(y - 4688195 + r * 10, 2) AS d2, ROW_NUMBER() OVER (PARTITION BY r, c ORDER BY POW(x - 308005 - c * 10, 2) + POW(y - 4688195 + r * 10, 2), x, y) AS k FROM range(20) AS a(r) CROSS JOIN range(20) AS b(c) CROSS JOIN g) SELECT CAST(r AS INT) AS {R}, CAST(c AS INT) AS col, {sql_cut('SUM(z / GREATEST(d2, 1e-20)) / SUM(1 / GREATEST(d2, 1e-20))')} AS value, CAST(NULL AS DOUBLE) AS slope FROM n WHERE k <= 8 GROUP BY r, c")
def dtm_idw(spark, sf_dir):
    return terrain.dtm(cleaned(spark, sf_dir), GRID, TILE, method="idw").withColumn("value", cut(F.col("value")))


@register("chm_max_flags")
def chm_max_flags(spark, sf_dir):
    heights, base = terrain.heights_and_terrain(framed(spark, sf_dir), GRID, TILE, BUFFER)
    return surfaces.chm_from_heights(heights, GRID, base, max_height=60.0)


@register("chm_max", f"SELECT {R}, col, {sql_cut('MAX(hag)')} AS value FROM cells WHERE rn = 1 AND cls IN (2, 3, 4, 5, 9) GROUP BY {R}, col")
def chm_max(spark, sf_dir):
    out = chm_max_flags(spark, sf_dir).where("value is not null")
    return out.select("row", "col", cut(F.col("value")).alias("value"))


@register("chm_pitfree")
def chm_pitfree(spark, sf_dir):
    return surfaces.chm_layers(pts(spark, sf_dir), GRID, TILE, BUFFER)


@register("chm_tin")
def chm_tin(spark, sf_dir):
    return surfaces.chm_layers(pts(spark, sf_dir), GRID, TILE, BUFFER, (0.0,))


@register("chm_spike_free")
def chm_spike_free(spark, sf_dir):
    return surfaces.spike_free(cleaned(spark, sf_dir), GRID, TILE, BUFFER)


@register("statistical_outliers", "WITH p AS (SELECT pulse * 100 + rn AS id, x, y, z FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)), n AS (SELECT a.id, SQRT(POW(a.x - b.x, 2) + POW(a.y - b.y, 2) + POW(a.z - b.z, 2)) AS d, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY POW(a.x - b.x, 2) + POW(a.y - b.y, 2) + POW(a.z - b.z, 2)) AS k FROM p a JOIN p b ON a.id <> b.id AND b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25), m AS (SELECT id, AVG(d) AS d FROM n WHERE k <= 8 GROUP BY id) SELECT p.id, x AS \"X\", y AS \"Y\", z AS \"Z\" FROM p JOIN m ON p.id = m.id WHERE d <= (SELECT AVG(d) + 2 * STDDEV_SAMP(d) FROM m)")
def statistical_outliers(spark, sf_dir):
    p = cleaned(spark, sf_dir).withColumn("id", F.col("Pulse") * 100 + F.col("ReturnNumber"))
    return surfaces.drop_statistical_outliers(p, "id", 8, 2.0).select("id", "X", "Y", "Z")


@register("waveform_weights", f"WITH near AS (SELECT shot_id, p.*, POW(x - center_x, 2) + POW(y - center_y, 2) AS d2 FROM shots JOIN pts p ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - center_x, 2) + POW(y - center_y, 2) <= 272.25), w AS (SELECT shot_id, z, cls, EXP(-d2 / 60.5e0) / GREATEST(COUNT(*) FILTER (rn >= nr) OVER (PARTITION BY shot_id, FLOOR(x / 1.5e0), FLOOR(y / 1.5e0)), 1) AS w FROM near) SELECT shot_id, CAST(FLOOR(z / 2) AS BIGINT) AS bin, {sql_cut('SUM(w)')} AS energy, {sql_cut('SUM(CASE WHEN cls = 2 THEN w ELSE 0 END)')} AS ground FROM w GROUP BY 1, 2")
def waveform_weights(spark, sf_dir):
    points = fixtures.dealt(cleaned(spark, sf_dir))
    sums = cut(F.sum("w")).alias("energy"), cut(F.sum(F.col("w") * F.col("g"))).alias("ground")
    bins = lambda places: waveform.weighted_returns(places, points, _PLACE).groupBy(*_PLACE, F.floor(F.col("Z") / 2).alias("bin")).agg(*sums)
    return at_places(fixtures.shots(spark, sf_dir), *_PLACE, bins).select("shot_id", "bin", "energy", "ground")


@register("plot_terrain", f"WITH d AS (SELECT plot_id, p.* FROM plots JOIN pts p ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - px, 2) + POW(y - py, 2) <= 100) SELECT plot_id, {_metric_sql(('cc', 'h50', 'h95', 'hmax'))} FROM d GROUP BY plot_id")
def plot_terrain(spark, sf_dir):
    points, wanted = framed(spark, sf_dir), ("cc", "h50", "h95", "hmax")

    def structure(places: DataFrame) -> DataFrame:
        heights = products.plot_heights(places, points, ["px", "py"], 10.0)
        # to the micrometre: the terrain is interpolated, and heights of whole metres are bounds
        return metrics.structure(heights.withColumn("HeightAboveGround", F.round("HeightAboveGround", 6)), ["px", "py"], 100 * math.pi, wanted)

    return _tidy(at_places(fixtures.plots(spark, sf_dir), "px", "py", structure).select("plot_id", *wanted))


_BINS = "b AS (SELECT shot_id, 800 + (center_x - 308000) / 64 + (center_y - 4688000) / 32 AS zg, FLOOR(z * 2) / 2 AS low, SUM(CASE WHEN cls = 2 THEN 0.0e0 ELSE 1 END) AS canopy, SUM(CASE WHEN cls = 2 THEN 1.0e0 ELSE 0 END) AS ground FROM shots JOIN pts ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - center_x, 2) + POW(y - center_y, 2) <= 156.25 GROUP BY 1, 2, 3)"


@register("footprint_profiles", f"""WITH {_BINS}, t AS (SELECT shot_id, SUM(canopy) AS rv, SUM(ground) AS rg FROM b GROUP BY shot_id), e AS (SELECT CAST(k AS INT) AS bin, k - 3.0e0 AS low FROM range(50) AS a(k)),
 n AS (SELECT t.shot_id, bin, e.low, rv, rg, COALESCE(SUM(canopy * o), 0) AS canopy, COALESCE(SUM(ground * o), 0) AS ground FROM t CROSS JOIN e LEFT JOIN (SELECT *, UNNEST(range(50)) AS k FROM b) AS b ON b.shot_id = t.shot_id AND k = bin AND b.low - zg < e.low + 1 AND b.low - zg + 0.5e0 > e.low, LATERAL (SELECT (LEAST(b.low - zg + 0.5e0, e.low + 1) - GREATEST(b.low - zg, e.low)) / 0.5e0 AS o) GROUP BY ALL),
 u AS (SELECT *, SUM(canopy) OVER (PARTITION BY shot_id ORDER BY bin DESC) AS above, SUM(canopy + ground) OVER (PARTITION BY shot_id) AS whole FROM n),
 v AS (SELECT *, MAX(CASE WHEN above > 0.001e0 * whole THEN low + 1 END) OVER (PARTITION BY shot_id) AS signal_top FROM u)
 SELECT shot_id, bin, {sql_cut('canopy')} AS canopy, {sql_cut('ground')} AS ground, {sql_cut('CASE WHEN low < signal_top THEN 1 - (above - canopy / 2) / (rv + 1.5e0 * rg) END')} AS gap, signal_top FROM v""")
def footprint_profiles(spark, sf_dir):
    zg, is_ground = 800 + (F.col("center_x") - 308000) / 64 + (F.col("center_y") - 4688000) / 32, F.col("Classification") == 2
    sums = F.sum(F.when(is_ground, 0.0).otherwise(1.0)).alias("canopy"), F.sum(F.when(is_ground, 1.0).otherwise(0.0)).alias("ground")

    def profile(near: DataFrame) -> DataFrame:
        bins = near.groupBy(*_PLACE, zg.alias("z_ground"), (F.floor(F.col("Z") * 2) / 2 + 0.25).alias("z")).agg(*sums)
        return profiles.footprint_profiles(bins, _PLACE, [float(k) for k in range(-3, 48)], 0.5, 1.5)

    out = _footprints(spark, sf_dir, profile)
    return out.select("shot_id", "bin", *[cut(F.col(c)).alias(c) for c in ("canopy", "ground", "gap")], "signal_top")


@register("aligned_classes", "SELECT cls, CASE WHEN cls = 2 AND pulse % 5 = 0 THEN 1 ELSE cls END AS found, COUNT(*) AS n FROM pts WHERE yr = 2021 GROUP BY 1, 2")
def aligned_classes(spark, sf_dir):
    given = pts(spark, sf_dir)
    other = given.withColumn("Classification", F.when((F.col("Classification") == 2) & (F.col("Pulse") % 5 == 0), F.lit(1)).otherwise(F.col("Classification"))).orderBy(F.xxhash64("X", "Y"))
    return scoring.aligned(given, other, ("X", "Y", "Z", "Pulse", "ReturnNumber")).groupBy(F.col("Classification").alias("cls"), "found").agg(F.count("*").alias("n"))


@register("nested_blocks", "SELECT level, file_id FROM (SELECT file_id, (min_x - 308000) / 40 AS i, (min_y - 4688000) / 40 AS j FROM files), (VALUES (1, 1, 1), (4, 1, 2), (16, 0, 4)) AS l(level, off, s) WHERE i >= off AND i < off + s AND j >= off AND j < off + s")
def nested_blocks(spark, sf_dir):
    return scoring.nested_blocks(fixtures.files(spark, sf_dir), (1, 4, 16), 40.0)


_FIVE = "LEAST(FLOOR((4688200.0e0 - y) / 5), 39) AS r5, LEAST(FLOOR((x - 308000.0e0) / 5), 39) AS c5"


@register("reference_strata", f"WITH f AS (SELECT r5, c5, AVG(CASE WHEN hag > 2 THEN 1.0e0 ELSE 0 END) AS s FROM (SELECT *, {_FIVE} FROM cells) WHERE rn = 1 AND cls NOT IN (7, 18) GROUP BY 1, 2) SELECT CAST(r AS INT) AS {R}, CAST(c AS INT) AS col, '0-15' AS slope, CASE WHEN s IS NULL THEN '' WHEN s < 0.5 THEN '0-50' WHEN s < 0.8e0 THEN '50-80' WHEN s < 0.95e0 THEN '80-95' ELSE '95-100' END AS cover FROM range(40) AS a(r) CROSS JOIN range(40) AS b(c) LEFT JOIN f ON r5 = r AND c5 = c")
def reference_strata(spark, sf_dir):
    fine = Grid.from_bbox(*fixtures.EXTENT, 5.0)
    marks = framed(spark, sf_dir)
    return scoring.reference_strata(terrain.normalise(marks, fine, TILE, BUFFER), terrain.dtm(marks, fine, TILE, BUFFER), fine)


@register("reclassified")
def reclassified(spark, sf_dir):
    return ground.reclassify(_identified(spark, sf_dir), GRID, TILE, BUFFER).groupBy("Classification").agg(F.count("*").alias("n"))


@register("classifier_sweep")
def classifier_sweep(spark, sf_dir):
    settings = {f"smrf {slope}": _ground_query_settings(slope) for slope in (0.15, 0.5)}
    return scoring.sweep(_identified(spark, sf_dir), F.col("Classification") == 2, settings)


def _ground_query_settings(slope: float):
    return lambda points: ground.classify(points, GRID, TILE, BUFFER, "smrf", slope=slope)


@register("waveform_full")
def waveform_full(spark, sf_dir):
    shots = fixtures.shots(spark, sf_dir)
    return waveform.simulate(shots, fixtures.dealt(cleaned(spark, sf_dir))).select("shot_id", "n_points", "z_ground", "ground_supported", "cover", "rh")


def _identified(spark, sf_dir) -> DataFrame:
    return pts(spark, sf_dir).withColumn("id", F.col("Pulse") * 100 + F.col("ReturnNumber"))


def _ground_query(method: str, **parameters):
    def query(spark, sf_dir):
        return ground.classify(_identified(spark, sf_dir), GRID, TILE, BUFFER, method, **parameters)

    query.__name__ = f"ground_{method}"
    return query


for _method in ground.METHODS:
    register(f"ground_{_method}")(_ground_query(_method))


@register("ground_votes")
def ground_votes(spark, sf_dir):
    return ground.classify_by_votes(_identified(spark, sf_dir), GRID, TILE, BUFFER)


@register("ground_envelope")
def ground_envelope(spark, sf_dir):
    return ground.envelope(_identified(spark, sf_dir), GRID, TILE, BUFFER)


@register("vegetation_classes", "SELECT CASE WHEN cls = 1 THEN CASE WHEN hag >= 5 THEN 5 WHEN hag >= 2 THEN 4 WHEN hag >= 0.5 THEN 3 ELSE 1 END ELSE cls END AS \"Classification\", COUNT(*) AS n FROM pts GROUP BY 1")
def vegetation_classes(spark, sf_dir):
    return vegetation_by_height(pts(spark, sf_dir, None)).groupBy("Classification").agg(F.count("*").alias("n"))


@register("transmittance_fit")
def transmittance_fit(spark, sf_dir):
    gaps = profiles.gap_from_returns(filters.of_classes(pts(spark, sf_dir), (2, 3, 4, 5)), ["Year"], [float(k) for k in range(1, 40)])
    return fit_transmittance(gaps.select(F.lit(1).alias("key"), (40.0 - F.col("height")).alias("c"), F.col("gap").alias("t")), ["key"], "c", "t")
