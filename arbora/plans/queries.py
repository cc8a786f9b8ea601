"""Registered queries over the derived point tables, each beside the SQL that must give the same rows.

Derived doubles are cut to six decimals on both sides by the same expression,
as sums in another order differ in the last bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import fixtures
from arbora.functions import columns as fn
from arbora.grid import Grid
from arbora.operators import allometry, filters, joins, metrics, profiles, scoring
from arbora.operators.change import change
from arbora.schema import BARE_GROUND

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GRID, YEAR = fixtures.GRID, 2021
_SOURCES = {"pts": fixtures.PTS, "shots": fixtures.SHOTS, "plots": fixtures.PLOTS, "files": fixtures.FILES}


def cut(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.3) / 1e6


def _cut(sql: str) -> str:
    return f"(FLOOR(({sql}) * 1e6 + 0.3e0) / 1e6)"


def register(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may use pts, shots, plots, files and cells (owned points of 2021 with row and col)."""

    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ctes = [f"{k} AS ({v})" for k, v in _SOURCES.items() if k in sql or (k == "pts" and "cells" in sql)]
            if "cells" in sql:
                ctes.append(f"cells AS ({_CELLS})")
            body = sql.strip()
            own = body[5:] if body.startswith("WITH ") else body
            ORACLES[name] = body if not ctes else "WITH " + ", ".join(ctes) + (" " if own is body else ", ") + own
        return query

    return keep


_CELLS = "SELECT *, CAST(LEAST(FLOOR((4688200.0e0 - y) / 10.0e0), 19) AS INT) AS \"row\", CAST(LEAST(FLOOR((x - 308000.0e0) / 10.0e0), 19) AS INT) AS col FROM pts WHERE yr = 2021 AND x >= 308000.0e0 AND x < 308200.0e0 AND y > 4688000.0e0 AND y <= 4688200.0e0"
_VEG = "cls IN (3, 4, 5) AND hag > 0"
R = '"row"'


def pts(spark, sf_dir, year: int | None = YEAR) -> DataFrame:
    return fixtures.points(spark, sf_dir, year)


def cleaned(spark, sf_dir) -> DataFrame:
    return filters.clean(pts(spark, sf_dir))


# scans and selections -------------------------------------------------------------------------------------------


@register("bbox_scan", "SELECT x AS \"X\", y AS \"Y\", z AS \"Z\", cls AS \"Classification\" FROM pts WHERE yr = 2021 AND x BETWEEN 308050 AND 308100 AND y BETWEEN 4688050 AND 4688120")
def bbox_scan(spark, sf_dir):
    from arbora.sources.catalog import query_bbox

    return query_bbox(pts(spark, sf_dir, None), 308050.0, 4688050.0, 308100.0, 4688120.0, ["Z", "Classification"], YEAR)


@register("tile_scan", "SELECT yr AS \"Year\", COUNT(*) AS n, MAX(z) AS top FROM pts WHERE x BETWEEN 308000 AND 310000 AND y BETWEEN 4687000 AND 4689000 GROUP BY yr")
def tile_scan(spark, sf_dir):
    from arbora.sources.catalog import query_tile

    return query_tile(pts(spark, sf_dir, None), 308, 4689, ["Z"]).groupBy("Year").agg(F.count("*").alias("n"), F.max("Z").alias("top"))


@register("available_years", "SELECT DISTINCT yr AS \"Year\" FROM pts")
def available_years(spark, sf_dir):
    return pts(spark, sf_dir, None).select("Year").distinct().orderBy("Year")


@register("data_extent", "SELECT MIN(x) AS min_x, MIN(y) AS min_y, MAX(x) AS max_x, MAX(y) AS max_y FROM pts")
def data_extent(spark, sf_dir):
    from arbora.sources.catalog import data_bbox

    return data_bbox(pts(spark, sf_dir, None))


@register("class_filter", "SELECT cls AS \"Classification\", COUNT(*) AS n FROM pts WHERE cls IN (2, 5) GROUP BY cls")
def class_filter(spark, sf_dir):
    return filters.of_classes(pts(spark, sf_dir, None), (2, 5)).groupBy("Classification").agg(F.count("*").alias("n"))


@register("clean_points", "SELECT x AS \"X\", y AS \"Y\", z AS \"Z\", pulse AS \"Pulse\" FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)")
def clean_points(spark, sf_dir):
    return cleaned(spark, sf_dir).select("X", "Y", "Z", "Pulse")


@register("surface_returns", "SELECT cls AS \"Classification\", COUNT(*) AS n, MIN(z) AS low FROM pts WHERE yr = 2021 AND rn = 1 AND cls IN (2, 3, 4, 5, 9) GROUP BY cls")
def surface_returns(spark, sf_dir):
    return filters.surface_returns(pts(spark, sf_dir)).groupBy("Classification").agg(F.count("*").alias("n"), F.min("Z").alias("low"))


@register("classifier_input", "SELECT CASE WHEN cls IN (7, 18) THEN cls ELSE 1 END AS \"Classification\", GREATEST(rn, 1) AS \"ReturnNumber\", GREATEST(nr, rn, 1) AS \"NumberOfReturns\", COUNT(*) AS n FROM pts GROUP BY 1, 2, 3")
def classifier_input(spark, sf_dir):
    return filters.classifier_input(pts(spark, sf_dir, None)).groupBy("Classification", "ReturnNumber", "NumberOfReturns").agg(F.count("*").alias("n"))


@register("point_bins", f"SELECT {R}, col, COUNT(*) AS n FROM cells GROUP BY {R}, col")
def point_bins(spark, sf_dir):
    return GRID.bins(pts(spark, sf_dir)).groupBy("row", "col").agg(F.count("*").alias("n"))


@register("grid_tiles", """SELECT CAST(r * 3 + c AS INT) AS tile, 308000.0e0 + c * 80.0e0 AS min_x, GREATEST(4688200.0e0 - (r + 1) * 80.0e0, 4688000.0e0) AS min_y,
 LEAST(308000.0e0 + (c + 1) * 80.0e0, 308200.0e0) AS max_x, 4688200.0e0 - r * 80.0e0 AS max_y, 308000.0e0 + c * 80.0e0 - 10.0e0 AS query_min_x, GREATEST(4688200.0e0 - (r + 1) * 80.0e0, 4688000.0e0) - 10.0e0 AS query_min_y,
 LEAST(308000.0e0 + (c + 1) * 80.0e0, 308200.0e0) + 10.0e0 AS query_max_x, 4688200.0e0 - r * 80.0e0 + 10.0e0 AS query_max_y FROM range(3) AS a(r), range(3) AS b(c), (SELECT COUNT(*) FROM plots WHERE plot_id < 0)""")
def grid_tiles(spark, sf_dir):
    return GRID.tiles(spark, 80.0, 10.0)


@register("halo_tiles", """SELECT CAST(r * 3 + c AS INT) AS tile, COUNT(*) AS n, SUM(CASE WHEN x >= 308000.0e0 + c * 80 AND x < LEAST(308000.0e0 + (c + 1) * 80, 308200) AND y > GREATEST(4688200.0e0 - (r + 1) * 80, 4688000) AND y <= 4688200.0e0 - r * 80 THEN 1 ELSE 0 END)::BIGINT AS core
 FROM pts, range(3) AS a(r), range(3) AS b(c) WHERE yr = 2021 AND x BETWEEN 308000 - 10 AND 308200 + 10
 AND x BETWEEN 308000.0e0 + c * 80 - 10 AND 308000.0e0 + (c + 1) * 80 + 10 - 1e-9 AND y BETWEEN 4688200.0e0 - (r + 1) * 80 - 10 + 1e-9 AND 4688200.0e0 - r * 80 + 10 GROUP BY 1""")
def halo_tiles(spark, sf_dir):
    out = GRID.halo(pts(spark, sf_dir).select("X", "Y"), 80.0, 10.0)
    return out.groupBy("tile").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_core"), 1)).alias("core"))


@register("dense_grid_left_join", f"SELECT CAST(a.r AS INT) AS {R}, CAST(b.c AS INT) AS col, COALESCE(n, 0) AS n FROM range(20) AS a(r) CROSS JOIN range(20) AS b(c) LEFT JOIN (SELECT {R}, col, COUNT(*) AS n FROM cells WHERE rn >= 6 GROUP BY {R}, col) t ON t.{R} = a.r AND t.col = b.c")
def dense_grid(spark, sf_dir):
    counts = GRID.bins(pts(spark, sf_dir).where("ReturnNumber >= 6")).groupBy("row", "col").agg(F.count("*").alias("n"))
    return GRID.cells(spark).select("row", "col").join(counts, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


@register("tile_names", "SELECT file_id, 2000 + CAST(file_id AS INT) AS \"year\", CAST(300 + file_id AS INT) AS x_km, CAST(4600 + file_id AS INT) AS y_km, CAST((300 + file_id) * 1000 AS DOUBLE) AS min_x, CAST((4600 + file_id) * 1000 - 2000 AS DOUBLE) AS min_y FROM files")
def tile_names(spark, sf_dir):
    from arbora.sources.tiles import parse_names

    names = fixtures.files(spark, sf_dir).select("file_id", F.format_string("PNOA_%d_ARA_%d-%d_ORT.laz", (2000 + F.col("file_id")).cast("int"), (300 + F.col("file_id")).cast("int"), (4600 + F.col("file_id")).cast("int")).alias("path"))
    return parse_names(names, "path").select("file_id", "year", "x_km", "y_km", "min_x", "min_y")


# rasters --------------------------------------------------------------------------------------------------------


@register("dsm_max", f"SELECT {R}, col, MAX(z) AS value FROM cells WHERE cls NOT IN (7, 18) AND rn = 1 GROUP BY {R}, col")
def dsm_max(spark, sf_dir):
    from arbora.operators.surfaces import dsm

    return dsm(pts(spark, sf_dir), GRID)


@register("dtm_min", f"SELECT {R}, col, MIN(z) AS value FROM cells WHERE cls IN (2, 9) GROUP BY {R}, col")
def dtm_min(spark, sf_dir):
    from arbora.operators.surfaces import dtm_min as lowest

    return lowest(pts(spark, sf_dir), GRID)


@register("rasterise_p90", f"SELECT {R}, col, {_cut('quantile_cont(z, 0.9)')} AS value FROM cells GROUP BY {R}, col")
def rasterise_p90(spark, sf_dir):
    return metrics.rasterise(pts(spark, sf_dir), GRID, "Z", "p90").withColumn("value", cut(F.col("value")))


@register("density", f"SELECT {R}, col, COUNT(*) / 100.0e0 AS density FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col")
def density(spark, sf_dir):
    return metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("density",))


_FIRST = "rn = 1 AND cls IN (2, 3, 4, 5)"
_CC = f"CAST(COUNT(*) FILTER ({_FIRST} AND cls <> 2 AND hag > 2) AS DOUBLE) / NULLIF(COUNT(*) FILTER ({_FIRST}), 0)"


@register("canopy_cover", f"SELECT {R}, col, {_CC} AS cc FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col")
def canopy_cover(spark, sf_dir):
    return metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("cc",))


def _metric_sql(names: tuple[str, ...], source: str = "cells", keys: str = f"{R}, col", area: str = "100.0e0") -> str:
    veg = f"({_VEG})"
    h = f"CASE WHEN {_VEG} THEN hag END"
    strata = {n: f"CAST(COUNT(*) FILTER ({veg} AND hag > {lo} AND hag <= {hi if math.isfinite(hi) else 1e9}) AS DOUBLE) / NULLIF(COUNT(*) FILTER ({veg}), 0)" for n, (lo, hi) in metrics.STRATA.items()}
    all_sql = {
        "density": f"COUNT(*) / {area}", "cc": _CC, "hmean": _cut(f"AVG({h})"), **strata,
        **{n: _cut(f"quantile_cont({h}, {q})") for n, q in (("h50", 0.5), ("h75", 0.75), ("h95", 0.95))},
        "hmax": f"MAX({h})", "crr": _cut(f"(AVG({h}) - MIN({h})) / NULLIF(MAX({h}) - MIN({h}), 0)"),
    }
    return ", ".join(f"{all_sql[n]} AS {n}" for n in names)


_PLAIN = tuple(m for m in metrics.METRICS if m not in ("fhd", "vci"))
_ROUGH = ("hmean", "h50", "h75", "h95", "crr", "fhd", "vci")


def _tidy(df: DataFrame) -> DataFrame:
    return df.select(*[cut(F.col(c)).alias(c) if c in _ROUGH else F.col(c) for c in df.columns])


@register("height_percentiles", f"SELECT {R}, col, {_metric_sql(('h50', 'h75', 'h95', 'hmax'))} FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col")
def height_percentiles(spark, sf_dir):
    return _tidy(metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("h50", "h75", "h95", "hmax")))


@register("height_strata", f"SELECT {R}, col, {_metric_sql(tuple(metrics.STRATA))} FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col")
def height_strata(spark, sf_dir):
    return metrics.cell_metrics(cleaned(spark, sf_dir), GRID, tuple(metrics.STRATA))


@register("canopy_relief", f"SELECT {R}, col, {_metric_sql(('hmean', 'crr'))} FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col")
def canopy_relief(spark, sf_dir):
    return _tidy(metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("hmean", "crr")))


_FHD = f"""bands AS (SELECT {R}, col, LEAST(FLOOR(hag), 79) AS band, COUNT(*) AS n FROM cells WHERE {_VEG} AND hag <= 80 GROUP BY 1, 2, 3),
 fhd AS (SELECT {R}, col, -SUM(p * LN(p)) AS fhd FROM (SELECT {R}, col, n / SUM(n) OVER (PARTITION BY {R}, col) AS p FROM bands) t GROUP BY {R}, col)"""


@register("fhd_vci", f"WITH {_FHD} SELECT c.{R}, c.col, {_cut('fhd')} AS fhd, {_cut('fhd / LN(80)')} AS vci FROM (SELECT DISTINCT {R}, col FROM cells WHERE cls NOT IN (7, 18)) c LEFT JOIN fhd f ON f.{R} = c.{R} AND f.col = c.col")
def fhd_vci(spark, sf_dir):
    return _tidy(metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("fhd", "vci")))


@register("all_metrics", f"WITH {_FHD}, plain AS (SELECT {R}, col, {_metric_sql(_PLAIN)} FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col HAVING COUNT(*) / 100.0e0 >= 0.5) SELECT c.*, {_cut('fhd')} AS fhd, {_cut('fhd / LN(80)')} AS vci FROM plain c LEFT JOIN fhd f ON f.{R} = c.{R} AND f.col = c.col")
def all_metrics(spark, sf_dir):
    out = metrics.cell_metrics(cleaned(spark, sf_dir), GRID, min_density=0.5)
    return _tidy(out.where("density is not null"))


_GAP = f"SELECT {R}, col, COUNT(*) FILTER (rn = 1 AND cls = 2) AS gap_n_ground, COUNT(*) FILTER (rn = 1 AND cls IN (2, 3, 4, 5)) AS gap_n_classified, COUNT(*) FILTER (rn = 1) AS gap_n_first FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col"


@register("gap_fraction", f"SELECT {R}, col, CAST(gap_n_ground AS DOUBLE) / NULLIF(gap_n_classified, 0) AS gap, gap_n_ground, gap_n_classified, gap_n_first, CASE WHEN gap_n_classified > 0 THEN gap_n_ground = 0 END AS gap_saturated FROM ({_GAP}) t")
def gap_fraction(spark, sf_dir):
    return metrics.gap_fraction(cleaned(spark, sf_dir), GRID)


@register("lai", f"SELECT {R}, col, {_cut('LEAST(GREATEST(-LN(gap_n_ground / CAST(gap_n_classified AS DOUBLE)) / 0.5e0, 0), 15)')} AS lai FROM ({_GAP}) t WHERE gap_n_ground > 0")
def lai(spark, sf_dir):
    gap = metrics.gap_fraction(cleaned(spark, sf_dir), GRID)
    return gap.select("row", "col", cut(fn.lai(F.col("gap"))).alias("lai")).where("lai is not null")


@register("naesset_agb", f"SELECT {R}, col, CASE WHEN cc = 0 THEN 0.0e0 WHEN cc > 0 AND cc <= 1 AND h95 > 0 THEN {_cut('0.8e0 * POW(h95, 1.8e0) * POW(cc, 0.5e0)')} END AS agb FROM (SELECT {R}, col, {_CC} AS cc, quantile_cont(CASE WHEN {_VEG} THEN hag END, 0.95) AS h95 FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col) t")
def naesset_agb(spark, sf_dir):
    m = metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("cc", "h95"))
    return m.select("row", "col", F.when(F.col("cc") == 0, F.lit(0.0)).otherwise(cut(allometry.naesset())).alias("agb"))


LINEAR = allometry.LinearModel(("h50", "h95"), (-2.0, 1.5, 2.5), offset=1.0, bias=1.05)


@register("linear_agb", f"SELECT {R}, col, {_cut('1.05e0 * POW(GREATEST(-2.0e0 + 1.5e0 * SQRT(h50 + 1) + 2.5e0 * SQRT(h95 + 1), 0), 2)')} AS agb FROM (SELECT {R}, col, quantile_cont(CASE WHEN {_VEG} THEN hag END, 0.5) AS h50, quantile_cont(CASE WHEN {_VEG} THEN hag END, 0.95) AS h95 FROM cells WHERE cls NOT IN (7, 18) GROUP BY {R}, col) t")
def linear_agb(spark, sf_dir):
    m = metrics.cell_metrics(cleaned(spark, sf_dir), GRID, ("h50", "h95"))
    return m.select("row", "col", cut(LINEAR.biomass()).alias("agb"))


_STRATA4 = ("ENT x Europe", "ENT x North America", "GSW x Australia", "DBT x South America", "EBT x Europe")
_RH = {40: 2.0, 50: 4.0, 60: 6.0, 70: 9.0, 80: 12.0, 98: 20.0}


def _footprint_sql() -> str:
    arms = []
    for k, s in enumerate(_STRATA4):
        bias, b0, terms = allometry.FOOTPRINT_MODELS[allometry.STRATUM_MODELS.get(s, s)]
        total = " + ".join([f"CAST({b0} AS DOUBLE)"] + [f"CAST({b} AS DOUBLE) * SQRT({_RH[r]}e0 + (shot_id % 7) + 100)" for r, b in terms.items()])
        arms.append(f"WHEN shot_id % 5 = {k} THEN CAST({bias} AS DOUBLE) * POW(GREATEST({total}, 0), 2)")
    return f"SELECT shot_id, {_cut('CASE ' + ' '.join(arms) + ' END')} AS agbd FROM shots"


@register("gedi_l4a", _footprint_sql())
def gedi_l4a(spark, sf_dir):
    s = fixtures.shots(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(x) for x in _STRATA4]), (F.col("shot_id") % 5 + 1).cast("int"))
    given = s.select("shot_id", name.alias("stratum"), *[(F.lit(v) + F.col("shot_id") % 7).alias(f"rh{k}") for k, v in _RH.items()])
    return allometry.footprint_biomass(given).select("shot_id", cut(F.col("agbd")).alias("agbd"))


@register("pulse_density", "SELECT CAST(FLOOR(x / 5) AS BIGINT) AS kx, CAST(FLOOR(y / 5) AS BIGINT) AS ky, COUNT(*) / 25.0e0 AS density FROM pts WHERE yr = 2021 AND rn = 1 GROUP BY 1, 2")
def pulse_density(spark, sf_dir):
    return metrics.pulse_density(pts(spark, sf_dir))


@register("freeze_local", f"SELECT kx, ky, {_cut('3.1e0 / LN(1.75e0 * LEAST(GREATEST(density, 0.5e0), 100) + 2.1e0) + 1')} AS freeze FROM (SELECT CAST(FLOOR(x / 5) AS BIGINT) AS kx, CAST(FLOOR(y / 5) AS BIGINT) AS ky, COUNT(*) / 25.0e0 AS density FROM pts WHERE yr = 2021 AND rn = 1 GROUP BY 1, 2) t")
def freeze_local(spark, sf_dir):
    return metrics.pulse_density(pts(spark, sf_dir)).select("kx", "ky", cut(fn.freeze_distance(F.col("density"))).alias("freeze"))


@register("pulse_spacing", f"SELECT n, cells, {_cut('SQRT(cells * 25.0e0 / n)')} AS spacing, {_cut('3 * SQRT(cells * 25.0e0 / n)')} AS freeze FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT (FLOOR(x / 5), FLOOR(y / 5))) AS cells FROM pts WHERE yr = 2021 AND rn = 1) t")
def pulse_spacing(spark, sf_dir):
    out = metrics.pulse_spacing(pts(spark, sf_dir).where("ReturnNumber = 1"))
    return out.select("n", "cells", cut(F.col("spacing")).alias("spacing"), cut(F.col("freeze")).alias("freeze"))


@register("scan_angle", f"SELECT {R}, col, {_cut('AVG(ABS(pulse % 41 - 20))')} AS angle FROM cells WHERE rn = 1 GROUP BY {R}, col")
def scan_angle(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("ScanAngleRank", (F.col("Pulse") % 41 - 20).cast("int"))
    return metrics.scan_angle(p, GRID).withColumn("angle", cut(F.col("angle")))


GRID5 = Grid.from_bbox(*fixtures.EXTENT, 5.0)


@register("vegetation_evidence", f"""WITH s AS (SELECT CAST(LEAST(FLOOR((4688200.0e0 - y) / 5), 39) AS INT) AS r, CAST(LEAST(FLOOR((x - 308000.0e0) / 5), 39) AS INT) AS c, AVG(CASE WHEN nr > 1 THEN 1.0e0 ELSE 0.0e0 END) AS share FROM cells GROUP BY 1, 2),
 d AS (SELECT a.r, b.c, COALESCE(share, 0) AS share FROM range(40) AS a(r) CROSS JOIN range(40) AS b(c) LEFT JOIN s ON s.r = a.r AND s.c = b.c)
 SELECT CAST(a.r AS INT) AS {R}, CAST(a.c AS INT) AS col, {_cut('AVG(b.share)')} AS evidence FROM d a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) i CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) j
 JOIN d b ON b.r = LEAST(GREATEST(a.r + i, 0), 39) AND b.c = LEAST(GREATEST(a.c + j, 0), 39) GROUP BY 1, 2""")
def vegetation_evidence(spark, sf_dir):
    return metrics.vegetation_evidence(pts(spark, sf_dir), GRID5).withColumn("evidence", cut(F.col("evidence")))


# thinning and outliers ------------------------------------------------------------------------------------------


@register("thin_highest", "SELECT x AS \"X\", y AS \"Y\", hag AS \"HeightAboveGround\" FROM (SELECT x, y, hag, ROW_NUMBER() OVER (PARTITION BY FLOOR(x / 2), FLOOR(y / 2) ORDER BY hag DESC, x, y) AS k FROM pts WHERE yr = 2021) t WHERE k = 1")
def thin_highest(spark, sf_dir):
    return filters.thin_highest(pts(spark, sf_dir), 2.0).select("X", "Y", "HeightAboveGround")


@register("lowest_ground", "SELECT x AS \"X\", y AS \"Y\", z AS \"Z\" FROM (SELECT x, y, z, ROW_NUMBER() OVER (PARTITION BY FLOOR(x / 2.5), FLOOR(y / 2.5) ORDER BY z, x, y) AS k FROM pts WHERE yr = 2021 AND cls = 2) t WHERE k = 1")
def lowest_ground(spark, sf_dir):
    ground = filters.of_classes(pts(spark, sf_dir), (BARE_GROUND,))
    return filters.best_per_cell(ground, 2.5, [F.col("Z"), F.col("X"), F.col("Y")]).select("X", "Y", "Z")


@register("thin_pulses", "WITH f AS (SELECT pulse, ROW_NUMBER() OVER (PARTITION BY FLOOR(x / 4), FLOOR(y / 4) ORDER BY (pulse * 7919) % 10007, pulse, x, y) AS k FROM pts WHERE yr = 2021 AND rn = 1) SELECT pulse AS \"Pulse\", rn AS \"ReturnNumber\", z AS \"Z\" FROM pts WHERE yr = 2021 AND pulse IN (SELECT pulse FROM f WHERE k = 1)")
def thin_pulses(spark, sf_dir):
    rank = (F.col("Pulse") * 7919) % 10007
    return filters.thin_pulses(pts(spark, sf_dir), 4.0, rank=rank).select("Pulse", "ReturnNumber", "Z")


@register("dup_ground_mean", f"SELECT x AS \"X\", y AS \"Y\", {_cut('AVG(z)')} AS \"Z\", COUNT(*) AS n FROM pts WHERE cls IN (2, 9) GROUP BY x, y")
def dup_ground_mean(spark, sf_dir):
    return filters.merged_ground(pts(spark, sf_dir, None)).select("X", "Y", cut(F.col("Z")).alias("Z"), "n")


@register("elm_outliers", """WITH g AS (SELECT x, y, z - CASE WHEN pulse % 97 = 0 THEN 5 + pulse % 11 ELSE 0 END AS z FROM pts WHERE yr = 2021 AND cls = 2),
 s AS (SELECT *, COALESCE(LEAD(z) OVER w - z, 0) AS step FROM g WINDOW w AS (PARTITION BY FLOOR(x / 10), FLOOR(y / 10) ORDER BY z, x, y))
 SELECT x AS "X", y AS "Y", z AS "Z" FROM (SELECT *, MIN(step) OVER (PARTITION BY FLOOR(x / 10), FLOOR(y / 10) ORDER BY z, x, y ROWS UNBOUNDED PRECEDING) AS run FROM s) t WHERE run > 1""")
def elm_outliers(spark, sf_dir):
    ground = filters.of_classes(pts(spark, sf_dir), (BARE_GROUND,))
    low = F.when(F.col("Pulse") % 97 == 0, 5 + F.col("Pulse") % 11).otherwise(F.lit(0))
    return filters.low_outliers(ground.select("X", "Y", (F.col("Z") - low).alias("Z"))).where("is_low").select("X", "Y", "Z")


@register("radius_outlier", "WITH p AS (SELECT pulse * 100 + rn AS id, x, y, z FROM pts WHERE yr = 2021) SELECT a.id FROM p a LEFT JOIN p b ON a.id <> b.id AND FLOOR(b.x / 3) BETWEEN FLOOR(a.x / 3) - 1 AND FLOOR(a.x / 3) + 1 AND FLOOR(b.y / 3) BETWEEN FLOOR(a.y / 3) - 1 AND FLOOR(a.y / 3) + 1 AND POW(a.x - b.x, 2) + POW(a.y - b.y, 2) + POW(a.z - b.z, 2) <= 9 GROUP BY a.id HAVING COUNT(b.id) < 2")
def radius_outlier(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("id", F.col("Pulse") * 100 + F.col("ReturnNumber"))
    return filters.radius_outliers(p, "id", 3.0, 2)


# joins ----------------------------------------------------------------------------------------------------------


@register("disc_join_counts", "SELECT shot_id, COUNT(*) AS n, MAX(z) AS top FROM shots JOIN pts ON yr = 2021 AND POW(x - center_x, 2) + POW(y - center_y, 2) <= 156.25 GROUP BY shot_id")
def disc_join_counts(spark, sf_dir):
    points = fixtures.dealt(pts(spark, sf_dir).select("X", "Y", "Z"))
    counts = lambda places: joins.disc_join(places, points, 12.5, *_PLACE).groupBy(*_PLACE).agg(F.count("*").alias("n"), F.max("Z").alias("top"))
    return joins.at_places(fixtures.shots(spark, sf_dir), *_PLACE, counts).select("shot_id", "n", "top")


_PLACE = ["center_x", "center_y"]
_DISC = "disc AS (SELECT c.id, p.* FROM (SELECT CAST(a.r * 20 + b.c AS INT) AS id, 308005.0e0 + b.c * 10 AS cx, 4688195.0e0 - a.r * 10 AS cy FROM range(20) AS a(r) CROSS JOIN range(20) AS b(c)) c JOIN pts p ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - cx, 2) + POW(y - cy, 2) <= 64)"


def _centres(spark) -> DataFrame:
    return GRID.cells(spark).select((F.col("row") * GRID.nx + F.col("col")).cast("int").alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))


@register("baba_metrics", f"WITH {_DISC} SELECT id, {_metric_sql(('cc', 'hmean', 'h95', 'hmax'))} FROM disc GROUP BY id")
def baba_metrics(spark, sf_dir):
    out = metrics.disc_metrics(_centres(spark), cleaned(spark, sf_dir), ["id"], 8.0, ("density", "cc", "hmean", "h95", "hmax"))
    return _tidy(out.where("density is not null").drop("density"))


@register("disc_cell_metrics", f"WITH {_DISC} SELECT id, {_metric_sql(('density', 'cc', 'hmean', *metrics.STRATA, 'h50', 'h75', 'h95', 'hmax', 'crr'), area='(PI() * 64)')} FROM disc GROUP BY id")
def disc_cell_metrics(spark, sf_dir):
    names = ("density", "cc", "hmean", *metrics.STRATA, "h50", "h75", "h95", "hmax", "crr")
    return _tidy(metrics.disc_metrics(_centres(spark), cleaned(spark, sf_dir), ["id"], 8.0, names, parts=4).where("density is not null"))


@register("baba_gap", f"WITH {_DISC} SELECT id, COUNT(*) FILTER (rn = 1 AND cls = 2) AS gap_n_ground, COUNT(*) FILTER ({_FIRST}) AS gap_n_classified, CAST(COUNT(*) FILTER (rn = 1 AND cls = 2) AS DOUBLE) / NULLIF(COUNT(*) FILTER ({_FIRST}), 0) AS gap FROM disc GROUP BY id")
def baba_gap(spark, sf_dir):
    return metrics.disc_gap(_centres(spark), cleaned(spark, sf_dir), ["id"], 8.0).select("id", "gap_n_ground", "gap_n_classified", "gap")


@register("plot_metrics", f"WITH d AS (SELECT plot_id, p.* FROM plots LEFT JOIN pts p ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - px, 2) + POW(y - py, 2) <= 100) SELECT plot_id, {_metric_sql(('cc', 'h95', 'hmax'))}, COUNT(x) AS n_points FROM d GROUP BY plot_id")
def plot_metrics(spark, sf_dir):
    return _tidy(metrics.plot_metrics(fixtures.plots(spark, sf_dir), cleaned(spark, sf_dir), "plot_id", 10.0, ("cc", "h95", "hmax")))


@register("nearest_ground", "WITH n AS (SELECT shot_id, x, y, z, ROW_NUMBER() OVER (PARTITION BY shot_id ORDER BY POW(x - center_x, 2) + POW(y - center_y, 2), x, y) AS k FROM shots JOIN pts ON yr = 2021 AND cls = 2) SELECT shot_id, MIN(x) AS \"X\", MIN(y) AS \"Y\" FROM n WHERE k = 1 GROUP BY shot_id")
def nearest_ground(spark, sf_dir):
    ground = filters.of_classes(pts(spark, sf_dir), (BARE_GROUND,)).select("X", "Y", "Z").dropDuplicates(["X", "Y"])
    return joins.nearest(fixtures.shots(spark, sf_dir), ground, "shot_id", 1, None, "center_x", "center_y").select("shot_id", "X", "Y")


@register("idw_k8", f"WITH g AS (SELECT DISTINCT x, y, z FROM pts WHERE yr = 2021 AND cls = 2), n AS (SELECT shot_id, z, POW(x - center_x, 2) + POW(y - center_y, 2) AS d2, ROW_NUMBER() OVER (PARTITION BY shot_id ORDER BY POW(x - center_x, 2) + POW(y - center_y, 2), x, y) AS k FROM shots CROSS JOIN g), w AS (SELECT shot_id, z, 1 / POW(GREATEST(SQRT(d2), 1e-10), 2) AS w FROM n WHERE k <= 8) SELECT shot_id, {_cut('SUM(w * z) / SUM(w)')} AS \"Z\", COUNT(*) AS n FROM w GROUP BY shot_id")
def idw_k8(spark, sf_dir):
    ground = filters.of_classes(pts(spark, sf_dir), (BARE_GROUND,)).select("X", "Y", "Z").distinct()
    shots = fixtures.shots(spark, sf_dir).withColumnsRenamed({"center_x": "cx", "center_y": "cy"})
    return joins.idw(shots, ground, "shot_id", 8).withColumn("Z", cut(F.col("Z")))


@register("seed_gap_antijoin", "SELECT shot_id FROM shots WHERE NOT EXISTS (SELECT 1 FROM pts WHERE yr = 2021 AND cls = 2 AND rn = 1 AND POW(x - center_x, 2) + POW(y - center_y, 2) <= 9)")
def seed_gap(spark, sf_dir):
    seeds = pts(spark, sf_dir).where("Classification = 2 and ReturnNumber = 1")
    candidates = fixtures.shots(spark, sf_dir).select("shot_id", F.col("center_x").alias("X"), F.col("center_y").alias("Y"))
    return joins.without_neighbour(candidates, seeds, "shot_id", 3.0).select("shot_id")


@register("neighbors_range_join", "SELECT a.file_id, b.file_id AS neighbour_id FROM files a JOIN files b ON a.file_id <> b.file_id AND a.yr = b.yr AND b.max_x >= a.min_x - 5 AND b.min_x <= a.max_x + 5 AND b.max_y >= a.min_y - 5 AND b.min_y <= a.max_y + 5")
def neighbors(spark, sf_dir):
    return joins.file_neighbours(fixtures.files(spark, sf_dir), 5.0)


@register("manifest_antijoin", "WITH m AS (SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'ok' ELSE 'failed' END AS status, 1 AS ts FROM files UNION ALL SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'ok' ELSE 'failed' END, 2 FROM files WHERE file_id % 2 = 0), l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ts DESC) AS k FROM m) SELECT file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM l WHERE k = 1 AND status = 'ok')")
def manifest_antijoin(spark, sf_dir):
    from arbora.sources.catalog import latest_entries, pending

    files = fixtures.files(spark, sf_dir)
    status = lambda by, ts: files.select("file_id", F.when(F.col("file_id") % by == 0, "ok").otherwise("failed").alias("status"), F.lit(ts).alias("ts"))
    manifest = latest_entries(status(4, 1).union(status(3, 2).where("file_id % 2 = 0")), "file_id")
    return pending(files, manifest, "file_id").select("file_id")


@register("resume_intersect", "SELECT file_id AS tile FROM files WHERE NOT (file_id % 2 = 0 AND file_id % 3 = 0)")
def resume_intersect(spark, sf_dir):
    tiles = fixtures.files(spark, sf_dir).select(F.col("file_id").alias("tile"))
    done = tiles.where("tile % 2 = 0").intersect(tiles.where("tile % 3 = 0"))
    return tiles.subtract(done)


# change and profiles --------------------------------------------------------------------------------------------

_TWO = f"SELECT CAST(LEAST(FLOOR((4688200.0e0 - y) / 10.0e0), 19) AS INT) AS {R}, CAST(LEAST(FLOOR((x - 308000.0e0) / 10.0e0), 19) AS INT) AS col, yr, MAX(hag) AS v FROM pts WHERE x >= 308000 AND x < 308200 AND y > 4688000 AND y <= 4688200 AND cls NOT IN (7, 18) GROUP BY 1, 2, 3"


@register("change_detection", f"WITH t AS ({_TWO}), d AS (SELECT a.{R}, a.col, b.v - a.v AS delta, a.v AS base FROM t a JOIN t b ON a.{R} = b.{R} AND a.col = b.col AND a.yr = 2017 AND b.yr = 2021) SELECT {R}, col, {_cut('delta')} AS delta, CASE WHEN ABS(base) >= 1 THEN {_cut('100 * delta / base')} END AS pct, CASE WHEN delta > 0.5 THEN 1 WHEN delta < -0.5 THEN -1 ELSE 0 END AS flag FROM d")
def change_detection(spark, sf_dir):
    p = GRID.bins(filters.clean(pts(spark, sf_dir, None)))
    raster = p.groupBy("row", "col", F.col("Year").alias("year")).agg(F.max("HeightAboveGround").alias("value"))
    out = change(raster, 2017, 2021, 0.5, 1.0)
    return out.select("row", "col", cut(F.col("delta")).alias("delta"), cut(F.col("pct")).alias("pct"), "flag")


_FOOT = "foot AS (SELECT shot_id, center_x, center_y, p.* FROM shots JOIN pts p ON yr = 2021 AND cls NOT IN (7, 18) AND POW(x - center_x, 2) + POW(y - center_y, 2) <= 156.25)"
_BINS = f"{_FOOT}, span AS (SELECT shot_id, MIN(z) AS z_min, GREATEST(CAST(CEIL((MAX(z) - MIN(z)) / 0.5e0) AS INT), 1) AS bins FROM foot GROUP BY shot_id), hist AS (SELECT f.shot_id, CAST(LEAST(FLOOR((z - z_min) / 0.5e0), bins - 1) AS INT) AS bin, z_min, COUNT(*) AS n FROM foot f JOIN span s ON f.shot_id = s.shot_id GROUP BY 1, 2, 3)"


def _footprints(spark, sf_dir, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``work`` makes of the returns around each place of a shot, for every shot."""
    points = fixtures.dealt(cleaned(spark, sf_dir))
    return joins.at_places(fixtures.shots(spark, sf_dir), *_PLACE, lambda places: work(joins.disc_join(places, points, 12.5, *_PLACE)))


def _histograms(spark, sf_dir, work: Callable[[DataFrame], DataFrame], **energies: Column) -> DataFrame:
    """The rows that ``work`` makes of the histogram of each place of a shot, for every shot."""
    points = fixtures.dealt(cleaned(spark, sf_dir))
    return joins.at_places(fixtures.shots(spark, sf_dir), *_PLACE, lambda places: work(profiles.disc_histogram(places, points, _PLACE, 12.5, 0.5, energies, *_PLACE)))


@register("waveform_histogram", f"WITH {_BINS} SELECT shot_id, bin, CAST(n AS DOUBLE) AS energy FROM hist")
def waveform_histogram(spark, sf_dir):
    return _histograms(spark, sf_dir, lambda h: h, energy=F.lit(1.0)).select("shot_id", "bin", "energy")


@register("waveform_beam_energy", f"WITH {_FOOT} SELECT shot_id, {_cut('SUM(EXP(-(POW(x - center_x, 2) + POW(y - center_y, 2)) / (2 * 5.5e0 * 5.5e0)))')} AS energy FROM foot GROUP BY shot_id")
def waveform_beam_energy(spark, sf_dir):
    beam = F.sum(F.exp(-F.col("distance2") / (2 * 5.5 * 5.5)))
    return _footprints(spark, sf_dir, lambda f: f.groupBy(*_PLACE).agg(cut(beam).alias("energy"))).select("shot_id", "energy")


@register("rh_from_histogram", f"WITH {_BINS}, run AS (SELECT shot_id, bin, n, SUM(n) OVER (PARTITION BY shot_id ORDER BY bin) AS c, SUM(n) OVER (PARTITION BY shot_id) AS t FROM hist) SELECT shot_id, level, {_cut('(MIN(bin) + 0.5e0) * 0.5e0')} AS rh FROM run CROSS JOIN (SELECT unnest([25, 50, 75, 98]) AS level) l WHERE CAST(c AS DOUBLE) / t >= level / 100.0e0 - 1e-12 GROUP BY shot_id, level")
def rh_from_histogram(spark, sf_dir):
    out = _histograms(spark, sf_dir, lambda h: profiles.relative_heights(h.withColumn("z_ground", F.col("z_min")), _PLACE, [25, 50, 75, 98], 0.5), energy=F.lit(1.0))
    return out.select("shot_id", "level", cut(F.col("rh") + 1e-9).alias("rh"))


@register("canopy_cover_wave", f"WITH {_BINS} SELECT shot_id, {_cut('CAST(SUM(CASE WHEN bin >= 4 THEN n ELSE 0 END) AS DOUBLE) / SUM(n)')} AS cover FROM hist GROUP BY shot_id")
def canopy_cover_wave(spark, sf_dir):
    out = _histograms(spark, sf_dir, lambda h: profiles.waveform_cover(h.withColumn("z_ground", F.col("z_min")), _PLACE, 0.5), energy=F.lit(1.0))
    return out.select("shot_id", cut(F.col("cover")).alias("cover"))


@register("gap_from_returns", f"WITH {_FOOT}, u AS (SELECT shot_id, CASE WHEN cls = 2 THEN 0 ELSE hag END AS h FROM foot WHERE cls IN (2, 3, 4, 5)) SELECT shot_id, height, {_cut('CAST(SUM(CASE WHEN h <= height THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)')} AS gap FROM u CROSS JOIN (SELECT unnest([0.0e0, 5.0e0, 10.0e0, 20.0e0]) AS height) l GROUP BY shot_id, height")
def gap_from_returns(spark, sf_dir):
    out = _footprints(spark, sf_dir, lambda f: profiles.gap_from_returns(f, _PLACE, [0.0, 5.0, 10.0, 20.0]))
    return out.select("shot_id", "height", cut(F.col("gap")).alias("gap"))


@register("gap_from_waveform", f"WITH {_FOOT}, span AS (SELECT shot_id, MIN(z) AS z_min, GREATEST(CAST(CEIL((MAX(z) - MIN(z)) / 0.5e0) AS INT), 1) AS bins FROM foot GROUP BY shot_id), e AS (SELECT f.shot_id, CAST(LEAST(FLOOR((z - z_min) / 0.5e0), bins - 1) AS INT) AS bin, CAST(SUM(CASE WHEN cls = 2 THEN 0 ELSE 1 END) AS DOUBLE) AS canopy, CAST(SUM(CASE WHEN cls = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS ground FROM foot f JOIN span s ON f.shot_id = s.shot_id GROUP BY 1, 2) SELECT shot_id, bin, {_cut('1 - (SUM(canopy) OVER (PARTITION BY shot_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - canopy / 2) / (SUM(canopy) OVER (PARTITION BY shot_id) + 1.5e0 * SUM(ground) OVER (PARTITION BY shot_id))')} AS gap FROM e")
def gap_from_waveform(spark, sf_dir):
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    is_ground = F.col("Classification") == BARE_GROUND
    out = _histograms(spark, sf_dir, lambda h: profiles.gap_from_waveform(h, _PLACE, 1.5), canopy=one(~is_ground), ground=one(is_ground))
    return out.select("shot_id", "bin", cut(F.col("gap")).alias("gap"))


@register("pavd_profile", f"""WITH {_FOOT}, u AS (SELECT shot_id, cls, CASE WHEN cls = 2 THEN 0 ELSE hag END AS h FROM foot WHERE cls IN (2, 3, 4, 5)),
 s AS (SELECT shot_id, COUNT(*) AS n, COUNT(*) FILTER (cls = 2) AS n_ground, quantile_cont(CASE WHEN cls <> 2 AND h > 0 THEN h END, 0.98) AS top FROM u GROUP BY shot_id),
 e AS (SELECT shot_id, n, CAST(unnest(range(0, GREATEST(CAST(CEIL(top / 2.0e0) AS INT), 1) + 1)) AS INT) AS layer FROM s WHERE n_ground >= 5 AND top > 0),
 g AS (SELECT e.shot_id, layer, n, COUNT(h) AS below FROM e LEFT JOIN u ON u.shot_id = e.shot_id AND h <= layer * 2.0e0 GROUP BY 1, 2, 3)
 SELECT shot_id, layer, {_cut('LEAST(GREATEST(-LN(LEAST(GREATEST(CAST(below AS DOUBLE) / n, 1.0e0 / n), 1)) / 0.5e0, 0), 15)')} AS pai FROM g""")
def pavd_profile(spark, sf_dir):
    out = _footprints(spark, sf_dir, lambda f: profiles.pavd_profile(f, _PLACE, 2.0))
    return out.select("shot_id", "layer", cut(F.col("pai")).alias("pai"))


@register("plant_area_density", f"""WITH v AS (SELECT CAST(FLOOR(x / 20) AS BIGINT) AS kx, CAST(FLOOR(y / 20) AS BIGINT) AS ky, CASE WHEN cls = 2 THEN -1 ELSE CAST(FLOOR(hag / 20) AS INT) END AS kz, COUNT(*) AS veg FROM pts WHERE yr = 2021 AND cls IN (2, 3, 4, 5) GROUP BY 1, 2, 3),
 b AS (SELECT *, COALESCE(SUM(veg) OVER (PARTITION BY kx, ky ORDER BY kz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
 SELECT kx, ky, kz, veg, CAST(below AS BIGINT) AS below, {_cut('-LN((below + 0.5e0) / (below + veg + 0.5e0)) / (0.5e0 * 20)')} AS pad FROM b WHERE kz >= 0""")
def plant_area_density(spark, sf_dir):
    return profiles.voxel_density(pts(spark, sf_dir), 20.0).withColumn("pad", cut(F.col("pad")))


@register("attenuation_levels", f"WITH l AS (SELECT shot_id, level, (shot_id * 13 + level * 7) % 101 / 10.0e0 AS pavd FROM shots CROSS JOIN range(0, 101) AS r(level)), m AS (SELECT CAST(level AS INT) AS level, quantile_cont(pavd, 0.5) AS median, COUNT(*) AS n FROM l GROUP BY 1) SELECT level, {_cut('median')} AS median, n, {_cut('SUM(median) OVER (ORDER BY level DESC)')} AS cumulative FROM m")
def attenuation_levels(spark, sf_dir):
    levels = fixtures.shots(spark, sf_dir).select("shot_id", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("level"))
    given = levels.withColumn("pavd", ((F.col("shot_id") * 13 + F.col("level") * 7) % 101) / 10.0)
    out = profiles.attenuation_levels(given)
    return out.select("level", cut(F.col("median")).alias("median"), "n", cut(F.col("cumulative")).alias("cumulative"))


# scores, models and reports -------------------------------------------------------------------------------------


@register("raster_moments", f"WITH t AS ({_TWO}), p AS (SELECT a.v AS x, b.v AS y FROM t a JOIN t b ON a.{R} = b.{R} AND a.col = b.col AND a.yr = 2017 AND b.yr = 2021) SELECT COUNT(*) AS n, {_cut('AVG(y - x)')} AS bias, {_cut('AVG(ABS(y - x))')} AS mae, {_cut('SQRT(AVG((y - x) * (y - x)))')} AS rmse, {_cut('1 - AVG((y - x) * (y - x)) / VAR_POP(x)')} AS r2, {_cut('CORR(x, y)')} AS r FROM p")
def raster_moments(spark, sf_dir):
    p = GRID.bins(filters.clean(pts(spark, sf_dir, None))).groupBy("row", "col").pivot("Year", [2017, 2021]).agg(F.max("HeightAboveGround"))
    out = scoring.moments(p, [], "2017", "2021")
    # what SQL divides by a spread of zero is no number, or below all numbers
    flat = F.when(F.col("n") > 0, F.lit(math.nan))
    r2 = F.when(F.col("r2").isNull() & (F.col("rmse") > 0), F.lit(-math.inf)).otherwise(F.coalesce(cut(F.col("r2")), flat))
    return out.select("n", *[cut(F.col(c)).alias(c) for c in ("bias", "mae", "rmse")], r2.alias("r2"), F.coalesce(cut(F.col("r")), flat).alias("r"))


_TERR = f"WITH t AS (SELECT {R}, col, MIN(z) AS ref, MAX(CASE WHEN rn = 1 THEN z END) AS cand FROM cells WHERE cls = 2 GROUP BY {R}, col), d AS (SELECT *, cand - ref AS r FROM t), m AS (SELECT quantile_cont(r, 0.5) AS m FROM d)"


@register("terrain_error", f"{_TERR} SELECT {_cut('AVG(r)')} AS bias, {_cut('AVG(ABS(r))')} AS mae, {_cut('SQRT(AVG(r * r))')} AS rmse, {_cut('1.4826e0 * quantile_cont(ABS(r - m), 0.5)')} AS nmad, {_cut('quantile_cont(ABS(r), 0.95)')} AS p95, {_cut('COUNT(r) / CAST(COUNT(*) AS DOUBLE)')} AS coverage FROM d, m")
def terrain_error(spark, sf_dir):
    ground = GRID.bins(filters.of_classes(pts(spark, sf_dir), (BARE_GROUND,)))
    pairs = ground.groupBy("row", "col").agg(F.min("Z").alias("ref"), F.max(F.when(F.col("ReturnNumber") == 1, F.col("Z"))).alias("cand"))
    out = scoring.terrain_error(pairs, [], "ref", "cand")
    return out.select(*[cut(F.col(c)).alias(c) for c in out.columns])


_CONF = "COUNT(*) FILTER (t AND f) AS tp, COUNT(*) FILTER (NOT t AND f) AS fp, COUNT(*) FILTER (t AND NOT f) AS fn, COUNT(*) FILTER (NOT t AND NOT f) AS tn"
_SCORES = f"tp, fp, fn, tn, {_cut('tp / NULLIF(CAST(tp + fp AS DOUBLE), 0)')} AS \"precision\", {_cut('tp / NULLIF(CAST(tp + fn AS DOUBLE), 0)')} AS recall, {_cut('2 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0)')} AS f1, {_cut('(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) + tn / NULLIF(CAST(tn + fp AS DOUBLE), 0)) / 2')} AS balanced_accuracy, {_cut('fn / NULLIF(CAST(tp + fn AS DOUBLE), 0)')} AS omission, {_cut('fp / NULLIF(CAST(tn + fp AS DOUBLE), 0)')} AS commission, {_cut('(fp + fn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS total_error"
_TRUTH = "SELECT cls = 2 AS t, hag < 4 AS f, CASE WHEN nr < 3 THEN 'few' ELSE 'many' END AS returns, CASE WHEN yr = 2017 THEN 'old' ELSE 'new' END AS survey FROM pts"


def _rounded_scores(df: DataFrame) -> DataFrame:
    rough = ("precision", "recall", "f1", "balanced_accuracy", "omission", "commission", "total_error")
    return df.select(*[cut(F.col(c)).alias(c) if c in rough else F.col(c) for c in df.columns])


@register("class_scores", f"SELECT {_SCORES} FROM (SELECT {_CONF} FROM ({_TRUTH}) a) b")
def class_scores(spark, sf_dir):
    p = pts(spark, sf_dir, None)
    return _rounded_scores(scoring.ground_scores(p, F.col("Classification") == 2, F.col("HeightAboveGround") < 4))


@register("strata_scores", f"SELECT returns, survey, {_SCORES} FROM (SELECT returns, survey, {_CONF} FROM ({_TRUTH}) a GROUP BY GROUPING SETS ((), (returns), (survey))) b")
def strata_scores(spark, sf_dir):
    p = pts(spark, sf_dir, None).withColumn("returns", F.when(F.col("NumberOfReturns") < 3, "few").otherwise("many")).withColumn("survey", F.when(F.col("Year") == 2017, "old").otherwise("new"))
    return _rounded_scores(scoring.strata_scores(p, F.col("Classification") == 2, F.col("HeightAboveGround") < 4, ["returns", "survey"]))


@register("timing_pivot", "WITH s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS tool, 4.0e0 AS area_km2, 8 AS cores, event_id % 3 AS repeat, CASE WHEN event_id % 5 = 0 THEN 'setup' ELSE 'run' END AS stage, (event_id % 50) / 2.0e0 AS seconds FROM events), r AS (SELECT tool, area_km2, cores, repeat, stage, SUM(seconds) AS seconds FROM s GROUP BY ALL), m AS (SELECT tool, area_km2, cores, stage, quantile_cont(seconds, 0.5) AS seconds FROM r GROUP BY ALL), w AS (SELECT tool, area_km2, cores, MAX(CASE WHEN stage = 'setup' THEN seconds END) AS setup, MAX(CASE WHEN stage = 'run' THEN seconds END) AS run FROM m GROUP BY ALL) SELECT *, " + _cut("area_km2 / (run * cores / 3600.0e0)") + " AS km2_per_core_hour FROM w, (SELECT COUNT(*) AS z FROM plots WHERE plot_id < 0)")
def timing_pivot(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    steps = e.select(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("tool"), F.lit(4.0).alias("area_km2"), F.lit(8).alias("cores"), (F.col("event_id") % 3).alias("repeat"), F.when(F.col("event_id") % 5 == 0, "setup").otherwise("run").alias("stage"), ((F.col("event_id") % 50) / 2.0).alias("seconds"))
    return scoring.timing_report(steps).withColumn("km2_per_core_hour", cut(F.col("km2_per_core_hour"))).withColumn("z", F.lit(0).cast("bigint"))


@register("cv_folds", "SELECT block, CAST(NTILE(5) OVER (ORDER BY block) - 1 AS INT) AS fold FROM (SELECT DISTINCT block FROM plots) t")
def cv_folds(spark, sf_dir):
    return allometry.folds(fixtures.plots(spark, sf_dir), "block", 5)


def _plot_table(spark, sf_dir) -> DataFrame:
    return fixtures.plots(spark, sf_dir).select("plot_id", "block", F.abs("agb").alias("agb"), (F.col("px") - 308000.0).alias("u"), (F.col("py") - 4688000.0).alias("v"))


_OLS = "SELECT SQRT(ABS(agb)) AS y, SQRT(px - 308000) AS a, SQRT(py - 4688000) AS b FROM plots"


@register("ols_normal_equations", f"WITH d AS ({_OLS}), m AS (SELECT AVG(y) AS y, AVG(a) AS a, AVG(b) AS b, COVAR_POP(a, a) AS aa, COVAR_POP(a, b) AS ab, COVAR_POP(b, b) AS bb, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS \"by\" FROM d), s AS (SELECT *, (ay * bb - \"by\" * ab) / (aa * bb - ab * ab) AS p, (\"by\" * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m) SELECT {_cut('y - p * a - q * b')} AS b0, {_cut('p')} AS b1, {_cut('q')} AS b2 FROM s")
def ols(spark, sf_dir):
    model = allometry.fit_linear(_plot_table(spark, sf_dir), "agb", ("u", "v"), bias_method="none")
    return spark.createDataFrame([model.coefficients], "b0 double, b1 double, b2 double").select(*[cut(F.col(c)).alias(c) for c in ("b0", "b1", "b2")])


@register("agb_interval")
def agb_interval(spark, sf_dir):
    plots = _plot_table(spark, sf_dir)
    model = allometry.fit_linear(plots, "agb", ("u", "v"))
    se, low, high = model.interval(0.9)
    return plots.select("plot_id", model.biomass().alias("agb"), se.alias("se"), low.alias("lower"), high.alias("upper"))


_SQRT = "g AS (SELECT plot_id, block, ABS(agb) AS raw, SQRT(ABS(agb)) AS y, SQRT(px - 308000) AS a, SQRT(py - 4688000) AS b FROM plots)"
_MEANS = "COUNT(*) AS n, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, COVAR_POP(a, a) AS aa, COVAR_POP(a, b) AS ab, COVAR_POP(b, b) AS bb, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS ty"
_SOLVED = "SELECT *, my - p * ma - q * mb AS b0 FROM (SELECT *, (ay * bb - ty * ab) / (aa * bb - ab * ab) AS p, (ty * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m)"
_FITTED = "POW(GREATEST(b0 + p * a + q * b, 0), 2)"


@register("agb_standard_error", f"""WITH {_SQRT}, m AS (SELECT {_MEANS} FROM g), s AS ({_SOLVED}), e AS (SELECT SUM(raw) / SUM({_FITTED}) AS bias, SUM(POW(y - b0 - p * a - q * b, 2)) / (MAX(n) - 3) AS mse FROM g CROSS JOIN s)
 SELECT plot_id, ROUND(bias * {_FITTED}, 4) AS agb, ROUND(SQRT(mse * (1 + 1.0e0 / n + (POW(a - ma, 2) * bb - 2 * (a - ma) * (b - mb) * ab + POW(b - mb, 2) * aa) / (n * (aa * bb - ab * ab)))), 6) AS se FROM g CROSS JOIN s CROSS JOIN e""")
def agb_standard_error(spark, sf_dir):
    return agb_interval(spark, sf_dir).select("plot_id", F.round("agb", 4).alias("agb"), F.round("se", 6).alias("se"))


@register("agb_cross_validation", f"""WITH {_SQRT}, k AS (SELECT block, CAST(NTILE(3) OVER (ORDER BY block) - 1 AS INT) AS fold FROM (SELECT DISTINCT block FROM g)), d AS (SELECT g.*, fold FROM g JOIN k USING (block)),
 t AS (SELECT left_out, d.* FROM d JOIN (SELECT DISTINCT fold AS left_out FROM k) ON fold <> left_out), m AS (SELECT left_out, {_MEANS} FROM t GROUP BY left_out), s AS ({_SOLVED}), c AS (SELECT left_out, SUM(raw) / SUM({_FITTED}) AS bias FROM t JOIN s USING (left_out) GROUP BY left_out)
 SELECT plot_id, fold, ROUND(bias * {_FITTED}, 4) AS predicted FROM d JOIN s ON s.left_out = fold JOIN c ON c.left_out = fold""")
def agb_cv(spark, sf_dir):
    out = allometry.cross_validate(_plot_table(spark, sf_dir), "agb", "block", lambda df: allometry.fit_linear(df, "agb", ("u", "v")), 3)
    return out.select("plot_id", "fold", F.round("predicted", 4).alias("predicted"))


@register("local_maxima", f"WITH c AS (SELECT {R} AS r, col AS c, MAX(z) AS v FROM cells GROUP BY 1, 2) SELECT a.r AS {R}, a.c AS col, a.v AS value FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE ABS(a.r - b.r) <= 1 AND ABS(a.c - b.c) <= 1 AND b.v > a.v)")
def local_maxima(spark, sf_dir):
    return metrics.local_maxima(metrics.rasterise(pts(spark, sf_dir), GRID, "Z"), "value", GRID.ny, GRID.nx)


@register("season_strips", "SELECT shot_id, CASE WHEN (center_x - 308000.0e0) % 40.0e0 < 10 THEN true ELSE false END AS inside, CASE WHEN beam * 4 < 10 THEN 'flat' WHEN beam * 4 < 25 THEN 'moderate' ELSE 'steep' END AS slope FROM shots")
def season_strips(spark, sf_dir):
    return fixtures.shots(spark, sf_dir).select("shot_id", fn.in_strips(F.col("center_x"), 308000.0, 40.0, 10.0).alias("inside"), fn.slope_class(F.col("beam") * 4).alias("slope"))
