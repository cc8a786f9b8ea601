"""Registered queries over ground with relief, other coordinate systems, ingestion and fused products, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import projection
from arbora.functions.lineage import written
from arbora.operators import metrics, terrain
from arbora.plans.queries import GRID, R, cleaned, pts, register

TILE, BUFFER = 50.0, 30.0
_UTM = """u AS (SELECT 6378137.0e0 AS a, 1 / 298.257222101e0 AS f), k AS (SELECT a, f / (2 - f) AS n, SQRT(f * (2 - f)) AS e FROM u),
 s AS (SELECT n, e, 0.9996e0 * a / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS radius,
  n / 2 - 2 * n * n / 3 + 37 * POW(n, 3) / 96 - POW(n, 4) / 360 AS b1, n * n / 48 + POW(n, 3) / 15 - 437 * POW(n, 4) / 1440 AS b2, 17 * POW(n, 3) / 480 - 37 * POW(n, 4) / 840 AS b3, 4397 * POW(n, 4) / 161280 AS b4,
  n / 2 - 2 * n * n / 3 + 5 * POW(n, 3) / 16 + 41 * POW(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * POW(n, 3) / 5 + 557 * POW(n, 4) / 1440 AS a2, 61 * POW(n, 3) / 240 - 103 * POW(n, 4) / 140 AS a3, 49561 * POW(n, 4) / 161280 AS a4,
  2 * n - 2 * n * n / 3 - 2 * POW(n, 3) + 116 * POW(n, 4) / 45 AS d1, 7 * n * n / 3 - 8 * POW(n, 3) / 5 - 227 * POW(n, 4) / 45 AS d2, 56 * POW(n, 3) / 15 - 136 * POW(n, 4) / 35 AS d3, 4279 * POW(n, 4) / 630 AS d4 FROM k),
 o AS (SELECT *, y / radius AS xi, (x - 500000) / radius AS eta FROM pts, s),
 i AS (SELECT *, xi - b1 * SIN(2 * xi) * COSH(2 * eta) - b2 * SIN(4 * xi) * COSH(4 * eta) - b3 * SIN(6 * xi) * COSH(6 * eta) - b4 * SIN(8 * xi) * COSH(8 * eta) AS xj,
  eta - b1 * COS(2 * xi) * SINH(2 * eta) - b2 * COS(4 * xi) * SINH(4 * eta) - b3 * COS(6 * xi) * SINH(6 * eta) - b4 * COS(8 * xi) * SINH(8 * eta) AS ej FROM o),
 c AS (SELECT *, ASIN(SIN(xj) / COSH(ej)) AS chi FROM i),
 g AS (SELECT *, chi + d1 * SIN(2 * chi) + d2 * SIN(4 * chi) + d3 * SIN(6 * chi) + d4 * SIN(8 * chi) AS phi, RADIANS(-3) + ATAN2(SINH(ej), COS(xj)) AS lam FROM c),
 t AS (SELECT *, SINH(ATANH(SIN(phi)) - e * ATANH(e * SIN(phi))) AS tau, lam - RADIANS(3) AS turn FROM g),
 h AS (SELECT *, ATAN2(tau, COS(turn)) AS xp, ATANH(SIN(turn) / SQRT(1 + tau * tau)) AS ep FROM t)"""


def _hundredths(c: Column, of: float = 100.0) -> Column:
    return (F.floor(c * of + 0.3) / of).cast("double")


@register("projected_points", f"""WITH {_UTM} SELECT pulse AS "Pulse", rn AS "ReturnNumber", FLOOR(DEGREES(lam) * 1e7 + 0.3e0) / 1e7 AS lon, FLOOR(DEGREES(phi) * 1e7 + 0.3e0) / 1e7 AS lat,
 FLOOR((500000 + radius * (ep + a1 * COS(2 * xp) * SINH(2 * ep) + a2 * COS(4 * xp) * SINH(4 * ep) + a3 * COS(6 * xp) * SINH(6 * ep) + a4 * COS(8 * xp) * SINH(8 * ep))) * 100 + 0.3e0) / 100 AS x31,
 FLOOR(radius * (xp + a1 * SIN(2 * xp) * COSH(2 * ep) + a2 * SIN(4 * xp) * COSH(4 * ep) + a3 * SIN(6 * xp) * COSH(6 * ep) + a4 * SIN(8 * xp) * COSH(8 * ep)) * 100 + 0.3e0) / 100 AS y31 FROM h""")
def projected_points(spark, sf_dir):
    """Every point in degrees and in the neighbouring zone."""
    points = pts(spark, sf_dir, None).select("Pulse", "ReturnNumber", "X", "Y")
    degrees = projection.reproject(points, 25830, 4258, z=None).withColumnsRenamed({"X": "lon", "Y": "lat"})
    both = degrees.select("Pulse", "ReturnNumber", "lon", "lat", F.struct(*projection.system_of(25831).forward(F.col("lon"), F.col("lat"))).alias("at"))
    return both.select("Pulse", "ReturnNumber", _hundredths(F.col("lon"), 1e7).alias("lon"), _hundredths(F.col("lat"), 1e7).alias("lat"), _hundredths(F.col("at.col1")).alias("x31"), _hundredths(F.col("at.col2")).alias("y31"))


# Ground marks on a skew lattice, of which the triangulation is known; the heights are those of the highest point of each cell.
_AT, _U, _V, _NI, _NJ = (308010.0, 4688008.0), (9.7, 1.3), (1.7, 9.1), 16, 18
_DET = _U[0] * _V[1] - _V[0] * _U[1]
_SKEW = f"({_V[1]}e0 * (x - {_AT[0]}) - {_V[0]}e0 * (y - {_AT[1]})) / {_DET!r}e0 AS a, ({_U[0]}e0 * (y - {_AT[1]}) - {_U[1]}e0 * (x - {_AT[0]})) / {_DET!r}e0 AS b"
_MARKS = f"""marks AS (SELECT i, j, {_AT[0]} + {_U[0]}e0 * i + {_V[0]}e0 * j AS mx, {_AT[1]} + {_U[1]}e0 * i + {_V[1]}e0 * j AS my, 800 + COALESCE(h, 0) / 4 AS mz
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range({_NI + 1})) CROSS JOIN (SELECT CAST(range AS BIGINT) AS j FROM range({_NJ + 1}))
  LEFT JOIN (SELECT CAST(FLOOR(a) AS BIGINT) AS i, CAST(FLOOR(b) AS BIGINT) AS j, MAX(hag) AS h FROM (SELECT hag, {_SKEW} FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)) GROUP BY 1, 2) USING (i, j))"""


_INSIDE = f"a BETWEEN -1e-9 AND {_NI} + 1e-9 AND b BETWEEN -1e-9 AND {_NJ} + 1e-9"  # points on the outline are inside


def _ground_sql(source: str) -> str:
    """Height ``g`` of the marks' surface at ``source`` (id, x, y): within its outline by the lattice's triangles, else the nearest mark's."""
    return f"""{_MARKS}, skew AS (SELECT id, x, y, {_SKEW} FROM {source}),
 cell AS (SELECT *, GREATEST(LEAST(CAST(FLOOR(a) AS BIGINT), {_NI - 1}), 0) AS i, GREATEST(LEAST(CAST(FLOOR(b) AS BIGINT), {_NJ - 1}), 0) AS j FROM skew WHERE {_INSIDE}),
 held AS (SELECT id, CASE WHEN a - c.i + b - c.j <= 1 THEN p.mz + (a - c.i) * (q.mz - p.mz) + (b - c.j) * (r.mz - p.mz) ELSE s.mz + (1 - a + c.i) * (r.mz - s.mz) + (1 - b + c.j) * (q.mz - s.mz) END AS g FROM cell c
  JOIN marks p ON p.i = c.i AND p.j = c.j JOIN marks q ON q.i = c.i + 1 AND q.j = c.j JOIN marks r ON r.i = c.i AND r.j = c.j + 1 JOIN marks s ON s.i = c.i + 1 AND s.j = c.j + 1),
 out AS (SELECT id, x, y FROM skew WHERE NOT ({_INSIDE})),
 near AS (SELECT id, ARG_MIN(mz, POW(x - mx, 2) + POW(y - my, 2)) AS g FROM out CROSS JOIN marks GROUP BY id),
 surface AS (SELECT id, g, false AS outside FROM held UNION ALL SELECT id, g, true FROM near)"""


def on_relief(spark, sf_dir) -> DataFrame:
    """Clean points, none of them ground, and the marks as ground."""
    given = cleaned(spark, sf_dir)
    dx, dy = F.col("X") - _AT[0], F.col("Y") - _AT[1]
    tops = given.groupBy(F.floor((_V[1] * dx - _V[0] * dy) / _DET).alias("i"), F.floor((_U[0] * dy - _U[1] * dx) / _DET).alias("j")).agg(F.max("HeightAboveGround").alias("h"))
    lattice = spark.range((_NI + 1) * (_NJ + 1)).select(F.expr(f"id div {_NJ + 1}").alias("i"), (F.col("id") % (_NJ + 1)).alias("j"))
    marks = lattice.join(tops, ["i", "j"], "left").select((_AT[0] + _U[0] * F.col("i") + _V[0] * F.col("j")).alias("X"), (_AT[1] + _U[1] * F.col("i") + _V[1] * F.col("j")).alias("Y"), (800 + F.coalesce("h", F.lit(0.0)) / 4).alias("Z"), F.lit(2).alias("Classification"))
    points = given.withColumn("Classification", F.when(F.col("Classification").isin(2, 9), F.lit(1)).otherwise(F.col("Classification")))
    return written(points.unionByName(marks, allowMissingColumns=True))  # several steps read it


@register("relief_hag", f"""WITH own AS (SELECT ROW_NUMBER() OVER () AS id, * FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)), {_ground_sql('own')}
 SELECT x AS "X", y AS "Y", pulse AS "Pulse", rn AS "ReturnNumber", FLOOR(GREATEST(z - g, 0) * 1000 + 0.3e0) / 1000 AS hag, outside FROM own JOIN surface USING (id) WHERE x >= 308000 AND x < 308200 AND y > 4688000 AND y <= 4688200""")
def relief_hag(spark, sf_dir):
    """Heights of all points above rough ground, those outside the ground's outline among them."""
    out = terrain.normalise(on_relief(spark, sf_dir), GRID, TILE, BUFFER).where("Pulse IS NOT NULL")
    return out.select("X", "Y", "Pulse", "ReturnNumber", _hundredths(F.col("HeightAboveGround"), 1000.0).alias("hag"), F.col("GroundExtrapolated").alias("outside"))


@register("relief_dtm", f"""WITH own AS (SELECT r * 20 + c AS id, 308005.0e0 + c * 10 AS x, 4688195.0e0 - r * 10 AS y FROM range(20) AS a(r) CROSS JOIN range(20) AS b(c)), {_ground_sql('own')}
 SELECT CAST(id // 20 AS INT) AS {R}, CAST(id % 20 AS INT) AS col, FLOOR(g * 1000 + 0.3e0) / 1000 AS value FROM surface, (SELECT COUNT(*) FROM pts)""")
def relief_dtm(spark, sf_dir):
    """The same ground at pixel centres, from the triangulation that serves points too."""
    _, raster = terrain.heights_and_terrain(on_relief(spark, sf_dir), GRID, TILE, BUFFER)
    return raster.select("row", "col", _hundredths(F.col("value"), 1000.0).alias("value"))


LIMIT = 400
_NODES = "n AS (SELECT l, CAST(FLOOR((x - 308000) / (50 / POW(2, l))) AS BIGINT) AS i, CAST(FLOOR((4688200 - y) / (50 / POW(2, l))) AS BIGINT) AS j, COUNT(*) AS n FROM cells, range(9) AS t(l) GROUP BY ALL)"


@register("equal_tiles", f"""WITH {_NODES} SELECT CAST((POW(4, a.l) - 1) / 3 AS BIGINT) * 16 + a.j * (CAST(POW(2, a.l) AS BIGINT) * 4) + a.i AS tile, a.n FROM n a LEFT JOIN n p ON p.l = a.l - 1 AND p.i = a.i // 2 AND p.j = a.j // 2
 WHERE (a.l = 0 OR p.n > {LIMIT}) AND (a.n <= {LIMIT} OR a.l = 8)""")
def equal_tiles(spark, sf_dir):
    """Points of tiles that are cut in quarters until each has few enough."""
    points = written(pts(spark, sf_dir).select("X", "Y"))
    tiles = GRID.balanced(points, TILE, LIMIT).halo(points, TILE, 0.0).where("is_core")
    return tiles.groupBy("tile").agg(F.count("*").alias("n"))


@register("area_products", f"""WITH own AS (SELECT ROW_NUMBER() OVER () AS id, * FROM pts WHERE yr = 2021 AND cls NOT IN (7, 18)), {_ground_sql('own')},
 h AS (SELECT own.*, CASE WHEN cls IN (2, 9) THEN 1 ELSE cls END AS c, FLOOR(GREATEST(z - g, 0) * 1000 + 0.3e0) / 1000 AS h FROM own JOIN surface USING (id) WHERE x >= 308000 AND x < 308200 AND y > 4688000 AND y <= 4688200)
 SELECT CAST(LEAST(FLOOR((4688200 - y) / 10), 19) AS INT) AS {R}, CAST(LEAST(FLOOR((x - 308000) / 10), 19) AS INT) AS col,
  QUANTILE_CONT(h, 0.95) FILTER (c IN (3, 4, 5) AND h > 0) AS h95, MAX(h) FILTER (c IN (3, 4, 5) AND h > 0) AS hmax,
  COUNT(*) FILTER (rn = 1 AND c IN (3, 4, 5)) AS gap_n_first FROM h GROUP BY 1, 2""")
def area_products(spark, sf_dir):
    """Metrics of all points over rough ground and counts of first returns, by one aggregate."""
    heights = terrain.normalise(on_relief(spark, sf_dir), GRID, TILE, BUFFER).where("Pulse IS NOT NULL")
    heights = heights.withColumn("HeightAboveGround", _hundredths(F.col("HeightAboveGround"), 1000.0))
    first = F.count(F.when((F.col("ReturnNumber") == 1) & F.col("Classification").isin(3, 4, 5), 1)).alias("gap_n_first")
    return metrics.cell_metrics(heights, GRID, ("h95", "hmax"), beside=(first,))
