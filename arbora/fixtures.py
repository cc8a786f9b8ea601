"""Point, shot, plot and file tables derived from the star-schema test tables.

The box has no lidar data. ``PTS``, ``SHOTS``, ``PLOTS`` and ``FILES`` are SQL
that Spark and DuckDB run alike; the functions give them as DataFrames under
the names of the point schema. Shots are the stated query set, every 20th event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.grid import Grid

EXTENT = (308000.0, 4688000.0, 308200.0, 4688200.0)
GRID = Grid.from_bbox(*EXTENT, 10.0)

PTS = """
SELECT 308000.0e0 + lx AS x, 4688000.0e0 + ly AS y,
  800.0e0 + lx / 64.0e0 + ly / 32.0e0 + CASE WHEN cls = 2 THEN 0.0e0 ELSE h END AS z,
  CASE WHEN cls = 2 THEN 0.0e0 ELSE h END AS hag, cls, rn, nr, yr, l_orderkey AS pulse FROM (
 SELECT CAST((l_orderkey * 7919 + l_linenumber * 13) % 20000 AS DOUBLE) / 100.0e0 AS lx,
  CAST((l_orderkey * 104729 + l_partkey * 17) % 20000 AS DOUBLE) / 100.0e0 AS ly,
  CAST((l_partkey * 31 + l_suppkey * 7 + l_orderkey) % 4000 AS DOUBLE) / 100.0e0 AS h,
  CASE WHEN (l_orderkey * 3 + l_partkey) % 20 < 6 THEN 2
       WHEN (l_orderkey * 3 + l_partkey) % 20 < 10 THEN 3
       WHEN (l_orderkey * 3 + l_partkey) % 20 < 14 THEN 4
       WHEN (l_orderkey * 3 + l_partkey) % 20 < 18 THEN 5
       WHEN (l_orderkey * 3 + l_partkey) % 20 = 18 THEN 1 ELSE 7 END AS cls,
  CAST(rn AS INT) AS rn, CAST(nr AS INT) AS nr,
  CASE WHEN YEAR(l_shipdate) % 2 = 0 THEN 2017 ELSE 2021 END AS yr, l_orderkey FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
   ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rn,
   COUNT(*) OVER (PARTITION BY l_orderkey) AS nr FROM lineitem) AS r) AS b
"""
SHOTS = "SELECT event_id AS shot_id, 308010.0e0 + CAST((event_id * 37) % 1800 AS DOUBLE) / 10.0e0 AS center_x, 4688010.0e0 + CAST((event_id * 91) % 1800 AS DOUBLE) / 10.0e0 AS center_y, user_id % 8 AS beam FROM events WHERE event_id % 20 = 0"
PLOTS = "SELECT s_suppkey AS plot_id, 308020.0e0 + CAST((s_suppkey * 53) % 160 AS DOUBLE) AS px, 4688020.0e0 + CAST((s_suppkey * 71) % 160 AS DOUBLE) AS py, s_acctbal / 50.0e0 AS agb, s_nationkey AS block FROM supplier"
FILES = "SELECT n_nationkey AS file_id, CAST(n_nationkey % 5 AS DOUBLE) * 40.0e0 + 308000.0e0 AS min_x, CAST(n_nationkey % 5 AS DOUBLE) * 40.0e0 + 308040.0e0 AS max_x, FLOOR(n_nationkey / 5.0e0) * 40.0e0 + 4688000.0e0 AS min_y, FLOOR(n_nationkey / 5.0e0) * 40.0e0 + 4688040.0e0 AS max_y, CASE WHEN n_nationkey % 3 = 0 THEN 2017 ELSE 2021 END AS yr FROM nation"


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {given}"), given=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def points(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """X, Y, Z, HeightAboveGround, Classification, ReturnNumber, NumberOfReturns, Year, Pulse."""
    p = _view(spark, sf_dir, PTS, "lineitem")
    p = p.where(F.col("yr") == year) if year is not None else p
    names = {"x": "X", "y": "Y", "z": "Z", "hag": "HeightAboveGround", "cls": "Classification", "rn": "ReturnNumber", "nr": "NumberOfReturns", "yr": "Year", "pulse": "Pulse"}
    return p.select(*[F.col(a).alias(b) for a, b in names.items()])


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a test table is one row group, so one task, and a disc join makes many rows of each of its points."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SHOTS, "events")


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PLOTS, "supplier")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FILES, "nation")
