"""Synthetic forests with known truth, made by ranges and hashes: the same rows for the same seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.columns import terrain
from arbora.grid import Grid
from arbora.operators.joins import disc_join


def _unit(seed: int, *what):
    return F.pmod(F.xxhash64(*[F.lit(w) if isinstance(w, str) else w for w in what], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def trees(spark: SparkSession, grid: Grid, per_hectare: float, seed: int = 0) -> DataFrame:
    """tree, x, y, height, radius of a random stand over the grid."""
    area = (grid.x1 - grid.x0) * (grid.y1 - grid.y0) / 1e4
    rows = spark.range(max(1, round(per_hectare * area))).withColumnRenamed("id", "tree")
    height = 8.0 + 22.0 * _unit(seed, F.col("tree"), "h")
    return rows.select("tree", (grid.x0 + _unit(seed, F.col("tree"), "x") * (grid.x1 - grid.x0)).alias("x"), (grid.y0 + _unit(seed, F.col("tree"), "y") * (grid.y1 - grid.y0)).alias("y"), height.alias("height"), (1.0 + 0.12 * height).alias("radius"))


def canopy(cells: DataFrame, stand: DataFrame, key: list[str], widest: float = 6.0) -> DataFrame:
    """Height of the highest crown over each place (``key``, cx, cy): half ellipsoids on their stems' tops."""
    crowns = stand.select(F.col("x").alias("X"), F.col("y").alias("Y"), "height", "radius")
    over = disc_join(cells.select(*key, "cx", "cy"), crowns, widest).where("distance2 <= radius * radius")
    top = F.col("height") * (0.5 + 0.5 * F.sqrt(1.0 - F.col("distance2") / (F.col("radius") * F.col("radius"))))
    found = over.groupBy(*key).agg(F.max(top).alias("canopy"))
    return cells.join(found, key, "left").withColumn("canopy", F.coalesce("canopy", F.lit(0.0)))


def scene(spark: SparkSession, grid: Grid, kind: str = "hills", per_hectare: float = 300.0, pulses_per_m2: float = 4.0, penetration: float = 0.4, seed: int = 0) -> DataFrame:
    """Points with truth: X, Y, Z, ground, canopy, Classification, ReturnNumber, NumberOfReturns, Pulse.

    A pulse over a crown returns from it and, as often as ``penetration``, from the ground too.
    """
    n = math.ceil((grid.x1 - grid.x0) * (grid.y1 - grid.y0) * pulses_per_m2)
    shots = spark.range(n).select(F.col("id").alias("Pulse"), (grid.x0 + _unit(seed, F.col("id"), "px") * (grid.x1 - grid.x0)).alias("cx"), (grid.y0 + _unit(seed, F.col("id"), "py") * (grid.y1 - grid.y0)).alias("cy"))
    seen = canopy(shots, trees(spark, grid, per_hectare, seed), ["Pulse"])
    base = terrain(kind, F.col("cx") - grid.x0, F.col("cy") - grid.y0)
    through = _unit(seed, F.col("Pulse"), "t") < penetration
    high = F.struct((base + F.col("canopy")).alias("Z"), F.lit(5).alias("Classification"), F.lit(1).alias("ReturnNumber"), F.when(through, 2).otherwise(1).alias("NumberOfReturns"))
    low = lambda k: F.struct(base.alias("Z"), F.lit(2).alias("Classification"), F.lit(k).alias("ReturnNumber"), F.lit(k).alias("NumberOfReturns"))
    hits = F.when(F.col("canopy") < 0.5, F.array(low(1))).when(through, F.array(high, low(2))).otherwise(F.array(high))
    rows = seen.withColumn("__h", F.explode(hits))
    return rows.select(F.col("cx").alias("X"), F.col("cy").alias("Y"), "__h.*", base.alias("ground"), "canopy", "Pulse")
