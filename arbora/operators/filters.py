"""Selecting, thinning and reclassifying points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.lineage import written
from arbora.schema import GROUND, NOISE, VEGETATION


def finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) != float("inf"))


def clean(points: DataFrame, drop_noise: bool = True) -> DataFrame:
    """Points with finite coordinates, not withheld and, unless kept, no noise class."""
    keep = finite("X") & finite("Y") & finite("Z")
    if drop_noise:
        keep = keep & ~F.col("Classification").isin(*NOISE)
    if "Withheld" in points.columns:
        keep = keep & (F.coalesce(F.col("Withheld"), F.lit(0)) == 0)
    return points.where(keep)


def of_classes(points: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    return points.where(F.col("Classification").isin(*classes))


def surface_returns(points: DataFrame, first_only: bool = True) -> DataFrame:
    """Vegetation and ground returns that can form a surface."""
    keep = F.col("Classification").isin(*VEGETATION, *GROUND)
    return points.where(keep & (F.col("ReturnNumber") == 1) if first_only else keep)


def classifier_input(points: DataFrame) -> DataFrame:
    """Classes other than noise reset to 1; return numbers made consistent."""
    number = F.greatest(F.col("ReturnNumber"), F.lit(1))
    out = points.withColumn("Classification", F.when(F.col("Classification").isin(*NOISE), F.col("Classification")).otherwise(F.lit(1)))
    return out.withColumn("NumberOfReturns", F.greatest(F.col("NumberOfReturns"), number)).withColumn("ReturnNumber", number)


def low_outliers(points: DataFrame, cell: float = 10.0, gap: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with ``is_low``: the lowest of a cell while the next one is more than ``gap`` higher.

    The rule stops at the first point that has its successor within ``gap``; the
    highest point of a cell is never low.
    """
    cells = points.withColumn("__cx", F.floor(F.col("X") / cell)).withColumn("__cy", F.floor(F.col("Y") / cell))
    w = Window.partitionBy(*keys, "__cx", "__cy").orderBy("Z", "X", "Y")
    step = F.coalesce(F.lead("Z").over(w) - F.col("Z"), F.lit(0.0))
    run = F.min("__step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.withColumn("__step", step).withColumn("is_low", run > gap).drop("__cx", "__cy", "__step")


def drop_ground_outliers(points: DataFrame, cell: float = 10.0, gap: float = 1.0, ground: tuple[int, ...] = GROUND) -> DataFrame:
    """Low outliers among ground points become class 7; the other points stay as they are."""
    is_ground = F.col("Classification").isin(*ground)
    marked = low_outliers(points.where(is_ground), cell, gap).withColumn("Classification", F.when(F.col("is_low"), F.lit(7)).otherwise(F.col("Classification")))
    return marked.drop("is_low").unionByName(points.where(~is_ground | F.col("Classification").isNull()))


def radius_outliers(points: DataFrame, key: str, radius: float = 1.0, least: int = 2) -> DataFrame:
    """``key``, which names a point, of those with fewer than ``least`` other points within ``radius`` in 3-D.

    In a cube half a radius wide all points are neighbours, so those of a cube
    with more than ``least`` are settled by its count. The others meet the points
    of the cubes around theirs, and only who is still left those of a radius.
    """
    known = finite("X") & finite("Y") & finite("Z")
    keys = ["__kX", "__kY", "__kZ"]
    cube = lambda side: [F.when(known, F.floor(F.col(c) / side)).alias(k) for c, k in zip("XYZ", keys, strict=True)]
    own = written(points.select(F.col(key).alias("__key"), "X", "Y", "Z"))
    placed = own.select("*", *cube(radius / 2))
    crowded = placed.where("__kX is not null").groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    few = written(placed.join(crowded, keys, "left_anti").select(*own.columns))
    d2 = F.pow(F.col("X") - F.col("cx"), 2) + F.pow(F.col("Y") - F.col("cy"), 2)
    for side in (radius / 2, radius):
        spread = few.select("__key", *[F.col(c).alias(f"c{c.lower()}") for c in "XYZ"], *cube(side))
        for c in keys:
            spread = spread.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
        near = spread.join(own.withColumnRenamed("__key", "__other").select("*", *cube(side)), keys)
        close = near.where((F.col("__key") != F.col("__other")) & (F.pow(F.col("Z") - F.col("cz"), 2) + d2 <= radius * radius))
        enough = close.groupBy("__key").count().where(F.col("count") >= least).select("__key")
        few = written(few.join(enough, "__key", "left_anti"))
    return few.select(F.col("__key").alias(key))


def best_per_cell(points: DataFrame, cell: float, order: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """The first point of each cell in ``order``."""
    w = Window.partitionBy(*keys, F.floor(F.col("X") / cell), F.floor(F.col("Y") / cell)).orderBy(*order)
    return points.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def thin_highest(points: DataFrame, cell: float) -> DataFrame:
    """The highest point above ground of each cell; ties to the smaller X, then Y."""
    return best_per_cell(points, cell, [F.col("HeightAboveGround").desc(), F.col("X"), F.col("Y")])


def thin_pulses(points: DataFrame, cell: float, pulse: str = "Pulse", rank: Column | None = None) -> DataFrame:
    """All returns of one pulse per cell: the pulse of a first return with the lowest rank.

    ``rank`` is a hash of the pulse; by default a 64-bit one.
    """
    chance = F.xxhash64(F.col(pulse)) if rank is None else rank
    chosen = best_per_cell(points.where("ReturnNumber = 1").withColumn("__rank", chance), cell, [F.col("__rank"), F.col(pulse), F.col("X"), F.col("Y")])
    return points.join(chosen.select(pulse).distinct(), pulse, "left_semi")


def merged_ground(points: DataFrame, ground: tuple[int, ...] = GROUND) -> DataFrame:
    """Ground with the mean Z of each exact position."""
    return of_classes(points, ground).groupBy("X", "Y").agg(F.avg("Z").alias("Z"), F.count("*").alias("n"))


def vegetation_by_height(points: DataFrame, bounds: tuple[float, float, float] = (0.5, 2.0, 5.0), source: tuple[int, ...] = (1,)) -> DataFrame:
    """Classes 3, 4 and 5 by height above ground for points of the source classes."""
    h, (a, b, c) = F.col("HeightAboveGround"), bounds
    new = F.when((h >= a) & (h < b), F.lit(3)).when((h >= b) & (h < c), F.lit(4)).when(h >= c, F.lit(5)).otherwise(F.col("Classification"))
    return points.withColumn("Classification", F.when(F.col("Classification").isin(*source), new).otherwise(F.col("Classification")))
