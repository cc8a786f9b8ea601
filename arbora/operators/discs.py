"""Aggregates over discs from cells that are counted once.

A disc holds many whole cells and a rim. Whole cells come from sums that every
disc shares, only the points of rim cells are met one by one, so work grows
with the disc's edge and not with its points. Percentiles come from counts by
metre band: only points of a band that holds a wanted rank are gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.lineage import written

#: Most cells on a radius; fewer than the least aren't worth their sums, and a cell should hold so many times the rows of its sums.
PARTS, LEAST_PARTS, GAIN = 16, 6, 4
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}

Values = dict[str, tuple[Column, str]]


def disc_parts(points: DataFrame, radius: float, rows: int = 1) -> int:
    """Cells on a radius that suit the mean density where points are; 0 if discs hold too few points for cells to save work.

    ``rows`` is how many rows the sums of one cell take (metre bands, say). The
    choice changes only the work: one count by square of the radius.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    squares = points.groupBy(F.floor(F.col("X") / radius), F.floor(F.col("Y") / radius)).agg(F.count("*").alias("n"))
    mean = squares.agg(F.avg("n")).first()[0] or 0.0
    parts = min(PARTS, int(math.sqrt(mean / (GAIN * rows))))
    return parts if parts >= LEAST_PARTS else 0


def disc_cells(centres: DataFrame, keys: list[str], radius: float, parts: int, x: str = "cx", y: str = "cy") -> DataFrame:
    """The cells that the disc around each centre touches: keys, ``__x``, ``__y``, ``__kx``, ``__ky`` and ``__whole``.

    A cell is whole if its farthest corner lies inside by a millionth of the
    radius, so rounding never takes a point in that the distance would leave out.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    if parts < 1:
        raise ValueError("parts must be at least 1")
    cell = radius / parts
    steps = F.sequence(F.lit(-parts - 1), F.lit(parts + 1))
    out = centres.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    out = out.withColumn("__kx", F.floor(F.col("__x") / cell) + F.col("__i")).withColumn("__ky", F.floor(F.col("__y") / cell) + F.col("__j"))

    def ends(place: str, index: str) -> tuple[Column, Column]:
        low, high = F.col(index) * cell - F.col(place), (F.col(index) + 1) * cell - F.col(place)
        return F.greatest(low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))

    (near_x, far_x), (near_y, far_y) = ends("__x", "__kx"), ends("__y", "__ky")
    touched = out.where(F.hypot(near_x, near_y) <= radius * (1 + 1e-6))
    return touched.withColumn("__whole", F.hypot(far_x, far_y) <= radius * (1 - 1e-6)).drop("__i", "__j")


def celled(points: DataFrame, radius: float, parts: int) -> DataFrame:
    """``points`` with the keys of :func:`disc_cells`."""
    cell = radius / parts
    return points.withColumn("__kx", F.floor(F.col("X") / cell)).withColumn("__ky", F.floor(F.col("Y") / cell))


def inside(radius: float) -> Column:
    return F.pow(F.col("X") - F.col("__x"), 2) + F.pow(F.col("Y") - F.col("__y"), 2) <= radius * radius


def disc_sums(cells: DataFrame, points: DataFrame, keys: list[str], radius: float, values: Values, by: tuple[str, ...] = ()) -> DataFrame:
    """``values`` merged over each disc, and by further columns ``by`` of the points; discs without points are absent.

    ``cells`` is :func:`disc_cells`, ``points`` :func:`celled`; a value is a
    column of one point and how it merges: sum, min or max.
    """
    merged = [_MERGE[how](F.col(name)).alias(name) for name, (_, how) in values.items()]
    single = points.select("X", "Y", "__kx", "__ky", *by, *[column.alias(name) for name, (column, _) in values.items()])
    shared = single.groupBy("__kx", "__ky", *by).agg(*merged)
    kept = [*keys, *by, *values]
    whole = cells.where("__whole").join(shared, ["__kx", "__ky"]).select(*kept)
    rim = cells.where(~F.col("__whole")).join(single, ["__kx", "__ky"]).where(inside(radius)).select(*kept)
    return whole.unionByName(rim).groupBy(*keys, *by).agg(*merged)


def disc_percentiles(cells: DataFrame, points: DataFrame, counts: DataFrame, keys: list[str], radius: float, value: str, band: str, asked: dict[str, float]) -> DataFrame:
    """``counts`` with exact percentiles (linear interpolation) of ``value`` over each disc; it is written once.

    Its column ``__bands`` lists how many of a disc's points lie in each ``band``,
    structs of the band and ``n``; bands don't fall as ``value`` grows. Those that
    hold a rank next to a wanted place are gathered and ranked, no others.
    """
    total = F.aggregate("__bands", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    counts = written(counts.withColumn("__all", total))
    at = {name: p * (F.col("__all") - 1) for name, p in asked.items()}
    ranks = {name: (F.floor(place), F.ceil(place)) for name, place in at.items()}
    run = Window.partitionBy(*keys).orderBy(band)
    listed = counts.where("__all > 0").select(*keys, "__all", F.inline("__bands")).withColumn("__before", F.sum("n").over(run) - F.col("n"))
    wanted = F.lit(False)
    for rank in (r for pair in ranks.values() for r in pair):
        wanted = wanted | ((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("n")))
    held = listed.where(wanted).select(*keys, band, "__before", "__all")
    met = cells.join(held, keys).join(points.select("X", "Y", "__kx", "__ky", band, value), ["__kx", "__ky", band]).where(F.col("__whole") | inside(radius))
    order = Window.partitionBy(*keys, band).orderBy(value)
    ranked = met.select(*keys, "__all", value, (F.col("__before") + F.row_number().over(order) - 1).alias("__rank"))
    picked = [F.max(F.when(F.col("__rank") == rank, F.col(value))).alias(f"__{end}_{name}") for name, pair in ranks.items() for end, rank in zip(("lo", "hi"), pair, strict=True)]
    ends = ranked.groupBy(*keys, "__all").agg(*picked)

    def between(name: str) -> Column:
        (low, high), lo, hi = ranks[name], F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return F.when((low == high) | (lo == hi), lo).otherwise((high - at[name]) * lo + (at[name] - low) * hi)

    return counts.join(ends.select(*keys, *[between(name).alias(name) for name in asked]), keys, "left")
