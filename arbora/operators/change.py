"""Change of a raster between two surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change(raster: DataFrame, year_from: int, year_to: int, min_delta: float = 0.0, least_base: float = 0.0, value: str = "value") -> DataFrame:
    """row, col, delta, pct and flag of the pixels that both years have.

    ``pct`` is null where the earlier value is smaller than ``least_base`` (or
    1e-9); ``flag`` is 1 for a gain and -1 for a loss of more than ``min_delta``.
    """
    old = raster.where(F.col("year") == year_from).select("row", "col", F.col(value).alias("__old"))
    new = raster.where(F.col("year") == year_to).select("row", "col", F.col(value).alias("__new"))
    delta = F.col("__new") - F.col("__old")
    pct = F.when(F.abs("__old") >= max(least_base, 1e-9), 100.0 * delta / F.when(F.col("__old") != 0, F.col("__old")))
    flag = F.when(delta > min_delta, F.lit(1)).when(delta < -min_delta, F.lit(-1)).when(delta.isNotNull(), F.lit(0))
    return old.join(new, ["row", "col"]).select("row", "col", delta.alias("delta"), pct.alias("pct"), flag.alias("flag"))
