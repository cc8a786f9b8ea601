"""Attenuation of transmitted energy with the plant area above, and footprint selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 101
#: Plant types that are judged in the leafy season only.
LEAF_ON_TYPES = (3, 4)


def select_shots(shots: DataFrame, bbox: tuple[float, float, float, float], margin: float = 25.0, sensitivity: float = 0.95, years: tuple[int, ...] | None = None) -> DataFrame:
    """Good shots inside the box less its margin, with ``rv_rg``: canopy over ground reflectance, the median where unknown."""
    min_x, min_y, max_x, max_y = bbox
    keep = F.col("center_x").between(min_x + margin, max_x - margin) & F.col("center_y").between(min_y + margin, max_y - margin)
    keep = keep & (F.col("l2a_quality_flag") == 1) & (F.col("l2b_quality_flag") == 1) & (F.col("degrade_flag") == 0) & (F.col("sensitivity") >= sensitivity)
    keep = keep & (~F.col("pft_class").isin(*LEAF_ON_TYPES) | (F.col("leaf_off_flag") == 0))
    if years is not None:
        keep = keep & F.year("time").isin(*years)
    good = shots.where(keep).withColumn("rv_rg", F.when((F.col("rhog") > 0) & (F.col("rhov") > 0), F.col("rhov") / F.col("rhog")))
    middle = good.agg(F.median("rv_rg").alias("__m"))
    return good.crossJoin(F.broadcast(middle)).withColumn("rv_rg", F.coalesce("rv_rg", "__m", F.lit(1.0))).drop("__m")  # one row


def relative_levels(profiles: DataFrame, keys: list[str], values: str = "pavd") -> DataFrame:
    """Array profiles as rows: keys, level 0 to 100, value."""
    return profiles.select(*keys, F.posexplode(values).alias("level", "value")).where(F.col("level") < LEVELS)


def observed_levels(footprints: DataFrame, shots: DataFrame, row: str = "shot_row", values: str = "pavd") -> DataFrame:
    """``footprints`` with a row for each level of the profile that ``shots`` holds under the same number, none without one."""
    return footprints.join(relative_levels(shots, [row], values), row)


def ratios(levels: DataFrame, reference: str, candidate: str, least: float = 5e-3, least_sum: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ratio of candidate to reference at each level (of each block), and of their sums from the top, where the reference is large enough."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.col("level").desc())  # at most 101 rows a block
    r, c = F.col(reference), F.col(candidate)
    out = levels.withColumn("__r", F.sum(r).over(w)).withColumn("__c", F.sum(c).over(w))
    return out.select(*keys, "level", F.when(r > least, c / F.nullif(r, F.lit(0.0))).alias("ratio"), F.when(F.col("__r") > least_sum, F.col("__c") / F.nullif(F.col("__r"), F.lit(0.0))).alias("cumulative_ratio"))


def fit_transmittance(samples: DataFrame, keys: list[str], cover: str, transmitted: str, free_amplitude: bool = True, least: int = 4) -> DataFrame:
    """``T = a exp(-b C)`` by least squares with b of at least 0: keys, a, b, rmse, n; groups with too few samples are left out.

    Levels are aggregated before, so a group is a profile's few levels.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[cover, transmitted]).sort_values([cover, transmitted])
        c, t = p[cover].to_numpy(float), p[transmitted].to_numpy(float)
        if len(c) < least:
            return pd.DataFrame(columns=[*keys, "a", "b", "rmse", "n"])

        def at(b: float) -> tuple[float, float]:
            e = np.exp(-b * c)
            a = float(e @ t / (e @ e)) if free_amplitude else 1.0
            return float(((t - a * e) ** 2).sum()), a

        grid = np.concatenate([[0.0], np.geomspace(1e-4, 20, 200)])
        k = int(np.argmin([at(b)[0] for b in grid]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
        for _ in range(80):  # golden section
            d = (hi - lo) * 0.6180339887498949
            if at(hi - d)[0] < at(lo + d)[0]:
                hi = lo + d
            else:
                lo = hi - d
        b = (lo + hi) / 2
        cost, a = at(b)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"a": [a], "b": [b], "rmse": [(cost / len(c)) ** 0.5], "n": [len(c)]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a double, b double, rmse double, n bigint"
    return samples.select(*keys, cover, transmitted).groupBy(*keys).applyInPandas(fit, schema)
