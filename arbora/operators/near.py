"""Mean distances to the nearest points in space, by blocks of points with a rim.

Pairs of points are met and ranked inside a block and never become rows, so what
is shuffled grows with the points. A point whose k nearest aren't all within the
rim goes on to a wider one; the few that are left after that, far from the
others, are searched for by joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.lineage import written
from arbora.operators.filters import finite
from arbora.operators.joins import nearest
from arbora.operators.terrain import apart

#: Points of a block, its rim aside; rims tried; distances held at a time.
BLOCK, ROUNDS, AT_ONCE = 100_000, 3, 2_000_000


def mean_distances(points: DataFrame, key: str, k: int) -> DataFrame:
    """``__key`` and ``__d``, the mean distance of each point to its ``k`` nearest others in space, to all where there are fewer.

    ``key`` names a point; one without others has no row.
    """
    own = written(points.where(finite("X") & finite("Y") & finite("Z")).select(F.col(key).alias("__key"), "X", "Y", "Z"))
    box = own.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{e}") for c in "XYZ" for e, f in (("0", F.min), ("1", F.max))]).first()
    kind = own.schema["__key"].dataType.simpleString()
    found, left = own.sparkSession.createDataFrame([], f"__key {kind}, __d double"), own.select("__key")
    if box["n"] > k:
        whole = math.hypot(*[box[f"{c}1"] - box[f"{c}0"] for c in "XYZ"]) + 1e-6
        reach = _reach(own, k, box, whole)
        for _ in range(ROUNDS):
            if reach >= whole / 2:
                break
            told = written(_in_blocks(own, left, k, reach, kind))
            found = found.union(told.where("__d is not null"))
            left = written(told.where("__d is null").select("__key"))
            if left.isEmpty():
                return found
            reach *= 2
    centre = own.join(left, "__key", "left_semi").select("__key", F.col("X").alias("cx"), F.col("Y").alias("cy"), F.col("Z").alias("cz"))
    far = nearest(centre, own.withColumnRenamed("__key", "__other"), "__key", k, z="cz", other="__other")
    return found.union(far.groupBy("__key").agg(F.avg(F.sqrt("distance2")).alias("__d")))


def _reach(own: DataFrame, k: int, box, whole: float) -> float:
    """A distance within which most points have ``k`` others but not many more."""
    volume = math.prod(max(box[f"{c}1"] - box[f"{c}0"], whole * 1e-3) for c in "XYZ")
    reach, last = min(whole, (k / 2 * volume / box["n"]) ** (1 / 3)), math.inf
    while reach > whole * 1e-6:
        cubes = own.groupBy(*[F.floor(F.col(c) / reach).alias(c) for c in "XYZ"]).agg(F.count("*").cast("double").alias("n"))
        crowd = cubes.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).first()[0]
        if crowd <= k:
            return reach
        if crowd > 0.7 * last:  # repeated positions: smaller cubes hold hardly fewer
            return before
        before, last, reach = reach, crowd, reach * max(0.05, (k / 2 / crowd) ** (1 / 3))
    return max(reach, whole * 1e-6)


def _side(own: DataFrame, reach: float) -> float:
    """The side of a block: as many points as a task should have, but wider than its rim."""
    count, side = own.count(), 64 * reach
    most = max(1000, min(BLOCK, count // (4 * own.sparkSession.sparkContext.defaultParallelism)))
    squares = own.groupBy(F.floor(F.col("X") / side), F.floor(F.col("Y") / side)).agg(F.count("*").cast("double").alias("n"))
    crowd = squares.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).first()[0] or 1.0
    return max(4 * reach, min(64.0 * 64 * reach, side * math.sqrt(most / crowd)))


def _in_blocks(own: DataFrame, left: DataFrame, k: int, reach: float, kind: str) -> DataFrame:
    """``__key`` and ``__d`` of the points named in ``left``; null where their ``k`` nearest aren't all within ``reach``."""
    side = _side(own, reach)
    asked = own.join(left.withColumn("__asked", F.lit(True)), "__key", "left").withColumn("__asked", F.coalesce("__asked", F.lit(False)))
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    spread = asked.withColumn("__bx", F.explode(span("X"))).withColumn("__by", F.explode(span("Y")))
    home = (F.floor(F.col("X") / side) == F.col("__bx")) & (F.floor(F.col("Y") / side) == F.col("__by"))
    spread = spread.withColumn("__asked", F.col("__asked") & home)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which = np.flatnonzero(pdf["__asked"].to_numpy())
        if not len(which):
            return pd.DataFrame({"__key": pdf["__key"].iloc[:0], "__d": np.zeros(0)})
        d = mean_of_nearest(pdf[["X", "Y", "Z"]].to_numpy(), which, k, reach)
        return pd.DataFrame({"__key": pdf["__key"].iloc[which], "__d": d})

    return apart(spread, ["__bx", "__by"]).groupBy("__bx", "__by").applyInPandas(run, f"__key {kind}, __d double")


def mean_of_nearest(p: np.ndarray, which: np.ndarray, k: int, reach: float) -> np.ndarray:
    """Mean distance of the points ``which`` to their ``k`` nearest others, NaN if those aren't all within ``reach``."""
    cell = np.floor(p / reach).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    _, ny, nz = cell.max(axis=0) + 2
    number = (cell[:, 0] * ny + cell[:, 1]) * nz + cell[:, 2]
    order = np.argsort(number, kind="stable")
    sorted_number, q = number[order], p[order]
    place = np.empty(len(p), np.int64)
    place[order] = np.arange(len(p))
    asked = np.argsort(number[which], kind="stable")
    at = which[asked]
    # cubes that follow each other in height are one run of points
    shift = np.array([(i * ny + j) * nz for i in (-1, 0, 1) for j in (-1, 0, 1)])
    first = np.searchsorted(sorted_number, number[at][:, None] + shift - 1, "left")
    count = np.searchsorted(sorted_number, number[at][:, None] + shift + 1, "right") - first
    total = count.sum(axis=1)
    out = np.full(len(which), np.nan)
    begin = 0
    while begin < len(at):
        widest = np.maximum.accumulate(total[begin : begin + AT_ONCE // (k + 1)])
        rows = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), AT_ONCE, "right")))
        own, n = at[begin : begin + rows], count[begin : begin + rows].ravel()
        ends = np.cumsum(n)
        near = np.repeat(first[begin : begin + rows].ravel() - ends + n, n) + np.arange(ends[-1])
        t = total[begin : begin + rows]
        row = np.repeat(np.arange(len(own)), t)
        d2 = ((q[near] - p[own][row]) ** 2).sum(axis=1)
        d2[near == place[own][row]] = np.inf
        table = np.full((len(own), max(k, int(t.max()))), np.inf)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(t) - t, t)] = d2
        best = np.sort(np.partition(table, k - 1, axis=1)[:, :k], axis=1)
        done = best[:, -1] <= reach * reach
        out[asked[begin : begin + rows][done]] = np.sqrt(best[done]).mean(axis=1)
        begin += rows
    return out
