"""Structural metrics, gap fraction and rasters as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.lineage import written
from arbora.grid import Grid
from arbora.operators.filters import finite
from arbora.operators.discs import Values, celled, disc_cells, disc_parts, disc_percentiles, disc_sums
from arbora.operators.joins import disc_join
from arbora.schema import BARE_GROUND, VEGETATION

COVER_HEIGHT = 2.0
BAND_LIMIT = 80
#: What the sums of a cell cost against a pair of a disc and a point, with metre bands and without. Pairs that only add to sums are cheap: at 30
#: points per m2 and 12.5 m percentiles take 12.8 s by cells and 18.0 s by pairs, sums 4.1 s and 2.8 s.
BAND_ROWS, SUM_ROWS = 16, 64
#: Height strata, lower edge open and upper edge closed.
STRATA = {"pv_0_2": (0.0, 2.0), "pv_2_5": (2.0, 5.0), "pv_5_10": (5.0, 10.0), "pv_10_20": (10.0, 20.0), "pv_20_40": (20.0, 40.0), "pv_above40": (40.0, float("inf"))}
PERCENTILES = {"h50": 0.5, "h75": 0.75, "h95": 0.95}
METRICS = ("density", "cc", "hmean", *STRATA, "h50", "h75", "h95", "hmax", "crr", "fhd", "vci")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def structure(points: DataFrame, keys: list[str], area: float, wanted: tuple[str, ...] = METRICS, min_density: float = 0.0, beside: tuple[Column, ...] = ()) -> DataFrame:
    """The wanted metrics of each group of ``keys``, from points with HeightAboveGround.

    All but the height diversity are one aggregate, with one buffer for all
    percentiles; the diversity counts by 1 m band first. With less than
    ``min_density`` points per area all metrics are null. ``beside`` are
    aggregates of other products that go along.
    """
    unknown = set(wanted) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    h, cls = F.col("HeightAboveGround"), F.col("Classification")
    known = finite("HeightAboveGround")
    veg = F.coalesce(known & cls.isin(*VEGETATION) & (h > 0), F.lit(False))
    first = F.coalesce(known & (F.col("ReturnNumber") == 1) & cls.isin(*VEGETATION, BARE_GROUND), F.lit(False))
    height = F.when(veg, h)
    n_veg = count_if(veg)
    parts: dict[str, Column] = {
        "density": F.count("*") / area,
        "cc": share(count_if(first & cls.isin(*VEGETATION) & (h > COVER_HEIGHT)), count_if(first)),
        "hmean": F.avg(height),
        **{name: share(count_if(veg & (h > lo) & (h <= hi)), n_veg) for name, (lo, hi) in STRATA.items()},
        "hmax": F.max(height),
        "crr": share(F.avg(height) - F.min(height), F.max(height) - F.min(height)),
    }
    marked = points.withColumn("__veg", veg)
    chosen = [parts[m].alias(m) for m in wanted if m in parts]
    asked = [m for m in PERCENTILES if m in wanted]
    if asked:
        chosen.append(F.percentile(F.when(F.col("__veg"), h), [PERCENTILES[m] for m in asked]).alias("__p"))
    out = marked.groupBy(*keys).agg((F.count("*") / area).alias("__density"), *chosen, *beside)
    carried = [c for c in out.columns if c not in (*keys, "__density", "__p", *wanted)]
    out = out.withColumns({m: F.col("__p")[k] for k, m in enumerate(asked)})
    if {"fhd", "vci"} & set(wanted):
        out = out.join(height_diversity(marked.where("__veg"), keys), keys, "left")
    full = F.col("__density") >= min_density
    return out.select(*keys, *[F.when(full, F.col(m)).alias(m) for m in wanted], *carried)


def height_diversity(vegetation: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy of vegetation over 1 m bands up to 80 m (fhd), and its share of the largest (vci)."""
    band = F.least(F.floor("HeightAboveGround"), F.lit(BAND_LIMIT - 1)).cast("int")
    counts = vegetation.where(F.col("HeightAboveGround") <= BAND_LIMIT).groupBy(*keys, band.alias("__band")).agg(F.count("*").alias("__n"))
    return _diversity(counts, keys)


def _diversity(counts: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("__n").cast("double")
    # -sum(p ln p) with p = n / N is ln N - sum(n ln n) / N
    sums = counts.groupBy(*keys).agg(F.sum("__n").cast("double").alias("__all"), F.sum(n * F.log(n)).alias("__nln"))
    fhd = F.greatest(F.log("__all") - F.col("__nln") / F.col("__all"), F.lit(0.0))
    return sums.select(*keys, fhd.alias("fhd"), (fhd / math.log(BAND_LIMIT)).alias("vci"))


def cell_metrics(points: DataFrame, grid: Grid, wanted: tuple[str, ...] = METRICS, min_density: float = 0.0, beside: tuple[Column, ...] = ()) -> DataFrame:
    """Metrics of each pixel that owns a point."""
    need = [c for c in ("X", "Y", "HeightAboveGround", "Classification", "ReturnNumber") if c in points.columns]
    return structure(grid.bins(points.select(*need)), ["row", "col"], grid.resolution**2, wanted, min_density, beside)


def disc_metrics(centres: DataFrame, points: DataFrame, keys: list[str], radius: float, wanted: tuple[str, ...] = METRICS, min_density: float = 0.0, x: str = "cx", y: str = "cy", parts: int | None = None) -> DataFrame:
    """Metrics over the disc around each centre; centres without enough points stay, with nulls.

    The same values as :func:`structure` of all pairs; a place that several
    centres share is worked out once. Where points are dense they
    come from cells that the discs share, ``parts`` of them on a radius: 0 for
    pairs alone, by default as :func:`disc_parts` says.
    """
    out = _disc_structure(centres.select(x, y).distinct(), points, [x, y], radius, wanted, min_density, x, y, parts)
    return centres.select(*dict.fromkeys([*keys, x, y])).join(out, [x, y], "left").select(*keys, *wanted)


def _disc_structure(centres: DataFrame, points: DataFrame, keys: list[str], radius: float, wanted: tuple[str, ...], min_density: float, x: str, y: str, parts: int | None) -> DataFrame:
    unknown = set(wanted) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    h, cls = F.col("HeightAboveGround"), F.col("Classification")
    known = finite("HeightAboveGround")
    need = points.select("X", "Y", "HeightAboveGround", "Classification", "ReturnNumber")
    asked = {name: p for name, p in PERCENTILES.items() if name in wanted}
    banded = bool(asked) or bool({"fhd", "vci"} & set(wanted))
    parts = disc_parts(need, radius, BAND_ROWS if banded else SUM_ROWS) if parts is None else parts
    if parts == 0:
        found = disc_join(centres.select(*dict.fromkeys([*keys, x, y])), need, radius, x, y)
        return structure(found, keys, math.pi * radius**2, wanted, min_density, (F.count("*").alias("n_points"),))
    need = celled(need, radius, parts)
    veg, first, height = F.col("__veg"), F.col("__first"), F.when(F.col("__veg"), h)
    marked = need.withColumns({
        "__veg": F.coalesce(known & cls.isin(*VEGETATION) & (h > 0), F.lit(False)),
        "__first": F.coalesce(known & (F.col("ReturnNumber") == 1) & cls.isin(*VEGETATION, BARE_GROUND), F.lit(False)),
    }).withColumn("__band", F.when(veg, F.floor(h)).otherwise(F.lit(-1).cast("bigint")))
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    values: Values = {"n_points": (F.lit(1).cast("bigint"), "sum"), "__n": (one(veg), "sum")}
    if "cc" in wanted:
        values |= {"__n_first": (one(first), "sum"), "__n_cover": (one(first & cls.isin(*VEGETATION) & (h > COVER_HEIGHT)), "sum")}
    if {"hmean", "crr"} & set(wanted):
        values["__sum"] = (height, "sum")
    if {"hmax", "crr"} & set(wanted):
        values["__top"] = (height, "max")
    if "crr" in wanted:
        values["__low"] = (height, "min")
    if {"fhd", "vci"} & set(wanted):
        values["__n_band"] = (one(veg & (h <= BAND_LIMIT)), "sum")
    strata = [name for name in STRATA if name in wanted]
    values |= {f"__{name}": (one(veg & (h > STRATA[name][0]) & (h <= STRATA[name][1])), "sum") for name in strata}
    marked = written(marked)  # whole cells, rims and percentiles read it
    cells = disc_cells(centres, keys, radius, parts, x, y)
    sums = disc_sums(cells, marked, keys, radius, values, ("__band",) if banded else ())
    out = sums
    if banded:
        band = F.struct("__band", F.col("__n").alias("n"), *(["__n_band"] if "__n_band" in values else []))
        listed = F.collect_list(F.when(F.col("__band") >= 0, band)).alias("__bands")  # as many as a disc has metres of height
        out = sums.groupBy(*keys).agg(listed, *[getattr(F, how)(name).alias(name) for name, (_, how) in values.items()])
    if asked:
        out = disc_percentiles(cells, marked.where("__veg"), out, keys, radius, "HeightAboveGround", "__band", asked)
    if "__n_band" in values:
        bands = out.select(*keys, F.inline("__bands")).where("__n_band > 0").groupBy(*keys, F.least("__band", F.lit(BAND_LIMIT - 1)).alias("__band")).agg(F.sum("__n_band").alias("__n"))
        out = out.join(_diversity(bands, keys), keys, "left")
    mean = F.col("__sum") / F.when(F.col("__n") > 0, F.col("__n"))
    made: dict[str, Column] = {
        "density": F.col("n_points") / (math.pi * radius**2),
        "cc": share(F.col("__n_cover"), F.col("__n_first")),
        "hmean": mean,
        **{name: share(F.col(f"__{name}"), F.col("__n")) for name in strata},
        "hmax": F.col("__top"),
        "crr": share(mean - F.col("__low"), F.col("__top") - F.col("__low")),
    }
    full = F.col("n_points") / (math.pi * radius**2) >= min_density
    return out.select(*keys, *[F.when(full, made.get(m, F.col(m))).alias(m) for m in wanted], "n_points")


def plot_metrics(plots: DataFrame, points: DataFrame, key: str, radius: float, wanted: tuple[str, ...] = METRICS, x: str = "px", y: str = "py", parts: int | None = None) -> DataFrame:
    """Metrics of each plot, and ``n_points``; plots without points stay."""
    out = _disc_structure(plots.select(x, y).distinct(), points, [x, y], radius, wanted, 0.0, x, y, parts)
    return plots.select(key, x, y).join(out, [x, y], "left").select(key, *wanted, F.coalesce("n_points", F.lit(0)).alias("n_points"))


def gap_sums() -> tuple[Column, ...]:
    """The counts of first returns that gap fraction takes: ground, ground and vegetation, all."""
    first = F.col("ReturnNumber") == 1
    ground, veg = first & (F.col("Classification") == BARE_GROUND), first & F.col("Classification").isin(*VEGETATION)
    return count_if(ground).alias("gap_n_ground"), count_if(ground | veg).alias("gap_n_classified"), count_if(first).alias("gap_n_first")


def gap_columns(area: float, min_density: float = 0.0) -> dict[str, Column]:
    """``gap`` and ``gap_saturated`` of those counts."""
    supported = (F.col("gap_n_classified") > 0) & (F.col("gap_n_first") / area >= min_density)
    return {"gap": F.when(supported, F.col("gap_n_ground") / F.col("gap_n_classified")), "gap_saturated": F.when(supported, F.col("gap_n_ground") == 0)}


def gap_counts(points: DataFrame, keys: list[str], area: float, min_density: float = 0.0) -> DataFrame:
    """Gap fraction of first returns: ground over ground and vegetation, with its counts."""
    out = points.groupBy(*keys).agg(*gap_sums()).withColumns(gap_columns(area, min_density))
    return out.select(*keys, "gap", "gap_n_ground", "gap_n_classified", "gap_n_first", "gap_saturated")


def gap_fraction(points: DataFrame, grid: Grid, min_density: float = 0.0) -> DataFrame:
    return gap_counts(grid.bins(points.select("X", "Y", "Classification", "ReturnNumber")), ["row", "col"], grid.resolution**2, min_density)


def disc_gap(centres: DataFrame, points: DataFrame, keys: list[str], radius: float, x: str = "cx", y: str = "cy", min_density: float = 0.0, parts: int | None = None) -> DataFrame:
    """Gap fraction over the disc around each centre that has a point, from cells that the discs share."""
    first = F.col("ReturnNumber") == 1
    ground, veg = first & (F.col("Classification") == BARE_GROUND), first & F.col("Classification").isin(*VEGETATION)
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    values: Values = {"gap_n_ground": (one(ground), "sum"), "gap_n_classified": (one(ground | veg), "sum"), "gap_n_first": (one(first), "sum")}
    need = points.select("X", "Y", "Classification", "ReturnNumber")
    parts = disc_parts(need, radius, SUM_ROWS) if parts is None else parts
    if parts == 0:
        return gap_counts(disc_join(centres.select(*keys, x, y), need, radius, x, y), keys, math.pi * radius**2, min_density)
    need = celled(need, radius, parts)
    out = disc_sums(disc_cells(centres, keys, radius, parts, x, y), need, keys, radius, values)
    out = out.withColumns(gap_columns(math.pi * radius**2, min_density))
    return out.select(*keys, "gap", "gap_n_ground", "gap_n_classified", "gap_n_first", "gap_saturated")


def rasterise(points: DataFrame, grid: Grid, value: str, statistic: str = "max") -> DataFrame:
    """One statistic of ``value`` per pixel: max, min, mean, median, count, std, sum or pNN."""
    v = F.when(finite(value), F.col(value))
    named = {"max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "count": F.count, "std": F.stddev_pop, "sum": F.sum}
    if statistic in named:
        out = named[statistic](v)
    elif statistic.startswith("p") and statistic[1:].replace(".", "", 1).isdigit() and float(statistic[1:]) <= 100:
        out = F.percentile(v, float(statistic[1:]) / 100)
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    return grid.bins(points.select("X", "Y", value)).groupBy("row", "col").agg(out.alias("value"))


def pulse_density(points: DataFrame, cell: float = 5.0) -> DataFrame:
    """First returns per m2 on cells at whole multiples of ``cell``: kx, ky, density."""
    first = points.where("ReturnNumber = 1")
    return first.groupBy(F.floor(F.col("X") / cell).alias("kx"), F.floor(F.col("Y") / cell).alias("ky")).agg((F.count("*") / (cell * cell)).alias("density"))


def pulse_spacing(points: DataFrame, cell: float = 5.0) -> DataFrame:
    """One row: points, occupied cells, spacing, and the automatic freeze distance of three spacings."""
    cells = points.groupBy(F.floor(F.col("X") / cell), F.floor(F.col("Y") / cell)).agg(F.count("*").alias("n"))
    one = cells.agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    spacing = F.sqrt(F.col("cells") * (cell * cell) / F.when(F.col("n") > 0, F.col("n")))
    return one.select("n", "cells", spacing.alias("spacing"), (3 * spacing).alias("freeze"))


def scan_angle(points: DataFrame, grid: Grid) -> DataFrame:
    """Mean absolute scan angle of first returns per pixel."""
    return grid.bins(points.where("ReturnNumber = 1").select("X", "Y", "ScanAngleRank")).groupBy("row", "col").agg(F.avg(F.abs("ScanAngleRank")).alias("angle"))


def neighbourhood(cells: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """The nine values around each pixel of a dense raster, edges repeated: row, col, ``value``."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = cells.select("row", "col").withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    clamp = lambda c, d, n: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.lit(n - 1))
    spread = spread.select("row", "col", clamp("row", "__i", rows).alias("__r"), clamp("col", "__j", cols).alias("__c"))
    source = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return spread.join(source, ["__r", "__c"]).select("row", "col", value)


def vegetation_evidence(points: DataFrame, grid: Grid) -> DataFrame:
    """Share of returns from pulses with several, smoothed over 3 x 3 pixels with repeated edges."""
    per = grid.bins(points.select("X", "Y", "NumberOfReturns")).groupBy("row", "col").agg(F.avg((F.col("NumberOfReturns") > 1).cast("double")).alias("share"))
    dense = grid.cells(points.sparkSession).select("row", "col").join(per, ["row", "col"], "left").select("row", "col", F.coalesce("share", F.lit(0.0)).alias("share"))
    return neighbourhood(dense, "share", grid.ny, grid.nx).groupBy("row", "col").agg(F.avg("share").alias("evidence"))


def local_maxima(cells: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """Pixels whose value is the largest of the 3 x 3 around them."""
    top = neighbourhood(cells, value, rows, cols).groupBy("row", "col").agg(F.max(value).alias("__top"))
    return cells.join(top, ["row", "col"]).where(F.col(value) >= F.col("__top")).drop("__top")
