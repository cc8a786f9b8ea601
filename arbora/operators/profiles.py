"""Vertical profiles: gap probability, plant area density, relative heights and attenuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.columns import plant_area
from arbora.operators.joins import at_places, disc_join
from arbora.schema import BARE_GROUND, VEGETATION

STEP = 0.15
LEAST_GROUND = 5


def gap_from_returns(returns: DataFrame, keys: list[str], heights: list[float], weight: Column | None = None) -> DataFrame:
    """Gap probability at each height: the weighted share of returns at or below it (below 0: at 0).

    ``returns`` has HeightAboveGround and Classification; ground counts at 0.
    """
    h = F.when(F.col("Classification") == BARE_GROUND, F.lit(0.0)).otherwise(F.col("HeightAboveGround"))
    w = F.lit(1.0) if weight is None else weight
    used = returns.where(F.col("Classification").isin(BARE_GROUND, *VEGETATION)).withColumn("__h", h).withColumn("__w", w)
    at = F.array(*[F.lit(float(x)) for x in heights])
    sums = used.groupBy(*keys).agg(F.sum("__w").alias("__all"), F.array(*[F.sum(F.when(F.col("__h") <= max(float(x), 0.0), F.col("__w")).otherwise(0.0)) for x in heights]).alias("__below"))
    return sums.where("__all > 0").select(*keys, F.posexplode(F.arrays_zip(at.alias("height"), F.transform("__below", lambda b: b / F.col("__all")).alias("gap"))).alias("level", "__z")).select(*keys, "level", F.col("__z.height").alias("height"), F.col("__z.gap").alias("gap"))


def pavd_profile(points: DataFrame, keys: list[str], step: float = STEP, k: float = 0.5, least_ground: int = LEAST_GROUND) -> DataFrame:
    """Plant area and its density by layer for each group: layer, z, pai, pavd, canopy_height.

    Groups with fewer than ``least_ground`` ground returns, or without vegetation
    above ground, have no profile.
    """
    cls = F.col("Classification")
    h = F.when(cls == BARE_GROUND, F.lit(0.0)).otherwise(F.col("HeightAboveGround"))
    used = points.where(cls.isin(BARE_GROUND, *VEGETATION)).select(*keys, (cls == BARE_GROUND).alias("__g"), h.alias("__h")).where("__h is not null and not isnan(__h)")
    # returns of one height are one row before anything is shuffled; one shuffle by group then serves its totals, its counts by layer and their running sum
    heights = used.groupBy(*keys, "__g", "__h").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys)
    totals = {"n": F.sum("__n"), "n_ground": F.sum(F.when(F.col("__g"), F.col("__n")).otherwise(0)), "canopy_height": F.percentile(F.when(~F.col("__g") & (F.col("__h") > 0), F.col("__h")), 0.98, F.col("__n"))}
    good = heights.repartition(*keys).select("*", *[c.over(group).alias(name) for name, c in totals.items()]).where((F.col("n_ground") >= least_ground) & (F.col("canopy_height") > 0))
    # returns by the first edge at or above them; a running sum of the counts is the gap
    edge = F.greatest(F.ceil(F.col("__h") / step), F.lit(0)).cast("int")
    edge = F.when((edge - 1) * step >= F.col("__h"), F.greatest(edge - 1, F.lit(0))).when(edge * step < F.col("__h"), edge + 1).otherwise(edge)
    counts = good.groupBy(*keys, *totals, edge.alias("layer")).agg(F.sum("__n").alias("c"))
    layers = F.greatest(F.ceil(F.col("canopy_height") / step), F.lit(1)).cast("int")
    bins = counts.groupBy(*keys, *totals).agg(F.map_from_entries(F.collect_list(F.struct("layer", "c"))).alias("__c"))
    edges = bins.select(*keys, *totals, "__c", F.explode(F.sequence(F.lit(0), layers)).alias("layer"))
    w = Window.partitionBy(*keys).orderBy("layer")
    full = edges.withColumn("below", F.sum(F.coalesce(F.col("__c")[F.col("layer")], F.lit(0))).over(w))
    gap = F.greatest(F.col("below") / F.col("n"), 1.0 / F.col("n"))
    full = full.withColumn("z", F.col("layer") * step).withColumn("pai", plant_area(F.least(gap, F.lit(1.0)), k))
    pavd = (F.col("pai") - F.lead("pai").over(w)) / (F.lead("z").over(w) - F.col("z"))
    return full.select(*keys, "layer", "z", "pai", pavd.alias("pavd"), "canopy_height", F.col("n").alias("n_points"), "n_ground")


def waveform_histogram(returns: DataFrame, keys: list[str], step: float = STEP, weight: Column | None = None) -> DataFrame:
    """Weighted returns by height bin from each group's lowest Z: bin, energy; the top edge is in the last bin."""
    group = Window.partitionBy(*keys)
    rows = returns.select(*keys, "Z", (F.lit(1.0) if weight is None else weight).alias("__w")).repartition(*keys)
    rows = rows.withColumn("z_min", F.min("Z").over(group)).withColumn("bins", F.greatest(F.ceil((F.max("Z").over(group) - F.col("z_min")) / step), F.lit(1)).cast("int"))
    at = F.least(F.floor((F.col("Z") - F.col("z_min")) / step), F.col("bins") - 1).cast("int")
    return rows.groupBy(*keys, at.alias("bin")).agg(F.sum("__w").alias("energy"), F.first("z_min").alias("z_min"))


def disc_histogram(centres: DataFrame, points: DataFrame, keys: list[str], radius: float, step: float, energies: dict[str, Column], x: str = "cx", y: str = "cy") -> DataFrame:
    """The bins of :func:`waveform_histogram` over the disc around each centre: keys, bin, ``energies``, z_min.

    Each centre first learns its lowest and highest Z, then meets the points
    again to count them: pairs of a centre and a point are only ever summed where
    they are met, never shuffled.
    """
    own = list(dict.fromkeys([*keys, x, y]))
    ends = disc_join(centres.select(*own), points.select("X", "Y", "Z"), radius, x, y).groupBy(*own).agg(F.min("Z").alias("z_min"), F.max("Z").alias("__top"))
    bins = F.greatest(F.ceil((F.col("__top") - F.col("z_min")) / step), F.lit(1))
    found = disc_join(ends.withColumn("__bins", bins), points.select("X", "Y", "Z", *[c.alias(name) for name, c in energies.items()]), radius, x, y)
    at = F.least(F.floor((F.col("Z") - F.col("z_min")) / step), F.col("__bins") - 1).cast("int")
    return found.groupBy(*keys, "z_min", at.alias("bin")).agg(*[F.sum(name).alias(name) for name in energies])


def relative_heights(histogram: DataFrame, keys: list[str], levels: list[int], step: float = STEP, ground: str = "z_ground") -> DataFrame:
    """For each level the centre of the first bin where that share of the energy is reached, above ``ground``."""
    w = Window.partitionBy(*keys)
    running = F.sum("energy").over(w.orderBy("bin"))
    run = histogram.withColumn("__share", running / F.sum("energy").over(w)).withColumn("__z", F.col("z_min") + (F.col("bin") + 0.5) * step)
    rows = run.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    reached = F.when(F.col("level") == 0, F.col("energy") > 0).otherwise(F.col("__share") >= F.col("level") / 100.0 - 1e-12)
    return rows.where(reached).groupBy(*keys, "level").agg(F.min("__z").alias("__z"), F.first(ground).alias("__g")).select(*keys, "level", (F.col("__z") - F.col("__g")).alias("rh"))


def waveform_cover(histogram: DataFrame, keys: list[str], step: float = STEP, threshold: float = 2.0, ratio: float = 1.0, ground: str = "z_ground") -> DataFrame:
    """Canopy cover: vegetation energy over itself and ``ratio`` times the ground energy."""
    z = F.col("z_min") + (F.col("bin") + 0.5) * step
    sums = histogram.groupBy(*keys).agg(F.sum(F.when(z >= F.col(ground) + threshold, F.col("energy")).otherwise(0.0)).alias("__v"), F.sum("energy").alias("__t"))
    whole = F.col("__v") + ratio * (F.col("__t") - F.col("__v"))
    return sums.select(*keys, F.when(whole > 0, F.col("__v") / whole).otherwise(0.0).alias("cover"))


def gap_from_waveform(bins: DataFrame, keys: list[str], ratio: float = 1.0) -> DataFrame:
    """Gap at bin centres from canopy and ground energy: one minus the canopy share above."""
    w = Window.partitionBy(*keys)
    above = F.sum("canopy").over(w.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)) - F.col("canopy") / 2
    whole = F.sum("canopy").over(w) + ratio * F.sum("ground").over(w)
    return bins.select(*keys, "bin", F.when(whole > 0, 1.0 - above / whole).alias("gap"))


def rebin(bins: DataFrame, keys: list[str], energies: list[str], edges: list[float], step: float, z: str = "z", ground: str = "z_ground") -> DataFrame:
    """Waveforms on bins of height above ground: keys, bin, low, high and the energies, for every bin of every waveform.

    ``z`` is the centre of a bin ``step`` high; its energy goes to the new bins
    by the share of its height that they hold, and is lost outside the edges.
    """
    low = F.col(z) - step / 2 - F.col(ground)
    new = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    rows = bins.select(*keys, *energies, low.alias("__low"), F.explode_outer(F.filter(new, lambda t: (t["low"] < low + step) & (t["high"] > low))).alias("__t"))
    held = (F.least(F.col("__low") + step, F.col("__t.high")) - F.greatest(F.col("__low"), F.col("__t.low"))) / step
    sums = rows.groupBy(*keys, F.coalesce(F.col("__t.bin"), F.lit(-1)).alias("__bin")).agg(*[F.sum(F.col(e) * held).alias(e) for e in energies])
    # as many entries as there are edges
    whole = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__bin", F.struct(*energies)))).alias("__m")).select(*keys, "__m", F.explode(new).alias("__t"))
    return whole.select(*keys, "__t.*", *[F.coalesce(F.col("__m")[F.col("__t.bin")][e], F.lit(0.0)).alias(e) for e in energies])


def footprint_profiles(bins: DataFrame, keys: list[str], edges: list[float], step: float, ratio: float = 1.0, threshold: float = 1e-3) -> DataFrame:
    """Canopy, ground and gap by height of each waveform (z, z_ground, canopy, ground), and its ``signal_top``.

    The signal top is the upper edge of the highest bin with more than
    ``threshold`` of the energy at or above it; from there up the gap is null,
    and ``signal_height``, the bin's centre below it, too.
    """
    group = Window.partitionBy(*keys)
    totals = bins.select(*keys, "z", "z_ground", "canopy", "ground", F.sum("canopy").over(group).alias("__rv"), F.sum("ground").over(group).alias("__rg"))
    out = rebin(totals, [*keys, "__rv", "__rg"], ["canopy", "ground"], edges, step)
    above = F.sum("canopy").over(group.orderBy(F.col("bin").desc()))
    out = out.withColumn("__above", above).withColumn("__all", F.sum(F.col("canopy") + F.col("ground")).over(group))
    top = F.max(F.when(F.col("__above") > threshold * F.col("__all"), F.col("high"))).over(group)
    out = out.withColumn("signal_top", F.coalesce(top, F.lit(float(edges[0]))))
    whole = F.col("__rv") + ratio * F.col("__rg")
    gap = F.when((whole > 0) & (F.col("low") < F.col("signal_top")), 1.0 - (F.col("__above") - F.col("canopy") / 2) / whole)
    centre = F.when(F.col("low") < F.col("signal_top"), (F.col("low") + F.col("high")) / 2)
    return out.select(*keys, "bin", "low", "high", "canopy", "ground", gap.alias("gap"), centre.alias("signal_height"), "signal_top")


def plant_area_above(levels: DataFrame, keys: list[str], value: str = "pavd", step: float = 1.0) -> DataFrame:
    """Plant area strictly above each level."""
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(1, Window.unboundedFollowing)
    return levels.withColumn("above", F.coalesce(F.sum(F.col(value) * step).over(w), F.lit(0.0)))


def voxel_density(points: DataFrame, voxel: float, extinction: float = 0.5, ground: int = BARE_GROUND) -> DataFrame:
    """Plant area density of voxels: returns that stop in one against those that get to it from above.

    All returns below a voxel in its column, and the ground, have passed it.
    """
    cells = points.where(F.col("Classification").isin(ground, *VEGETATION)).withColumn("kx", F.floor(F.col("X") / voxel)).withColumn("ky", F.floor(F.col("Y") / voxel))
    height = F.when(F.col("Classification") == ground, F.lit(-1)).otherwise(F.greatest(F.floor(F.col("HeightAboveGround") / voxel), F.lit(0))).cast("int")
    counts = cells.groupBy("kx", "ky", height.alias("kz")).agg(F.count("*").alias("veg"))
    w = Window.partitionBy("kx", "ky").orderBy("kz").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("veg").over(w), F.lit(0))
    pad = -F.log((F.col("below") + 0.5) / (F.col("below") + F.col("veg") + 0.5)) / (extinction * voxel)
    return counts.withColumn("below", below).where("kz >= 0").select("kx", "ky", "kz", "veg", "below", pad.alias("pad"))


def attenuation_levels(profiles: DataFrame, value: str = "pavd", keys: tuple[str, ...] = ()) -> DataFrame:
    """Median of each level over all shots (of each block), and the running sum of the medians from the top: level, median, n, cumulative."""
    med = profiles.groupBy(*keys, "level").agg(F.median(value).alias("median"), F.count(value).alias("n"))
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.col("level").desc())  # at most as many rows as levels
    return med.withColumn("cumulative", F.sum("median").over(w))


def matched_gaps(shots: DataFrame, points: DataFrame, key: str, heights: list[float], beam_sigma: float, density_cell: float, radius: float) -> DataFrame:
    """Gap profiles of footprints with the beam and density weights: ``key``, level, height, first, all_returns."""
    return at_places(shots.select(key, "center_x", "center_y"), "center_x", "center_y", lambda places: _matched_gaps(places, points, ["center_x", "center_y"], heights, beam_sigma, density_cell, radius)).drop("center_x", "center_y")


def _matched_gaps(shots: DataFrame, points: DataFrame, keys: list[str], heights: list[float], beam_sigma: float, density_cell: float, radius: float) -> DataFrame:
    first = points.where("ReturnNumber = 1").groupBy(F.floor(F.col("X") / density_cell).alias("__dx"), F.floor(F.col("Y") / density_cell).alias("__dy")).agg(F.count("*").alias("__pulses"))
    used = points.withColumn("__dx", F.floor(F.col("X") / density_cell)).withColumn("__dy", F.floor(F.col("Y") / density_cell)).join(first, ["__dx", "__dy"], "left")
    found = disc_join(shots, used, radius, "center_x", "center_y")
    weight = F.when(F.col("__pulses") > 0, F.exp(-F.col("distance2") / (2.0 * beam_sigma**2)) / F.col("__pulses")).otherwise(0.0)
    found = found.withColumn("__beam", weight)
    a = gap_from_returns(found.where("ReturnNumber = 1"), keys, heights, F.col("__beam")).withColumnRenamed("gap", "first")
    b = gap_from_returns(found, keys, heights, F.col("__beam") / F.greatest(F.col("NumberOfReturns"), F.lit(1))).withColumnRenamed("gap", "all_returns")
    return a.join(b.drop("height"), [*keys, "level"], "full")
