"""Products by name: each is a query over a point table that can go to a raster store with its provenance."""

from __future__ import annotations

import importlib.metadata
import math
import platform
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.columns import lai
from arbora.functions.lineage import written
from arbora.grid import BalancedGrid, Grid
from arbora.operators import filters, metrics, surfaces, terrain
from arbora.operators.change import change
from arbora.operators.joins import disc_join
from arbora.operators.profiles import pavd_profile
from arbora.sources.catalog import RasterStore

TILE, BUFFER = 500.0, 50.0
#: Points over which a tile is cut in quarters before kernels run on it.
LIMIT = 500_000


def even(grid: Grid, points: DataFrame, tile: float) -> Grid:
    """The lattice with tiles of no more than ``LIMIT`` points each."""
    return grid if isinstance(grid, BalancedGrid) else grid.balanced(points, tile, LIMIT)


def of_year(points: DataFrame, year: int | None) -> DataFrame:
    """The survey's points; a year must be named."""
    if year is None:
        raise ValueError("name the survey year")
    return points.where(F.col("Year") == year)


def normalised(points: DataFrame, grid: Grid, year: int, tile: float = TILE, buffer: float = BUFFER, outliers: bool = True) -> DataFrame:
    """Clean points of the year with heights above ground; low ground outliers are dropped first."""
    p = _for_heights(points, year, outliers)
    return terrain.normalise(p, even(grid, p, tile), tile, buffer)


def _for_heights(points: DataFrame, year: int, outliers: bool = True) -> DataFrame:
    p = filters.clean(of_year(points, year))
    return filters.clean(filters.drop_ground_outliers(p)) if outliers else p


def compute_dtm(points: DataFrame, grid: Grid, year: int, method: str = "tin", tile: float = TILE, buffer: float = 10.0) -> DataFrame:
    p = filters.clean(of_year(points, year), drop_noise=False)
    return surfaces.dtm_min(p, grid) if method == "min" else terrain.dtm(p, even(grid, p, tile) if method == "tin" else grid, tile, buffer, method)


def compute_dsm(points: DataFrame, grid: Grid, year: int, first_only: bool = True) -> DataFrame:
    return surfaces.dsm(filters.clean(of_year(points, year), drop_noise=False), grid, first_only)


def compute_chm(points: DataFrame, grid: Grid, year: int, method: str = "max", tile: float = TILE, buffer: float = BUFFER, fill: bool = False, max_height: float | None = None) -> DataFrame:
    """Canopy height by method: max, tin, pitfree or spikefree; ``max`` carries quality flags."""
    grid = even(grid, of_year(points, year), tile)
    if method == "max":
        heights, base = terrain.heights_and_terrain(_for_heights(points, year), grid, tile, buffer)
        out = surfaces.chm_from_heights(heights, grid, base, max_height=max_height)
        return surfaces.fill_pits(out, grid) if fill else out
    heights = normalised(points, grid, year, tile, buffer)
    if method == "tin":
        out = surfaces.chm_layers(heights, grid, tile, buffer, (0.0,))
    elif method == "pitfree":
        out = surfaces.chm_layers(heights, grid, tile, buffer)
    elif method == "spikefree":
        out = surfaces.spike_free(heights, grid, tile, buffer)
    else:
        raise ValueError(f"unknown method {method!r}")
    return surfaces.fill_pits(out, grid) if fill else out


def compute_all(points: DataFrame, grid: Grid, year: int, tile: float = TILE, buffer: float = BUFFER, max_height: float | None = None) -> dict[str, DataFrame]:
    """``dtm``, ``dsm`` and ``chm`` (largest height, with quality flags) of one survey.

    Ground, without its low outliers, is triangulated once for points and pixels.
    """
    grid = even(grid, of_year(points, year), tile)
    heights, base = terrain.heights_and_terrain(_for_heights(points, year), grid, tile, buffer)
    heights, base = written(heights), written(base)
    return {"dtm": base, "dsm": compute_dsm(points, grid, year), "chm": surfaces.chm_from_heights(heights, grid, base, max_height=max_height)}


def compute_metrics(points: DataFrame, grid: Grid, year: int, wanted: tuple[str, ...] = metrics.METRICS, min_density: float = 0.0, radius: float | None = None, tile: float = TILE, buffer: float = BUFFER) -> DataFrame:
    """Structural metrics of each pixel, or of the disc around its centre."""
    heights = normalised(points, grid, year, tile, buffer)
    if radius is None:
        return metrics.cell_metrics(heights, grid, wanted, min_density)
    centres = grid.cells(points.sparkSession).select("row", "col", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return metrics.disc_metrics(centres, heights, ["row", "col"], radius, wanted, min_density)


def plot_heights(plots: DataFrame, points: DataFrame, key: str | list[str], radius: float, margin: float = 20.0, x: str = "px", y: str = "py", outliers: bool = True, max_distance: float | None = None, extrapolate: bool = True) -> DataFrame:
    """The points within ``radius`` of each plot, with heights above the plot's own terrain.

    The terrain is triangulated from the ground within ``radius + margin`` along
    both axes, cleaned as for a tile of ``compute_metrics``. ``key`` is one column
    or several; plots on one place cost less as one, by their ``x`` and ``y``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    p = filters.clean(points)
    if outliers:
        p = filters.clean(filters.drop_ground_outliers(p))
    centres, reach = plots.select(*dict.fromkeys([*keys, x, y])), radius + margin
    around = disc_join(centres, filters.merged_ground(p).select("X", "Y", "Z"), reach * 2**0.5, x, y)
    base = written(around.where((F.abs(F.col("X") - F.col(x)) <= reach) & (F.abs(F.col("Y") - F.col(y)) <= reach)).select(*keys, "X", "Y", "Z"))
    inside = written(disc_join(centres, p.drop("HeightAboveGround"), radius, x, y))
    places = inside.select(*keys, "X", "Y").distinct().withColumn("id", F.struct("X", "Y"))
    found = terrain.evaluate(places, base, keys, max_distance, extrapolate).select(*keys, "X", "Y", F.col("ground").alias("__g"))
    height = F.col("Z") - F.col("__g")
    return inside.join(found, [*keys, "X", "Y"], "left").withColumn("HeightAboveGround", F.when(height.isNotNull(), F.greatest(height, F.lit(0.0)))).drop("__g")


def compute_plot_metrics(plots: DataFrame, points: DataFrame, key: str, radius: float, wanted: tuple[str, ...] = metrics.METRICS, x: str = "px", y: str = "py", **how) -> DataFrame:
    """The wanted metrics of each plot from raw points, and ``n_points``; plots without points or ground stay, with nulls."""
    place = [x, y]
    heights = written(plot_heights(plots.select(*place).distinct(), points, place, radius, x=x, y=y, **how).withColumn("__h", F.col("HeightAboveGround").isNotNull()))
    out = metrics.structure(heights.where("__h"), place, math.pi * radius**2, wanted)
    counts = heights.where("__h").groupBy(*place).agg(F.count("*").alias("n_points"))
    return plots.select(key, *place).join(out, place, "left").join(counts, place, "left").select(key, *wanted, F.coalesce("n_points", F.lit(0)).alias("n_points"))


def compute_gap_fraction(points: DataFrame, grid: Grid, year: int, k: float = 0.5, clumping: float = 1.0, min_density: float = 0.0) -> DataFrame:
    out = metrics.gap_fraction(filters.clean(of_year(points, year)), grid, min_density)
    return out.withColumn("lai", lai(F.col("gap"), k, clumping))


def compute_biomass(points: DataFrame, grid: Grid, year: int, model: Column, required: tuple[str, ...], tile: float = TILE, buffer: float = BUFFER) -> DataFrame:
    """``model`` over the metrics it requires: row, col, value."""
    return compute_metrics(points, grid, year, required, tile=tile, buffer=buffer).select("row", "col", model.alias("value"))


GAP = ("gap", "lai", "gap_n_first", "gap_saturated")


def software() -> dict[str, str]:
    """Versions that go with a product's provenance."""
    return {"python": platform.python_version(), **{m: importlib.metadata.version(m) for m in ("pyspark", "numpy", "pandas", "pyarrow")}}


def has_survey(points: DataFrame, grid: Grid, year: int) -> bool:
    """Whether the survey has points in the lattice's box; a year that no point has is an error."""
    if points.where(F.col("Year") == year).isEmpty():
        known = [r["Year"] for r in points.select("Year").distinct().orderBy("Year").collect()]
        raise ValueError(f"no points of {year}; there are {known}")
    return not of_year(points, year).where(grid.owned()).isEmpty()


def area_columns(heights: DataFrame, grid: Grid, wanted: tuple[str, ...], gap: bool, k: float = 0.5, clumping: float = 1.0, min_density: float = 0.0) -> DataFrame:
    """Metrics, gap and leaf area of each pixel by one aggregate over points with heights."""
    out = metrics.cell_metrics(heights, grid, wanted, min_density, metrics.gap_sums() if gap else ())
    if not gap:
        return out
    out = out.withColumns(metrics.gap_columns(grid.resolution**2, min_density))
    return out.withColumn("lai", lai(F.col("gap"), k, clumping)).select("row", "col", *wanted, *GAP)


def compute_area_products(points: DataFrame, grid: Grid, year: int, wanted: tuple[str, ...] = metrics.METRICS, models: Mapping[str, Column] | None = None, gap: bool = True, tile: float = TILE, buffer: float = BUFFER,
                          chm: bool = False, store: RasterStore | None = None, features: Mapping[str, tuple[str, ...]] | None = None, settings: Mapping | None = None,
                          revision: Callable[[], str] | None = None, overwrite: bool = False) -> DataFrame:
    """Metrics, gap, leaf area, biomass and canopy height of each pixel from one normalisation and one aggregate.

    With a ``store`` each variable is a run with its provenance (``settings``,
    tiles, software and ``revision`` of the points, such as a table's). What is
    complete under the same settings isn't worked out again: a model whose
    ``features`` (metrics by model, ``wanted`` if not given) are stored takes
    them from there, and if nothing is open the points aren't read. All open
    variables are written by one job. A revision that changes meanwhile is an
    error, and the runs stay failed. Other settings than those of a complete run
    are an error unless ``overwrite``. Gives row, col and a column for each
    variable.
    """
    models = dict(models or {})
    need = {name: tuple((features or {}).get(name, wanted)) for name in models}
    unknown = {m for names in (wanted, *need.values()) for m in names} - set(metrics.METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    asked = [*wanted, *(GAP if gap else ()), *models, *(("chm",) if chm else ())]
    if store is None:
        every = tuple(dict.fromkeys([*wanted, *(m for names in need.values() for m in names)]))
        return _area(points, grid, year, every, models, gap, chm, tile, buffer, None).select("row", "col", *asked)
    before = revision() if revision else ""
    common = {"year": year, "resolution": grid.resolution, "tile": tile, "buffer": buffer, "software": software(), "revision": before, **(settings or {})}
    runs = {v: {"variable": v, **common, **({"features": list(need[v]), "model": str(models[v])} if v in models else {})} for v in asked}
    store.ensure_grid(grid)
    todo = [v for v in asked if store.check_run(v, grid.resolution, year, runs[v], overwrite)]
    if todo:
        lacking = {m for v in todo if v in models for m in need[v] if m not in wanted or m in todo}
        metric = tuple(m for m in metrics.METRICS if m in todo or m in lacking)
        stored = sorted({m for v in todo if v in models for m in need[v]} - set(metric))
        some_gap = any(v in todo for v in GAP)
        reads_points = bool(metric) or some_gap or "chm" in todo
        for v in todo:
            store.mark_run(v, grid.resolution, year, "running", runs[v])
        try:
            known = store.to_wide(grid, stored, year).select("row", "col", *stored) if stored else None
            open_models = {v: m for v, m in models.items() if v in todo}
            if reads_points:
                out = _area(points, grid, year, metric, open_models, some_gap, "chm" in todo, tile, buffer, known)
            else:
                out = known.withColumns(open_models)
            store.write_wide(out, todo, grid.resolution, year)
            if revision and revision() != before:
                raise RuntimeError("the points changed while products were made")
        except Exception:
            for v in todo:
                store.mark_run(v, grid.resolution, year, "failed", runs[v])
            raise
        for v in todo:
            store.mark_run(v, grid.resolution, year, "complete", runs[v])
    return store.to_wide(grid, asked, year).select("row", "col", *asked)


def _area(points: DataFrame, grid: Grid, year: int, metric: tuple[str, ...], models: Mapping[str, Column], gap: bool, chm: bool, tile: float, buffer: float, known: DataFrame | None) -> DataFrame:
    """The open variables; ``known`` holds stored metrics by row and col."""
    if chm:
        p = _for_heights(points, year)
        heights, base = terrain.heights_and_terrain(p, even(grid, p, tile), tile, buffer)
        heights = written(heights)
    else:
        heights = normalised(points, grid, year, tile, buffer)
    out = area_columns(heights, grid, metric, gap)
    if known is not None:
        out = out.join(known, ["row", "col"], "left")
    out = out.withColumns(dict(models)) if models else out
    if chm:
        top = surfaces.chm_from_heights(heights, grid, base).select("row", "col", F.col("value").alias("chm"))
        out = out.join(top, ["row", "col"], "full")
    return out


def compute_change(store: RasterStore, variable: str, resolution: float, year_from: int, year_to: int, min_delta: float = 0.0, least_base: float = 0.0) -> DataFrame:
    return change(store.read(variable, resolution), year_from, year_to, min_delta, least_base)


def compute_profiles(points: DataFrame, shots: DataFrame, radius: float, year: int, grid: Grid, key: str = "shot_id", tile: float = TILE, buffer: float = BUFFER, step: float = 0.15) -> DataFrame:
    """Plant area profiles of footprints."""
    heights = terrain.normalise(filters.clean(of_year(points, year)), grid, tile, buffer)
    found = disc_join(shots.select(key, "center_x", "center_y"), heights.select("X", "Y", "HeightAboveGround", "Classification"), radius, "center_x", "center_y")
    return pavd_profile(found, [key], step)


def store_product(store: RasterStore, raster: DataFrame, variable: str, grid: Grid, year: int, settings: Mapping, overwrite: bool = False) -> bool:
    """Writes ``value`` of a product unless it is complete under the same settings."""
    return store.run(raster, variable, grid, year, {"variable": variable, "resolution": grid.resolution, "year": year, **settings}, overwrite)
