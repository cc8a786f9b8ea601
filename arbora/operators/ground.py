"""Ground classification by tile: morphological filters, cloth, progressive triangulation and its tilted votes.

Each method is a small function of one tile's points, run by groups; tiles come
with a halo and only their own points are kept. The ensemble spreads its runs
over tasks too: a point is ground if enough tilted runs say so.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.columns import tilt
from arbora.functions.lineage import written
from arbora.grid import Grid
from arbora.operators import terrain
from arbora.operators.envelope import ground_under
from arbora.operators.filters import low_outliers, radius_outliers, vegetation_by_height
from arbora.operators.spikes import without_spikes
from arbora.operators.terrain import Mesh, delaunay, held_by_boxes
from arbora.schema import NOISE

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Raster:
    """A classifier that looks at points only through the lowest height of each cell.

    ``work`` makes layers of that grid, and ``test`` says by the layers' values
    at a point's cell whether its height is ground's; heights are arrays or columns.
    """

    def __init__(self, cell: float, work: Callable[[np.ndarray], list[np.ndarray]], test: Callable):
        self.cell, self.work, self.test = cell, work, test

    def layers(self, r: np.ndarray, c: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """The layers at the occupied cells, from their lowest heights; holes take their nearest rows' values."""
        grid = np.full((r.max() + 1, c.max() + 1), np.inf)
        grid[r, c] = low
        while np.isinf(grid).any():
            grid = np.where(np.isinf(grid), _window(grid, 1, np.minimum), grid)
        return [layer[r, c] for layer in self.work(grid)]

    def __call__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        r, c = (((v - v.min()) // self.cell).astype(int) for v in (y, x))
        cells, at = np.unique(np.stack([r, c], axis=1), axis=0, return_inverse=True)
        low = np.full(len(cells), np.inf)
        np.minimum.at(low, at.ravel(), z)
        return self.test(z, [layer[at.ravel()] for layer in self.layers(*cells.T, low)])


def _within(d, limit):
    return (d <= limit) & (d >= -limit)


def _window(a: np.ndarray, half: int, pick) -> np.ndarray:
    """Smallest or largest value of the square window around each cell."""
    for axis in (0, 1):
        p = np.pad(a, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = np.take(p, range(a.shape[axis]), axis=axis)
        for k in range(1, 2 * half + 1):
            a = pick(a, np.take(p, range(k, k + a.shape[axis]), axis=axis))
    return a


def _opened(a: np.ndarray, half: int) -> np.ndarray:
    return _window(_window(a, half, np.minimum), half, np.maximum)


def pmf(cell: float = 1.0, max_window: int = 33, slope: float = 1.0, initial: float = 0.15, limit: float = 2.5) -> Kernel:
    """Progressive morphological filter (Zhang et al., 2003)."""

    halves, half = [], 1
    while 2 * half + 1 <= max_window:
        halves.append(half)
        half *= 2
    rises = [initial if k == 0 else min(limit, slope * 2 * (halves[k] - halves[k - 1]) * cell + initial) for k in range(len(halves))]

    def work(surface):
        out = []
        for half in halves:
            surface = _opened(surface, half)
            out.append(surface)
        return out

    return Raster(cell, work, lambda z, v: functools.reduce(operator.and_, [z - opened <= rise for opened, rise in zip(v, rises, strict=False)], z == z))


def smrf(cell: float = 1.0, slope: float = 0.15, window: float = 18.0, threshold: float = 0.5, scalar: float = 1.25) -> Kernel:
    """Simple morphological filter (Pingel et al., 2013): open by growing windows, then test points against the surface."""

    def work(low):
        surface, high = low, np.zeros(low.shape, bool)
        for half in range(1, math.ceil(window / cell) + 1):
            opened = _opened(surface, half)
            high |= surface - opened > slope * half * cell
            surface = opened
        surface = np.where(high, np.inf, low)
        if np.isinf(surface).all():
            return [np.full(low.shape, np.nan)] * 2
        while np.isinf(surface).any():
            p = np.pad(surface, 1, constant_values=np.inf)
            near = np.stack([p[i : i + surface.shape[0], j : j + surface.shape[1]] for i in range(3) for j in range(3)])
            some = np.isfinite(near)
            mean = np.where(some, near, 0).sum(axis=0) / np.maximum(some.sum(axis=0), 1)
            surface = np.where(np.isinf(surface) & some.any(axis=0), mean, surface)
        gy, gx = np.gradient(surface) if min(surface.shape) > 1 else (np.zeros_like(surface),) * 2
        return [surface, np.hypot(gx, gy) / cell]

    return Raster(cell, work, lambda z, v: _within(z - v[0], threshold + scalar * v[1]))


def csf(resolution: float = 0.5, threshold: float = 0.5, rigidness: int = 1, steps: int = 500, time_step: float = 0.65) -> Kernel:
    """Cloth simulation (Zhang et al., 2016): a cloth falls on the upturned points and stays above them."""

    def work(low):
        roof = -low
        cloth, before = np.full(roof.shape, roof.max() + 1.0), np.full(roof.shape, roof.max() + 1.0)
        free = np.ones(roof.shape, bool)
        for _ in range(steps):
            moved = np.where(free, cloth + 0.99 * (cloth - before) - 0.2 * time_step**2, cloth)
            before, cloth = cloth, moved
            for _ in range(rigidness):
                for axis in (0, 1):
                    d = np.diff(cloth, axis=axis)
                    lead = [slice(None)] * 2
                    lag = [slice(None)] * 2
                    lead[axis], lag[axis] = slice(1, None), slice(None, -1)
                    a, b = free[tuple(lag)], free[tuple(lead)]
                    share = np.where(a & b, 0.25, 0.5)
                    cloth[tuple(lag)] += np.where(a, share * d, 0)
                    cloth[tuple(lead)] -= np.where(b, share * d, 0)
            hit = cloth <= roof
            cloth = np.where(hit, roof, cloth)
            free &= ~hit
            if np.abs(cloth - before).max() < 0.005:
                break
        return [-cloth]

    return Raster(resolution, work, lambda z, v: _within(v[0] - z, threshold))


def ptd(seed_cell: float = 10.0, angle: float = 45.0, distance: float = 1.0, spacing: float = 0.25, rounds: int = 50, spike_passes: int = 2) -> Kernel:
    """Progressive triangulation (Axelsson, 2000): seeds are the lowest of coarse cells on two shifted grids; points near
    a facet, by distance and by the angle to its corners, join until hardly any does. Then those off the plane of their
    neighbours leave, in ``spike_passes`` passes.
    """

    def run(x, y, z):
        order = np.lexsort((y, x, z))
        keys = np.stack([x[order] // spacing, y[order] // spacing], axis=1)
        few = order[np.sort(np.unique(keys, axis=0, return_index=True)[1])]  # the lowest of each fine cell
        ground = np.zeros(len(x), bool)
        for shift in (0.0, seed_cell / 2):
            k = np.stack([(x[few] + shift) // seed_cell, (y[few] + shift) // seed_cell], axis=1)
            ground[few[np.unique(k, axis=0, return_index=True)[1]]] = True
        mesh = Mesh(x, y)  # it grows by the points that join
        mesh.extend(x, y, np.flatnonzero(ground))
        for _ in range(rounds):
            free = few[~ground[few]]
            near = _facet_tests(x, y, z, mesh.triangles(), free, math.radians(angle), distance)
            if near.sum() < max(1, 0.0005 * len(few)):
                ground[free[near]] = True
                break
            ground[free[near]] = True
            mesh.extend(x, y, free[near])
        base = np.flatnonzero(ground)
        spike = np.zeros(len(x), bool)
        spike[base] = ~without_spikes(x[base], y[base], z[base], spike_passes, least=math.sqrt(3 * spacing))
        ground &= ~spike
        # all points close to the final surface belong to it
        base = np.flatnonzero(ground)
        rest = np.flatnonzero(~ground & ~spike)
        ground[rest[_facet_tests(x, y, z, base[delaunay(x[base], y[base])], rest, math.radians(angle), min(distance, spacing))]] = True
        return ground

    return run


def _facet_tests(x, y, z, facets, free, angle, distance) -> np.ndarray:
    """Which free points are within the distance and angle of the facet (a triple of points) over or under them."""
    out = np.zeros(len(free), bool)
    for q, tri in held_by_boxes(x, y, facets, x[free], y[free]):
        (a, b, c), p = facets[tri].T, free[q]
        det = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((x[p] - x[a]) * (y[c] - y[a]) - (y[p] - y[a]) * (x[c] - x[a])) / det
            v = ((x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a])) / det
            held = (det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
        a, b, c, p, q = a[held], b[held], c[held], p[held], q[held]
        n = np.cross(np.stack([x[b] - x[a], y[b] - y[a], z[b] - z[a]], axis=1), np.stack([x[c] - x[a], y[c] - y[a], z[c] - z[a]], axis=1))
        off = np.abs((x[p] - x[a]) * n[:, 0] + (y[p] - y[a]) * n[:, 1] + (z[p] - z[a]) * n[:, 2]) / np.linalg.norm(n, axis=1)
        reach = np.min([np.sqrt((x[p] - x[k]) ** 2 + (y[p] - y[k]) ** 2 + (z[p] - z[k]) ** 2) for k in (a, b, c)], axis=0)
        steep = np.arcsin(np.clip(off / np.maximum(reach, 1e-9), 0, 1))
        out[q[(off <= distance) & (steep <= angle)]] = True
    return out


METHODS: dict[str, Callable[..., Kernel]] = {"pmf": pmf, "smrf": smrf, "csf": csf, "ptd": ptd}


def classify(points: DataFrame, grid: Grid, tile_size: float, buffer: float, method: str = "smrf", key: str = "id", **parameters) -> DataFrame:
    """``key`` and ``is_ground`` of every point of the grid that isn't noise."""
    kernel = METHODS[method](**parameters)
    given = grid.halo(points.where("Classification not in (7, 18)").select(key, "X", "Y", "Z"), tile_size, buffer)
    if isinstance(kernel, Raster):
        return _by_raster(given, key, kernel)
    kind = points.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["X", "Y", "Z", key], ignore_index=True)
        found = kernel(*(p[c].to_numpy() for c in ("X", "Y", "Z")))
        return pd.DataFrame({key: p[key], "is_ground": found})[p["is_core"].to_numpy()]

    return terrain.apart(given, ["tile"]).groupBy("tile").applyInPandas(run, f"{key} {kind}, is_ground boolean")


def _by_raster(given: DataFrame, key: str, kernel: Raster) -> DataFrame:
    """A raster classifier on tiles with their halo: a task gets the lowest heights of a tile's cells, points meet its layers by cell."""
    corner = given.groupBy("tile").agg(F.min("X").alias("__x"), F.min("Y").alias("__y"))
    index = lambda v, low: F.floor((F.col(v) - F.col(low)) / kernel.cell).cast("int")
    placed = given.join(F.broadcast(corner), "tile").withColumns({"__r": index("Y", "__y"), "__c": index("X", "__x")})
    low = placed.groupBy("tile", "__r", "__c").agg(F.min("Z").alias("__low"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        layers = kernel.layers(*(pdf[c].to_numpy() for c in ("__r", "__c", "__low")))
        return pdf[["tile", "__r", "__c"]].assign(__v=list(np.stack(layers, axis=1)))

    kind = given.schema["tile"].dataType.simpleString()
    cells = terrain.apart(low, ["tile"]).groupBy("tile").applyInPandas(run, f"tile {kind}, __r int, __c int, __v array<double>")
    count = len(kernel.work(np.zeros((3, 3))))
    found = placed.where("is_core").join(cells, ["tile", "__r", "__c"])
    return found.select(key, F.coalesce(kernel.test(F.col("Z"), [F.col("__v")[k] for k in range(count)]), F.lit(False)).alias("is_ground"))


def with_noise(points: DataFrame, key: str = "id", radius: float = 1.0, least: int = 2) -> DataFrame:
    """``points`` with class 7 for low outliers of a cell and for points with fewer than ``least`` others within ``radius``."""
    noise = low_outliers(points.select(key, "X", "Y", "Z")).where("is_low").select(key).union(radius_outliers(points, key, radius, least)).distinct().withColumn("__noise", F.lit(True))
    return points.join(noise, key, "left").withColumn("Classification", F.when(F.col("__noise"), F.lit(7)).otherwise(F.col("Classification"))).drop("__noise")


def reclassify(points: DataFrame, grid: Grid, tile_size: float, buffer: float, key: str = "id", method: str = "smrf", denoise: bool = True, source: tuple[int, ...] = (1,), preserve: bool = True, bounds: tuple[float, float, float] = (0.5, 2.0, 5.0), **parameters) -> DataFrame:
    """``points`` of the grid with new classes: noise, ground by ``method`` (of ``CLASSIFIERS``), vegetation by height above it.

    With ``preserve`` only points of the ``source`` classes get a new one after
    noise is marked. A null class counts as none of them. ``key`` names a point.
    """
    own = written((with_noise(points, key) if denoise else points).withColumn("__given", F.col("Classification")))
    found = CLASSIFIERS[method](own, grid, tile_size, buffer, key=key, **parameters).select(key, "is_ground")
    marked = own.join(found, key, "left").withColumn("Classification", F.when(F.col("is_ground"), F.lit(2)).when(F.col("Classification").isin(*NOISE), F.col("Classification")).otherwise(F.lit(1))).drop("is_ground")
    heights = terrain.normalise(written(marked), grid, tile_size, buffer)
    out = vegetation_by_height(heights, bounds)
    if preserve:
        free = F.coalesce(F.col("__given").isin(*source), F.lit(False))
        out = out.withColumn("Classification", F.when(free, F.col("Classification")).otherwise(F.col("__given")))
    return out.select(*points.columns)


def classify_by_votes(points: DataFrame, grid: Grid, tile_size: float, buffer: float, runs: int = 8, angle: float = 10.0, votes: int = 3, key: str = "id", **parameters) -> DataFrame:
    """Progressive triangulation on the upright points and on tilted copies; ground has at least ``votes`` of the runs.

    Every tile and run is a group of its own. Tilting turns about the tile's middle.
    """
    kernel = ptd(**parameters)
    given = grid.halo(points.where("Classification not in (7, 18)").select(key, "X", "Y", "Z"), tile_size, buffer)
    middle = given.groupBy("tile").agg(F.avg("X").alias("mx"), F.avg("Y").alias("my"), F.avg("Z").alias("mz"))
    centred = given.join(F.broadcast(middle), "tile").select("tile", key, "is_core", (F.col("X") - F.col("mx")).alias("x"), (F.col("Y") - F.col("my")).alias("y"), (F.col("Z") - F.col("mz")).alias("z"))
    parts = []
    for k in range(runs):
        x, y, z = tilt(F.col("x"), F.col("y"), F.col("z"), angle if k else 0.0, 360.0 * (k - 1) / max(1, runs - 1))
        parts.append(F.struct(F.lit(k).alias("run"), x.alias("X"), y.alias("Y"), z.alias("Z")))
    spread = centred.select("tile", key, "is_core", F.inline(F.array(*parts)))
    kind = points.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["X", "Y", "Z", key], ignore_index=True)
        found = kernel(*(p[c].to_numpy() for c in ("X", "Y", "Z")))
        return pd.DataFrame({key: p[key], "vote": found.astype(int)})[p["is_core"].to_numpy()]

    told = terrain.apart(spread, ["tile", "run"]).groupBy("tile", "run").applyInPandas(run, f"{key} {kind}, vote int")
    return told.groupBy(key).agg((F.sum("vote") >= votes).alias("is_ground"), F.sum("vote").cast("int").alias("votes"))


def envelope(points: DataFrame, grid: Grid, tile_size: float, buffer: float, key: str = "id", **parameters) -> DataFrame:
    """A smooth lower surface fitted to last returns by reweighting, seeded by the voted triangulation.

    Where pulses have several returns the fit follows the lower side of the
    points, on bare ground their middle (see ``envelope.ground_under``, of which
    ``parameters`` are). ``points`` may have ReturnNumber and NumberOfReturns;
    without them all counts as vegetated last returns. Gives ``key`` and ``is_ground``.
    """
    seeds = classify_by_votes(points, grid, tile_size, buffer, key=key).select(key, F.col("is_ground").alias("seed"))
    known = {"ReturnNumber", "NumberOfReturns"} <= set(points.columns)
    last = F.coalesce(F.col("ReturnNumber") >= F.col("NumberOfReturns"), F.lit(True)) if known else F.lit(True)
    several = F.coalesce(F.col("NumberOfReturns") > 1, F.lit(False)) if known else F.lit(True)
    given = points.where("Classification not in (7, 18)").join(seeds, key, "left").select(key, "X", "Y", "Z", last.alias("last"), several.alias("several"), F.coalesce("seed", F.lit(False)).alias("seed"))
    kind = points.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["X", "Y", "Z", key], ignore_index=True)
        found = ground_under(*(p[c].to_numpy() for c in ("X", "Y", "Z", "last", "several", "seed")), **parameters)
        return pd.DataFrame({key: p[key], "is_ground": found})[p["is_core"].to_numpy()]

    return terrain.apart(grid.halo(given, tile_size, buffer), ["tile"]).groupBy("tile").applyInPandas(run, f"{key} {kind}, is_ground boolean")


#: Whole classifiers by name, each giving ``key`` and ``is_ground``.
CLASSIFIERS: dict[str, Callable[..., DataFrame]] = {
    **{name: functools.partial(classify, method=name) for name in METHODS},
    "votes": classify_by_votes,
    "envelope": envelope,
}
