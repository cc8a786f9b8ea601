"""Terrain from ground points: triangulation, heights above ground, slope.

A tile's ground (with a halo) meets the places asked about in one cogrouped
function: it is triangulated, and heights and slopes are read off in whole
arrays. Points outside take the nearest ground point, if wanted. Surfaces that
are built otherwise return triangles as rows, which meet points by an equi-join
on the cells that they touch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from arbora.functions.lineage import written
from arbora.grid import Grid
from arbora.operators.filters import merged_ground
from arbora.operators.joins import idw, nearest
from arbora.schema import GROUND

EDGE = 1e-10
TRIANGLE = "tri int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


class Mesh:
    """A Delaunay triangulation that grows by one vertex at a time.

    ``apex[u, v]`` is the third corner of the triangle on the left of u to v. The
    three last vertices are a frame far outside.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n = n = len(x)
        span = max(np.ptp(x), np.ptp(y), 1e-9)
        self.px = [*((x - x.mean()) / span).tolist(), -1e4, 1e4, 0.0]
        self.py = [*((y - y.mean()) / span).tolist(), -1e4, -1e4, 1e4]
        self.apex: dict[tuple[int, int], int] = {(n, n + 1): n + 2, (n + 1, n + 2): n, (n + 2, n): n + 1}
        self.at = (n, n + 1)

    def find(self, p: int, near: tuple[int, int] | None = None) -> tuple[int, int, int]:
        """The triangle that holds vertex p, by a walk from the edge ``near`` or the last change."""
        px, py, apex = self.px, self.py, self.apex
        a, b = near if near in apex else self.at
        c = apex[a, b]
        x, y = px[p], py[p]
        for _ in range(4 * self.n + 8):
            if (px[b] - px[a]) * (y - py[a]) - (py[b] - py[a]) * (x - px[a]) < 0:
                a, b = b, a
            elif (px[c] - px[b]) * (y - py[b]) - (py[c] - py[b]) * (x - px[b]) < 0:
                a, b = c, b
            elif (px[a] - px[c]) * (y - py[c]) - (py[a] - py[c]) * (x - px[c]) < 0:
                a, b = a, c
            else:
                break
            c = apex[a, b]
        return a, b, c

    def insert(self, p: int, held: tuple[int, int, int], locked: set[tuple[int, int]] = frozenset()) -> list[tuple[int, int]]:
        """Adds vertex p, which the triangle ``held`` holds; gives the edges that it forms triangles with.

        Edges in ``locked`` (both directions) stay, whatever circles they lie in.
        """
        px, py, apex = self.px, self.py, self.apex
        a, b, c = held
        hole, rim = [(a, b), (b, c), (c, a)], []
        for e in hole:
            del apex[e]
        while hole:
            u, v = hole.pop()
            w = apex.get((v, u)) if (u, v) not in locked else None
            if w is not None and _inside(px, py, u, v, w, p):
                del apex[v, u], apex[u, w], apex[w, v]
                hole += [(u, w), (w, v)]
            else:
                apex[u, v], apex[v, p], apex[p, u] = p, u, v
                rim.append((u, v))
        self.at = rim[-1]
        return rim

    def extend(self, x: np.ndarray, y: np.ndarray, vertices: np.ndarray) -> None:
        """Adds vertices along a snake, so that each lies near the one before."""
        if not len(vertices):
            return
        x, y = x[vertices], y[vertices]
        span = max(np.ptp(x), np.ptp(y), 1e-9)
        strips = max(1, int(math.sqrt(len(vertices) / 2)))
        strip = np.minimum(((x - x.min()) / span * strips).astype(int), strips)
        for p in vertices[np.lexsort((np.where(strip % 2, -y, y), strip))].tolist():
            self.insert(p, self.find(p))

    def triangles(self) -> np.ndarray:
        """Vertex triples without those at the frame."""
        out = [(a, b, c) for (a, b), c in self.apex.items() if a < b and a < c and max(b, c) < self.n]
        return np.array(sorted(out), int).reshape(-1, 3)


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vertex triples of the Delaunay triangulation of distinct points, by inserting them along a snake."""
    n = len(x)
    if n < 3:
        return np.zeros((0, 3), int)
    mesh = Mesh(x, y)
    mesh.extend(x, y, np.arange(n))
    return mesh.triangles()


def _inside(px: list[float], py: list[float], u: int, v: int, w: int, p: int) -> bool:
    """Whether p lies in the circle of the triangle (v, u, w), which is to the left of v to u."""
    ax, ay, bx, by, cx, cy = px[v] - px[p], py[v] - py[p], px[u] - px[p], py[u] - py[p], px[w] - px[p], py[w] - py[p]
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c - b * cy) - ay * (bx * c - b * cx) + a * (bx * cy - by * cx) > 1e-14 * max(a, b, c)


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by key to some partitions per core: groups are small in bytes but long to work on, so none waits behind another, and Spark, which would merge them, doesn't."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def triangles(points: DataFrame, keys: list[str], max_edge: float | None = None) -> DataFrame:
    """The triangulation of each group of points (X, Y, Z; positions distinct): keys and ``TRIANGLE``."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["X", "Y", "Z"], ignore_index=True)
        x, y, z = (p[c].to_numpy() for c in ("X", "Y", "Z"))
        t = delaunay(x, y)
        if max_edge is not None and len(t):
            sides = np.stack([np.hypot(x[t[:, i]] - x[t[:, j]], y[t[:, i]] - y[t[:, j]]) for i, j in ((0, 1), (1, 2), (2, 0))])
            t = t[sides.max(axis=0) <= max_edge]
        out = {k: [p[k].iloc[0]] * len(t) for k in keys} | {"tri": np.arange(len(t), dtype=np.int32)}
        for j, corner in enumerate("abc"):
            out |= {f"{corner}x": x[t[:, j]], f"{corner}y": y[t[:, j]], f"{corner}z": z[t[:, j]]}
        return pd.DataFrame(out)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + TRIANGLE
    return apart(points.select(*keys, "X", "Y", "Z"), keys).groupBy(*keys).applyInPandas(build, schema)


def _spread_triangles(tin: DataFrame, finest: float) -> DataFrame:
    """``tin`` with a row for each bucket cell that a triangle's box touches: ``__k`` (level) and ``__kx``, ``__ky``.

    A triangle's level follows from its own extent: its cells are from a half to
    a quarter as wide, so it touches few, dense ground has small cells and sparse
    ground large ones.
    """
    ends = {c: (F.least(*[F.col(f"{v}{c}") for v in "abc"]), F.greatest(*[F.col(f"{v}{c}") for v in "abc"])) for c in "xy"}
    extent = F.greatest(ends["x"][1] - ends["x"][0], ends["y"][1] - ends["y"][0])
    levelled = tin.withColumn("__k", F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / finest)), F.lit(0)).cast("int"))
    width = F.pow(F.lit(2.0), F.col("__k")) * (finest / 2)
    cells = lambda c: F.sequence(F.floor((ends[c][0] - EDGE) / width), F.floor((ends[c][1] + EDGE) / width))
    return levelled.withColumn("__kx", F.explode(cells("x"))).withColumn("__ky", F.explode(cells("y")))


def interpolate(queries: DataFrame, tin: DataFrame, keys: list[str], finest: float = 0.5) -> DataFrame:
    """``queries`` (keys, id, X, Y) with ``ground`` and ``slope`` (degrees) of the triangle that holds them, else null.

    Of several, as on a common edge, the first counts. Triangles and points meet
    by cells in levels; a query looks in the levels that triangles have.
    """
    spread = _spread_triangles(tin, finest)
    levels = spread.agg(F.collect_set("__k")).first()[0]  # a few numbers
    level = F.explode(F.array(*[F.lit(k) for k in sorted(levels)]) if levels else F.array().cast("array<int>"))
    width = F.pow(F.lit(2.0), F.col("__k")) * (finest / 2)
    keyed = queries.select(*keys, "id", "X", "Y", level.alias("__k")).withColumn("__kx", F.floor(F.col("X") / width)).withColumn("__ky", F.floor(F.col("Y") / width))
    e1x, e1y, e1z = (F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    e2x, e2y, e2z = (F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz")
    dx, dy = F.col("X") - F.col("ax"), F.col("Y") - F.col("ay")
    det = e1x * e2y - e1y * e2x
    u, v = (dx * e2y - dy * e2x) / F.nullif(det, F.lit(0.0)), (e1x * dy - e1y * dx) / F.nullif(det, F.lit(0.0))
    gx, gy = (e1z * e2y - e2z * e1y) / F.nullif(det, F.lit(0.0)), (e2z * e1x - e1z * e2x) / F.nullif(det, F.lit(0.0))
    held = keyed.join(spread, [*keys, "__k", "__kx", "__ky"]).withColumn("__u", u).withColumn("__v", v).where((F.col("__u") >= -EDGE) & (F.col("__v") >= -EDGE) & (F.col("__u") + F.col("__v") <= 1 + EDGE))
    z = F.col("az") + F.col("__u") * e1z + F.col("__v") * e2z
    first = held.groupBy(*keys, "id").agg(F.min_by(z, "tri").alias("ground"), F.min_by(F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), "tri").alias("slope"))
    return queries.join(first, [*keys, "id"], "left")


def held_by_boxes(x: np.ndarray, y: np.ndarray, t: np.ndarray, qx: np.ndarray, qy: np.ndarray, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a triangle that may hold it, among them all that do, some at a time.

    Triangles go to the cells that their boxes touch, on levels by their own
    extent, and queries look in the cells of each level.
    """
    if not len(t) or not len(qx):
        return
    ends = [(v[t].min(axis=1), v[t].max(axis=1)) for v in (x, y)]
    extent = np.maximum(ends[0][1] - ends[0][0], ends[1][1] - ends[1][0])
    level = np.ceil(np.log2(np.maximum(extent, 1e-9))).astype(int)
    level = np.maximum(level, np.quantile(level, 0.1).astype(int))
    x0, y0 = min(x.min(), qx.min()) - 1.0, min(y.min(), qy.min()) - 1.0
    for k in np.unique(level):
        width = 2.0**k / 2
        own = np.flatnonzero(level == k)
        low = [np.floor((e[0][own] - EDGE - o) / width).astype(np.int64) for e, o in zip(ends, (x0, y0), strict=True)]
        size = [np.floor((e[1][own] + EDGE - o) / width).astype(np.int64) - lo + 1 for e, o, lo in zip(ends, (x0, y0), low, strict=True)]
        count = size[0] * size[1]
        which = np.repeat(np.arange(len(own)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        tall = int(max((low[1] + size[1]).max(), (qy.max() - y0) // width)) + 2
        key = (low[0][which] + nth // size[1][which]) * tall + low[1][which] + nth % size[1][which]
        order = np.argsort(key, kind="stable")
        key, which = key[order], own[which[order]]
        mine = np.floor((qx - x0) / width).astype(np.int64) * tall + np.floor((qy - y0) / width).astype(np.int64)
        begin, n = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
        n = n - begin
        upto = np.cumsum(n)
        at = 0
        while at < len(qx):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
            q = np.repeat(np.arange(at, to), n[at:to])
            tri = which[np.repeat(begin[at:to] - np.cumsum(n[at:to]) + n[at:to], n[at:to]) + np.arange(len(q))]
            yield q, tri
            at = to


def located(x: np.ndarray, y: np.ndarray, z: np.ndarray, t: np.ndarray, qx: np.ndarray, qy: np.ndarray, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Height and slope (degrees) at each query, of the first triangle in ``t`` that holds it; NaN outside."""
    height, slope = np.full(len(qx), np.nan), np.full(len(qx), np.nan)
    first = np.full(len(qx), len(t))
    for q, tri in held_by_boxes(x, y, t, qx, qy, at_once):
        a, b, c = t[tri].T
        e1x, e1y, e2x, e2y, dx, dy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a], qx[q] - x[a], qy[q] - y[a]
        det = e1x * e2y - e1y * e2x
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (dx * e2y - dy * e2x) / det, (e1x * dy - e1y * dx) / det
            held = np.flatnonzero((u >= -EDGE) & (v >= -EDGE) & (u + v <= 1 + EDGE))
        held = held[np.lexsort((tri[held], q[held]))][::-1]  # of several the first is written last
        held = held[tri[held] < first[q[held]]]
        e1z, e2z = z[b[held]] - z[a[held]], z[c[held]] - z[a[held]]
        gx, gy = (e1z * e2y[held] - e2z * e1y[held]) / det[held], (e2z * e1x[held] - e1z * e2x[held]) / det[held]
        height[q[held]] = z[a[held]] + u[held] * e1z + v[held] * e2z
        slope[q[held]] = np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy)))
        first[q[held]] = tri[held]
    return height, slope


def by_group(queries: DataFrame, ground: DataFrame, keys: list[str]) -> DataFrame:
    """``queries`` with ``ground`` and ``slope`` over the triangulation of their group's ground: each group is triangulated once, where its queries are."""
    kinds = StructType([*queries.schema.fields, StructField("ground", DoubleType()), StructField("slope", DoubleType())])

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        base = base.sort_by([("gx", "ascending"), ("gy", "ascending"), ("gz", "ascending")])
        x, y, z = (base.column(c).to_numpy() for c in ("gx", "gy", "gz"))
        height, slope = located(x, y, z, delaunay(x, y), *(asked.column(c).to_numpy() for c in ("X", "Y")))
        return asked.append_column("ground", pa.array(height, from_pandas=True)).append_column("slope", pa.array(slope, from_pandas=True))

    # names of its own, as both sides may come from one table
    own = [f"g_{k}" for k in keys]
    base = ground.select(*[F.col(k).alias(g) for k, g in zip(keys, own, strict=True)], *[F.col(c).alias(f"g{c.lower()}") for c in "XYZ"])
    both = apart(base, own).groupBy(*own).cogroup(apart(queries, keys).groupBy(*keys))
    return both.applyInArrow(run, kinds)


def ground_halo(points: DataFrame, grid: Grid, tile_size: float, buffer: float, ground: tuple[int, ...] = GROUND) -> DataFrame:
    """Merged ground points of each buffered tile: tile, X, Y, Z."""
    return grid.halo(merged_ground(points, ground), tile_size, buffer).select("tile", "X", "Y", "Z")


def evaluate(queries: DataFrame, ground: DataFrame, keys: list[str], max_distance: float | None = None, extrapolate: bool = True) -> DataFrame:
    """``queries`` (keys, id, X, Y) with ground, slope, distance to the nearest ground point and ``extrapolated``.

    Outside the triangulation the height is the nearest ground point's, however
    far, unless ``extrapolate`` is off. Beyond ``max_distance`` from any ground
    point it is null. The distance is worked out only where one of these needs it.
    """
    out = written(by_group(queries, ground, keys))  # so that ground is triangulated once
    far = out if max_distance is not None else out.where("ground is null")
    if max_distance is None and (not extrapolate or far.isEmpty()):
        return out.withColumn("distance", F.lit(None).cast("double")).withColumn("extrapolated", F.col("ground").isNull())
    centre = far.select(*keys, "id", F.col("X").alias("cx"), F.col("Y").alias("cy")).withColumn("__id", F.struct(*keys, "id"))
    near = nearest(centre, ground.select("X", "Y", "Z").distinct(), "__id", 1, max_distance)
    near = near.select(*keys, "id", F.col("Z").alias("__z"), F.sqrt("distance2").alias("distance"))
    out = out.join(near, [*keys, "id"], "left").withColumn("extrapolated", F.col("ground").isNull())
    height = F.coalesce("ground", "__z") if extrapolate else F.col("ground")
    if max_distance is not None:
        height = F.when(F.col("distance") <= max_distance, height)
    return out.withColumn("ground", height).drop("__z")


def _places(points: DataFrame, grid: Grid, tile_size: float) -> tuple[DataFrame, DataFrame]:
    """The points that tiles own, with ``tile``, and their distinct positions: however many returns stand on one, it has one height."""
    own = grid.halo(points.drop("HeightAboveGround"), tile_size, 0.0).where("is_core").drop("is_core")
    return own, own.select("tile", "X", "Y").distinct()


def _over_ground(own: DataFrame, found: DataFrame) -> DataFrame:
    """Points with heights over the ground of their positions (tile, X, Y, ground, extrapolated, slope)."""
    found = found.select("tile", "X", "Y", F.col("ground").alias("__g"), F.col("extrapolated").alias("GroundExtrapolated"), F.col("slope").alias("GroundSlope"))
    out = own.join(found, ["tile", "X", "Y"], "left")
    height = F.col("Z") - F.col("__g")
    return out.withColumn("HeightAboveGround", F.when(height.isNotNull(), F.greatest(height, F.lit(0.0)))).withColumn("NegativeHAG", F.coalesce(height < 0, F.lit(False))).drop("__g")


def normalise(points: DataFrame, grid: Grid, tile_size: float, buffer: float, max_distance: float | None = None, extrapolate: bool = True, ground: tuple[int, ...] = GROUND) -> DataFrame:
    """Points of the grid with ``tile``, HeightAboveGround (not below 0), NegativeHAG, GroundExtrapolated.

    Each point is worked out once, in the tile that owns it.
    """
    own, places = _places(points, grid, tile_size)
    base = ground_halo(points, grid, tile_size, buffer, ground)
    return _over_ground(own, evaluate(places.withColumn("id", F.struct("X", "Y")), base, ["tile"], max_distance, extrapolate))


def _pixels(points: DataFrame, grid: Grid, tile_size: float) -> DataFrame:
    """Pixel centres in the tiles that own them: tile, row, col, X, Y."""
    cells = grid.cells(points.sparkSession).withColumnsRenamed({"x": "X", "y": "Y"})
    return grid.halo(cells, tile_size, 0.0).where("is_core").select("tile", "row", "col", "X", "Y")


def heights_and_terrain(points: DataFrame, grid: Grid, tile_size: float, buffer: float, ground: tuple[int, ...] = GROUND) -> tuple[DataFrame, DataFrame]:
    """What :func:`normalise` and :func:`dtm` give, from one triangulation and one lookup of positions and pixel centres."""
    own, places = _places(points, grid, tile_size)
    no = F.lit(None).cast("int")
    both = places.select("tile", no.alias("row"), no.alias("col"), "X", "Y").unionByName(_pixels(points, grid, tile_size)).withColumn("id", F.struct("row", "col", "X", "Y"))
    found = written(evaluate(both, ground_halo(points, grid, tile_size, buffer, ground), ["tile"]))
    raster = found.where("row is not null").select("row", "col", F.col("ground").alias("value"), "slope")
    return _over_ground(own, found.where("row is null")), raster


def dtm(points: DataFrame, grid: Grid, tile_size: float, buffer: float = 10.0, method: str = "tin", ground: tuple[int, ...] = GROUND) -> DataFrame:
    """Terrain at pixel centres: row, col, value, slope; ``method`` is tin or idw (see ``surfaces.dtm_min`` for min)."""
    if method == "idw":
        centres = grid.cells(points.sparkSession).select(F.struct("row", "col").alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        out = idw(centres, merged_ground(points, ground), "id")
        return out.select("id.row", "id.col", F.col("Z").alias("value"), F.lit(None).cast("double").alias("slope"))
    if method != "tin":
        raise ValueError("method must be tin or idw")
    queries = _pixels(points, grid, tile_size).select("tile", F.struct("row", "col").alias("id"), "X", "Y")
    return evaluate(queries, ground_halo(points, grid, tile_size, buffer, ground), ["tile"]).select("id.row", "id.col", F.col("ground").alias("value"), "slope")

