"""The pixel lattice: north-up, anchored at its north-west corner."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.lineage import written


@dataclass(frozen=True)
class Grid:
    x0: float
    y1: float
    resolution: float
    nx: int
    ny: int

    @classmethod
    def from_bbox(cls, min_x: float, min_y: float, max_x: float, max_y: float, resolution: float) -> Grid:
        """The lattice over a box, extended east and south to whole pixels."""
        if not (resolution > 0 and max_x > min_x and max_y > min_y):
            raise ValueError("a box and its resolution must be positive")
        count = lambda extent: max(1, math.ceil(round(extent / resolution, 9)))
        return cls(min_x, max_y, resolution, count(max_x - min_x), count(max_y - min_y))

    @property
    def x1(self) -> float:
        return self.x0 + self.nx * self.resolution

    @property
    def y0(self) -> float:
        return self.y1 - self.ny * self.resolution

    def owned(self, x: str = "X", y: str = "Y") -> Column:
        """Whether a pixel owns the point: west and north edges inside, east and south outside."""
        return (F.col(x) >= self.x0) & (F.col(x) < self.x1) & (F.col(y) > self.y0) & (F.col(y) <= self.y1)

    def row(self, y: str = "Y") -> Column:
        return F.least(F.floor((F.lit(self.y1) - F.col(y)) / self.resolution), F.lit(self.ny - 1)).cast("int")

    def col(self, x: str = "X") -> Column:
        return F.least(F.floor((F.col(x) - self.x0) / self.resolution), F.lit(self.nx - 1)).cast("int")

    def bins(self, points: DataFrame) -> DataFrame:
        """The owned points with ``row`` and ``col``."""
        return points.where(self.owned()).withColumn("row", self.row()).withColumn("col", self.col())

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every pixel: ``row``, ``col`` and its centre ``x``, ``y``."""
        ids = spark.range(self.nx * self.ny).select(F.expr(f"cast(id div {self.nx} as int)").alias("row"), (F.col("id") % self.nx).cast("int").alias("col"))
        return ids.select("row", "col", (self.x0 + (F.col("col") + 0.5) * self.resolution).alias("x"), (self.y1 - (F.col("row") + 0.5) * self.resolution).alias("y"))

    def tiles(self, spark: SparkSession, tile_size: float, buffer: float = 0.0) -> DataFrame:
        """Tiles in rows from the north-west: ``tile``, core box and buffered query box."""
        per = self.per_tile(tile_size)
        across, down = -(-self.nx // per), -(-self.ny // per)
        ids = spark.range(across * down).select(F.col("id").cast("int").alias("tile"), F.expr(f"cast(id div {across} as int)").alias("r"), (F.col("id") % across).cast("int").alias("c"))
        step = per * self.resolution
        core = ids.select(
            "tile",
            (self.x0 + F.col("c") * step).alias("min_x"),
            F.greatest(self.y1 - (F.col("r") + 1) * step, F.lit(self.y0)).alias("min_y"),
            F.least(self.x0 + (F.col("c") + 1) * step, F.lit(self.x1)).alias("max_x"),
            (self.y1 - F.col("r") * step).alias("max_y"),
        )
        return core.select("*", (F.col("min_x") - buffer).alias("query_min_x"), (F.col("min_y") - buffer).alias("query_min_y"), (F.col("max_x") + buffer).alias("query_max_x"), (F.col("max_y") + buffer).alias("query_max_y"))

    def per_tile(self, tile_size: float) -> int:
        """Pixels along a tile's side; the tile must hold whole pixels."""
        per = round(tile_size / self.resolution)
        if per < 1 or abs(per * self.resolution - tile_size) > 1e-9 * max(1.0, tile_size):
            raise ValueError("tile_size must be a whole multiple of the resolution")
        return per

    def halo(self, points: DataFrame, tile_size: float, buffer: float) -> DataFrame:
        """Each point once for every tile whose buffered box holds it: ``tile`` and ``is_core``.

        A tile owns points as a pixel does. The copies are at most nine while the
        buffer is no wider than a tile.
        """
        per = self.per_tile(tile_size)
        across, down = -(-self.nx // per), -(-self.ny // per)
        step = per * self.resolution
        near = points.where((F.col("X") >= self.x0 - buffer) & (F.col("X") <= self.x1 + buffer) & (F.col("Y") >= self.y0 - buffer) & (F.col("Y") <= self.y1 + buffer))
        span = lambda low, high, last: F.sequence(F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.floor(high), F.lit(last)).cast("int"))
        columns = span((F.col("X") - buffer - self.x0) / step, (F.col("X") + buffer - self.x0) / step, across - 1)
        rows = span((self.y1 - F.col("Y") - buffer) / step, (self.y1 - F.col("Y") + buffer) / step, down - 1)
        spread = near.withColumn("__c", F.explode(columns)).withColumn("__r", F.explode(rows))
        own = self.owned() & (F.floor((F.col("X") - self.x0) / step) == F.col("__c")) & (F.floor((F.lit(self.y1) - F.col("Y")) / step) == F.col("__r"))
        return spread.withColumn("tile", F.col("__r") * across + F.col("__c")).withColumn("is_core", own).drop("__r", "__c")

    def balanced(self, points: DataFrame, tile_size: float, limit: int, depth: int = 8) -> BalancedGrid:
        """The same lattice with tiles of about equal load: see :class:`BalancedGrid`."""
        return BalancedGrid(self.x0, self.y1, self.resolution, self.nx, self.ny, self._leaves(points, tile_size, limit, depth), tile_size, depth)

    def _leaves(self, points: DataFrame, tile_size: float, limit: int, depth: int) -> DataFrame:
        """Tiles cut in quarters, again and again, while more than ``limit`` points lie in one: level, i, j (a quarter's column and row in its level)."""
        if limit < 1 or not 0 <= depth <= 12:
            raise ValueError("limit must be positive, depth from 0 to 12")
        self.per_tile(tile_size)
        fine = tile_size / (1 << depth)
        own = points.where(self.owned())
        counts = own.groupBy(F.floor((F.col("X") - self.x0) / fine).cast("int").alias("i"), F.floor((F.lit(self.y1) - F.col("Y")) / fine).cast("int").alias("j")).agg(F.count("*").alias("n"))
        # a histogram of quarters on all levels, from the finest cells up
        levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
        nodes = counts.withColumn("level", levels).groupBy("level", *[F.expr(f"shiftright({c}, {depth} - level)").alias(c) for c in "ij"]).agg(F.sum("n").alias("n"))
        nodes = written(nodes)
        over = nodes.where((F.col("n") > limit) & (F.col("level") < depth))
        quarters = over.select((F.col("level") + 1).alias("level"), F.explode(F.array(*[F.struct((2 * F.col("i") + a).alias("i"), (2 * F.col("j") + b).alias("j")) for a in (0, 1) for b in (0, 1)])).alias("at")).select("level", "at.*")
        across, down = (-(-n // self.per_tile(tile_size)) for n in (self.nx, self.ny))
        top = points.sparkSession.range(across * down).select(F.lit(0).alias("level"), (F.col("id") % across).cast("int").alias("i"), F.expr(f"cast(id div {across} as int)").alias("j"))
        return written(top.unionByName(quarters).join(over, ["level", "i", "j"], "left_anti"))


@dataclass(frozen=True, eq=False)
class BalancedGrid(Grid):
    """A lattice whose tiles are quarters of quarters of ``base`` tiles, none with more points than a limit (or at the last depth).

    Whatever takes a grid and asks for its halo works on these tiles; the tile
    size that it names must be ``base``. Points meet tiles by cells as wide as
    the smallest quarter or, where tiles are larger, as these: an equi-join on
    (level, column, row), as each level of tiles has its own cells.
    """

    leaves: DataFrame
    base: float
    depth: int

    def halo(self, points: DataFrame, tile_size: float, buffer: float) -> DataFrame:
        if tile_size != self.base:
            raise ValueError("tiles were made for another size")
        side = F.lit(self.base) / F.pow(F.lit(2.0), F.col("level"))
        box = self.leaves.withColumn("__w", self.x0 + F.col("i") * side).withColumn("__e", F.col("__w") + side).withColumn("__n", self.y1 - F.col("j") * side).withColumn("__s", F.col("__n") - side)
        # a number for each tile: its place in its level, after those of the levels above
        wide = lambda n: f"cast(ceil({n} / {self.per_tile(self.base)}) as bigint)"
        first = f"cast((pow(4, level) - 1) / 3 as bigint) * {wide(self.nx)} * {wide(self.ny)}"
        box = box.withColumn("tile", F.expr(f"{first} + cast(j as bigint) * cast(pow(2, level) as bigint) * {wide(self.nx)} + i"))
        cells = lambda low, high, origin, sign: F.sequence(F.floor(sign * (low - origin) / side), F.floor(sign * (high - origin) / side))
        spread = box.withColumn("__kx", F.explode(cells(F.col("__w") - buffer, F.col("__e") + buffer, F.lit(self.x0), 1))).withColumn("__ky", F.explode(cells(F.col("__n") + buffer, F.col("__s") - buffer, F.lit(self.y1), -1)))
        levels = [r["level"] for r in self.leaves.select("level").distinct().collect()]  # no more than depth + 1
        near = points.where((F.col("X") >= self.x0 - buffer) & (F.col("X") <= self.x1 + buffer) & (F.col("Y") >= self.y0 - buffer) & (F.col("Y") <= self.y1 + buffer))
        keyed = near.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])))
        keyed = keyed.withColumn("__kx", F.floor((F.col("X") - self.x0) / side)).withColumn("__ky", F.floor((F.lit(self.y1) - F.col("Y")) / side))
        met = keyed.join(spread.select("level", "__kx", "__ky", "tile", "__w", "__e", "__n", "__s"), ["level", "__kx", "__ky"])
        met = met.where((F.col("X") >= F.col("__w") - buffer) & (F.col("X") <= F.col("__e") + buffer) & (F.col("Y") >= F.col("__s") - buffer) & (F.col("Y") <= F.col("__n") + buffer))
        core = self.owned() & (F.col("X") >= F.col("__w")) & (F.col("X") < F.col("__e")) & (F.col("Y") > F.col("__s")) & (F.col("Y") <= F.col("__n"))
        return met.withColumn("is_core", core).drop("level", "__kx", "__ky", "__w", "__e", "__n", "__s")
