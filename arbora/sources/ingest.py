"""Ingesting LAS files: reprojection, noise, ground and vegetation in one job over all new files.

Files are read by ranges and put in the table's coordinate system; classifiers
run by tile of a lattice anchored at multiples of the tile size, over the
points of all files together. So a tile's halo takes in whatever file its
neighbours come from, and classes at the border of two files are those of one
merged file. Files that were ingested before and lie within the buffer of a new
one are read again as context, only where they can matter, and aren't kept.
"""

from __future__ import annotations

import functools
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.lineage import written
from arbora.functions.projection import is_feet, reproject, system_of, utm_of
from arbora.grid import Grid
from arbora.operators import ground
from arbora.sources.catalog import PointTable, fingerprint
from arbora.sources.las import read_headers, read_las


@dataclass(frozen=True)
class Stages:
    """What is done to points on their way in.

    ``reproject``: None keeps the files' system, "auto" takes files in feet to
    the UTM zone of the first one, else an EPSG code. ``ground`` names a
    classifier of ``ground.CLASSIFIERS``; ``buffer`` is the halo of its tiles.
    ``classes`` keeps points of these classes only, at the end.
    """

    reproject: int | str | None = None
    denoise: bool = False
    ground: str | None = None
    parameters: dict = field(default_factory=dict)
    tile: float = 250.0
    buffer: float = 25.0
    source: tuple[int, ...] = (1,)
    preserve: bool = True
    bounds: tuple[float, float, float] = (0.5, 2.0, 5.0)
    classes: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        low, middle, high = self.bounds
        if self.ground is not None and self.ground not in ground.CLASSIFIERS:
            raise ValueError(f"ground must be one of {sorted(ground.CLASSIFIERS)}")
        if not low < middle < high or self.tile <= 0 or self.buffer < 0 or not self.source or any(not 0 <= c <= 255 for c in self.source):
            raise ValueError("bounds must rise, tile be positive, buffer not negative, source classes from 0 to 255")

    @property
    def active(self) -> bool:
        """Whether classes change."""
        return self.denoise or self.ground is not None

    @property
    def fingerprint(self) -> str:
        return fingerprint(asdict(self) | {"classes": sorted(self.classes)})


def lattice(points: DataFrame, tile: float) -> Grid | None:
    """Tiles that own all points, with corners at multiples of ``tile``; None without points."""
    low_x, high_x, low_y, high_y = points.agg(F.min("X"), F.max("X"), F.min("Y"), F.max("Y")).first()
    if low_x is None:
        return None
    return Grid.from_bbox(math.floor(low_x / tile) * tile, (math.ceil(low_y / tile) - 1) * tile, (math.floor(high_x / tile) + 1) * tile, math.ceil(high_y / tile) * tile, tile)


def staged(points: DataFrame, stages: Stages, context: DataFrame | None = None) -> DataFrame:
    """``points`` with new classes; ``context`` are points of the same columns that stand around them."""
    out = points
    if stages.active:
        own = points.withColumn("__own", F.lit(True))
        both = own if context is None else own.unionByName(context.withColumn("__own", F.lit(False)), allowMissingColumns=True)
        both = written(both.withColumn("__id", F.monotonically_increasing_id()))
        grid = lattice(both.where("__own"), stages.tile)
        if grid is not None:
            if stages.ground is None:
                both = ground.with_noise(both, "__id")
            else:
                both = ground.reclassify(both, grid, stages.tile, stages.buffer, "__id", stages.ground, stages.denoise, stages.source, stages.preserve, stages.bounds, **stages.parameters)
        out = both.where("__own").select(*points.columns)
    return out.where(F.col("Classification").isin(*stages.classes)) if stages.classes else out


def _neighbours(heads: DataFrame, new: list[str], done: list[str], buffer: float) -> tuple[list[str], tuple[float, ...] | None]:
    """Done files whose bounds come within the buffer of a new one, and the box around those new ones' buffers."""
    spark = heads.sparkSession
    named = lambda names: spark.createDataFrame([(n,) for n in names], "file string")
    size = max(1000.0, 4 * buffer)
    cells = lambda df, b: df.select("file", "year", "crs", *[(F.col(c) + s * b).alias(c) for c, s in (("min_x", -1), ("min_y", -1), ("max_x", 1), ("max_y", 1))]).withColumn("kx", F.explode(F.sequence(F.floor(F.col("min_x") / size), F.floor(F.col("max_x") / size)))).withColumn("ky", F.explode(F.sequence(F.floor(F.col("min_y") / size), F.floor(F.col("max_y") / size))))
    a = cells(heads.join(named(new), "file", "left_semi"), buffer)
    b = cells(heads.join(named(done), "file", "left_semi"), 0.0).select("kx", "ky", "year", "crs", F.col("file").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    met = a.join(b, ["kx", "ky", "year", "crs"]).where("o_max_x >= min_x AND o_min_x <= max_x AND o_max_y >= min_y AND o_min_y <= max_y")
    rows = met.groupBy("other").agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).collect()
    if not rows:
        return [], None
    return [r["other"] for r in rows], (min(r[1] for r in rows), min(r[2] for r in rows), max(r[3] for r in rows), max(r[4] for r in rows))


def _target(stages: Stages, heads: list, texts: dict[int, str]) -> int:
    """EPSG code of the points to come; 0 if it isn't known."""
    if stages.reproject not in (None, "auto"):
        return int(str(stages.reproject).removeprefix("EPSG:"))
    for h in heads:
        crs = texts[h["crs"]] or (f"EPSG:{h['epsg']}" if h["epsg"] else "")
        if crs and stages.reproject == "auto" and is_feet(crs):
            spark = SparkSession.active()
            lon, lat = system_of(crs).inverse(F.lit((h["min_x"] + h["max_x"]) / 2), F.lit((h["min_y"] + h["max_y"]) / 2))
            return utm_of(*spark.range(1).select(lon, lat).first())
        if h["epsg"]:
            return h["epsg"]
    return 0


def ingest_las(spark: SparkSession, table: PointTable, files: list[str], stages: Stages = Stages(), overwrite: bool = False, year: int | None = None) -> dict[str, int]:
    """Adds LAS files in one job, each once; gives points by file, 0 for those that were there.

    The table takes the first good file's system, or the one asked for. Files
    that can't be read, or that can't come to the table's system, are recorded
    as failed and give -1; files without a system take the table's. A file that
    was ingested with other stages gives -1.
    """
    heads = written(read_headers(spark, files).withColumn("text", F.coalesce("crs", F.lit(""))).withColumn("crs", F.xxhash64("text")))
    texts = {r["crs"]: r["text"] for r in heads.select("crs", "text").distinct().collect()}
    rows = heads.drop("text").orderBy("file").collect()  # a row for each file
    good = [h for h in rows if h["error"] is None]
    target = _target(stages, good, texts)
    if overwrite or not table.exists():
        kept = table.epsg if table.exists() else 0
        table.create(target or kept, overwrite=True)
    own = table.epsg or target
    convert = stages.reproject is not None
    out, groups = {}, {}
    for h in rows:
        problem = h["error"]
        code = h["epsg"] or 0
        crs = (texts[h["crs"]] or (f"EPSG:{code}" if code else "")) if problem is None else ""
        wanted = convert and crs and not (stages.reproject == "auto" and not is_feet(crs))
        if problem is None and code not in (0, own) and not wanted:
            problem = f"EPSG:{code} in an EPSG:{own} table"
        if problem is None and wanted and code != own:
            try:
                system_of(crs), system_of(own)
            except ValueError as e:
                problem = str(e)
        if problem:
            table.record(h["file"], "failed", 0, "", problem)
            out[h["file"]] = -1
        else:
            groups.setdefault(crs if wanted and code != own else "", []).append(h["file"])
    ready = {f for names in groups.values() for f in names}
    if not ready:
        return out
    seen = {r["file"] for r in table.list_ingested().select("file").collect()} & ready
    new = sorted(ready - seen)

    def read(names: set[str], box: tuple[float, ...] | None = None) -> DataFrame | None:
        parts = []
        for crs, members in groups.items():
            chosen = sorted(names & set(members))
            if chosen:
                points = read_las(spark, chosen, year, box=box if not crs else None)
                parts.append(reproject(points, crs, own) if crs else points)
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    points = read(set(new))
    if points is None:
        points = read(ready)  # nothing is new: only the settings are compared
    elif stages.active:
        around, box = _neighbours(heads, new, sorted(seen), stages.buffer) if seen and stages.buffer > 0 else ([], None)
        points = staged(points, stages, read(set(around), box) if around else None)
    elif stages.classes:
        points = staged(points, stages)
    return out | table.ingest_files(points, sorted(ready), None, own, stages.fingerprint)
