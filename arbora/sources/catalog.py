"""The catalog: the partitioned point table, the ingest manifest, rasters and product runs.

Points live in Parquet by year and 500 m tile (``tx``, ``ty``); queries turn a
box into tile ranges as well as coordinate ranges, so that both partitions and
row groups are pruned. Manifest, runs and finished tiles are small append-only
tables whose latest row counts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.lineage import written
from arbora.grid import Grid
from arbora.schema import ATTRIBUTES, YEARS, point_schema

TILE = 500.0


def query_bbox(points: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, attributes: list[str] | None = None, year: int | None = None) -> DataFrame:
    """Points in the closed box, of one year or all; X, Y and the chosen attributes.

    A stored table also gets predicates on its tile columns.
    """
    if not (max_x >= min_x and max_y >= min_y):
        raise ValueError("the box is empty")
    keep = F.col("X").between(min_x, max_x) & F.col("Y").between(min_y, max_y)
    if "tx" in points.columns:
        keep = keep & F.col("tx").between(int(min_x // TILE), int(max_x // TILE)) & F.col("ty").between(int(min_y // TILE), int(max_y // TILE))
    if year is not None:
        keep = keep & (F.col("Year") == year)
    found = points.where(keep)
    return found.select("X", "Y", *attributes) if attributes is not None else found.drop("tx", "ty")


def query_tile(points: DataFrame, x_km: int, y_km: int, attributes: list[str] | None = None, year: int | None = None, size: float = 2000.0) -> DataFrame:
    """Points of the 2 km tile whose north-west corner is (x_km, y_km)."""
    x, y = x_km * 1000.0, y_km * 1000.0
    found = query_bbox(points, x, y - size, x + size, y, None, year)
    return found.select("X", "Y", "Year", *attributes) if attributes is not None else found


def with_attributes(points: DataFrame, attributes: list[str]) -> DataFrame:
    """X, Y and the attributes, with 0 for those that the table doesn't store; unknown names raise."""
    unknown = [a for a in attributes if a not in ATTRIBUTES]
    if unknown:
        raise ValueError(f"unknown attributes {unknown}")
    return points.select("X", "Y", *[F.col(a) if a in points.columns else F.lit(0).cast(ATTRIBUTES[a]).alias(a) for a in attributes])


def data_bbox(points: DataFrame) -> DataFrame:
    """One row: the extent of the points."""
    return points.agg(F.min("X").alias("min_x"), F.min("Y").alias("min_y"), F.max("X").alias("max_x"), F.max("Y").alias("max_y"))


def latest_entries(entries: DataFrame, key: str) -> DataFrame:
    """The newest entry (``ts``) of each key."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    return entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pending(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The files that the manifest doesn't have as ok."""
    return files.join(manifest.where("status = 'ok'").select(key), key, "left_anti")


def _now() -> str:
    return datetime.now(UTC).isoformat()


class PointTable:
    """A point table at ``path``, with its coordinate system and manifest beside it.

    Points are written in batches, each in a folder of its own, and count only
    once the manifest names their batch, which is one write. So a job that fails
    or is killed leaves nothing that is read, and may be run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _append(self, name: str, rows: list[tuple], schema: str, mode: str = "append") -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._has("meta")

    def create(self, epsg: int = 0, overwrite: bool = False) -> PointTable:
        """Makes the table; ``overwrite`` removes every point and the manifest."""
        if self.exists() and not overwrite:
            raise ValueError("the table exists")
        self._append("manifest", [], _MANIFEST, "overwrite")
        self._append("meta", [(epsg,)], "epsg int", "overwrite")
        self._remove("points")
        return self

    def _remove(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    @property
    def epsg(self) -> int:
        return self.spark.read.parquet(f"{self.path}/meta").first()["epsg"]

    def _agree(self, epsg: int) -> None:
        own = self.epsg
        if epsg and own and epsg != own:
            raise ValueError(f"EPSG:{epsg} points can't go to an EPSG:{own} table")
        if epsg and not own:
            self._append("meta", [(epsg,)], "epsg int", "overwrite")

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    def _batches(self) -> list[str]:
        """The batches that count: those in the manifest but for what a merged one replaces."""
        rows = self._entries().where("batch is not null and status in ('ok', 'merged')").groupBy("batch").agg(F.max(F.when(F.col("status") == "merged", F.col("message"))).alias("replaced")).collect()
        gone = {b for r in rows if r["replaced"] for b in json.loads(r["replaced"])}
        return sorted(r["batch"] for r in rows if r["batch"] not in gone)

    def points(self) -> DataFrame:
        schema = "X double, Y double, " + ", ".join(f"{n} {t.simpleString()}" for n, t in ATTRIBUTES.items()) + ", Year int, tx int, ty int"
        folders = [f"{self.path}/points/batch={b}" for b in self._batches()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/points").parquet(*folders).drop("batch")

    def _write(self, points: DataFrame, year: int | None) -> str | None:
        """Writes a batch and gives its name, or None if there are no points. A column ``file`` goes along for counting."""
        at = F.lit(year) if year is not None else F.col("Year")
        columns = [F.coalesce(F.col(n), F.lit(0)).cast(t).alias(n) if n in points.columns else F.lit(0).cast(t).alias(n) for n, t in ATTRIBUTES.items()]
        named = [F.col("file").alias("__file")] if "file" in points.columns else []
        rows = points.select(F.col("X").cast("double"), F.col("Y").cast("double"), *columns, *named, at.cast("int").alias("Year")).where(F.col("Year").between(*YEARS))
        rows = rows.withColumn("tx", F.floor(F.col("X") / TILE).cast("int")).withColumn("ty", F.floor(F.col("Y") / TILE).cast("int"))
        batch = uuid.uuid4().hex
        self._lay(rows, batch)
        return batch if self._has(f"points/batch={batch}") else None

    def _lay(self, rows: DataFrame, batch: str) -> None:
        laid = rows.repartitionByRange("Year", "tx", "ty", "X", "Y").sortWithinPartitions("Year", "tx", "ty", z_order("X", "Y"))
        laid.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "Year", "tx", "ty").parquet(f"{self.path}/points")

    def write(self, points: DataFrame, year: int | None = None, epsg: int = 0) -> None:
        """Appends points: absent attributes become 0, unknown columns are dropped, rows are laid out by tile."""
        self._agree(epsg)
        batch = self._write(points.drop("file"), year)
        if batch:
            self._append("manifest", [(None, "ok", None, "", "", _now(), batch)], _MANIFEST)

    def query_bbox(self, *box: float, attributes: list[str] | None = None, year: int | None = None) -> DataFrame:
        return query_bbox(self.points(), *box, attributes, year)

    def available_years(self) -> list[int]:
        return [r["Year"] for r in self.points().select("Year").distinct().orderBy("Year").collect()]

    def manifest(self) -> DataFrame:
        return latest_entries(self._entries().where("file is not null"), "file")

    def record(self, file: str, status: str, n_points: int, fingerprint: str = "", message: str = "") -> None:
        self._append("manifest", [(file, status, n_points, fingerprint, message, _now(), None)], _MANIFEST)

    def list_ingested(self) -> DataFrame:
        return self.manifest().where("status = 'ok'").orderBy("ts")

    def ingest_files(self, points: DataFrame, names: list[str], year: int | None = None, epsg: int = 0, fingerprint: str = "") -> dict[str, int]:
        """Points of many files (column ``file``, of ``names``) in one job, each file once.

        What the manifest has as ok with the same settings gives 0, with others -1.
        Points are read once; counts by file come from the written batch, and one
        manifest entry makes all of it count. A failure is recorded for each file
        and raised.
        """
        wanted = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "file string")
        seen = {r["file"]: r["fingerprint"] for r in self.manifest().where("status = 'ok'").join(wanted, "file", "left_semi").collect()}
        out = {n: 0 if seen.get(n, fingerprint) == fingerprint else -1 for n in names}
        new = [n for n in out if n not in seen]
        if not new:
            return out
        done = self.spark.createDataFrame([(n,) for n in seen], "file string")
        try:
            self._agree(epsg)
            batch = self._write(points.join(done, "file", "left_anti") if seen else points, year)
            counts = self.spark.read.option("basePath", f"{self.path}/points").parquet(f"{self.path}/points/batch={batch}").groupBy("__file").count().collect() if batch else []
        except Exception as e:
            self._append("manifest", [(n, "failed", 0, fingerprint, str(e)[:500], _now(), None) for n in new], _MANIFEST)
            raise
        found = {r["__file"]: r["count"] for r in counts}
        self._append("manifest", [(n, "ok", found.get(n, 0), fingerprint, "", _now(), batch) for n in new], _MANIFEST)
        return out | {n: found.get(n, 0) for n in new}

    def ingest(self, file: str, points: DataFrame, year: int, epsg: int = 0, fingerprint: str = "") -> int:
        """One file's points, once: a file that is ok in the manifest with the same settings is left out.

        With other settings it is an error. A failure is recorded and raised.
        """
        n = self.ingest_files(points.withColumn("file", F.lit(file)), [file], year, epsg, fingerprint)[file]
        if n < 0:
            raise ValueError(f"{file} was ingested with other settings")
        return n

    def ingest_many(self, files: dict[str, DataFrame], year: int, epsg: int = 0, fingerprint: str = "") -> dict[str, int]:
        """All files in one job. If that fails each goes by itself: a failed one gives -1 and doesn't stop the others."""
        out = {}
        whole = {file: df.withColumn("file", F.lit(file)) for file, df in files.items() if {"X", "Y"} <= set(df.columns)}
        if len(whole) > 1:
            try:
                out = self.ingest_files(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), whole.values()), list(whole), year, epsg, fingerprint)
            except Exception:  # recorded in the manifest
                out = {}
        for file, points in files.items():
            if file not in out:
                try:
                    out[file] = self.ingest(file, points, year, epsg, fingerprint)
                except Exception:  # recorded in the manifest
                    out[file] = -1
        return {file: out[file] for file in files}

    def file_count(self) -> int:
        return len(self.points().inputFiles()) if self._batches() else 0

    def optimize(self) -> None:
        """Rewrites the points as one batch with a sorted stretch of files for each tile, which then takes the others' place.

        Those stay for whoever still reads them, until ``vacuum``.
        """
        old = self._batches()
        if old:
            batch = uuid.uuid4().hex
            rows = self.points().repartitionByRange("Year", "tx", "ty").sortWithinPartitions("Year", "tx", "ty", z_order("X", "Y"))
            rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "Year", "tx", "ty").parquet(f"{self.path}/points")
            self._append("manifest", [(None, "merged", None, "", json.dumps(old), _now(), batch)], _MANIFEST)

    def vacuum(self) -> int:
        """Removes the batches that don't count, when nobody reads or writes them any more; gives how many there were."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/points")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        old = {n for n in names if n.startswith("batch=")} - {f"batch={b}" for b in self._batches()}
        for name in old:
            self._remove(f"points/{name}")
        return len(old)

    def revision(self) -> str:
        """A digest of the files that make up the table: names, sizes and times of change."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = []
        for batch in self._batches():
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/points/batch={batch}")
            files = at.getFileSystem(conf).listFiles(at, True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


_MANIFEST = "file string, status string, n_points bigint, fingerprint string, message string, ts string, batch string"


def z_order(x: str, y: str, cell: float = 10.0) -> F.Column:
    """Interleaved bits of the 10 m cell within a tile: near points lie near in the file."""
    kx, ky = F.floor(F.pmod(F.col(x), F.lit(TILE)) / cell).cast("int"), F.floor(F.pmod(F.col(y), F.lit(TILE)) / cell).cast("int")
    out = F.lit(0)
    for bit in range(6):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(kx, bit).bitwiseAND(F.lit(1)), 2 * bit)).bitwiseOR(F.shiftleft(F.shiftright(ky, bit).bitwiseAND(F.lit(1)), 2 * bit + 1))
    return out


def fingerprint(configuration: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, default=str).encode()).hexdigest()


#: Pixels along the side of a block of a raster, which is written and replaced as one.
BLOCK = 256


class RasterStore:
    """Rasters as one long table by variable, resolution, year and block of pixels; runs and finished tiles beside it.

    Batches of blocks are only ever added; a list of blocks says which batch
    counts for each, so a killed write changes nothing that is read.
    """

    _RUNS = "variable string, resolution double, year int, status string, fingerprint string, configuration string, ts string"
    _TILES = "variable string, resolution double, year int, tile int, ts string"
    _GRIDS = "resolution double, x0 double, y1 double, nx int, ny int, epsg int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    _has, _append, _remove = PointTable._has, PointTable._append, PointTable._remove
    _BLOCKS = "variable string, resolution double, year int, batch string, block_row int, block_col int, ts string"
    _RASTER = "row int, col int, value float, batch string, variable string, resolution double, year int, block_row int, block_col int"

    def ensure_grid(self, grid: Grid, epsg: int = 0) -> None:
        """Registers the lattice of a resolution; another one for it is an error."""
        row = (grid.resolution, grid.x0, grid.y1, grid.nx, grid.ny, epsg)
        if self._has("grids"):
            for seen in self.spark.read.parquet(f"{self.path}/grids").where(F.col("resolution") == grid.resolution).collect():
                if tuple(seen) != row:
                    raise ValueError("the store has another grid or coordinate system at this resolution")
                return
        self._append("grids", [row], self._GRIDS)

    def check_run(self, variable: str, resolution: float, year: int, configuration: dict, overwrite: bool = False) -> bool:
        """Whether the run must be done: not if it is complete under the same settings; other settings are an error unless overwritten."""
        if not self._has("runs"):
            return True
        mine = self.spark.read.parquet(f"{self.path}/runs").where((F.col("variable") == variable) & (F.col("resolution") == resolution) & (F.col("year") == year))
        last = mine.orderBy(F.col("ts").desc()).first()
        if last is None or overwrite:
            return True
        if last["fingerprint"] != fingerprint(configuration):
            raise ValueError(f"{variable} of {year} was made with other settings")
        return last["status"] != "complete"

    def mark_run(self, variable: str, resolution: float, year: int, status: str, configuration: dict) -> None:
        self._append("runs", [(variable, float(resolution), year, status, fingerprint(configuration), json.dumps(configuration, sort_keys=True, default=str), _now())], self._RUNS)

    def _put(self, rows: DataFrame, variables: list[str], resolution: float, year: int, whole: bool) -> None:
        """Writes a batch of blocks of row, col, variable, value; one entry of the block list makes it count."""
        batch, side = uuid.uuid4().hex, F.lit(BLOCK)
        slices = F.lit(batch).alias("batch"), F.lit(float(resolution)).alias("resolution"), F.lit(year).alias("year")
        laid = rows.select("row", "col", F.col("value").cast("float").alias("value"), *slices, "variable", F.floor(F.col("row") / side).cast("int").alias("block_row"), F.floor(F.col("col") / side).cast("int").alias("block_col"))
        laid.repartition("variable", "block_row", "block_col").sortWithinPartitions("variable", "block_row", "block_col", "row", "col").write.mode("append").partitionBy("batch", "variable", "resolution", "year", "block_row", "block_col").parquet(f"{self.path}/raster")
        entries = [(v, float(resolution), year, batch, None, None, _now()) for v in variables] if whole else []
        if self._has(f"raster/batch={batch}"):
            there = self.spark.read.option("basePath", f"{self.path}/raster").schema(self._RASTER).parquet(f"{self.path}/raster/batch={batch}")
            entries += [(r["variable"], float(resolution), year, batch, r["block_row"], r["block_col"], _now()) for r in there.select("variable", "block_row", "block_col").distinct().collect()]
        if entries:
            self._append("blocks", entries, self._BLOCKS)

    def _current(self) -> DataFrame:
        """The batch that counts for each block: the last since its slice was last written whole."""
        entries = self.spark.read.schema(self._BLOCKS).parquet(f"{self.path}/blocks")
        of = ["variable", "resolution", "year"]
        since = F.max(F.when(F.col("block_row").isNull(), F.col("ts"))).over(Window.partitionBy(*of))
        last = Window.partitionBy(*of, "block_row", "block_col").orderBy(F.desc("ts"), "batch")
        kept = entries.withColumn("since", since).where("block_row IS NOT NULL AND (since IS NULL OR ts >= since)")
        return kept.withColumn("n", F.row_number().over(last)).where("n = 1").select(*of, "batch", "block_row", "block_col")

    def _pixels(self) -> DataFrame:
        """All pixels that count; what is asked of variable, resolution and year reaches the folders."""
        if not self._has("raster"):
            return self.spark.createDataFrame([], self._RASTER)
        every = self.spark.read.schema(self._RASTER).parquet(f"{self.path}/raster")
        return every.join(self._current(), ["variable", "resolution", "year", "batch", "block_row", "block_col"], "left_semi")

    def write(self, raster: DataFrame, variable: str, resolution: float, year: int) -> None:
        """Replaces the slice of one variable, resolution and year by row, col, value. Until it is whole the old slice counts."""
        self._put(raster.select("row", "col", "value", F.lit(variable).alias("variable")), [variable], resolution, year, True)

    def write_wide(self, wide: DataFrame, variables: list[str], resolution: float, year: int) -> None:
        """The same for many variables in one job, from row, col and a column for each; nulls take no room."""
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("float").alias("value")) for v in variables]))
        self._put(wide.select("row", "col", pairs.alias("v")).select("row", "col", "v.*").where("value IS NOT NULL"), variables, resolution, year, True)

    def upsert(self, raster: DataFrame, variable: str, resolution: float, year: int) -> None:
        """Puts pixels (row, col, value) in the place of those stored, such as a tile. Only the blocks that they touch are written anew."""
        rows = written(raster.select("row", "col", F.col("value").cast("float").alias("value")))
        block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
        touched = rows.select(block("row").alias("block_row"), block("col").alias("block_col")).distinct()
        old = self._pixels().where((F.col("variable") == variable) & (F.col("resolution") == float(resolution)) & (F.col("year") == year))
        old = old.join(touched, ["block_row", "block_col"], "left_semi").select("row", "col", "value").join(rows, ["row", "col"], "left_anti")
        self._put(rows.unionByName(old).withColumn("variable", F.lit(variable)), [variable], resolution, year, False)

    def read(self, variable: str, resolution: float, year: int | None = None) -> DataFrame:
        keep = (F.col("variable") == variable) & (F.col("resolution") == float(resolution))
        return self._pixels().where(keep if year is None else keep & (F.col("year") == year)).select("row", "col", "value", "year")

    def variables(self) -> DataFrame:
        return self._current().select("variable", "resolution", "year").distinct()

    def vacuum(self) -> int:
        """Removes batches of which no block counts, when nobody reads or writes them any more; gives how many there were."""
        kept = {r["batch"] for r in self._current().select("batch").distinct().collect()}
        gone = {r["batch"] for r in self.spark.read.schema(self._BLOCKS).parquet(f"{self.path}/blocks").select("batch").distinct().collect()} - kept
        gone = {b for b in gone if self._has(f"raster/batch={b}")}
        for b in gone:
            self._remove(f"raster/batch={b}")
        return len(gone)

    def to_wide(self, grid: Grid, variables: list[str], year: int) -> DataFrame:
        """Every pixel of the lattice with a column for each variable."""
        raster = self._pixels().where((F.col("resolution") == grid.resolution) & (F.col("year") == year) & F.col("variable").isin(*variables))
        wide = raster.groupBy("row", "col").pivot("variable", variables).agg(F.first("value"))
        return grid.cells(self.spark).join(wide, ["row", "col"], "left")

    def mark_tiles(self, variable: str, resolution: float, year: int, tiles: list[int]) -> None:
        self._append("tiles", [(variable, float(resolution), year, t, _now()) for t in tiles], self._TILES)

    def open_tiles(self, tiles: DataFrame, variable: str, resolution: float, year: int) -> DataFrame:
        """The tiles that have not been finished."""
        if not self._has("tiles"):
            return tiles
        done = self.spark.read.parquet(f"{self.path}/tiles").where((F.col("variable") == variable) & (F.col("resolution") == float(resolution)) & (F.col("year") == year))
        return tiles.join(done.select("tile"), "tile", "left_anti")

    def run(self, raster: DataFrame, variable: str, grid: Grid, year: int, configuration: dict, overwrite: bool = False, epsg: int = 0) -> bool:
        """Writes a product once, with its provenance; False if it was complete already."""
        self.ensure_grid(grid, epsg)
        if not self.check_run(variable, grid.resolution, year, configuration, overwrite):
            return False
        self.mark_run(variable, grid.resolution, year, "running", configuration)
        try:
            self.write(raster, variable, grid.resolution, year)
        except Exception:
            self.mark_run(variable, grid.resolution, year, "failed", configuration)
            raise
        self.mark_run(variable, grid.resolution, year, "complete", configuration)
        return True
