"""LAS files (uncompressed, point formats 0 to 10) as point tables and back.

A file is read by ranges of points, each a partition of its own, so one file
keeps many tasks busy and its size has no bound. Planning reads headers only,
some hundred bytes a file, and leaves out files whose bounds miss the box;
:func:`index_las` keeps the bounds and classes of every range, by which
:func:`read_las` leaves out ranges. Within a range, points outside the box and
of other classes are dropped before they reach Spark, and only the chosen
columns are made. ``spark.read.format("las")`` gives the same as a data source,
into which Spark pushes comparisons if asked to.

Compressed LAZ isn't read. Waveform packets (formats 4, 5, 9 and 10) are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.schema import ATTRIBUTES, point_schema
from arbora.sources.files import Ranges, listed
from arbora.sources.tiles import epsg_of

_CORE = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2")]
_OLD = [*_CORE, ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
_NEW = [*_CORE, ("bits", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("gps", "<f8")]
_GPS, _RGB = ("gps", "<f8"), [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_INFRARED = [*_NEW, *_RGB, ("nir", "<u2")]
#: Record layouts by point format, without waveform packets, which come last.
FORMATS = {0: _OLD, 1: [*_OLD, _GPS], 2: [*_OLD, *_RGB], 3: [*_OLD, _GPS, *_RGB], 4: [*_OLD, _GPS], 5: [*_OLD, _GPS, *_RGB], 6: _NEW, 7: [*_NEW, *_RGB], 8: _INFRARED, 9: _NEW, 10: _INFRARED}
#: Points of a partition, and of a batch within it.
CHUNK, BATCH = 1_000_000, 200_000
SUFFIXES = (".las", ".laz")
Reader = Callable[[int, int], bytes]


def header_by(read: Reader) -> dict:
    """Version, counts, scales, bounds, creation year and coordinate system, by reads of (offset, length)."""
    data = read(0, 375)
    if data[:4] != b"LASF":
        raise ValueError("no LAS file")
    minor, year = data[25], struct.unpack_from("<H", data, 92)[0]
    size, offset, records, kind, length, count = struct.unpack_from("<HIIBHI", data, 94)
    scale = struct.unpack_from("<6d", data, 131)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", data, 179)
    if minor >= 4 and size >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    text, at = "", size
    for _ in range(records):
        head = read(at, 54)
        if len(head) < 54:
            break
        record, span = struct.unpack_from("<HH", head, 18)
        if record == 2112:
            text = read(at + 54, span).split(b"\0")[0].decode(errors="replace")
        elif record == 34735 and not text:
            keys = np.frombuffer(read(at + 54, span - span % 8), "<u2").reshape(-1, 4)
            code = [int(k[3]) for k in keys if k[0] == 3072]
            text = f"EPSG:{code[0]}" if code else ""
        at += 54 + span
    return {"version": f"1.{minor}", "year": year, "offset": offset, "format": kind & 63, "compressed": bool(kind & 128), "record": length, "n_points": count, "scale": scale[:3], "shift": scale[3:], "min_x": min_x, "min_y": min_y, "min_z": min_z, "max_x": max_x, "max_y": max_y, "max_z": max_z, "crs": text, "epsg": epsg_of(text)}


def read_header(data: bytes) -> dict:
    """The same of a whole file in memory, or of its beginning."""
    return header_by(lambda at, n: data[at : at + n])


def problem(head: dict, size: int) -> str | None:
    """Why the points of a file of ``size`` bytes can't be read."""
    if head["compressed"]:
        return "compressed"
    if head["format"] not in FORMATS:
        return f"point format {head['format']}"
    return "cut short" if head["offset"] + head["n_points"] * head["record"] > size else None


def _columns(data: bytes, head: dict, wanted: set[str]) -> dict[str, np.ndarray]:
    """The wanted attributes of a run of records."""
    kind = np.dtype(FORMATS[head["format"]])
    layout = np.dtype({"names": kind.names, "formats": [kind[n] for n in kind.names], "offsets": [kind.fields[n][1] for n in kind.names], "itemsize": head["record"]})
    p = np.frombuffer(data, layout)
    new = head["format"] >= 6
    flag, shift = (p["flags"], 0) if new else (p["class"], 5)
    zero = np.zeros(len(p), np.int64)
    made: dict[str, Callable[[], np.ndarray]] = {
        **{n: lambda k=k, n=n: p[n.lower()] * head["scale"][k] + head["shift"][k] for k, n in enumerate("XYZ")},
        "Intensity": lambda: p["intensity"], "Classification": lambda: p["class"] if new else p["class"] & 31, "UserData": lambda: p["user"], "PointSourceId": lambda: p["source"],
        "ReturnNumber": lambda: p["bits"] & (15 if new else 7), "NumberOfReturns": lambda: p["bits"] >> 4 if new else p["bits"] >> 3 & 7,
        "ScanDirectionFlag": lambda: (p["flags"] if new else p["bits"]) >> 6 & 1, "EdgeOfFlightLine": lambda: (p["flags"] if new else p["bits"]) >> 7,
        "ScanAngleRank": lambda: np.round(p["angle"] * 0.006).astype(np.int64) if new else p["angle"],
        **{n: lambda k=k: flag >> shift + k & 1 for k, n in enumerate(("Synthetic", "KeyPoint", "Withheld"))},
        "Overlap": lambda: p["flags"] >> 3 & 1 if new else zero, "GpsTime": lambda: p["gps"] if "gps" in kind.names else zero.astype(float),
        **{n: lambda n=n: p[n.lower()] if n.lower() in kind.names else zero for n in ("Red", "Green", "Blue")},
    }
    return {n: made.get(n, lambda: zero)() for n in wanted}


def range_batches(path: str, at: int, n: int, head: dict, schema: pa.Schema, year: int | None, box: tuple[float, ...] | None, classes: tuple[int, ...] | None) -> Iterator[pa.RecordBatch]:
    """Points ``at`` to ``at + n`` of a file that lie in the box (min_x, min_y, max_x, max_y) and have one of the classes."""
    needed = {f.name for f in schema} - {"file", "Year"} | ({"X", "Y"} if box else set()) | ({"Classification"} if classes is not None else set())
    with Ranges(path) as read:
        for first in range(at, at + n, BATCH):
            count = min(BATCH, at + n - first)
            data = read(head["offset"] + first * head["record"], count * head["record"])
            if len(data) < count * head["record"]:
                raise ValueError(f"{path}: cut short")
            columns = _columns(data, head, needed)
            keep = np.ones(count, bool)
            if box:
                keep &= (columns["X"] >= box[0]) & (columns["X"] <= box[2]) & (columns["Y"] >= box[1]) & (columns["Y"] <= box[3])
            if classes is not None:
                keep &= np.isin(columns["Classification"], classes)
            if keep.any():
                held = int(keep.sum())
                columns |= {"file": np.full(held, path, object), "Year": np.full(held, head["year"] if year is None else year)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][keep] if len(columns[f.name]) == count and f.name not in ("file", "Year") else columns[f.name]).cast(f.type) for f in schema], schema=schema)


def las_schema(columns: tuple[str, ...] | None = None) -> str:
    """``file``, X, Y, Year and all attributes as DDL, or those of them that are named."""
    every = {"file": "string"} | {f.name: f.dataType.simpleString() for f in point_schema().fields}
    unknown = set(columns or ()) - set(every)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return ", ".join(f"{c} {every[c]}" for c in (columns or every))


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, size, and the header as JSON with ``error`` in it; one small read a file, spread over tasks."""
    import json

    files = listed(_paths(paths), SUFFIXES)
    width = max(1, min(len(files) // 8, 4 * spark.sparkContext.defaultParallelism))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, size in zip(frame["file"], frame["size"], strict=True):
                try:
                    with Ranges(path) as read:
                        head = header_by(read)
                    head["error"] = problem(head, size)
                except Exception as e:  # whatever a damaged header leads to
                    head = {"error": str(e)[:500] or "no header"}
                out.append((path, size, json.dumps(head)))
            yield pd.DataFrame(out, columns=["file", "size", "head"])

    return spark.createDataFrame(files or [("", 0)], "file string, size bigint").where("file != ''").repartition(width).mapInPandas(run, "file string, size bigint, head string")


_HEAD = "version string, year int, n_points bigint, epsg int, crs string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, error string"


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file: version, count, bounds, creation year, coordinate system, and ``error`` if its points can't be read."""
    return _heads(spark, paths).select("file", F.from_json("head", _HEAD).alias("h")).select("file", "h.*")


def _ranges(spark: SparkSession, paths: str | list[str], chunk: int, box: tuple[float, ...] | None = None) -> DataFrame:
    """file, head, at, n: the ranges of all files whose bounds meet the box."""
    heads = _heads(spark, paths).withColumn("h", F.from_json("head", _HEAD))
    bad = F.raise_error(F.concat("file", F.lit(": "), "h.error"))
    good = heads.withColumn("n_points", F.when(F.col("h.error").isNull(), F.col("h.n_points")).otherwise(bad.cast("bigint")))
    if box:
        slack = 1e-6  # bounds in headers are rounded
        good = good.where((F.col("h.max_x") >= box[0] - slack) & (F.col("h.min_x") <= box[2] + slack) & (F.col("h.max_y") >= box[1] - slack) & (F.col("h.min_y") <= box[3] + slack))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_points") - 1, F.lit(chunk).cast("bigint"))
    return good.where("n_points > 0").select("file", "head", F.explode(starts).alias("at"), "n_points").select("file", "head", "at", F.least(F.lit(chunk), F.col("n_points") - F.col("at")).alias("n"))


def _spread(ranges: DataFrame) -> DataFrame:
    """Each range a partition, up to some per core; ranges of one file lie apart."""
    spark = ranges.sparkSession
    return ranges.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "file", "at")


def index_las(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK) -> DataFrame:
    """Ranges with what is in them: file, head, at, n, min_x, min_y, max_x, max_y, and classes in order. Write it as a table beside the files."""
    import json

    bounds = ["min_x", "min_y", "max_x", "max_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("X", pa.float64()), ("Y", pa.float64()), ("Classification", pa.int16())])
        for batch in batches:
            for r in batch.to_pylist():
                box, classes = [np.inf, np.inf, -np.inf, -np.inf], set()
                for part in range_batches(r["file"], r["at"], r["n"], json.loads(r["head"]), schema, None, None, None):
                    x, y, c = (part.column(k).to_numpy() for k in range(3))
                    box = [min(box[0], x.min()), min(box[1], y.min()), max(box[2], x.max()), max(box[3], y.max())]
                    classes |= set(np.unique(c).tolist())
                yield pa.RecordBatch.from_pylist([r | dict(zip(bounds, map(float, box), strict=True)) | {"classes": sorted(classes)}])

    given = _spread(_ranges(spark, paths, chunk)).select("file", "head", "at", "n")
    return given.mapInArrow(run, "file string, head string, at bigint, n bigint, " + ", ".join(f"{b} double" for b in bounds) + ", classes array<bigint>")


def read_las(spark: SparkSession, paths: str | list[str] | None = None, year: int | None = None, chunk: int = CHUNK, columns: tuple[str, ...] | None = None,
             box: tuple[float, float, float, float] | None = None, classes: tuple[int, ...] | None = None, index: DataFrame | None = None) -> DataFrame:
    """The points of LAS files: ``file``, X, Y, Year and all attributes, or only ``columns``; Year from ``year`` or the header.

    With a table of :func:`index_las` in place of ``paths``, ranges outside the
    box or without the classes aren't read.
    """
    import json

    if index is None:
        ranges = _ranges(spark, paths or [], chunk, box)
    else:
        ranges = index
        if box:
            ranges = ranges.where((F.col("max_x") >= box[0]) & (F.col("min_x") <= box[2]) & (F.col("max_y") >= box[1]) & (F.col("min_y") <= box[3]))
        if classes is not None:
            ranges = ranges.where(F.arrays_overlap("classes", F.array(*[F.lit(int(c)).cast("bigint") for c in classes]).cast("array<bigint>")))
    names = las_schema(columns)
    schema = spark.createDataFrame([], names).limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from range_batches(r["file"], r["at"], r["n"], json.loads(r["head"]), schema, year, box, classes)

    return _spread(ranges.select("file", "head", "at", "n")).mapInArrow(run, names)




class LasBody:
    """Records of format 6 or 7 from batches of points, and the LAS 1.4 header that goes before them."""

    def __init__(self, epsg: int, scale: float, year: int, colours: bool):
        self.epsg, self.scale, self.year, self.format = epsg, scale, year, 7 if colours else 6
        self.kind = np.dtype(FORMATS[self.format])
        self.shift: list[float] | None = None
        self.low, self.high, self.count = [np.inf] * 3, [-np.inf] * 3, 0
        self.by_return = np.zeros(15, np.int64)

    def records(self, points: dict[str, np.ndarray]) -> bytes:
        n = len(points["X"])
        get = lambda c: np.nan_to_num(np.asarray(points[c])) if c in points else np.zeros(n, np.int64)
        whole = lambda c: get(c).astype(np.int64)
        if self.shift is None:
            self.shift = [float(np.floor(points[c][0])) if n else 0.0 for c in "XYZ"]
        rec = np.zeros(n, self.kind)
        for k, c in enumerate("XYZ"):
            steps = np.round((points[c] - self.shift[k]) / self.scale)
            if n and np.abs(steps).max() >= 2**31:
                raise ValueError(f"{c} spans more than 32 bits hold at scale {self.scale}")
            rec[c.lower()] = steps
            if n:
                exact = steps * self.scale + self.shift[k]
                self.low[k], self.high[k] = min(self.low[k], float(exact.min())), max(self.high[k], float(exact.max()))
        rec["intensity"], rec["class"], rec["user"], rec["source"], rec["gps"] = whole("Intensity"), whole("Classification"), whole("UserData"), whole("PointSourceId"), get("GpsTime")
        rec["bits"] = whole("ReturnNumber") & 15 | whole("NumberOfReturns") << 4
        rec["flags"] = sum(whole(c) << k for c, k in (("Synthetic", 0), ("KeyPoint", 1), ("Withheld", 2), ("Overlap", 3), ("ScanDirectionFlag", 6), ("EdgeOfFlightLine", 7)))
        rec["angle"] = np.round(whole("ScanAngleRank") / 0.006)
        if self.format == 7:
            rec["red"], rec["green"], rec["blue"] = whole("Red"), whole("Green"), whole("Blue")
        self.count += n
        self.by_return += np.bincount(np.clip(whole("ReturnNumber"), 1, 15) - 1, minlength=15)
        return rec.tobytes()

    def header(self) -> bytes:
        keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, self.epsg) if self.epsg else b""
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 34735, len(keys), b"") + keys if self.epsg else b""
        head = bytearray(375)
        head[:4], head[24:26] = b"LASF", bytes([1, 4])
        struct.pack_into("<HHHIIBH", head, 90, 1, self.year, 375, 375 + len(vlr), 1 if self.epsg else 0, self.format, self.kind.itemsize)
        some = self.count > 0
        bounds = [v for k in range(3) for v in ((self.high[k], self.low[k]) if some else (0.0, 0.0))]
        struct.pack_into("<12d", head, 131, *[self.scale] * 3, *(self.shift or [0.0] * 3), *bounds)
        struct.pack_into("<Q15Q", head, 247, self.count, *self.by_return.tolist())
        return bytes(head) + vlr


def encode_las(points: pd.DataFrame, scale: float = 0.01, year: int = 2021, epsg: int = 0) -> bytes:
    """One LAS 1.4 file from X, Y, Z and whichever attributes are there; :func:`write_las` writes DataFrames."""
    body = LasBody(epsg, scale, year, "Red" in points)
    records = body.records({c: points[c].to_numpy() for c in points.columns})
    return body.header() + records


def write_las(points: DataFrame, path: str, epsg: int = 0, scale: float = 0.01, year: int = 2021) -> None:
    """Writes each partition as a LAS 1.4 file in the folder ``path``; files appear only when all are written."""
    register(points.sparkSession)
    points.write.format("las").mode("append").option("epsg", epsg).option("scale", scale).option("year", year).save(path)


def register(spark: SparkSession) -> None:
    """Makes ``format("las")`` known to the session."""
    from arbora.sources.las_source import LasSource

    spark.dataSource.register(LasSource)
