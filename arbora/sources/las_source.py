"""``spark.read.format("las")`` and ``df.write.format("las")``.

Options to read: ``path`` (a file, folder or pattern) or ``paths`` (a JSON list),
``columns`` (by comma), ``box`` (min_x, min_y, max_x, max_y by comma), ``classes``
(by comma), ``year``, ``chunk`` (points of a partition), and ``pushdown``: with
"true", and ``spark.sql.python.filterPushdown.enabled`` set, comparisons of X, Y
and Classification in the query narrow the box and the classes. To write:
``path``, ``epsg``, ``scale`` and ``year``.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from arbora.sources import las
from arbora.sources.files import Ranges, listed, store_of


def _split(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text is not None else None


@dataclass
class LasRange(InputPartition):
    file: str
    at: int
    n: int
    head: dict


class LasReader(DataSourceReader):
    """Plans ranges from headers, and reads them."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.names = [f.name for f in schema.fields]
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.chunk, self.year = int(options.get("chunk", las.CHUNK)), int(options["year"]) if options.get("year") else None
        box, classes = _split(options.get("box")), _split(options.get("classes"))
        self.box = [float(v) for v in box] if box else [-math.inf, -math.inf, math.inf, math.inf]
        self.classes = {int(c) for c in classes} if classes is not None else None

    def partitions(self) -> list[LasRange]:
        def plan(file: str, size: int) -> list[LasRange]:
            with Ranges(file) as read:
                head = las.header_by(read)
            if wrong := las.problem(head, size):
                raise ValueError(f"{file}: {wrong}")
            x0, y0, x1, y1 = self.box
            if head["max_x"] < x0 - 1e-6 or head["min_x"] > x1 + 1e-6 or head["max_y"] < y0 - 1e-6 or head["min_y"] > y1 + 1e-6:
                return []
            return [LasRange(file, at, min(self.chunk, head["n_points"] - at), head) for at in range(0, head["n_points"], self.chunk)]

        with ThreadPoolExecutor(16) as pool:
            return [r for rs in pool.map(lambda f: plan(*f), listed(self.paths, las.SUFFIXES)) for r in rs]

    def read(self, partition: LasRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        kinds = {"file": pa.string(), "Year": pa.int32(), "X": pa.float64(), "Y": pa.float64()}
        small = {"double": pa.float64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
        schema = pa.schema([(n, kinds.get(n) or small[las.ATTRIBUTES[n].simpleString()]) for n in self.names])
        box = tuple(self.box) if any(map(math.isfinite, self.box)) else None
        yield from las.range_batches(partition.file, partition.at, partition.n, partition.head, schema, self.year, box, tuple(sorted(self.classes)) if self.classes is not None else None)


class PushedLasReader(LasReader):
    """The same, narrowed by the query's comparisons; Spark still checks them all."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        axis = {("X",): 0, ("Y",): 1}
        for f in filters:
            where = axis.get(tuple(getattr(f, "attribute", ())))
            if where is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.box[where] = max(self.box[where], float(f.value))
            if where is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.box[where + 2] = min(self.box[where + 2], float(f.value))
            if tuple(getattr(f, "attribute", ())) == ("Classification",) and isinstance(f, (EqualTo, In)):
                some = {int(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.classes = some if self.classes is None else self.classes & some
            yield f


@dataclass
class LasFile(WriterCommitMessage):
    written: str
    name: str


class LasWriter(DataSourceArrowWriter):
    """A file for each task, under a hidden name until the job commits."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("LAS files are appended to a folder, not overwritten")
        missing = {"X", "Y", "Z"} - {f.name for f in schema.fields}
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        self.path, self.colours = options["path"].rstrip("/"), "Red" in [f.name for f in schema.fields]
        self.epsg, self.scale, self.year = int(options.get("epsg", 0)), float(options.get("scale", 0.01)), int(options.get("year", 2021))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> LasFile | None:
        body = las.LasBody(self.epsg, self.scale, self.year, self.colours)
        store, folder = store_of(self.path)
        with tempfile.TemporaryFile() as held:  # a task's own; the header needs the counts, and stores take no seeks
            for batch in iterator:
                if batch.num_rows:
                    held.write(body.records({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}))
            if not body.count:
                return None
            held.seek(0)
            name = f"part-{uuid.uuid4().hex}.las"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/.{name}") as out:
                out.write(body.header())
                while block := held.read(4 << 20):
                    out.write(block)
        return LasFile(f"{folder}/.{name}", f"{folder}/{name}")

    def commit(self, messages: list[LasFile | None]) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None:
                store.move(m.written, m.name)

    def abort(self, messages: list[LasFile | None]) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.written)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        columns = _split(self.options.get("columns"))
        return las.las_schema(tuple(columns) if columns else None)

    def reader(self, schema: StructType) -> LasReader:
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (PushedLasReader if pushed else LasReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), schema, overwrite)
