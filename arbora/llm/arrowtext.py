"""Arrow and numpy kernels over columns of text, used inside Spark tasks.

Every kernel works on a slice of an Arrow batch whose text holds about
``SLICE_BYTES`` bytes, so a task's memory follows that bound and the longest
single text, not the batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
ROWS_PER_BATCH = 1000
_WINDOW = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE[[1, 32]] = 0
_STEP = np.uint64(int(_BYTE_CODE[77]) | 1)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(step: np.uint64) -> np.ndarray:
    out = np.full(_WINDOW, step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP), _powers(_INVERSE)

#: What separates words; what ends a sentence (its white space belongs to neither side).
NOT_WORD = r"[^\p{L}\p{M}\p{N}\x01]+"
SENTENCE_END = r"[.!?]+[ \t\r\n]+|[。！？]+[ \t\r\n]*|[ \t\r]*\n[ \t\r\n]*"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows, so that long texts fit in a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, that all machines share.

    A local folder is taken only by a session in one JVM that names none, as in
    tests; a cluster must name one.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in :func:`shared_folder` and read back, so that later steps read only the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a table by :func:`written` that nothing reads any more."""
    spark, path = df.sparkSession, df._written_to
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(texts: pa.Array, sentences: bool = False) -> pa.Array:
    """Lower-case words with one space between; null gives "".

    With ``sentences``, each sentence end becomes the byte 1.
    """
    out = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.string()))
    if sentences:
        out = pc.replace_substring_regex(pc.replace_substring(out, "\x01", " "), SENTENCE_END, "\x01")
        return pc.replace_substring_regex(out, NOT_WORD, " ")
    return pc.replace_substring_regex(out, NOT_WORD.replace(r"\x01", ""), " ")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins (one entry more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    buffers = texts.buffers()
    if buffers[2] is None or not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    first = np.frombuffer(buffers[1], np.int32, 1, texts.offset * 4)[0]
    return np.frombuffer(buffers[2], np.uint8, int(offsets[-1]), int(first)), offsets


class Words:
    """Words of folded texts: ``hashes`` (uint64), byte ``starts``, and ``offsets`` of each text's words."""

    def __init__(self, texts: pa.Array, prefix_bytes: int = 0):
        self.data, self.text_at = bytes_of(texts)
        data, n = self.data, len(self.data)
        inside = data > 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = self.text_at[:-1]
        begin = begin[begin < n]
        first[begin] = inside[begin]
        self.starts = np.flatnonzero(first)
        self.offsets = np.searchsorted(self.starts, self.text_at)
        self.hashes = self._hash(data, self.starts)
        self.prefixes = None
        if prefix_bytes:
            gap = np.diff(np.append(self.starts, n))
            total = np.zeros(len(self.starts), np.uint64)
            alive = np.ones(len(self.starts), bool)
            for k in range(prefix_bytes):
                at = np.minimum(self.starts + k, max(n - 1, 0))
                alive &= (k < gap) & (inside[at] if n else False)
                total += np.where(alive, _BYTE_CODE[data[at]] * _UP[k], np.uint64(0))
            self.prefixes = mix64(total ^ np.uint64(0x5851F42D4C957F2D))

    @staticmethod
    def _hash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        scale, shrink = np.uint64(1), np.ones(len(starts), np.uint64)
        up = np.uint64(pow(int(_STEP), _WINDOW, 1 << 64))
        down = np.uint64(pow(int(_INVERSE), _WINDOW, 1 << 64))
        back = np.uint64(1)
        with np.errstate(over="ignore"):
            for base in range(0, len(data), _WINDOW):
                part = data[base : base + _WINDOW]
                lo, hi = np.searchsorted(starts, [base, base + len(part)])
                value = _BYTE_CODE[part] * _UP[: len(part)]
                local = starts[lo:hi] - base
                cuts = local if len(local) and local[0] == 0 else np.concatenate([[0], local])
                sums = np.add.reduceat(value, cuts) * scale
                if len(cuts) > len(local):  # the rest of the word that began before
                    if lo:
                        out[lo - 1] += sums[0]
                    sums = sums[1:]
                out[lo:hi] += sums
                shrink[lo:hi] = _DOWN[local] * back
                scale, back = scale * up, back * down
            return mix64(out * shrink)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` values; a shorter row gives one hash of all of it."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width_here = min(width, n)
    out = np.zeros(n - width_here + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width_here):
            out = out * _STEP + hashes[k : n - width_here + 1 + k]
        return mix64(out ^ np.uint64(width_here))


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
