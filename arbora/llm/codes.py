"""Compression of vectors to codes: one codebook for each of 16 parts, fitted by Lloyd rounds with Elkan's bounds.

A vector of whole numbers (:mod:`arbora.llm.vectors`) is cut into equal parts.
Each part position has a codebook, at first that part of the 64 smallest ids.
A round assigns each part to its nearest entry (squared Euclidean distance,
ties to the lower index) and moves each entry to the componentwise
floor(sum / count) of its parts; an unused entry stays. Parts are assigned once
more after the last round.

The bounds are kept with the rows, in a table that each round writes anew: of
each part an upper bound to its own entry and a lower bound to each entry. When
entries have moved, the upper bound grows by the movement of its entry and the
lower ones shrink by those of theirs. An entry is left out only if its lower
bound, or half its distance to the own entry, is strictly more than the upper
bound; the others get integer distances, so ties are decided exactly. Bounds
are rounded outwards. Of a fit only sums by part and entry are shuffled, and
the codebooks (64 vectors) come to the driver.

Size: a row of the table holds 2 bytes a lower bound (16 * 64 of them), 4 an
upper bound and 4 a component.

Rows whose vector takes no part are dropped; so are those of another length than
that of the smallest id (see :mod:`arbora.llm.vectors`). With fewer than 64 rows
the codebooks have as many entries. Ids may be null (last in order) or repeated
(ties go by components); labels may be null. Of the input only the id, vector
and label columns are read, so other columns may have any names. An empty table
gives an empty result. A length that 16 doesn't divide is an error, as are
components whose squared distances exceed 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import vectors
from arbora.llm.arrowtext import arrow_map, forget, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Labels up to which their sums are broadcast (some 50 bytes each); beyond, they are joined with a salt.
BROADCAST_LABELS, SALTS = 200_000, 64
_UNIT, _OUT = 16.0, 1 + 1e-12
_STATE = "id bigint, label bigint, parts binary, code binary, upper binary, lower binary, distances bigint"


def _down(squared: np.ndarray) -> np.ndarray:
    """Lower bounds of distances, in sixteenths."""
    return np.minimum(np.floor(np.sqrt(squared.astype(np.float64)) * (_UNIT / _OUT)), 65535).astype(np.uint16)


def _up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(squared.astype(np.float64)) * _OUT).astype(np.float32), np.float32(np.inf))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` and ``b``."""
    kind = vectors.exact(2 * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)), a.shape[-1])
    d = a.astype(kind) - b.astype(kind)
    return (d * d).sum(-1).astype(np.int64)


def first_assignment(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bounds and lower bounds of ``x`` (parts, rows, width) by all distances to ``books`` (parts, entries, width)."""
    kind = vectors.exact(2 * max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)), x.shape[-1])
    a, b = x.astype(kind), books.astype(kind)
    squared = (a * a).sum(2)[:, :, None] - 2 * (a @ b.transpose(0, 2, 1)) + (b * b).sum(2)[:, None, :]
    code = squared.argmin(2)
    return code, _up(np.take_along_axis(squared, code[..., None], 2)[..., 0]), _down(squared)


class Moved:
    """Codebooks before and after a round: how far entries moved, and half the distances between the new ones."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.books = new
        self.move = np.sqrt(_squared(old, new).astype(np.float64)) * _OUT
        between = _squared(new[:, :, None, :], new[:, None, :, :]).astype(np.float64)
        self.half = np.sqrt(between) / (2 * _OUT)


def next_assignment(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved, with how many distances were worked out."""
    parts, rows, _ = x.shape
    p, i = np.arange(parts)[:, None], np.arange(rows)[None, :]
    top = upper.astype(np.float64) + moved.move[p, code]
    low = np.maximum(lower / _UNIT - moved.move[:, None, :], 0.0)
    half = moved.half[p, code]
    open_ = (low <= top[..., None]) & (half <= top[..., None])
    open_[p, i, code] = False
    code, top = code.copy(), (top * _OUT).astype(np.float32)
    top = np.nextafter(top, np.float32(np.inf))
    pp, ii = np.nonzero(open_.any(2))
    own = _squared(x[pp, ii], moved.books[pp, code[pp, ii]])
    tight = np.sqrt(own.astype(np.float64)) * _OUT
    still = open_[pp, ii] & (low[pp, ii] <= tight[:, None]) & (half[pp, ii] <= tight[:, None])
    k, c = np.nonzero(still)
    other = _squared(x[pp[k], ii[k]], moved.books[pp[k], c])
    squared = np.full(still.shape, np.iinfo(np.int64).max)
    squared[np.arange(len(pp)), code[pp, ii]] = own
    squared[k, c] = other
    best = squared.argmin(1)
    low = np.floor(low * _UNIT).astype(np.uint16)
    low[pp, ii, code[pp, ii]] = _down(own)
    low[pp[k], ii[k], c] = _down(other)
    code[pp, ii] = best
    top[pp, ii] = _up(squared[np.arange(len(pp)), best])
    return code, top, low, len(own) + len(other)


def _by_part(values: np.ndarray, parts: int) -> np.ndarray:
    return np.ascontiguousarray(values.reshape(len(values), parts, -1).transpose(1, 0, 2))


def _blobs(values: np.ndarray) -> pa.Array:
    """A binary value for each row of (parts, rows, ...)."""
    rows = np.ascontiguousarray(np.moveaxis(values, 0, 1))
    size = rows[0].nbytes if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(rows)])


def _read(batch: pa.RecordBatch, name: str, kind: type, parts: int) -> np.ndarray:
    column = batch.column(name)
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return np.moveaxis(flat.reshape(batch.num_rows, parts, -1), 0, 1)


def _state(batch: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    columns = [batch.column("id"), batch.column("label"), _blobs(x.astype(np.int32)), _blobs(code.astype(np.uint8)), _blobs(upper.astype(np.float32)), _blobs(lower), pa.array(distances)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "label", "parts", "code", "upper", "lower", "distances"])


def _assigned_first(df: DataFrame, books: np.ndarray, size: int) -> DataFrame:
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _by_part(vectors.numbers(batch.column("vector"), size), parts)
            if np.abs(x).max(initial=0) >= 2.0**31:
                raise OverflowError("components are too large for 64-bit sums of their products")
            code, upper, lower = first_assignment(x, books)
            yield _state(batch, x, code, upper, lower, np.full(batch.num_rows, books.shape[0] * books.shape[1]))

    return arrow_map(df, assign, _STATE)


def _assigned_next(state: DataFrame, moved: Moved) -> DataFrame:
    parts = len(moved.books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _read(batch, "parts", np.int32, parts).astype(np.int64)
            code, upper, lower = (_read(batch, n, k, parts) for n, k in (("code", np.uint8), ("upper", np.float32), ("lower", np.uint16)))
            code, upper, lower, _ = counted = next_assignment(x, code[..., 0].astype(np.int64), upper[..., 0], lower, moved)
            share = np.full(batch.num_rows, counted[3] // batch.num_rows)
            share[: counted[3] % batch.num_rows] += 1
            yield _state(batch, x, code, upper, lower, batch.column("distances").to_numpy() + share)

    return arrow_map(state, assign, _STATE)


def _new_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = _read(batch, "parts", np.int32, parts).astype(np.int64), _read(batch, "code", np.uint8, parts)[..., 0]
                for p in range(parts):
                    np.add.at(total[p], code[p], x[p])
                    count[p] += np.bincount(code[p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p * entries + e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    found = arrow_map(state.select("parts", "code"), sums, "entry bigint, n bigint, sums array<bigint>")
    totals = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    new = books.copy()
    for row in totals.collect():
        p, e = divmod(row["entry"], entries)
        new[p, e] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return new


def fit(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows with their final code, and the codebooks (parts, entries, width).

    Columns ``id``, ``label``, ``parts`` (the whole numbers), ``code`` (a byte a
    part) and ``distances``, how many were worked out for the row's batch, spread
    over its rows. The rows lie in the shared folder of ``spark.checkpoint.dir``.
    """
    if not 1 <= entries <= 256 or rounds < 1:
        raise ValueError("between 1 and 256 entries, and a round at least")
    kept, size = vectors.taken(df.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector")), "id", "vector")
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    first = kept.select("id", F.transform("vector", lambda x: F.floor(x.cast("double") * vectors.SCALE)).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    state = written(_assigned_first(kept, books, size))
    for _ in range(rounds):
        new = _new_books(state, books)
        again = written(_assigned_next(state, Moved(books, new)))
        forget(state)
        state, books = again, new
    return state, books


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors of whole numbers that codes (rows, parts) stand for."""
    return books[np.arange(len(books))[None, :], codes].reshape(len(codes), -1)


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Columns ``id``, ``code`` (two hex digits a part), ``error``, ``label_error`` (summed over equal labels, nulls together), ``codebooks_sha256`` and ``n_distances``."""
    state, books = fit(df, id, vector, label, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, code = _read(batch, "parts", np.int32, parts).astype(np.int64), _read(batch, "code", np.uint8, parts)[..., 0]
                error = _squared(x, books[np.arange(parts)[:, None], code]).sum(0)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("code"), pa.array(error), batch.column("distances")], names=["id", "label", "code", "error", "distances"])

    rows = arrow_map(state.select("id", "label", "parts", "code", "distances"), errors, "id bigint, label bigint, code binary, error bigint, distances bigint")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = F.pmod(F.hash("code"), F.lit(SALTS))
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(by_label.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of")))
    else:
        spread = by_label.withColumnRenamed("label", "of").withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salted).join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("with")))
    return joined.select(F.col("id").alias(id), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("distances").alias("n_distances"))
