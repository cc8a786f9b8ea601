"""Hard-negative mining: rows of another label that score near an anchor's positives.

A score is the integer inner product of vectors of whole numbers
(:mod:`arbora.llm.vectors`). An anchor's positives are its best rows of the same
label; for each of them, the window of scores from ``low`` to ``high`` hundredths
of the positive's score holds its negatives, of which the best are returned.
Higher scores come first, ties by smaller id.

The kth score of a window is found by distributed radix selection. A task counts
the scores of its rows in each window in 256 equal buckets; the counts of all
tasks are added up, which gives the bucket of the kth row; the next pass divides
that bucket in 256, until it is one score. A task sends no bucket below the one
in which it has k rows itself, as the kth of all can't lie there. A last pass
gathers the rows above that score, and of those at it each task's smallest ids,
no more than are still wanted. So only counts and qualifying rows are shuffled,
a window's rows at the end are few whatever the data, and ties (copies of one
vector, say) cost no more than others.

Anchors are a stated query set against all rows, in pages of ``PAGE`` anchors
that are broadcast; each pass reads the rows in place, without a shuffle. The
work is anchors times rows.

Rows with a null label, or whose vector takes no part, take none; nor do rows of
another length than the vector of the smallest id. A row with a null id is no
anchor but may be found, last among ties. Rows that repeat an id are rows of
their own: each anchor row gets its answer, and each is found by others; other
rows of an anchor are those of other ids. Of the input only the id, vector and
label columns are read, so other columns may have any names. An empty table, or
one without anchors, gives no rows. Scores over 64 bits are an error. A label is
a whole number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm import vectors
from arbora.llm.arrowtext import arrow_map, checkpointed

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
PAGE = 4096
#: Buckets of a digit, and anchors whose scores a worker holds at a time.
BUCKETS, _AT_ONCE = 256, 1024
_NO_ID = np.iinfo(np.int64).max


class Windows:
    """Score intervals [lo, hi] of a page's anchors, ``per`` for each anchor in order, narrowed to the kth row's.

    ``above`` counts rows between the interval and ``end``, the window's upper
    end; ``want`` is k, ``open`` whether the interval is still to be divided.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: int, same: bool):
        self.ids, self.labels, self.values, self.same = ids, labels, values, same
        self.lo, self.hi, self.want = lo.astype(np.int64), hi.astype(np.int64), want
        self.end, self.above = self.hi.copy(), np.zeros(len(lo), np.int64)
        self.per = len(lo) // max(len(ids), 1)

    @property
    def open(self) -> np.ndarray:
        return self.lo < self.hi

    def width(self) -> np.ndarray:
        return np.maximum(-((self.lo - self.hi - 1) // BUCKETS), 1)

    def narrowed(self, window: int, bucket: int, above: int) -> None:
        width = int(self.width()[window])
        top = int(self.hi[window]) - bucket * width
        self.lo[window] = max(int(self.lo[window]), top - width + 1)
        self.hi[window], self.above[window] = top, above


def _pairs(batch: pa.RecordBatch, size: int, w: Windows, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Window, row of the batch and score of all that lie in the intervals [lo, hi]."""
    values = vectors.numbers(batch.column("vector"), size)
    ids, labels = batch.column("id").fill_null(_NO_ID).to_numpy(), batch.column("label").to_numpy()
    kind = vectors.exact(max(np.abs(values).max(initial=0), np.abs(w.values).max(initial=0)), size)
    rows, anchors = values.T.astype(kind), w.values.astype(kind)
    lo, hi = lo.reshape(-1, w.per), hi.reshape(-1, w.per)
    for at in range(0, len(w.ids), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        scores = (anchors[part] @ rows).astype(np.int64)
        fit = (scores >= lo[part].min(1, initial=_NO_ID)[:, None]) & (scores <= hi[part].max(1, initial=-_NO_ID)[:, None])
        fit &= (w.labels[part, None] == labels) == w.same
        if w.same:
            fit &= w.ids[part, None] != ids
        a, r = np.nonzero(fit)
        score = scores[a, r]
        for j in range(w.per):
            inside = (score >= lo[part][a, j]) & (score <= hi[part][a, j])
            yield (at + a[inside]) * w.per + j, r[inside], score[inside]


def _counted(rows: DataFrame, size: int, shared) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        n, width, wanted = np.zeros(len(w.lo) * BUCKETS, np.int32), w.width(), w.want - w.above
        lo, hi = np.where(w.open, w.lo, _NO_ID), np.where(w.open, w.hi, -_NO_ID)
        for batch in batches:
            for window, _, score in _pairs(batch, size, w, lo, hi):
                np.add.at(n, window * BUCKETS + (w.hi[window] - score) // width[window], 1)
        n = n.reshape(-1, BUCKETS)
        before = np.cumsum(n, 1) - n
        window, bucket = np.nonzero((n > 0) & (before < wanted[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(bucket), pa.array(n[window, bucket].astype(np.int64)), pa.array(wanted[window])], names=["window", "bucket", "n", "wanted"])

    return arrow_map(rows, count, "window bigint, bucket bigint, n bigint, wanted bigint")


def _narrowed(rows: DataFrame, size: int, w: Windows) -> Windows:
    """``w`` narrowed to the score of each window's kth row, a digit at a time; with fewer rows than k a window stays whole."""
    spark = rows.sparkSession
    while w.open.any():
        shared = spark.sparkContext.broadcast(w)
        counts = _counted(rows, size, shared).groupBy("window", "bucket", "wanted").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
        kth = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        found = kth.select("window", "bucket", (F.col("upto") - F.col("n")).alias("before")).collect()
        divided = np.zeros(len(w.lo), bool)
        for r in found:
            divided[r["window"]] = True
            w.narrowed(r["window"], r["bucket"], int(w.above[r["window"]]) + r["before"])
        few = w.open & ~divided  # all its rows are wanted: the least score is the bound, and no tie is cut
        w.hi[few], w.above[few] = w.lo[few], -1
        shared.unpersist()
    return w


def _gathered(rows: DataFrame, size: int, w: Windows) -> DataFrame:
    """Columns ``window``, ``id``, ``score``: the rows above each window's kth score, and at it each task's smallest ids."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        ties: list[np.ndarray] = []
        every = w.above < 0
        for batch in batches:
            ids = batch.column("id")
            sortable = ids.fill_null(_NO_ID).to_numpy()
            for window, row, score in _pairs(batch, size, w, w.lo, w.end):
                out = (score > w.lo[window]) | every[window]
                yield pa.RecordBatch.from_arrays([pa.array(window[out]), ids.take(pa.array(row[out])), pa.array(score[out])], names=["window", "id", "score"])
                ties.append(np.stack([window[~out], sortable[row[~out]]]))
            if ties:
                ties = [_smallest(np.concatenate(ties, 1), w.want - w.above)]
        if ties and ties[0].size:
            window, tied = ties[0]
            yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(tied, mask=tied == _NO_ID), pa.array(w.lo[window])], names=["window", "id", "score"])

    return arrow_map(rows, gather, "window bigint, id bigint, score bigint")


def _smallest(ties: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of (window, id) columns each window's ``wanted`` smallest ids."""
    ties = ties[:, np.lexsort((ties[1], ties[0]))]
    first = np.searchsorted(ties[0], ties[0])
    return ties[:, np.arange(ties.shape[1]) - first < wanted[ties[0]]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _page(rows: DataFrame, size: int, page: list, bound: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    ids, labels = (np.array([r[c] for r in page], np.int64) for c in ("id", "label"))
    values = np.floor(np.array([r["vector"] for r in page], np.float64).reshape(len(page), size) * vectors.SCALE)
    every = np.full(len(page), bound, np.int64)
    best = _ranked(_gathered(rows, size, _narrowed(rows, size, Windows(ids, labels, values, -every, every, positives, True))), positives).collect()
    score = np.zeros((len(page), positives), np.int64)
    there, found = np.zeros(score.shape, bool), np.zeros(score.shape, object)
    for r in best:
        at = r["window"], r["rank"] - 1
        score[at], there[at], found[at] = r["score"], True, r["id"]
    lo = np.where(there, -((-low * score) // 100), 1).ravel()
    hi = np.where(there, (high * score) // 100, 0).ravel()
    w = _narrowed(rows, size, Windows(ids, labels, values, lo, np.maximum(hi, lo - 1), negatives, False))
    windows = np.flatnonzero(there).tolist()
    of = rows.sparkSession.createDataFrame(
        list(zip(windows, np.repeat(ids, positives)[windows].tolist(), found[there].tolist(), score[there].tolist(), strict=True)),
        "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    picked = _ranked(_gathered(rows, size, w), negatives)
    return picked.join(F.broadcast(of), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(df: DataFrame, anchors: Callable[[Column], Column], id: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Columns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    ``anchors`` says of the id column which rows are anchors; ``low`` and ``high``
    are hundredths of the positive's score.
    """
    named = df.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector")).where(F.col("label").isNotNull())
    rows, size = vectors.taken(named, "id", "vector")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            most = max(most, float((vectors.numbers(batch.column("vector"), size) ** 2).sum(1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    most = arrow_map(rows.select("vector"), norms, "most double").agg(F.max("most")).head()[0] or 0.0
    if most >= 2.0**60:
        raise OverflowError("components are too large for 64-bit scores")
    chosen = checkpointed(rows.where(anchors(F.col("id"))))
    pages = max(1, -(-chosen.count() // PAGE))
    paged = chosen.withColumn("page", F.pmod(F.monotonically_increasing_id(), F.lit(pages)))
    out = []
    for k in range(pages):
        page = paged.where(F.col("page") == k).select("id", "label", "vector").collect()
        if page:
            out.append(_page(rows, size, page, int(most * (1 + 1e-9)) + 1, positives, negatives, low, high))
    none = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return reduce(DataFrame.unionAll, out) if out else df.sparkSession.createDataFrame([], none)
