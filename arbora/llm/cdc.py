"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 UTF-8 bytes decides where chunks end: it must
have eight leading zero bits before the normal chunk size and four after it
(normalised chunking), between a smallest and a largest size. As the hash sees
only nearby bytes, an edit moves the boundaries near it and the chunking falls
into step again, however far the text was shifted. A fingerprint is the set of
chunk digests with their lengths, and the containment of A in B is the share
of A's distinct chunk length that B has too.

``probe_edits`` also compares each document with an edited text and with the
next document in descending order of id. Rows meet their successor inside
ranges of the id, one range to a task, where the first row of the next range
comes along as a guest; so there is one shuffle of the texts and no task sees
more than its range.

Null text counts as empty. Empty texts have the empty fingerprint, which is
contained in an empty one only. Equal ids are ordered by text, null ids come
last, and the only row of a table is its own successor. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import arrow_map

SMALLEST, NORMAL, LARGEST = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 8, 4
_GEAR = np.random.default_rng(6).integers(0, 1 << 32, 256, dtype=np.uint32)
_REACH = 32
_WINDOW = 1 << 17


def _gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum of gear values of the last 32 bytes, each doubled once per step back."""
    h = _GEAR[data]
    span = 1
    while span < _REACH:
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def _marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a chunk may end (exclusive), by the strict and by the loose rule."""
    strict, loose = [], []
    for base in range(0, len(data), _WINDOW):
        lead = min(base, _REACH)
        h = _gear(data[base - lead : base + _WINDOW])[lead:]
        at = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
        strict.append(at[h[at] < np.uint32(1 << (32 - STRICT_BITS))] + base + 1)
        loose.append(at + base + 1)
    return np.concatenate(strict).tolist(), np.concatenate(loose).tolist()


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``, in order."""
    n, ends, at = len(data), [], 0
    if not n:
        return ends
    strict, loose = _marks(np.frombuffer(data, np.uint8))
    while n - at > SMALLEST:
        k = bisect_left(strict, at + SMALLEST)
        if k < len(strict) and strict[k] < at + NORMAL:
            at = strict[k]
        else:
            k = bisect_left(loose, at + NORMAL)
            at = loose[k] if k < len(loose) and loose[k] <= at + LARGEST else min(n, at + LARGEST)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[int, int]:
    """Distinct chunk digests (48 bits) and their lengths, by digest."""
    out, at, view = {}, 0, memoryview(data)
    for end in chunk_ends(data):
        out[xxhash.xxh64_intdigest(view[at:end]) >> 16] = end - at
        at = end
    return dict(sorted(out.items()))


def fingerprint(found: dict[int, int]) -> str:
    return " ".join(f"{digest:012x}:{length}" for digest, length in found.items())


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's distinct chunk length that b holds; of nothing: 1 in nothing, else 0."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and ``chunks`` (digest, length) of every whole text."""
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("length", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [[{"digest": d, "length": n} for d, n in chunks(t.encode()).items()] for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, kind)], names=["doc_id", "n_chars", "chunks"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_chars bigint, chunks array<struct<digest: bigint, length: int>>")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_PROBED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probe(batches):
    """Rows come in the order of a range, its guest last."""
    held, rows = None, []

    def flush():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            bucket, guest = batch.column("bucket")[k].as_py(), batch.column("guest")[k].as_py()
            text = batch.column("text")[k].as_py() or ""
            found = None
            if held is not None and held[0] == bucket:
                _, doc, mine, own = held
                found = chunks(text.encode())
                changed = edited(mine, text)
                other = chunks(changed.encode())
                rows.append((doc, len(mine), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(own), fingerprint(other), containment(own, other), containment(own, found)))
            held = None if guest else (bucket, batch.column("doc_id")[k].as_py(), text, chunks(text.encode()) if found is None else found)
            if len(rows) >= 500:
                yield flush()
                rows = []
    if rows:
        yield flush()


def probe_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if cuts:
        ranges = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="__range", handleInvalid="keep")
        place = lambda df: ranges.transform(df.withColumn("__at", F.col("doc_id").cast("double"))).withColumn(
            "bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - F.col("__range")).cast("int")
        )
    else:
        place = lambda df: df.withColumn("bucket", F.lit(0))
    heads = sorted((r["bucket"], r["head"]) for r in place(rows.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    links = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]  # one for each range at most
    guests = spark.createDataFrame(links, "head bigint, host int")
    placed = place(rows).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    sent = F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    placed = placed.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, sent))).alias("at"))
    dealt = placed.select("doc_id", "text", "at.*").repartitionById(max(1, len(cuts) + 1), F.col("bucket"))
    ordered = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return arrow_map(ordered, _probe, _PROBED)
