"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in an order given by hashed ids, form blocks of
``block_size``. A source of weight ``w`` in a total of ``D`` has its k-th block
(from 0) released at slot ``floor(k*D/w)`` and due by ``ceil((k+1)*D/w)``. At
each slot the released block with the earliest deadline runs, so every source
stays less than one block from its share at every slot.

Weights are whole numbers, so the schedule repeats every ``D`` slots and is
worked out once for a period, a list as long as the total weight. When a
source has no blocks left, a new phase begins, in which the rest share the
slots by their weights. The driver sees only counts by source; a document's
slot is then arithmetic on its place in its source, and that place comes from
window functions over (source, bucket of the hashed id), so that no window
holds a whole source.

Files and shuffles keep no order of rows, so a mixed table says by what it was
mixed: the metadata of its ``source`` column hold the blocks and the weight of
each source, and its rows are placed again by those alone.

A null source is a source of its own. A source without a target gets
``default_weight``. Null ids and texts are ordinary rows, repeated rows take
a place each, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE = 16
BUCKETS = 1024
MAX_SOURCES = 1000
DEFAULT_WEIGHT = 1
METADATA = "mix"
#: Production targets, in parts.
TARGETS = {f"src{k}": 1 + k % 5 for k in range(20)}


def period(weights: list[int]) -> list[int]:
    """Which source runs in each slot of one period: earliest deadline first, ties to the earlier source."""
    total = sum(weights)
    done, out = [0] * len(weights), []
    for slot in range(total):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(weights) if done[i] * total // w <= slot]
        _, i = min(ready)
        done[i] += 1
        out.append(i)
    return out


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, int]) -> list[dict]:
    """For each phase and live source: its blocks ``first`` to ``last`` (exclusive), the phase's first slot, period and places in it."""
    left = dict(sorted(((s, n) for s, n in blocks.items() if n), key=lambda x: (x[0] is not None, x[0] or "")))
    taken = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        live = list(left)
        plan = period([weights[s] for s in live])
        places = {s: [t for t, i in enumerate(plan) if i == k] for k, s in enumerate(live)}
        ends = {s: (left[s] - 1) // len(places[s]) * len(plan) + places[s][(left[s] - 1) % len(places[s])] + 1 for s in live}
        length = min(ends.values())
        turns, rest = divmod(length, len(plan))
        for s in live:
            ran = turns * len(places[s]) + sum(t < rest for t in places[s])
            out.append({"source": s, "first": taken[s], "last": taken[s] + ran, "start": start, "period": len(plan), "places": places[s]})
            taken[s] += ran
            left[s] -= ran
        left = {s: n for s, n in left.items() if n}
        start += length
    return out


def _order(key: Column) -> Column:
    """28 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("bigint")


def settle(docs: DataFrame, targets: Mapping[str | None, int] | None = None, block_size: int = BLOCK_SIZE, default_weight: int = DEFAULT_WEIGHT) -> dict:
    """The mix of ``docs``: the size of blocks, and how many blocks and which weight each source has."""
    if block_size < 1 or default_weight < 1 or any(int(w) != w or w < 1 for w in (targets or {}).values()):
        raise ValueError("block size and weights must be whole numbers of at least one")
    weights = TARGETS if targets is None else targets
    totals = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["source"], r["n"]) for r in totals), key=lambda x: (x[0] is not None, x[0] or ""))
    return {"block_size": block_size, "sources": [{"source": s, "blocks": -(-n // block_size), "weight": int(weights.get(s, default_weight))} for s, n in found]}


def _placed(docs: DataFrame, settled: dict) -> DataFrame:
    """The columns of ``docs`` as ``c0``, ``c1``, ..., and ``block``, ``slot`` and ``place``; null in rows over the blocks that were settled."""
    kept = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*kept)
    source, doc = (F.col(kept[docs.columns.index(c)]) for c in ("source", "doc_id"))
    rows = rows.withColumn("__known", source.isNotNull()).withColumn("__source", F.coalesce(source.cast("string"), F.lit("")))
    # rows without an id are spread by all that they hold, rows with one by it alone
    spread = F.when(doc.isNull(), F.pmod(F.xxhash64(*[F.col(c) for c in kept]), F.lit(1 << 28))).otherwise(_order(doc))
    rows = rows.withColumn("__hash", spread).withColumn("__bucket", F.col("__hash") % BUCKETS)
    keys = ["__known", "__source", "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    running = Window.partitionBy("__known", "__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    plan = phases({x["source"]: x["blocks"] for x in settled["sources"]}, {x["source"]: x["weight"] for x in settled["sources"]})
    table = docs.sparkSession.createDataFrame(
        [(p["source"] is not None, p["source"] or "", p["first"], p["last"], p["start"], p["period"], p["places"]) for p in plan],
        "k2 boolean, s2 string, first bigint, last bigint, start bigint, period bigint, places array<int>",
    )
    texts = [F.xxhash64(*[F.col(c) for c in kept])]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__hash", doc, *texts))
    placed = rows.withColumn("__number", number).join(before, keys).withColumn("__nth", F.col("before") + F.col("__number") - 1)
    placed = placed.withColumn("__block", F.floor(F.col("__nth") / settled["block_size"]))
    # sources and phases are few: at most a row for each pair of sources that were counted
    within = (F.col("__block") >= F.col("first")) & (F.col("__block") < F.col("last"))
    placed = placed.join(F.broadcast(table), (F.col("__known") == F.col("k2")) & (F.col("__source") == F.col("s2")) & within, "left")
    nth = F.col("__block") - F.col("first")
    slot = F.col("start") + F.floor(nth / F.size("places")) * F.col("period") + F.get("places", (nth % F.size("places")).cast("int"))
    values = {"block": F.col("__block").cast("bigint"), "slot": slot.cast("bigint"), "place": (F.col("__nth") % settled["block_size"]).cast("int")}
    return placed.select(*kept, *[F.when(F.col("k2").isNotNull(), v).alias(name) for name, v in values.items()])


def place(docs: DataFrame, settled: dict) -> DataFrame:
    """``docs`` with ``__block`` (within the source), ``__slot`` of the block and ``__place`` of the row in its block, by what :func:`settle` gave."""
    return _placed(docs, settled).toDF(*docs.columns, "__block", "__slot", "__place")


def schedule(docs: DataFrame, targets: Mapping[str | None, int] | None = None, block_size: int = BLOCK_SIZE, default_weight: int = DEFAULT_WEIGHT) -> DataFrame:
    """``docs`` placed by the mix that :func:`settle` finds for them."""
    return place(docs, settle(docs, targets, block_size, default_weight))


def mix(docs: DataFrame, targets: Mapping[str | None, int] | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``docs``, with their own columns, in scheduled order; the metadata of ``source`` hold the mix, in Parquet too."""
    settled = settle(docs, targets, block_size)
    out = _placed(docs, settled).orderBy("slot", "place")
    noted = {c: docs.schema[c].metadata | ({METADATA: settled} if c == "source" else {}) for c in docs.columns}
    return out.select(*[F.col(f"c{k}").alias(c, metadata=noted[c]) for k, c in enumerate(docs.columns)])


def mixed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows of :func:`mix`, in any order: ``columns``, and the ``slot`` and ``place`` by the mix that they came with; without one these are null."""
    out = _placed(docs, docs.schema["source"].metadata.get(METADATA, {"block_size": BLOCK_SIZE, "sources": []}))
    return out.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in columns], "slot", "place")
