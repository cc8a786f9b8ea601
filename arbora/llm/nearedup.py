"""Near-duplicate documents by improved consistent weighted sampling.

A text is the weighted set of its runs of five folded words (a shorter text is
one run). The weight of a run is ``tf * idf`` with
``idf = 1 + ln((1 + N) / (1 + df)) / ln(DAMP)``, where ``df`` counts the
documents that hold the run, exactly and over all of them; a run in fewer than
one of ``RARE`` documents weighs as if it were in so many. (So for up to
``RARE`` documents the weights are the plain formula's.) The idf is damped: a
plain logarithm would give the runs of a large group of near copies a small part
of the weight of the few runs that differ, and the copies would be lost.

Runs in more documents than that are found in two passes. The first counts
documents by ``SLOTS`` hashed slots, and a slot's count is no less than that of
any run in it; the second counts the runs of the slots over the bound one by
one. What is broadcast is a bit a slot and the runs over the bound, of which
there can be no more than ``RARE`` times the mean number of runs of a text,
however many texts there are.

``BANDS * ROWS`` consistent weighted samples (Ioffe, 2010) of each distinct
text form bands. Texts that share a band meet in two steps:

1. All meet the band's leader, the text that shares bands with most others. The
   weighted Jaccard similarity is worked out from whole texts; ``SIMILARITY``
   or more is a link, so most of a group of copies is joined by one comparison
   a text.
2. Those that aren't linked to their leader are compared with each other and
   with those that are, in blocks of bounded size, each in one task. Left out
   are only pairs that can't be links: by their total weights; by the triangle
   inequality for ``1 - similarity``, which is a metric, over their known
   similarities to the leader; pairs that another band holds too, and pairs
   that are already in one component.

So every two texts that share a band and are similar enough end up in one
class. As with all banding, that is a matter of chance: at similarity 0.8 a
pair shares a band in 99.7 % of cases. Equal texts are one node throughout;
classes are the connected components. The first step grows with the number of
texts, the second with the square of how many texts of one band are not linked
to its leader; nothing is left out for that.

Rows that share an id are one document in ``classes``; a null id is in no class
(class null). Null text equals nothing; texts without words equal texts with
the same characters. Texts of any length count as a whole. An empty table gives
no rows; other columns are ignored there and kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import _STEP, Words, arrow_map, checkpointed, folded, mix64, run_hashes, slices
from arbora.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
#: Documents per rarest frequency that is told apart; the base of the idf's damping; slots of the first count, some times ``RARE`` texts' runs.
RARE, DAMP, SLOTS = 1 << 14, 1 << 18, 1 << 25
_BLOCK, _ADDERS = 1 << 16, 128
#: Similarities under this aren't kept; two texts of which one is linked to a third and the other isn't even so similar to it aren't a link.
RELATED = 2 * SIMILARITY - 1
#: Texts, and weight (a run weighs 1 at least), of a block of the second step.
BLOCK, BLOCK_WEIGHT = 256, 2_000_000
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PIECE = 512
_CLOSE = 1e-9


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs & np.uint64(SLOTS - 1)).astype(np.int64)


class Idf:
    """idf of runs: those in ``heavy`` (ascending hashes) have values of their own, all others ``rest``."""

    def __init__(self, heavy: np.ndarray, value: np.ndarray, rest: float):
        self.heavy, self.value, self.rest = heavy, value.astype(np.float32), np.float32(rest)
        bits = np.zeros(SLOTS, bool)
        bits[_slot(heavy)] = True
        self.bits = np.packbits(bits)

    def of(self, runs: np.ndarray) -> np.ndarray:
        out = np.full(len(runs), self.rest, np.float32)
        maybe = np.flatnonzero(_has_bit(self.bits, runs))
        if len(maybe):
            at = np.minimum(np.searchsorted(self.heavy, runs[maybe]), len(self.heavy) - 1)
            found = self.heavy[at] == runs[maybe]
            out[maybe[found]] = self.value[at[found]]
        return out


def _has_bit(bits: np.ndarray, runs: np.ndarray) -> np.ndarray:
    slot = _slot(runs)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _document_runs(batches):
    """The distinct runs of each text, a slice of texts at a time."""
    for batch in batches:
        for part in slices(batch):
            words = Words(folded(part.column("text")))
            yield [np.unique(run_hashes(words.hashes[lo:hi], WIDTH)) for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True)]


def _full_slots(docs: DataFrame, bound: float) -> np.ndarray:
    """A bit for each slot that more than ``bound`` documents meet."""

    def count(batches):
        total, seen = np.zeros(SLOTS, np.uint16), 0

        def blocks():
            for k in np.flatnonzero(total.reshape(-1, _BLOCK).any(axis=1)):
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "counts": pa.array([pa.compress(total[k * _BLOCK : (k + 1) * _BLOCK].tobytes(), "zstd", asbytes=True)], pa.binary())})

        for texts in _document_runs(batches):
            for runs in texts:
                if seen == 65535:
                    yield from blocks()
                    total[:], seen = 0, 0
                total[_slot(runs)] += 1
                seen += 1
        yield from blocks()

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total = held.setdefault(k, np.zeros(_BLOCK, np.int64))
                total += np.frombuffer(pa.decompress(counts, 2 * _BLOCK, "zstd", asbytes=True), np.uint16)
        for k, total in held.items():
            if (total > bound).any():
                yield pa.record_batch({"block": pa.array([k], pa.int32()), "full": pa.array([np.packbits(total > bound).tobytes()], pa.binary())})

    counted = arrow_map(docs.select("text"), count, "block int, counts binary")
    full = arrow_map(counted.repartition(_ADDERS, "block"), add, "block int, full binary")
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in full.collect():  # a bit a slot in all
        bits[row["block"] * _BLOCK // 8 :][: _BLOCK // 8] = np.frombuffer(row["full"], np.uint8)
    return bits


def run_idf(docs: DataFrame) -> Idf:
    """idf by the documents that hold a run, over all documents."""
    n = docs.count()
    bound = max(1.0, n / RARE)
    shared = docs.sparkSession.sparkContext.broadcast(_full_slots(docs, bound))

    def count(batches):
        bits = shared.value
        for texts in _document_runs(batches):
            every = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
            run, times = np.unique(every[_has_bit(bits, every)], return_counts=True)
            yield pa.record_batch({"run": pa.array(run.view(np.int64)), "n": pa.array(times)})

    found = arrow_map(docs.select("text"), count, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > bound).toArrow()
    run, df = found.column("run").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.float64)
    order = np.argsort(run)
    value = lambda d: 1 + np.log((1 + n) / (1 + d)) / math.log(DAMP)
    return Idf(run[order], value(df[order]), value(bound))


def weighted_runs(hashes: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of a text's words, ascending, and their weights."""
    runs, times = np.unique(run_hashes(hashes, WIDTH), return_counts=True)
    return runs, times * idf.of(runs).astype(np.float64)


def _product(bits: np.ndarray) -> np.ndarray:
    """The product of two uniform numbers from the halves of each value, over 0; minus its log is Gamma(2, 1)."""
    halves = bits.view(np.int32).astype(np.float32) * np.float32(2.0**-32) + np.float32(0.5)
    return np.maximum(halves[:, 0::2] * halves[:, 1::2], np.float32(1e-19))


def samples(runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``HASHES`` consistent weighted samples, as 64-bit values."""
    best = np.full(HASHES, np.inf, np.float32)
    out = np.zeros(HASHES, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(runs), _PIECE):
            run = runs[lo : lo + _PIECE]
            z = mix64(run[:, None] ^ _SEEDS)
            y = (z ^ (z >> np.uint64(32))) * np.uint64(0xD1B54A32D192ED03)
            y ^= y >> np.uint64(29)
            r = np.maximum(-np.log(_product(z)), np.float32(1e-6))
            c = np.maximum(-np.log(_product(y)), np.float32(1e-30))
            beta = ((z * _STEP + y) >> np.uint64(41)).astype(np.int32).astype(np.float32) * np.float32(2.0**-23)
            t = np.floor(np.log(weights[lo : lo + _PIECE]).astype(np.float32)[:, None] / r + beta)
            a = np.log(c) - r * (t - beta + 1)
            at = a.argmin(axis=0)
            low = a[at, np.arange(HASHES)]
            better = low < best
            best = np.where(better, low, best)
            out = np.where(better, mix64(run[at] + t[at, np.arange(HASHES)].astype(np.int64).view(np.uint64) * _STEP), out)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of weighted runs."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = np.minimum(a[1][at[same]], b[1][same]).sum()
    union = a[1].sum() + b[1].sum() - both
    return float(both / union) if union else 0.0


def _halves(digest: int) -> list[int]:
    """128 bits as two signed values."""
    return [x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & 0xFFFFFFFFFFFFFFFF)]


def _identity(docs: DataFrame) -> list[Column]:
    """What names a row: nulls last, then ``did``, then the digest of its text."""
    did = docs["doc_id"].cast("bigint")
    return [did.isNull().alias("nameless"), F.coalesce(did, F.lit(0)).alias("did"), F.unhex(F.md5(docs["text"])).alias("digest")]


def sketches(docs: DataFrame, idf: Idf) -> DataFrame:
    """Each row's identity, text key (k1, k2), total weight and band keys; no bands without words. Null texts give no row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                words = Words(folded(part.column("text")))
                rows = []
                for k in range(part.num_rows):
                    own = words.hashes[words.offsets[k] : words.offsets[k + 1]]
                    if not len(own):
                        rows.append((*_halves(xxhash.xxh3_128_intdigest(part.column("text")[k].as_py(), seed=1)), 0.0, None))
                        continue
                    runs, weights = weighted_runs(own, table)
                    with np.errstate(over="ignore"):
                        grouped = samples(runs, weights).reshape(BANDS, ROWS)
                        key = np.arange(1, BANDS + 1, dtype=np.uint64)
                        for j in range(ROWS):
                            key = mix64(key * _STEP + grouped[:, j])
                    rows.append((*_halves(xxhash.xxh3_128_intdigest(own.tobytes())), float(weights.sum()), key.view(np.int64)))
                cols = list(zip(*rows, strict=True))
                own_columns = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)]
                yield pa.record_batch([*part.drop_columns(["text"]).columns, *own_columns], names=["nameless", "did", "digest", "k1", "k2", "weight", "bands"])

    given = docs.where("text is not null")
    schema = "nameless boolean, did bigint, digest binary, k1 bigint, k2 bigint, weight double, bands array<bigint>"
    return arrow_map(given.select(*_identity(given), "text"), run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """The pairs (a, b) whose ``similarity``, from whole texts (node, text), is ``RELATED`` or more."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches):
        table, last, known = shared.value, None, None
        for batch in batches:
            for part in slices(batch, "tb"):
                words, led, mine, score = Words(folded(part.column("tb"))), part.column("a").to_numpy(), part.column("ta"), np.zeros(part.num_rows)
                for k in range(part.num_rows):
                    if last != led[k]:  # rows come sorted by a, so a leader's runs serve its next pairs
                        last, known = led[k], weighted_runs(Words(folded(mine.slice(k, 1))).hashes, table)
                    score[k] = similarity(known, weighted_runs(words.hashes[words.offsets[k] : words.offsets[k + 1]], table))
                keep = pa.array(score >= RELATED - _CLOSE)
                yield pa.record_batch([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(score).filter(keep)], names=["a", "b", "similarity"])

    return arrow_map(two, run, "a bigint, b bigint, similarity double")


def _nodes(seen: DataFrame) -> DataFrame:
    """One row for each distinct text, with ``node``, a number that ascends with the least identity of its rows."""
    keeper = F.min(F.struct("nameless", "did", "digest")).alias("keeper")
    found = seen.groupBy("k1", "k2").agg(keeper, F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    return found.orderBy("keeper", "k1", "k2").withColumn("node", F.monotonically_increasing_id())


def _led(nodes: DataFrame) -> DataFrame:
    """The bands (key) that several texts share: key, node, leader.

    A text that shares its bands with many is central to its copies, so such a
    one leads. The joins give a row for each text and band, whoever shares it;
    what they look up is written first, so that both sides are plain shuffles,
    which Spark splits at a band that is large.
    """
    banded = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    sizes = checkpointed(banded.groupBy("key").agg(F.count("*").alias("n")))
    shared = banded.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("popular"), F.collect_list(F.struct("key", "n")).alias("keys"))
    rank = (F.floor(8 * F.log2("popular")) * (1 << 40) + F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("rank")
    met = shared.select("node", rank, F.explode(F.filter("keys", lambda k: k["n"] > 1)["key"]).alias("key"))
    leaders = checkpointed(met.groupBy("key").agg(F.max_by("node", "rank").alias("leader")))
    return met.join(leaders, "key").select("key", "node", "leader")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) that join all nodes of a class, the nodes, and the rows with their text keys (k1, k2)."""
    docs = docs.select("doc_id", "text")
    idf = run_idf(docs)
    seen = checkpointed(sketches(docs, idf))
    nodes = checkpointed(_nodes(seen))
    met = checkpointed(_led(nodes))
    some = met.select("node").distinct().join(nodes, "node").select("node", "keeper.did", "keeper.digest")
    given = docs.where("text is not null")
    texts = given.select(*_identity(given)[1:], "text").join(some, ["did", "digest"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = checkpointed(texts)
    pairs = met.where("leader != node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tested = checkpointed(_verified(pairs, texts, idf))
    found = checkpointed(_unled(met, tested, nodes, texts, idf))
    return tested.where(F.col("similarity") >= SIMILARITY - _CLOSE).select("a", "b").union(found.select("a", "b")), nodes, seen


def _unled(met: DataFrame, tested: DataFrame, nodes: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """Links (a, b) of the second step."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    known = tested.select(F.col("a").alias("leader"), F.col("b").alias("node"), "similarity")
    own = nodes.select("node", "weight", "bands")
    to_leader = F.when(F.col("leader") == F.col("node"), 1.0).otherwise(F.coalesce("similarity", F.lit(RELATED)))
    rows = met.join(known, ["leader", "node"], "left").join(own, "node").select("key", "node", "weight", "bands", to_leader.alias("to_leader"), (F.col("similarity") >= RELATED - _CLOSE).alias("related"))
    rows = rows.withColumn("out", F.col("to_leader") < SIMILARITY - _CLOSE)
    out, linked, near = F.col("out"), ~F.col("out"), F.col("out") & F.coalesce("related", F.lit(False))

    def blocks(of: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.count_if(of) / BLOCK), F.ceil(F.sum(F.when(of, F.col("weight"))) / BLOCK_WEIGHT)).cast("int")

    counts = rows.groupBy("key").agg(F.count_if(out).alias("n_out"), F.count_if(near).alias("n_near"), F.count_if(linked).alias("n_linked"), blocks(out).alias("outs"), blocks(linked).alias("mains"))
    # a leader has met all, and those far from it can't be links of those that are linked to it
    is_open = checkpointed(counts.where("n_out > 1 or n_near > 0 and n_linked > 1").select("key", "outs", "mains"))
    rows = rows.join(is_open, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.when(out, F.col("outs")).otherwise(F.col("mains"))).cast("int"))
    # cell (i, j): block i of those out with block j of them, or with block -1 - j of those linked; small bands are one cell
    cells = F.expr(
        """case when outs = 1 and mains = 1 then array(struct(0 as i, 0 as j))
                when out then concat(transform(sequence(0, outs - 1), x -> struct(least(block, x) as i, greatest(block, x) as j)),
                                     transform(sequence(0, mains - 1), x -> struct(block as i, -1 - x as j)))
                else transform(sequence(0, outs - 1), x -> struct(x as i, -1 - block as j)) end"""
    )
    placed = rows.select("key", "node", "weight", "bands", "to_leader", "out", "block", F.inline(cells))
    placed = placed.withColumn("side", F.when(~F.col("out"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1)).join(texts, "node")
    placed = placed.select("key", "i", "j", "side", "node", "weight", "bands", "to_leader", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def run(batches):
        for cell in _cells(batches):
            found = _cell_links(cell, shared.value)
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return arrow_map(placed, run, "a bigint, b bigint")


def _cells(batches):
    """Tables of the rows that have one (key, i, j); such rows come together."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and at != keys[:, lo].tolist():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = keys[:, lo].tolist()
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cell_links(cell: pa.Table, idf: Idf) -> list[tuple[int, int]]:
    """Links (a, b) that join all components that a link of the cell's left rows with its rows joins."""
    node, weight, known = (cell.column(c).to_numpy() for c in ("node", "weight", "to_leader"))
    side = cell.column("side").to_numpy()
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    earlier = int(np.flatnonzero(bands[0] == cell.column("key")[0].as_py())[0])
    left = np.flatnonzero(side == 0)
    # in a cell of one block its rows meet each other, in one of two those of the other
    right = np.arange(len(node)) if cell.column("i")[0].as_py() == cell.column("j")[0].as_py() else np.flatnonzero(side > 0)
    runs = []
    for batch in cell.select(["text"]).to_batches():
        for part in slices(batch):
            words = Words(folded(part.column("text")))
            runs += [weighted_runs(words.hashes[lo:hi], idf) for lo, hi in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    size = np.array([len(r) for r, _ in runs])
    begin = np.concatenate([[0], np.cumsum(size)])
    vocabulary, item = np.unique(np.concatenate([r for r, _ in runs]), return_inverse=True)
    value = np.concatenate([w for _, w in runs])
    component = np.where(side == 2, -1, np.arange(len(node)))
    mine, out = np.zeros(len(vocabulary)), []
    for a in left:
        possible = (np.minimum(weight[a], weight[right]) >= np.maximum(weight[a], weight[right]) * (SIMILARITY - _CLOSE)) & (np.abs(known[right] - known[a]) <= 1 - SIMILARITY + _CLOSE)
        possible &= (component[right] != component[a]) & ((side[right] > 0) | (right > a)) & ~(bands[right, :earlier] == bands[a, :earlier]).any(axis=1)
        others = right[possible]
        if not len(others):
            continue
        own = slice(begin[a], begin[a + 1])
        mine[item[own]] = value[own]
        first = np.cumsum(size[others]) - size[others]
        where = np.repeat(begin[others] - first, size[others]) + np.arange(size[others].sum())
        both = np.add.reduceat(np.minimum(mine[item[where]], value[where]), first)
        mine[item[own]] = 0
        for k in np.flatnonzero(both >= (SIMILARITY - _CLOSE) * (weight[a] + weight[others] - both)):
            b = others[k]
            if component[b] != component[a]:
                out.append((int(node[a]), int(node[b])))
                component[component == component[b]] = component[a]
    return out


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with the ``label`` of their class, its least node, and the rows with their text keys."""
    found, nodes, seen = links(docs)
    label = components(found)
    return nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), seen


def classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, ``class_id`` (the smallest id of its class) and ``kept`` (it is that one)."""
    labelled, seen = _labelled(docs)
    least = labelled.where("node = label and not keeper.nameless").select("label", F.col("keeper.did").alias("class_id"))
    texts = labelled.select("k1", "k2", "label").join(least, "label")
    classed = seen.where("not nameless").join(texts, ["k1", "k2"]).groupBy("did").agg(F.min("class_id").alias("class_id"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    out = ids.join(classed, ids["doc_id"] == classed["did"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.coalesce("class_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns: the least by id (nulls last), then by text.

    Of rows with equal id and text one stays, chosen by a hash of its other
    columns; rows with null text all stay.
    """
    labelled, _ = _labelled(docs)
    kept = labelled.where("node = label").select("keeper.nameless", "keeper.did", "keeper.digest")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.where("text is not null")
    whole = rows.select(*_identity(rows), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    others = F.struct(*[F.col("row")[n].alias(n) for c, n in zip(docs.columns, names, strict=True) if c not in ("doc_id", "text")], F.lit(0).alias("rest"))
    one = whole.groupBy("nameless", "did", "digest").agg(F.min_by("row", F.xxhash64(F.to_json(others))).alias("row")).join(kept, ["nameless", "did", "digest"], "left_semi")
    return one.select(*[F.col("row")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)]).union(docs.where("text is null"))
