"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with words ``w`` has probability
``p = sigmoid(b + sum of weights of its words and word beginnings)``, and the
document's is the noisy-or ``1 - prod(1 - p)``. Only documents have labels:
the weights maximise the likelihood of the document labels, and the learned
``p`` then tells which sentences offend.

The classifier is fitted on a bounded sample, about ``positives`` and
``negatives`` labelled rows, taken by hashed id; scoring is one pass over
whole texts without a shuffle. Labels, language, source and id are no inputs.

Null and empty texts have no sentence and score 0. A document labelled twice
counts as toxic if one label says so. No label at all: every score is 0.
Repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import SENTENCE_END, Words, arrow_map, folded, slices

BITS = 18
POSITIVES, NEGATIVES = 2000, 4000
PREFIX_BYTES = 4
#: A feature gets a weight if so many sampled documents have it, and its share among toxic ones lies so many standard errors above the rest.
MIN_DOCUMENTS, MIN_LIFT = 5, 4.0
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
_CUT = re.compile(SENTENCE_END)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots (a row of two for each word), each word's sentence, and the offsets of each text's words."""
    words = Words(folded(texts, sentences=True), PREFIX_BYTES)
    shift = np.uint64(64 - BITS)
    slots = np.stack([words.hashes >> shift, words.prefixes >> shift], axis=1).astype(np.int32)
    ends = np.flatnonzero(words.data == 1)
    before = np.searchsorted(ends, words.starts)
    first = np.searchsorted(ends, words.text_at[:-1])
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    return slots, before - first[text], words.offsets


def _sample_counts(batches):
    """How many documents of each label have each feature; slot -1 counts the documents."""
    seen, many = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for part in slices(batch):
            slots, _, at = _features(part.column("text"))
            for k, toxic in enumerate(part.column("toxic").to_pylist()):
                seen[int(toxic > 0), np.unique(slots[at[k] : at[k + 1]])] += 1
                many[int(toxic > 0)] += 1
    for label in (0, 1):
        some = np.flatnonzero(seen[label])
        yield pa.record_batch({"label": pa.array(np.full(len(some) + 1, label, np.int32)), "slot": pa.array(np.append(some, -1).astype(np.int32)), "n": pa.array(np.append(seen[label][some], many[label]))})


def _chosen(seen: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The slots that lean to toxic documents, by counts of documents for each label and slot."""
    share, both = seen / many[:, None], seen.sum(axis=0) / many.sum()
    lift = (share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both) * (1 / many).sum(), 1e-12))
    return np.flatnonzero((seen.sum(axis=0) >= MIN_DOCUMENTS) & (lift >= MIN_LIFT))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _train(known: np.ndarray, bags: list[tuple[int, int, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> ToxicityModel:
    """Adam on the likelihood of the bags' labels. bags: label, sentences, and of each chosen feature its column and sentence."""
    size = 1 << BITS
    sizes = np.array([n for _, n, _, _ in bags])
    begin = np.cumsum(sizes) - sizes
    columns = [c for _, _, c, _ in bags]
    sentence_of = [s + at for (_, _, _, s), at in zip(bags, begin, strict=True)]
    bag_of_sentence, labels, total = [np.repeat(np.arange(len(bags)), sizes)], [label for label, *_ in bags], int(sizes.sum())
    column, row = np.concatenate(columns), np.concatenate(sentence_of)
    bag, y = np.concatenate(bag_of_sentence), np.array(labels, float)
    w, b = np.zeros(len(known)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[column], minlength=total)
        some = np.bincount(bag, _softplus(z), minlength=len(y))
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(some, 50)), 1e-9), 1.0) / len(y)
        gz = pull[bag] / (1 + np.exp(-np.clip(z, -700, 700)))
        gw = np.bincount(column, gz[row], minlength=len(w)) + ridge * w / len(y) ** 0.5
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    weights = np.zeros(size, np.float32)
    weights[known] = w
    return ToxicityModel(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> ToxicityModel:
    """Learns ``labels.toxic`` from the documents for which ``learn``, a condition on ``doc_id``, is true."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    hits, rest = counts["p"], counts["n"] - counts["p"]
    if not hits or not rest:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -np.inf if not hits else np.inf)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("bags")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, positives / hits))).otherwise(F.lit(min(1.0, negatives / rest)))
    sample = known.where(chance < share)  # about positives + negatives rows, so it can be broadcast
    bags = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    table = arrow_map(bags, _sample_counts, "label int, slot int, n bigint").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    label, slot, n = (table.column(c).to_numpy() for c in ("label", "slot", "n"))
    seen, many = np.zeros((2, 1 << BITS)), np.zeros(2)
    seen[label[slot >= 0], slot[slot >= 0]] = n[slot >= 0]
    many[label[slot < 0]] = n[slot < 0]
    if not many.all():  # the sampled labels have no documents
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -np.inf)
    known = _chosen(seen, many)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def chosen_features(batches):
        for batch in batches:
            for part in slices(batch):
                slots, sentence, at = _features(part.column("text"))
                use, rows = shared.value[slots], []
                for k, toxic in enumerate(part.column("toxic").to_pylist()):
                    own, said = use[at[k] : at[k + 1]], sentence[at[k] : at[k + 1]]
                    rows.append((int(toxic > 0), int(said.max()) + 1 if len(said) else 0, own[own >= 0].tobytes(), np.repeat(said[:, None], 2, axis=1)[own >= 0].astype(np.int32).tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["label", "sentences", "columns", "sentence"])

    # of a sampled text only the chosen features come to the driver
    table = arrow_map(bags, chosen_features, "label int, sentences int, columns binary, sentence binary").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("label", "sentences", "columns", "sentence")), strict=True))
    return _train(known, [(t, n, np.frombuffer(c, np.int32), np.frombuffer(i, np.int32)) for t, n, c, i in rows])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``score``, ``predicted``, and ``offending``: sentences (position, probability, text) of 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, score double, predicted int, offending array<struct<position: int, probability: double, sentence: string>>"
    kind = pa.list_(pa.struct([("position", pa.int32()), ("probability", pa.float64()), ("sentence", pa.string())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                slots, sentence, at = _features(texts)
                value = m.weights[slots].sum(axis=1, dtype=np.float64)
                scores, found = np.zeros(part.num_rows), []
                for k in range(part.num_rows):
                    lo, hi = at[k], at[k + 1]
                    if lo == hi:
                        found.append([])
                        continue
                    own, z = np.unique(sentence[lo:hi]), np.bincount(sentence[lo:hi], value[lo:hi])
                    z = z[own] + m.bias
                    scores[k] = -np.expm1(-_softplus(z).sum())
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    hot = np.flatnonzero(p >= SENTENCE_THRESHOLD)
                    said = _CUT.split(texts[k].as_py().replace("\x01", " ")) if len(hot) else []
                    found.append([{"position": int(own[j]), "probability": float(p[j]), "sentence": said[own[j]] if own[j] < len(said) else None} for j in hot])
                predicted = (scores >= threshold).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.array(scores), pa.array(predicted), pa.array(found, kind)], names=["doc_id", "score", "predicted", "offending"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)
