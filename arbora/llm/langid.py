"""Language identification by nearest centroids.

A text becomes a vector of hashed byte trigrams of its lower-case letters,
weighted ``(1 + ln tf) * idf`` and scaled to length one. Each language
has several centroids, clustered by cosine from a sample of its labelled rows;
a text gets the language of the centroid with the largest cosine. A text whose
best cosine is below the learned threshold is rejected.

The classifier is fitted on a bounded sample: about ``rows_per_language``
labelled rows of each language (rows whose hashed id falls under that share),
so what comes to the driver is ``languages * rows_per_language`` vectors of
``DIMENSIONS`` small numbers. Scoring is one pass without a shuffle.

Null text, empty text and text without a letter: language ``und``, score 0,
rejected. Rows without a language never train. No labelled row at all: every
row is ``und``. Ties go to the language that sorts first. Repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import arrow_map, bytes_of, folded, slices

DIMENSIONS = 4096
ROWS_PER_LANGUAGE = 256
CENTROIDS = 3
MAX_LANGUAGES = 512
#: A text is rejected below this part of the cosine that 99 % of the sample exceed.
REJECT_PART = 0.3
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    threshold: float


def _counts(texts: pa.Array) -> np.ndarray:
    """A row of trigram counts for each text; blanks next to blanks don't count."""
    data, at = bytes_of(folded(texts))
    data = np.where((data >= 48) & (data <= 57), np.uint8(32), data)  # digits are of no language
    rows = len(at) - 1
    out = np.zeros((rows, DIMENSIONS), np.float32)
    step = 64
    for lo in range(0, rows, step):
        hi = min(rows, lo + step)
        piece = data[at[lo] : at[hi]].astype(np.uint32)
        if len(piece) < 3:
            continue
        code = piece[:-2] | piece[1:-1] << np.uint32(8) | piece[2:] << np.uint32(16)
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))[:-2]
        whole = np.repeat(at[lo + 1 : hi + 1] - at[lo], np.diff(at[lo : hi + 1]))[:-2] >= np.arange(len(row)) + 3
        key = row[whole] * DIMENSIONS + slot[whole]
        out[lo:hi] = np.bincount(key, minlength=(hi - lo) * DIMENSIONS).reshape(hi - lo, DIMENSIONS)
    return out


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        unit = np.array(centres) / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centres.append(x[int(np.argmin((x @ unit.T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(10):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _sample_vectors(batches):
    for batch in batches:
        for part in slices(batch):
            counts = _counts(part.column("text")).astype(np.uint32)
            yield pa.record_batch({"lang": part.column("lang"), "counts": pa.array([r.tobytes() for r in counts], pa.binary())})


def fit(docs: DataFrame, learn: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` is true.

    About ``rows_per_language`` rows of each language are taken, by a hash of id
    and text. Every task holds the centroids, so more than ``MAX_LANGUAGES``
    labels are an error.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    totals = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return LanguageModel((), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.ones(DIMENSIONS, np.float32), 0.0)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows_per_language / r["count"]))) for r in totals])
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    table = arrow_map(rows.where(chance < share).select("lang", "text"), _sample_vectors, "lang string, counts binary").toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    counts = np.array([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()], np.float32).reshape(-1, DIMENSIONS)
    order = np.lexsort((counts @ np.arange(1, DIMENSIONS + 1, dtype=np.float64), langs.astype(str)))
    langs, counts = langs[order], counts[order]
    idf = (1 + np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0)))).astype(np.float32)
    x = _scaled(counts, idf)
    names = tuple(sorted(set(langs)))
    groups = [_clusters(x[langs == name], CENTROIDS) for name in names]
    centroids = np.concatenate(groups) if groups else np.zeros((0, DIMENSIONS), np.float32)
    owner = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    own = (x @ centroids.T).max(axis=1) if len(x) else np.zeros(1)
    return LanguageModel(names, centroids, owner, idf, float(np.quantile(own, 0.01)) * REJECT_PART)


_RESULTS = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``, which replace any of their names."""
    stay = [k for k, c in enumerate(keep) if c not in _RESULTS]
    out = _labelled(docs, model, keep)
    return out.select(*[F.col(f"c{k}").alias(keep[k]) for k in stay], *[F.col(f"__{c}").alias(c) for c in _RESULTS])


def _labelled(docs: DataFrame, model: LanguageModel, given: tuple[str, ...]) -> DataFrame:
    """The given columns as c0, c1, ... and the results with two underscores before their names."""
    keep = [f"c{k}" for k in range(len(given))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(c).alias(k) for c, k in zip(given, keep, strict=True)], F.col("text").alias("__text"))
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(given, keep, strict=True)) + ", __lang_pred string, __score double, __rejected boolean"

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "__text"):
                text = part.column("__text")
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if len(m.languages):
                    cosine = _scaled(_counts(text), m.idf) @ m.centroids.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                    lang = np.where(letters, m.owner[best], len(m.languages))
                else:
                    score, lang = np.zeros(len(letters)), np.zeros(len(letters), int)
                score = np.where(letters, score, 0.0).astype(np.float64)
                yield pa.record_batch(
                    [*(part.column(c) for c in keep), pa.array(names[lang], pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold) | (lang == len(m.languages)))],
                    names=[*keep, "__lang_pred", "__score", "__rejected"],
                )

    return arrow_map(kept, run, schema)


def identify(docs: DataFrame, learn: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fits on the labelled rows and labels every row."""
    return predict(docs, fit(docs, learn, rows_per_language), keep)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    given = tuple(docs.columns)
    out = _labelled(docs, fit(docs), given).where("not __rejected")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(given)])
