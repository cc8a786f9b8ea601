"""Substring dedup by sliding sentence spans.

A text is cut into sentences. The spans are runs of two or more sentences with
``MIN_WORDS`` words: for every sentence the shortest that begins there and the
shortest that ends there. So whatever run of sentences two texts share, if it
has that many words, spans that lie inside it cover all of it. A sentence of
``LONG_SENTENCE`` words is a span by itself too, and a text of several sentences
with fewer than ``MIN_WORDS`` words is one as a whole. Spans are known by 128
bits of hashes of their folded words. A span's first occurrence is the one in
the document with the lowest id, there the earliest. Every sentence that another
occurrence covers is removed with the separator that follows it; the rest of
the text stays as it is.

Spans meet in a global aggregate, which combines before the shuffle, and an
equi-join that Spark can split where a span is very common; what a text loses
is then gathered by id and text. Each span goes out once for a document.

Null and empty texts have no spans and stay. Rows that share an id count as
one document: what only they share stays, and each text loses its own covered
sentences. Null ids count together as the last document. Texts of any length
are taken whole. An empty table gives no rows. The other columns pass through,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import _INVERSE, _STEP, SENTENCE_END, Words, arrow_map, folded, mix64, slices

MIN_WORDS = 25
LONG_SENTENCE = 50
_CUT = re.compile(SENTENCE_END)
_LAST = (1 << 63) - 1
_OTHER = np.uint64(0xA0761D6478BD642F)


class Spans:
    """The spans of a slice of texts: their hashes, ``first`` and ``last`` sentence, with ``offsets`` by text."""

    def __init__(self, texts: pa.Array):
        words = Words(folded(texts, sentences=True))
        ends = np.flatnonzero(words.data == 1)
        before = np.searchsorted(ends, words.starts)
        first_end = np.searchsorted(ends, words.text_at[:-1])
        text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        # sentences that have words, in order: where each begins among the words
        fresh = np.ones(len(text), bool)
        fresh[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(fresh)
        self.number = before[begin] - first_end[text[begin]]
        owner = text[begin]
        n_words = len(text)
        starts_at = np.append(begin, n_words)
        self.first, self.last = self._runs(starts_at, owner, len(begin))
        lo, hi = starts_at[self.first], starts_at[self.last + 1]
        self.high = self._run_hashes(words.hashes, lo, hi)
        with np.errstate(over="ignore"):
            self.low = self._run_hashes(mix64(words.hashes * _OTHER), lo, hi)
        self.owner = owner[self.first]
        self.offsets = np.searchsorted(self.owner, np.arange(len(words.offsets)))

    @staticmethod
    def _runs(starts_at: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentence of each span, by first and then last."""
        at = np.arange(n)
        start, stop = np.searchsorted(owner, owner, side="left"), np.searchsorted(owner, owner, side="right")
        size = np.diff(starts_at)
        # the shortest run from each sentence on, and up to each, that has enough words
        last = np.maximum(np.searchsorted(starts_at, starts_at[:-1] + MIN_WORDS), at + 2) - 1
        first = np.minimum(np.searchsorted(starts_at, starts_at[1:] - MIN_WORDS, side="right") - 1, at - 1)
        onward, upward = last < stop, first >= start
        alone = size >= LONG_SENTENCE
        short = (at == start) & (stop - start > 1) & (starts_at[stop] - starts_at[start] < MIN_WORDS)
        found = np.unique(np.concatenate([at[onward], first[upward], at[alone], at[short]]) * (n + 1) + np.concatenate([last[onward], at[upward], at[alone], stop[short] - 1]))
        return found // (n + 1), found % (n + 1)

    @staticmethod
    def _run_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A hash of each run of words, from running sums of powers."""
        with np.errstate(over="ignore"):
            n = len(hashes)
            up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _STEP, np.uint64)]))
            down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]))
            total = np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * up[:n])])
            return mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _emit(batches):
    for batch in batches:
        for part in slices(batch, "__text"):
            spans = Spans(part.column("__text"))
            # each span once for a text, with whether it comes again there
            order = np.lexsort((spans.low, spans.high, spans.owner))
            own, high, low = spans.owner[order], spans.high[order], spans.low[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            at = np.flatnonzero(new)
            again = np.diff(np.append(at, len(own))) > 1
            doc, digest = (part.column(c).to_numpy(zero_copy_only=False)[own[at]] for c in ("__doc", "__digest"))
            yield pa.record_batch({"high": pa.array(high[at].view(np.int64)), "low": pa.array(low[at].view(np.int64)), "__doc": pa.array(doc), "__digest": pa.array(digest), "again": pa.array(again)})


def _without(text: str, gone: set[int]) -> str:
    """``text`` without the sentences of those numbers and the separators after them."""
    parts, at, number = [], 0, 0
    for cut in _CUT.finditer(text.replace("\x01", " ")):
        if number not in gone:
            parts.append(text[at : cut.end()])
        at, number = cut.end(), number + 1
    if number not in gone:
        parts.append(text[at:])
    return "".join(parts)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """The id, and a digest of the text that tells rows of one id apart where what they lose is gathered."""
    return [F.coalesce(docs[doc_id].cast("bigint"), F.lit(_LAST)).alias("__doc"), F.xxhash64(docs[text]).alias("__digest")]


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rewritten, and the count ``removed_sentences`` of each row."""
    work = docs.where("text is not null").select(*_keyed(docs, "doc_id", "text"), F.col("text").alias("__text"))
    found = arrow_map(work, _emit, "high bigint, low bigint, __doc bigint, __digest bigint, again boolean")
    shared = (
        found.groupBy("high", "low")
        .agg(F.min("__doc").alias("first"), F.max("__doc").alias("last"), F.max("again").alias("any_again"))
        .where((F.col("first") != F.col("last")) | F.col("any_again"))
        .select("high", "low", "first")
    )
    # a document loses every occurrence of a span that it isn't the first to have, and all but its earliest otherwise
    hits = found.join(shared, ["high", "low"]).where((F.col("__doc") != F.col("first")) | F.col("again"))
    lost = hits.groupBy("__doc", "__digest").agg(F.collect_set(F.struct("high", "low", (F.col("__doc") == F.col("first")).alias("keep_one"))).alias("__lost"))
    kept = [f"c{k}" for k in range(len(docs.columns))]
    at_text = docs.columns.index("text")
    rows = docs.toDF(*kept)
    rows = rows.select("*", *_keyed(rows, kept[docs.columns.index("doc_id")], kept[at_text]))
    joined = rows.join(lost, ["__doc", "__digest"], "left").select(*kept, "__lost")
    schema = ", ".join(f"`{name}` {f.dataType.simpleString()}" for name, f in zip(kept, docs.schema, strict=True)) + ", removed int"

    def run(batches):
        for batch in batches:
            for part in slices(batch, kept[at_text]):
                texts, removed = part.column(at_text), np.zeros(part.num_rows, np.int32)
                losses = part.column("__lost")
                touched = np.flatnonzero(losses.is_valid().to_numpy(zero_copy_only=False))
                if len(touched):
                    some = texts.take(pa.array(touched))
                    spans, new = Spans(some), texts.to_pylist()
                    for k, row in enumerate(touched):
                        lo, hi = spans.offsets[k], spans.offsets[k + 1]
                        rules = {(r["high"], r["low"]): r["keep_one"] for r in losses[int(row)].as_py()}
                        gone: set[int] = set()
                        for j in range(lo, hi):
                            h = int(spans.high[j].view(np.int64)), int(spans.low[j].view(np.int64))
                            if h in rules:
                                if rules[h]:
                                    rules[h] = False  # the first occurrence of all stays
                                else:
                                    gone.update(spans.number[spans.first[j] : spans.last[j] + 1].tolist())
                        if gone:
                            new[row] = _without(new[row], gone)
                            removed[row] = len(gone)
                    texts = pa.array(new, pa.string())
                columns = [texts if k == at_text else part.column(k) for k in range(len(kept))]
                yield pa.record_batch([*columns, pa.array(removed)], names=[*kept, "removed"])

    done = arrow_map(joined, run, schema)
    return done.select(*[F.col(c).alias(name) for c, name in zip(kept, docs.columns, strict=True)], F.col("removed").alias("removed_sentences"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` after substring dedup, with their own columns and ``n_chars`` counted anew."""
    out = dedup_spans(docs).drop("removed_sentences")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out
