"""Unigram encoding and decoding over a double-array trie of pieces.

A text gets one blank in front; blanks stand for the white-space marker of
pieces. It splits into words, each one or more blanks and what follows up to
the next blank, which no piece crosses. Each distinct word of a slice is
segmented once: the trie is walked from every character at the same time, and
a Viterbi pass takes the segmentation with the largest sum of log scores (ties
to the piece that begins earlier). A character that is no piece costs more
than any piece and becomes its UTF-8 bytes' pieces. Decoding joins the pieces'
bytes and drops the blank in front, so that every text comes back exactly; a
marker character that stands in a text is encoded by bytes and so comes back
too.

The pieces are those of a public SentencePiece file, read on the driver and
broadcast (their number is fixed by the file). That file belongs to a
pair-merging model and has merge ranks in place of log probabilities, so a
piece's score is the log of a Zipf-Mandelbrot probability of its rank.

Null text: null ids. Empty text: no ids. Texts of any length are encoded whole.
Repeated rows are encoded alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import arrow_map, bytes_of, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
ZIPF_SHIFT = 2.7
UNKNOWN_COST = 10.0
_BLOCK = 1 << 19


@dataclass(frozen=True)
class Trie:
    """A double array: from state s, byte c leads to ``base[s] + c`` if ``check`` there is s. ``piece`` ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    depth: int


@dataclass(frozen=True)
class Pieces:
    spelling: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray
    trie: Trie
    worst: float


def build_trie(entries: list[tuple[bytes, int]]) -> Trie:
    """The double array of distinct byte strings, in any order."""
    tree: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for spelling, piece in entries:
        node = 0
        for c in spelling:
            after = tree[node].get(c)
            if after is None:
                after = tree[node][c] = len(tree)
                tree.append({})
                ends.append(-1)
            node = after
        ends[node] = piece
    size = 4 * len(tree) + 512
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    state_of, free, hint = {0: 0}, 256, 256  # so that no base is below one
    for node in _breadth_first(tree):
        children = tree[node]
        state = state_of[node]
        if not children:
            continue
        codes = sorted(children)
        free = used.index(0, free)
        # a lone child takes the first free place; several start where the last search that was long ended
        at = (free if len(codes) == 1 else max(free, hint)) - codes[0]
        tries = 0
        while any(used[at + c] for c in codes):
            at += 1
            tries += 1
        if tries > 32:
            hint = at + codes[0]
        base[state] = at
        for c in codes:
            used[at + c] = 1
            check[at + c] = state
            state_of[children[c]] = at + c
            piece[at + c] = ends[children[c]]
    return Trie(base, check, piece, max((len(s) for s, _ in entries), default=0))


def _breadth_first(tree: list[dict[int, int]]):
    level = [0]
    while level:
        yield from level
        level = [child for node in level for child in tree[node].values()]


def load_pieces(path: str = MODEL) -> Pieces:
    """The pieces of a SentencePiece file that has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.vocab_size()
    bytes_at, spelling, entries = np.full(256, -1, np.int32), [b""] * count, []
    scores = np.full(count, -np.inf)
    for k in range(count):
        name = model.id_to_piece(k)
        if model.is_byte(k):
            bytes_at[int(name[3:5], 16)] = k
            spelling[k] = bytes([int(name[3:5], 16)])
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            spelling[k] = name.replace(MARKER, " ").encode()
            scores[k] = -np.log(len(entries) + 1 + ZIPF_SHIFT)
            entries.append((spelling[k], k))
    if (bytes_at < 0).any():
        raise ValueError("the file lacks byte pieces")
    scores -= np.log(np.exp(scores[np.isfinite(scores)]).sum())
    return Pieces(spelling, scores, bytes_at, build_trie(entries), float(scores[np.isfinite(scores)].min()) - UNKNOWN_COST)


def segment(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of adjoining words (bytes ``starts`` to ``ends`` of ``data``), and the number of ids of each word."""
    trie, n = pieces.trie, len(data)
    begin = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # character starts
    word = np.searchsorted(starts, begin, side="right") - 1
    limit = ends[word].astype(np.int32)
    width = np.diff(np.append(begin, n)).astype(np.int32)
    here, state, at, stop = np.arange(len(begin), dtype=np.int32), np.zeros(len(begin), np.int32), begin.copy(), limit
    froms, tos, ids = [], [], []
    single = np.zeros(len(begin), bool)
    for depth in range(1, trie.depth + 1):
        to = trie.base[state] + data[at]
        ok = trie.check[to] == state
        here, state, at, stop = here[ok], to[ok], at[ok] + 1, stop[ok]
        if not len(here):
            break
        found = trie.piece[state]
        hit = found >= 0
        froms.append(here[hit])
        tos.append(at[hit])
        ids.append(found[hit])
        single[here[hit][width[here[hit]] == depth]] = True
        more = at < stop
        here, state, at, stop = here[more], state[more], at[more], stop[more]
    alone = np.flatnonzero(~single).astype(np.int32)
    froms.append(alone)
    tos.append(begin[alone] + width[alone])
    ids.append(np.full(len(alone), -1, np.int32))
    origin, to, piece = begin[np.concatenate(froms)], np.concatenate(tos), np.concatenate(ids)
    score = np.where(piece >= 0, pieces.scores[piece], pieces.worst)
    # arcs by the offset of their start in its word: all arcs into a place have smaller offsets
    offset = origin - starts[word[np.concatenate(froms)]]
    order = np.argsort(offset, kind="stable")
    cuts = np.flatnonzero(np.diff(offset[order])) + 1
    origin, to, piece, score = origin[order], to[order], piece[order], score[order]
    best = np.full(n + 1, -np.inf)
    back, via = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    base = np.zeros(n + 1)  # the score at a word's start is 0, though another word may end there
    inner = np.ones(n + 1, bool)
    inner[starts] = False
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(origin)), strict=True):
        s, e = origin[lo:hi], to[lo:hi]
        new = np.where(inner[s], best[s], base[s]) + score[lo:hi]
        better = new > best[e]
        e = e[better]
        best[e], back[e], via[e] = new[better], s[better], piece[lo:hi][better]
    at, first = ends.copy(), starts
    taken_at, taken = [], []
    while len(at):
        taken_at.append(back[at])
        taken.append(via[at])
        at = back[at]
        more = at > first
        at, first = at[more], first[more]
    place = np.concatenate(taken_at) if taken_at else np.zeros(0, np.int32)
    chosen = np.concatenate(taken) if taken else np.zeros(0, np.int32)
    order = np.argsort(place)
    place, chosen = place[order], chosen[order]
    known = np.searchsorted(begin, place)
    times = np.where(chosen >= 0, 1, width[known])
    source = np.repeat(place, times)
    step = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
    out = np.where(np.repeat(chosen, times) >= 0, np.repeat(chosen, times), pieces.bytes_at[data[source + step]])
    counts = np.bincount(np.searchsorted(starts, source, side="right") - 1, minlength=len(starts))
    return out.astype(np.int32), counts


def encode_slice(texts: pa.Array, pieces: Pieces) -> pa.ListArray:
    """The ids of each text."""
    some = pc.fill_null(texts, "").cast(pa.string())
    led = pc.if_else(pc.equal(pc.binary_length(some), 0), "", pc.binary_join_element_wise(" ", some, ""))
    data, text_at = bytes_of(led)
    if not len(data):
        return pa.array([None if not v else [] for v in texts.is_valid().to_pylist()], pa.list_(pa.int32()))
    blank = data == 32
    starts = blank.copy()
    starts[1:] &= ~blank[:-1]
    starts[text_at[:-1][text_at[:-1] < len(data)]] = True
    starts = np.flatnonzero(starts)
    offsets = np.append(starts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    raw, at = bytes_of(words.dictionary)
    ids, counts, lo = [], [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _BLOCK, side="right")) - 1)
        got, n = segment(raw[at[lo] : at[hi]], at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo], pieces)
        ids.append(got)
        counts.append(n)
        lo = hi
    known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    spread = known.take(words.indices)
    cut = np.searchsorted(starts, text_at)
    by_word = spread.offsets.to_numpy()
    out = pa.ListArray.from_arrays(pa.array((by_word[cut] - by_word[0]).astype(np.int32)), spread.flatten())
    return out if not texts.null_count else pc.if_else(texts.is_valid(), out, pa.scalar(None, out.type))


def decode_slice(ids: pa.ListArray, spelling: pa.Array) -> pa.Array:
    """The text of each list of ids, as bytes."""
    flat = pc.list_flatten(ids)
    joined = spelling.take(flat)
    data, at = bytes_of_binary(joined)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = at[np.concatenate([[0], np.cumsum(sizes)])]
    out = [None if not ok else data[lo + (hi > lo) : hi].tobytes() for ok, lo, hi in zip(ids.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)]
    return pa.array(out, pa.binary())


def bytes_of_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    buffers = values.buffers()
    first = np.frombuffer(buffers[1], np.int32, 1, values.offset * 4)[0] if len(values) else 0
    return (np.frombuffer(buffers[2], np.uint8, int(at[-1]), int(first)) if at[-1] else np.zeros(0, np.uint8)), at


def _pieces_only(ids: pa.ListArray, count: int) -> pa.ListArray:
    """``ids`` with ``count`` in place of what is no number below it."""
    flat = pc.fill_null(ids.flatten(), -1)
    whole = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, count)), flat, pa.scalar(count, flat.type))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), whole, mask=ids.is_null())


def encode(docs: DataFrame, path: str = MODEL, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``ids``, ``n_ids`` and ``round_trip``: whether the decoded ids are the text again; then the columns ``carried``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches):
        pieces = shared.value
        spelling = pa.array(pieces.spelling, pa.binary())
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                ids = encode_slice(text, pieces)
                same = pc.fill_null(pc.equal(decode_slice(ids, spelling), text.cast(pa.binary())), True)
                more = [part.column(c) for c in carried]
                yield pa.record_batch([part.column("doc_id"), ids, pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), same, *more], names=["doc_id", "ids", "n_ids", "round_trip", *carried])

    schema = "doc_id bigint, ids array<int>, n_ids bigint, round_trip boolean" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carried), run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ``text`` of ids; other columns are ignored, and null ids have null text.

    An id that is null or no piece's, and bytes that are no UTF-8, become
    replacement characters, so damaged rows are read as far as they can be.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(path).spelling)

    def run(batches):
        spelling = pa.array([*shared.value, "\N{REPLACEMENT CHARACTER}".encode()], pa.binary())
        for batch in batches:
            raw = decode_slice(_pieces_only(batch.column("ids"), len(spelling) - 1), spelling).to_pylist()
            yield pa.record_batch([batch.column("doc_id"), pa.array([None if r is None else r.decode(errors="replace") for r in raw], pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids"), run, "doc_id bigint, text string")
