"""Chat formatting with typed content parts.

A turn's content is its text followed by its parts, each a struct of ``kind``
(text, image, audio or document) with its own fields. A visitor flattens the
parts in order: a text part gives escaped text, any other part a numbered
placeholder, an attachment record (position, kind, reference) and the number
of tokens that the placeholder stands for once it is expanded.

Template: ``<s>`` then for each turn ``<|role|>ROLE<|text|>CONTENT<|end|>``,
then ``</s>``. Inside roles and texts a backslash is doubled and every control
string gets a backslash after its first character, so that none can occur in
content; ``unescape`` takes both back. The loss mask holds the spans of the
text parts of assistant turns, without placeholders.

An image stands for a token for each patch of 14 pixels a side that it touches,
an audio for 25 tokens a second, a document for 512 a page, always for one at least.

Turns are ordered by ``turn``, role and text, nulls first. A null role or text
counts as empty; a null ``conv_id`` is a conversation of its own; repeated
rows are repeated turns; an empty table gives no rows; other columns are
ignored. A null part is none; null fields of a part count as 0 or empty; a part
of unknown kind raises an error.

One conversation is one output row, so it must fit in a task's memory; turns
are gathered per conversation and never beyond it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.arrowtext import arrow_map

OPEN, CLOSE, ROLE, TEXT, END = "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>"
CONTROLS = (OPEN, CLOSE, "<|", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(re.escape(ROLE) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)

#: Fields of a part beside ``kind``: text; ref; width, height (pixels); seconds; pages.
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
IMAGE_PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 512


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one conversation in order."""

    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        visitor = getattr(self, f"visit_{part.get('kind')}", None)
        if visitor is None:
            raise ValueError(f"unknown kind of part: {part.get('kind')!r}")
        return visitor(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (-(-(part.get(side) or 0) // IMAGE_PATCH) for side in ("width", "height"))
        return self._attach(part, max(1, across * down))

    def visit_audio(self, part: dict) -> str:
        return self._attach(part, max(1, -int(-(part.get("seconds") or 0.0) * AUDIO_TOKENS_PER_SECOND // 1)))

    def visit_document(self, part: dict) -> str:
        return self._attach(part, max(1, (part.get("pages") or 0)) * DOCUMENT_TOKENS_PER_PAGE)

    def _attach(self, part: dict, tokens: int) -> str:
        position = len(self.attachments)
        self.attachments.append({"position": position, "kind": part["kind"], "ref": part.get("ref"), "tokens": tokens})
        return f"<|{part['kind']}:{position}|>"


def format_turns(turns: list[dict]) -> dict:
    """The formatted text, its loss spans (begin, end) and attachments of ordered turns."""
    flat, out, at, spans = Flattener(), [OPEN], len(OPEN), []
    for turn in turns:
        role = turn.get("role") or ""
        head = ROLE + escape(role) + TEXT
        out.append(head)
        at += len(head)
        for part in [{"kind": "text", "text": turn.get("text")}, *(p for p in turn.get("parts") or [] if p is not None)]:
            body = flat.visit(part)
            if role == "assistant" and part["kind"] == "text":
                spans.append({"begin": at, "end": at + len(body)})
            out.append(body)
            at += len(body)
        out.append(END)
        at += len(END)
    out.append(CLOSE)
    return {"formatted": "".join(out), "loss_spans": spans, "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and contents of a formatted text, unescaped; placeholders stay in the content."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens of each conversation.

    ``conversations`` has conv_id, turn, role, text and, where there are other contents, ``parts``: array of ``PART``.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in conversations.columns else F.lit(None).cast(f"array<{PART}>")
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"), parts.alias("parts"))
    whole = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("__turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("__turn")).alias("turns"))

    def run(batches):
        for batch in batches:
            done = [format_turns(turns) for turns in batch.column("turns").to_pylist()]
            yield pa.record_batch(
                [batch.column("conv_id"), pa.array([d["formatted"] for d in done], pa.string()), pa.array([d["loss_spans"] for d in done], _SPANS), pa.array([d["attachments"] for d in done], _ATTACHED), pa.array([d["expanded_tokens"] for d in done], pa.int64())],
                names=["conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens"],
            )

    schema = "conv_id bigint, formatted string, loss_spans array<struct<begin: bigint, end: bigint>>, attachments array<struct<position: int, kind: string, ref: string, tokens: bigint>>, expanded_tokens bigint"
    return arrow_map(whole, run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say, for comparison with the source."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
