"""Every operator and stage over nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from arbora.llm import cdc, chat, gif, langid, mixing, nearedup, sharding, spans, toxicity, unigram

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, slot string, label int, bucket int, kept string, weight string"
LONG = " ".join(f"word{k % 997} runs on." for k in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs away into the deep green forest. It never came back to us again, they said."
ROWS = [
    (1, PLAIN, "en", "a", 10, "x", "y", 1, 2, "k", "w"),
    (2, PLAIN, "en", "a", 10, None, None, None, None, None, None),
    (2, PLAIN, "en", "a", 10, None, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None, None),
    (None, PLAIN + " More.", "de", "b", 3, "x", "y", 1, 2, "k", "w"),
    (None, None, "de", None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "x", "y", 1, 2, "k", "w"),
    (5, "", "fr", "b", 0, "x", "y", 1, 2, "k", "w"),
    (6, "!!! ??? \x01\x00", "fr", "c", 4, "x", "y", 1, 2, "k", "w"),
    (7, LONG, "en", "c", len(LONG), "x", "y", 1, 2, "k", "w"),
    (8, "x" * 300_000, "en", "c", 300_000, "x", "y", 1, 2, "k", "w"),
    (2, "another text under the id of two, not like the first at all.", "en", "a", 1, "x", "y", 1, 2, "k", "w"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none):
    out = sharding.place(docs).collect()
    assert len(out) == len(ROWS) and all(r["shard"] in sharding.SHARDS for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sharding.place(none).count() == 0


def test_language(docs, none):
    out = langid.identify(docs).collect()
    assert len(out) == len(ROWS)
    silent = [r for r in out if r["doc_id"] in (3, 4, 5, 6)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in silent)
    assert langid.identify(none).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    no_labels = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, no_labels).collect()} == {0.0}
    assert toxicity.score(none, no_labels).count() == 0


def test_fingerprints(docs, none):
    out = cdc.probe_edits(docs).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (1,)} | {cdc.fingerprint(cdc.chunks(PLAIN.encode()))}
    assert len(same) == 1
    assert cdc.probe_edits(none).count() == 0
    one = cdc.probe_edits(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert cdc.fingerprints(docs).count() == len(ROWS)


def test_gif(docs, none):
    out = gif.text_media(docs).collect()
    assert len(out) == len(ROWS)
    empty = {r["payload_sha256"] for r in out if r["doc_id"] in (3, 4, 5)}
    assert len(empty) == 1 and all(r["payload_bytes"] == 192 and r["n_bytes"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    assert gif.text_media(none).count() == 0
    frames = gif.read_frames(docs.select("doc_id", F.lit(None).cast("binary").alias("media")))
    assert frames.count() == 0


def test_encoding(docs, none):
    out = unigram.encode(docs)
    assert out.count() == len(ROWS) and out.where("not round_trip").count() == 0
    rows = out.collect()
    assert all(r["ids"] is None for r in rows if r["doc_id"] == 3) and all(r["ids"] == [] for r in rows if r["doc_id"] in (4, 5))
    texts = {r["doc_id"]: r["text"] for r in unigram.decode(out.where("doc_id in (6, 7, 8)")).collect()}
    assert texts == {6: ROWS[8][1], 7: LONG, 8: "x" * 300_000}
    assert unigram.encode(none).count() == 0


def test_damaged_ids_are_read_as_far_as_they_can_be(spark):
    letter = unigram.load_pieces().spelling.index(b" a")
    byte = int(unigram.load_pieces().bytes_at[0xFF])
    rows = [(1, [letter, -5, 10**6, None, letter], "x"), (2, None, "x"), (3, [], "x"), (None, [letter, byte], "x"), (1, [letter], "x")]
    out = unigram.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, "a\ufffd\ufffd\ufffd a"), (2, None), (3, ""), (None, "a\ufffd"), (1, "a")]
    assert unigram.decode(spark.createDataFrame([], "doc_id bigint, ids array<int>")).count() == 0


def test_shards_on_disk(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["doc_id"], r["shard"]) for r in sharding.place(docs).collect()}
    assert back.count() == len(ROWS) and {(r["doc_id"], r["shard"]) for r in back.collect()} == want


def test_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"<s>turn {k}</s>" * 40) for k in range(3000)]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert out["n_turns"] == 3000 and out["loss_chars"] == sum(len(t) for _, k, _, t in turns if k % 2)


def test_mixing(docs, none):
    out = mixing.schedule(docs, {"a": 2, "b": 1}, block_size=2)
    assert out.count() == len(ROWS)
    slots = sorted({r["__slot"] for r in out.collect()})
    assert slots == list(range(len(slots)))
    mixed = mixing.mix(docs, {"a": 2, "b": 1}, 2)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).count() == 0 and docs.exceptAll(mixed).count() == 0
    assert mixing.mix(none).count() == 0


def test_near_duplicates(docs, none):
    out = {r["doc_id"]: r["class_id"] for r in nearedup.classes(docs).collect()}
    assert len(out) == 9 and out[1] == out[2] == 1
    assert out[4] == out[5] == 4 and out[None] is None and out[3] == 3
    kept = nearedup.keep_one(docs)
    assert kept.columns == docs.columns
    # the other text under the id of two is a document of its own; the near copy without an id goes, null text stays
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert [r["text"] for r in kept.where("doc_id = 2 or doc_id is null").sort("doc_id").collect()] == [None, ROWS[-1][1]]
    assert nearedup.classes(none).count() == 0 and nearedup.keep_one(none).count() == 0


def test_spans(docs, none):
    out = spans.dedup_spans(docs)
    assert out.count() == len(ROWS)
    rows = out.collect()
    assert all(r["text"] == PLAIN for r in rows if r["doc_id"] == 1)
    assert all(r["text"] == "" for r in rows if r["doc_id"] == 2 and r["text"] != ROWS[-1][1])
    assert any(r["text"] == "More." for r in rows if r["doc_id"] is None)
    assert all(r["text"] is None for r in rows if r["doc_id"] == 3)
    assert spans.dedup_documents(docs).columns == docs.columns
    assert spans.dedup_spans(none).count() == 0


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, extra string, formatted string"
    rows = [(1, 0, "user", "hi", "e", "f"), (1, 0, "user", "hi", "e", "f"), (1, None, None, None, None, None), (None, 1, "assistant", "ok </s>", None, None), (2, 1, "assistant", "", None, None)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert out[1]["n_turns"] == 3 and out[None]["loss_chars"] == 7 and out[2]["loss_chars"] == 0
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, stage):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, plain, "")
    assert out.count() > 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == plain.columns
    assert stage(spark, plain.where("false"), "").count() == 0


def test_a_text_of_no_learned_language_is_rejected(spark):
    learned = spark.createDataFrame([(k, f"{PLAIN} number {k}", "en") for k in range(30)] + [(100 + k, f"der schnelle braune Fuchs springt über den faulen Hund und läuft davon {k}", "de") for k in range(30)], "doc_id bigint, text string, lang string")
    strange = spark.createDataFrame([(1, "Καλημέρα κόσμε, τι κάνεις σήμερα;", None), (2, "今日は良い天気ですね。明日も晴れるでしょう。", None), (3, "The dog jumps over the quick fox and runs into the deep forest 12345", None)], "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r for r in langid.predict(strange, langid.fit(learned)).collect()}
    assert out[1]["rejected"] and out[2]["rejected"] and not out[3]["rejected"] and out[3]["lang_pred"] == "en"
