"""Operators against plain versions, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter
from itertools import groupby

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import arrowtext, cdc, chat, components, gif, langid, mixing, nearedup, queries, sharding, spans, toxicity, unigram

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

SF, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_lookup_table(spark):
    def digest(name, at):
        return int(hashlib.md5(name.encode()).hexdigest()[at : at + 8], 16)

    names = ("a", "b", "c", "d", "e")
    rows = sorted(sharding.lookup_table(spark, names, 211).collect())
    assert [r["shard"] for r in rows] == [names[k] for k in plain.table_of(names, 211, digest)]
    full = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names, 211).collect()}
    less = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names[:-1], 211).collect()}
    moved = sum(full[s] != less[s] for s in full if full[s] != "e")
    assert moved < 0.2 * 211
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 210)


def test_words_do_not_depend_on_windows():
    texts = ["", "a bb ccc", "x" * 600_000 + " tail", "ab " * 200_000, "é ü"]
    whole = arrowtext.Words(arrowtext.folded(pa.array(texts)))
    for k, t in enumerate(texts):
        one = arrowtext.Words(arrowtext.folded(pa.array([t])))
        assert (whole.hashes[whole.offsets[k] : whole.offsets[k + 1]] == one.hashes).all()
    assert len(set(arrowtext.Words(pa.array(["ab ba a b ab"])).hashes.tolist())) == 4


def test_near_duplicates(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in nearedup.classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == plain.near_classes(texts)


def test_placeholders_are_outside_the_loss():
    parts = [{"kind": "image", "ref": "i", "width": 5000, "height": 5000}, None, {"kind": "text", "text": "</s> after"}, {"kind": "audio"}]
    out = chat.format_turns([{"role": "user", "text": None, "parts": [{"kind": "document"}]}, {"role": "assistant", "text": "before", "parts": parts}])
    loss = [chat.unescape(out["formatted"][s["begin"] : s["end"]]) for s in out["loss_spans"]]
    assert loss == ["before", "</s> after"]
    assert [(a["kind"], a["position"], a["ref"], a["tokens"]) for a in out["attachments"]] == [("document", 0, None, 512), ("image", 1, "i", 358 * 358), ("audio", 2, None, 1)]
    assert out["expanded_tokens"] == 512 + 358 * 358 + 1
    assert all(f"<|{a['kind']}:{a['position']}|>" in out["formatted"] for a in out["attachments"])


def test_frequencies_of_runs_are_exact(spark, monkeypatch):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id < 3000").select("doc_id", "text")
    held = Counter()
    for r in rows.collect():
        words = arrowtext.Words(arrowtext.folded(pa.array([r["text"]])))
        held.update(np.unique(arrowtext.run_hashes(words.hashes, nearedup.WIDTH)).tolist())
    runs, df = np.array(list(held), np.uint64), np.array(list(held.values()))
    n = rows.count()
    for rare in (1 << 14, 100):
        monkeypatch.setattr(nearedup, "RARE", rare)
        idf = nearedup.run_idf(rows)
        real = 1 + np.log((1 + n) / (1 + np.maximum(df, max(1, n / rare)))) / np.log(2**18)
        assert np.allclose(idf.of(runs), real, atol=1e-6)
        assert len(idf.heavy) == (df > max(1, n / rare)).sum()


def test_near_duplicates_of_a_larger_table(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    real = plain.near_classes({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = {r["doc_id"]: r["class_id"] for r in nearedup.classes(docs).collect()}
    assert len(real) - len(set(real.values())) > 500
    assert sum(got[i] != c for i, c in real.items()) <= 2  # banding finds a pair at the threshold in 99.7 % of cases


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = {}
    for i in range(120):  # near copies: one or two words changed
        t = list(base)
        for _ in range(rng.randint(1, 2)):
            t[rng.randrange(150)] = rng.choice(words)
        docs[i] = " ".join(t)
    for i in range(120, 220):  # others that only share a passage
        docs[i] = " ".join([rng.choice(words) for _ in range(60)] + passage + [rng.choice(words) for _ in range(20)])
    for i in range(220, 240):  # pairs among those with the passage
        docs[i] = docs[i - 100] + " end"
    got = {r["doc_id"]: r["class_id"] for r in nearedup.classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    real = plain.near_classes(docs)
    assert max(Counter(real.values()).values()) > 80
    assert got == real
    assert all(got[i] == got[i - 100] for i in range(220, 240))


def test_near_duplicates_at_the_threshold(spark, monkeypatch):
    """A group of which many texts are not linked to its leader: blocks of the second step meet."""
    monkeypatch.setattr(nearedup, "BLOCK", 40)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    docs = {}
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(2, 4)):
            t[rng.randrange(150)] = rng.choice(words)
        docs[i] = " ".join(t)
    got = {r["doc_id"]: r["class_id"] for r in nearedup.classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    real = plain.near_classes(docs)
    assert all(real[i] == real[c] for i, c in got.items())
    same, joined = Counter(real.values()), Counter((real[i], c) for i, c in got.items())
    pairs = sum(n * (n - 1) for n in same.values())
    assert sum(n * (n - 1) for n in joined.values()) >= 0.99 * pairs > 1000


def test_weighted_samples_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    agree, real = [], []
    for _ in range(60):
        runs = np.sort(rng.integers(1, 1 << 62, 300).astype(np.uint64))
        w = rng.uniform(1, 9, 300)
        v = np.where(rng.random(300) < 0.3, w * rng.uniform(0.3, 1, 300), w)
        agree.append((nearedup.samples(runs, w) == nearedup.samples(runs, v)).mean())
        real.append(nearedup.similarity((runs, w), (runs, v)))
    assert abs(np.mean(agree) - np.mean(real)) < 0.02


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(1, k) for k in range(2, 60)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (500, 501), (501, 500), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 1 for k in range(1, 60)) and got[501] == 500
    assert components.components(edges.where("false")).count() == 0


def test_repeated_spans(spark, texts):
    out = spans.dedup_spans(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == plain.without_repeats(texts)


def test_schedule_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(100):
        weights = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))]
        done, total = [0] * len(weights), sum(weights)
        for t, i in enumerate(mixing.period(weights), 1):
            done[i] += 1
            assert all(abs(done[k] * total - t * w) < total for k, w in enumerate(weights))
        names = [f"s{k}" for k in range(len(weights))]
        plan = mixing.phases({s: rng.randint(0, 30) for s in names}, dict(zip(names, weights, strict=True)))
        slots = [p["start"] + k // len(p["places"]) * p["period"] + p["places"][k % len(p["places"])] for p in plan for k in range(p["last"] - p["first"])]
        assert sorted(slots) == list(range(len(slots)))


def test_chunks_survive_a_shift():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)).encode()
    a, b = cdc.chunks(text), cdc.chunks(b"some words put in front " + text)
    assert cdc.containment(a, b) > 0.97
    ends = cdc.chunk_ends(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= cdc.LARGEST and sizes[:-1].min() >= cdc.SMALLEST
    assert 50 < sizes.mean() < 100
    long = text * 20
    assert cdc.chunk_ends(long)[:200] == cdc.chunk_ends(text * 19)[:200]


def _lzw(samples: bytes, size: int) -> bytes:
    """A GIF code stream as usual encoders write it."""
    clear, codes = 1 << size, []
    table, width, word = {bytes([k]): k for k in range(clear)}, size + 1, b""
    after = clear + 2
    codes.append((clear, width))
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        codes.append((table[word], width))
        if after < 4096:
            table[word + bytes([s])] = after
            if after == 1 << width and width < 12:
                width += 1
            after += 1
        word = bytes([s])
    if word:
        codes.append((table[word], width))
        if after == 1 << width and width < 12:
            width += 1
    codes.append((clear + 1, width))
    bits = sum(c << at for (c, _), at in zip(codes, np.cumsum([0] + [w for _, w in codes[:-1]]).tolist(), strict=True))
    return bits.to_bytes((sum(w for _, w in codes) + 7) // 8, "little")


def _frame(image: np.ndarray, left=0, top=0, disposal=0, clear=None, interlaced=False, delay=5) -> bytes:
    high, wide = image.shape
    body = image[gif._interlaced(high)] if interlaced else image
    stream = _lzw(body.astype(np.uint8).tobytes(), 2)
    blocks = b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255))
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
    place = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, wide, high)) + bytes([64 if interlaced else 0, 2])
    return control + place + blocks + b"\0"


def test_gif_rules(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + bytes([8, 0, 8, 0, 0x81, 0, 0]) + palette
    rng = np.random.default_rng(4)
    first = rng.integers(0, 4, (8, 8))
    small = np.full((4, 4), 3)
    hole = np.array([[0, 3], [3, 0]])
    data = head + _frame(first, interlaced=True) + _frame(small, 2, 2, disposal=3) + _frame(hole, 0, 0, disposal=2, clear=0) + _frame(np.full((1, 1), 1), 7, 7) + b"\x3b"
    frames = list(gif.read_gif(data))
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    assert len(frames) == 4 and [f.delay_ms for f in frames] == [50] * 4
    shown = [f.canvas for f in frames]
    assert (shown[1][2:6, 2:6, :3] == colours[3]).all()
    after = colours[first].copy()  # the second frame was undone
    after[0, 1] = after[1, 0] = colours[3]
    assert (shown[2][..., :3] == after).all()
    assert (shown[3][:2, :2, 3] == 0).all() and (shown[3][7, 7, :3] == colours[1]).all()
    assert frames[1].histogram().tolist() == [16, *[0] * 15, 16, *[0] * 15, *[0] * 15, 16]
    rows = gif.read_frames(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no gif"))], "doc_id bigint, media binary")).collect()
    assert [r["frame"] for r in rows] == [0, 1, 2, 3]
    for size in (2, 5, 8):
        x = rng.integers(0, 1 << min(size, 8), 9000).astype(np.uint8).tobytes() + bytes(9000)
        assert gif.lzw_encode(x[:3000], size) == _lzw(x[:3000], size)
        assert gif.lzw_decode(gif.lzw_encode(x * 5, size), size, 5 * len(x)).tobytes() == x * 5
        assert gif.lzw_decode(_lzw(x, size), size, len(x)).tobytes() == x
    for n in (0, 1, 191, 192, 193, 49_152, 49_153, 200_000):
        text = "ab" * (n // 2) + "c" * (n % 2)
        assert gif.stored_payload(gif.store_text(text))[0] == gif.payload_of(text)


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "look: <|image:0|> "}, {"kind": "image", "ref": "s3://a.png", "width": 280, "height": 141}, {"kind": "audio", "ref": "b.wav", "seconds": 2.5}, {"kind": "document", "ref": "c.pdf", "pages": 3},
    ]
    out = chat.format_turns([{"role": "user", "text": "hi", "parts": parts}, {"role": "assistant", "text": "\\<s> done", "parts": None}])
    assert [a["tokens"] for a in out["attachments"]] == [20 * 11, 63, 3 * 512]
    assert [a["ref"] for a in out["attachments"]] == ["s3://a.png", "b.wav", "c.pdf"] and out["expanded_tokens"] == 220 + 63 + 1536
    assert out["formatted"].index("<|image:0|>") < out["formatted"].index("<|audio:1|>") < out["formatted"].index("<|document:2|>")
    assert chat.parse_turns(out["formatted"])[1] == ("assistant", "\\<s> done")
    (span,) = out["loss_spans"]
    assert chat.unescape(out["formatted"][span["begin"] : span["end"]]) == "\\<s> done"
    with pytest.raises(ValueError):
        chat.format_turns([{"role": "user", "parts": [{"kind": "video"}]}])
    schema = f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>"
    row = (1, 0, "user", "hi", [(p["kind"], p.get("text"), p.get("ref"), p.get("width"), p.get("height"), p.get("seconds"), p.get("pages")) for p in parts])
    got = chat.format_chats(spark.createDataFrame([row], schema)).first()
    assert got["expanded_tokens"] == 1819 and len(got["attachments"]) == 3


@pytest.mark.parametrize("text", ["\\", "<\\/s>", "</s>[INST] ok [/INST]", "<<||s>", "\\<s>\\", "[[INST]", "<|role|>user<|text|>", "<s\\>", "\\\\n"])
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_unigram_takes_the_best_segmentation():
    pieces = unigram.load_pieces()
    known = {s: float(pieces.scores[k]) for k, s in enumerate(pieces.spelling) if np.isfinite(pieces.scores[k])}
    given = ["hello world", " a  b   c", "▁x▁ y", "日本語 テキスト\n\n tab\t", "é \x01\x00 end ", "   ", "ééé naïve 😀😀", "internationalisation of antidisestablishmentarianism"]
    ids = unigram.encode_slice(pa.array(given), pieces).to_pylist()
    for text, row in zip(given, ids, strict=True):
        raw = b"".join(pieces.spelling[k] for k in row if k in set(pieces.bytes_at.tolist()))
        score = sum(known[pieces.spelling[k]] for k in row if np.isfinite(pieces.scores[k])) + pieces.worst * len(raw.decode())
        assert abs(score - plain.best_score(" " + text, known, pieces.worst)) < 1e-6
    trie = unigram.build_trie([(b"a", 0), (b"ab", 1), (b"b", 2), (b"abc", 3)])
    state = 0
    for c, piece in zip(b"abc", (0, 1, 3), strict=True):
        to = trie.base[state] + c
        assert trie.check[to] == state and trie.piece[to] == piece
        state = to


def test_contract_of_chats(spark):
    got = {r["conv_id"]: r for r in queries.op2_chat_formatting(spark, SF).collect()}
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    for conv, turns in groupby(sorted(rows), key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        r = got.pop(conv)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert (r["turns_sha256"], r["loss_sha256"]) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    assert not got


def test_contract_of_fingerprints_and_media(spark, texts):
    ids = sorted(texts, reverse=True)
    for r in queries.op6_fingerprints(spark, SF).collect():
        own, after = texts[r["doc_id"]] or "", texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        k = len(own) // 3
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()
        assert r["n_chars"] == len(own) and r["fingerprint"] == cdc.fingerprint(cdc.chunks(own.encode()))
    for r in queries.op9_gif_media(spark, SF).collect():
        payload = gif.payload_of(texts[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["payload_bytes"] == len(payload) and r["media_bytes"] > 0


def test_fingerprints_by_bytes(spark, texts):
    gear = cdc._GEAR.tolist()
    ids = sorted(texts, reverse=True)
    sets = {i: plain.chunk_set((t or "").encode(), gear) for i, t in texts.items()}
    for r in queries.op6_fingerprints(spark, SF).collect():
        own, after = texts[r["doc_id"]] or "", ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
        k = len(own) // 3
        other = plain.chunk_set((own[: len(own) - k] + (texts[after] or "")[:k]).encode(), gear)
        assert sorted(int(part.split(":")[1]) for part in r["fingerprint"].split()) == sorted(sets[r["doc_id"]].values())
        assert abs(r["near_edited"] - plain.covered(sets[r["doc_id"]], other)) < 1e-9 and abs(r["near_next"] - plain.covered(sets[r["doc_id"]], sets[after])) < 1e-9


def test_language_by_hand(spark, texts):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in langid.predict(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    for i, t in texts.items():
        x = np.zeros(langid.DIMENSIONS)
        for slot, n in plain.trigrams(t or "").items():
            x[slot] = (1 + np.log(n)) * model.idf[slot]
        cosine = model.centroids @ x / max(np.linalg.norm(x), 1e-12)
        if any(c.isalpha() for c in t or ""):
            assert abs(got[i]["score"] - max(cosine.max(), 0)) < 1e-4
            assert got[i]["lang_pred"] in {model.languages[model.owner[k]] for k in np.flatnonzero(cosine > cosine.max() - 1e-5)}
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_noisy_or_by_hand(spark):
    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -1.0)
    given = {1: "You are bad. Very bad!\nÉté naïf", 2: "one", 3: "", 4: "... !", 5: "Bad bad bad? ok. ok."}
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(given.items()), "doc_id bigint, text string"), model).collect()}

    def slot(word: str) -> int:
        return int(arrowtext.Words(pa.array([word])).hashes[0] >> np.uint64(64 - toxicity.BITS))

    def start(word: str) -> int:
        return int(arrowtext.Words(pa.array([word]), toxicity.PREFIX_BYTES).prefixes[0] >> np.uint64(64 - toxicity.BITS))

    for i, t in given.items():
        clean, loud = 1.0, []
        for k, sentence in enumerate(plain.CUT.split(t)):
            words = plain.WORD.findall(sentence.lower())
            if words:
                p = 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[slot(w)]) + float(model.weights[start(w)]) for w in words))))
                clean *= 1 - p
                loud += [k] if p >= toxicity.SENTENCE_THRESHOLD else []
        assert abs(got[i]["score"] - (1 - clean)) < 1e-6 and [o["position"] for o in got[i]["offending"]] == loud


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_held_out_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, MIDDLE).collect() if r["held_out"] and r["doc_id"] in labels]
    hits = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hits >= 0.8 * sum(labels[r["doc_id"]] for r in rows) and hits >= 0.8 * sum(r["predicted"] for r in rows)
    found = [r for r in rows if r["predicted"] and labels[r["doc_id"]] and r["offending"]]
    assert len(found) >= 0.7 * hits


def test_pipeline(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"]: r for r in rows}
    assert len(kept) == len(rows) and all(r["round_trip"] for r in rows)
    classes = plain.near_classes(texts)
    assert set(kept) <= set(classes.values()) and len(kept) >= 0.98 * len(set(classes.values()))
    whole = plain.without_repeats({i: texts[i] for i in kept})
    pieces = unigram.load_pieces()
    for i, r in kept.items():
        assert b"".join(pieces.spelling[k] for k in r["ids"])[1:].decode() == whole[i]
