"""Vector codes, hard negatives and quality rules against plain versions, and over nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import codes, negatives, quality, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, window string, code string, page int"


def _rows(n: int, size: int, seed: int, odd: bool = True, scale: float = 1.0) -> list[tuple]:
    """Clustered vectors; with ``odd`` copies under one id, a vector that many share, null ids and vectors that take no part."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(7)]
    rows = [(k, [float(np.float32(scale * (x + rng.gauss(0, 0.3)))) for x in rng.choice(middles)], rng.randrange(4)) for k in range(n)]
    if odd:
        rows += [(1000 + k, [0.5 * scale] * size, k % 3) for k in range(60)] + rows[:5] + [(5, rows[9][1], 2), (None, rows[3][1], 1), (None, rows[4][1], None)]
        rows += [(2000, None, 1), (2001, [math.nan] + [0.0] * (size - 1), 1), (2002, [math.inf] + [0.0] * (size - 1), 1), (2003, [None] + [0.0] * (size - 1), 1), (2004, [1.0], 1), (2005, [], 1)]
    return [(*r, "i", "w", "c", 3) for r in rows]


def _kept(rows: list[tuple], size: int) -> list[tuple]:
    return [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]


def _last(i):
    return (i is None, i or 0)


def plain_codes(rows: list[tuple], size: int) -> tuple[list[tuple], str]:
    kept = _kept(rows, size)
    width = size // 16
    first = sorted(kept, key=lambda r: (_last(r[0]), r[1]))[:64]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for step in range(3):
        near = [[nearest(v[p * width : (p + 1) * width], books[p]) for p in range(16)] for _, v, _ in kept]
        if step == 2:
            break
        for p in range(16):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v, _), n in zip(kept, near, strict=True) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    label_error = Counter()
    for (_, _, c), n in zip(kept, near, strict=True):
        label_error[c] += sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), label_error[c]) for (i, _, c), n in zip(kept, near, strict=True)], digest


@pytest.mark.parametrize("scale", [1.0, 90_000.0])
def test_codes(spark, scale):
    rows = _rows(300, 32, 1, scale=scale)
    out = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    real, digest = plain_codes(rows, 32)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out) == Counter(real)
    assert {r["codebooks_sha256"] for r in out} == {digest}
    assert all(1024 <= r["n_distances"] < 3 * 1024 for r in out)
    assert sum(r["n_distances"] for r in out) < 2 * 1024 * len(out)  # the bounds leave out most of the later distances


def test_codes_by_salted_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 2)
    rows = _rows(120, 16, 2)
    out = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out) == Counter(plain_codes(rows, 16)[0])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, books = rng.integers(-300, 300, (16, 200, 4)), rng.integers(-300, 300, (16, 64, 4))
    code, upper, lower = codes.first_assignment(x.astype(float), books)
    for _ in range(4):
        new = books + rng.integers(-40, 40, books.shape)
        code, upper, lower, n = codes.next_assignment(x, code, upper, lower, codes.Moved(books, new))
        books = new
        real = ((x[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)
        assert (code == real.argmin(2)).all() and n < real.size
        assert (lower / 16.0 <= np.sqrt(real)).all() and (upper >= np.sqrt(real.min(2))).all()


def test_few_and_odd_codes(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([r for r in _rows(12, 16, 1) if r[0] == 2000], SCHEMA)).count() == 0
    rows = _rows(5, 16, 4, odd=False)
    out = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["error"] for r in out] == [0] * 5 and len({r["code"] for r in out}) == 5
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame(_rows(5, 20, 4, odd=False), SCHEMA))
    state, books = codes.fit(spark.createDataFrame(rows, SCHEMA))
    r = state.orderBy("id").first()
    assert codes.decoded(np.frombuffer(r["code"], np.uint8)[None, :], books)[0].tolist() == np.frombuffer(r["parts"], np.int32).tolist()
    with pytest.raises(OverflowError):
        vectors.exact(2.0**32, 16)


def plain_negatives(rows: list[tuple], size: int, anchor) -> Counter:
    taken = [r for r in _kept(rows, size) if r[2] is not None]
    out = Counter()
    for i, v, c in taken:
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), _last(j), j, d) for j, w, d in taken if j != i), key=lambda s: s[:2])
        for s, _, j, d in [x for x in scored if x[3] == c][:5]:
            inside = [x for x in scored if x[3] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            for rank, x in enumerate(inside, 1):
                out[(i, j, rank, x[2], -s, -x[0])] += 1
    return out


@pytest.mark.parametrize("scale", [0.1, 3000.0])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "PAGE", 9)
    rows = _rows(150, 16, 5, scale=scale)
    out = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), lambda i: i % 10 == 0).collect()
    real = plain_negatives(rows, 16, lambda i: i % 10 == 0)
    assert Counter(tuple(r) for r in out) == real and len(real) > 300


def test_hard_negatives_of_few_and_none(spark):
    every = lambda i: i % 1 == 0
    assert negatives.mine(spark.createDataFrame([], SCHEMA), every).count() == 0
    assert negatives.mine(spark.createDataFrame(_rows(5, 8, 1, odd=False), SCHEMA), lambda i: i < 0).count() == 0
    rows = _rows(6, 8, 7, odd=False)
    assert Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA), every).collect()) == plain_negatives(rows, 8, lambda i: True)
    zero = [(k, [0.0] * 8, k % 2, "i", "w", "c", 3) for k in range(40)]  # one score for all, so ids alone decide
    assert Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(zero, SCHEMA).repartition(4), lambda i: i == 20).collect()) == plain_negatives(zero, 8, lambda i: i == 20)


def plain_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    bare = [x.strip(quality.SPACES) for x in lines]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in words), "n_lines": len(lines), "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in bare),
        "n_bullet_lines": sum(x.lstrip(quality.SPACES).startswith(("- ", "* ", "• ")) for x in lines),
    }


def test_quality_rules(spark):
    rng = random.Random(8)
    few = [f"w{k}" for k in range(6)]
    texts = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "\n\n\t", "x\r\nx\r\nx\n", "- one\n- two\n* three...\n* three...\n", "\x0b\x0ca\xa0b 𝒳 |<>", "the " * 200, "aa " * 70_000 + "end"]
    texts += [" ".join(rng.choice(few) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(few + ["the", "of", "Für", "la"]) + rng.choice(["", ".", "#"]) for _ in range(9)) for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame([(k, t, "mine", 7) for k, t in enumerate(texts)], "doc_id bigint, text string, kept string, n_words int").repartition(3)
    out = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        counts = plain_counts(t)
        assert {m: out[k][m] for m in quality.MEASURES} == counts, t
        base = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        failed = [n for n, part, whole, low, high in quality.THRESHOLDS if (low is not None and 100 * counts[part] < low * counts[whole]) or (high is not None and 100 * counts[part] > high * counts[whole])]
        assert (out[k]["base_failed"], out[k]["failed"], out[k]["kept"]) == (base, failed, not base and not failed)
    assert quality.judged(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not measured"):
        quality.judged(docs, thresholds=(("x", "none", "n_words", 1, 2),))


def test_quality_rules_are_one_pass_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = quality.judged(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).head()[0]
    assert good > 0.99
