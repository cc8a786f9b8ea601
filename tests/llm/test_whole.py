"""The whole job where an earlier version did less."""

import os
import random
import sys

import corpus_pipeline

from arbora.llm import mixing, nearedup

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402


def _on_one_template(n_groups: int) -> dict[int, str]:
    """Texts on one template that are alike at 0.8 or more in groups of two only."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    template = [rng.choice(words) for _ in range(400)]
    docs = {}
    for g in range(n_groups):
        own = [rng.choice(words) for _ in range(60)]
        docs[2 * g] = " ".join(template + own)
        docs[2 * g + 1] = " ".join(template + own[:-5] + [rng.choice(words) for _ in range(5)])
    return docs


def test_small_groups_of_one_large_band(spark, monkeypatch):
    monkeypatch.setattr(nearedup, "BLOCK", 100)
    docs = _on_one_template(120)
    got = {r["doc_id"]: r["class_id"] for r in nearedup.classes(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    real = plain.near_classes(docs)
    assert len(set(real.values())) == 120
    assert got == real


def test_prefixes_of_the_corpus_hold_the_target_weights(spark):
    rows = [(k, f"text {k}", "en", f"src{k % 3}", 6) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    source = {r[0]: r[3] for r in rows}
    out = corpus_pipeline.encoded(spark, corpus_pipeline.mixed_sources(spark, docs, "").repartition(5), "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900))
    assert len({(r["slot"], r["place"]) for r in out}) == 900
    runs = {r["slot"]: source[r["doc_id"]] for r in out}
    done, left = dict.fromkeys(sorted(set(runs.values())), 0), 19  # blocks of 300 rows
    total = sum(mixing.TARGETS[s] for s in done)
    for slot in range(len(runs)):
        done[runs[slot]] += 1
        assert all(abs(n * total - (slot + 1) * mixing.TARGETS[s]) < total for s, n in done.items())
        if left in done.values():
            break
    assert slot > 30


def test_encoded_rows_follow_the_mixing_stage(spark, tmp_path):
    rows = [(k if k % 50 else None, f"text {k}", "en", f"src{k % 3}" if k % 7 else None, 6) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    def places(df):
        return sorted((r["doc_id"] or -1, r["slot"], r["place"]) for r in df.collect())

    def read_back(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name)).repartition(3)

    def wanted(targets):
        return sorted((r["doc_id"] or -1, r["__slot"], r["__place"]) for r in mixing.schedule(docs, targets).collect())

    own = {"src0": 7, None: 2}
    staged = corpus_pipeline.mixed_sources(spark, docs, "")
    assert staged.dtypes == docs.dtypes
    assert places(corpus_pipeline.encoded(spark, read_back("stage", staged), "")) == wanted(None)
    assert places(corpus_pipeline.encoded(spark, read_back("own", mixing.mix(docs, own)), "")) == wanted(own) != wanted(None)
    unmixed = corpus_pipeline.encoded(spark, docs, "").collect()
    assert len(unmixed) == 900 and all(r["slot"] is None and r["place"] is None for r in unmixed)


def test_rows_that_a_mix_did_not_count_stay_without_a_place(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "a" if k < 40 else "b") for k in range(80)], "doc_id bigint, text string, source string")
    settled = mixing.settle(docs.where("source = 'a' and doc_id < 20"))
    out = mixing.place(docs, settled).collect()
    assert len(out) == 80 and sum(r["__slot"] is not None for r in out) == 32  # two blocks of 16
    assert all((r["__slot"] is None) == (r["__place"] is None) == (r["__block"] is None) for r in out)


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "x", "a", 1, 2, 3) for k in range(40)], "doc_id bigint, text string, source string, `a.b` int, slot int, `__slot` int")
    out = mixing.mix(docs)
    assert out.dtypes == docs.dtypes and out.exceptAll(docs).count() == 0 and out.count() == 40
    placed = corpus_pipeline.encoded(spark, out, "").collect()
    assert {(r["slot"], r["place"]) for r in placed} == {(k // 16, k % 16) for k in range(40)}
