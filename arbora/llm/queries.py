"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import cdc, chat, codes, gif, langid, mixing, nearedup, negatives, quality, sharding, spans, toxicity, unigram
from arbora.llm.arrowtext import SENTENCE_END


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, remainder: int) -> Column:
    """True for held-out rows; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), "removed_sentences")


def _parts_of_turn() -> Column:
    """For user turns an image, an audio or a document by the turn's own numbers, with a caption after every other."""
    size, turn = F.length(F.coalesce("text", F.lit(""))), F.coalesce(F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4)), F.lit(3)).cast("int")
    none = {"text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}

    def part(kind: str, **given: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()])

    name = F.concat(F.lit("file-"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    one = F.when(turn == 0, part("image", ref=name, width=size, height=size % 300)).when(turn == 1, part("audio", ref=name, seconds=size / F.lit(16.0))).when(turn == 2, part("document", ref=name, pages=size % 9))
    parts = F.when(size % 2 == 0, F.array(one)).otherwise(F.array(one, part("text", text=F.lit("</s> a caption"))))
    return F.when((F.col("role") == "user") & (turn < 3), parts)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from the plain conversations; attachments and tokens of the same ones with parts."""
    given = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    given = given.unionByName(more)
    told = F.transform("attachments", lambda a: F.concat_ws(":", a["kind"], a["position"].cast("string"), a["ref"], a["tokens"].cast("string")))
    rich = chat.format_chats(given.withColumn("parts", _parts_of_turn())).select(F.col("conv_id").alias("of"), F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens", F.array_join(told, " ").alias("attached"), F.length("formatted").cast("bigint").alias("chars_with_parts"))
    return chat.read_back(chat.format_chats(given)).join(rich, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearedup.classes(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _fold(3, 1)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "offending")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.probe_edits(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__place").alias("place"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _fold(4, 2)
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings")).drop("n_distances")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(given.select("vec_id", "embedding", label.alias("label")), lambda id: id % 100 == 0)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_gif_media": op9_gif_media,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

_SHARDS = ", ".join(f"'{s}'" for s in sharding.SHARDS)
_N, _M = len(sharding.SHARDS), sharding.TABLE_SIZE
_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql() -> str:
    """Rounds of assignment and update as one query each."""
    ctes = f"""
WITH kept AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings WHERE {_WHOLE}),
parts AS MATERIALIZED (SELECT row, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) AS t(p)),
books0 AS (SELECT p, row - 1 AS e, x AS y FROM parts WHERE row <= 64)"""
    for k in range(codes.ROUNDS + 1):
        ctes += f""",
near{k} AS MATERIALIZED (SELECT row, p, min(d) * 64 + arg_min(e, d * 64 + e) AS best FROM (
    SELECT row, p, e, list_sum(list_transform(x, lambda c, i: (c - y[i]) * (c - y[i])))::BIGINT AS d FROM parts JOIN books{k} USING (p)) GROUP BY row, p)"""
        if k < codes.ROUNDS:
            ctes += f""",
means{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS y FROM (
    SELECT p, best % 64 AS e, j, SUM(x[j])::BIGINT AS s, COUNT(*) AS n FROM near{k} JOIN parts USING (row, p), generate_series(1, (SELECT max(len(x)) FROM parts)) AS t(j) GROUP BY ALL) GROUP BY p, e),
books{k + 1} AS MATERIALIZED (SELECT p, e, COALESCE(m.y, b.y) AS y FROM books{k} b LEFT JOIN means{k} m USING (p, e))"""
    last = codes.ROUNDS
    return ctes + f""",
coded AS (SELECT row, string_agg(lpad(to_hex(best % 64), 2, '0'), '' ORDER BY p) AS code, SUM(best // 64)::BIGINT AS error FROM near{last} GROUP BY row)
SELECT vec_id, lower(code) AS code, error, SUM(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM books{last}) AS codebooks_sha256 FROM kept JOIN coded USING (row)"""


def _rules_sql() -> str:
    """The table of thresholds in SQL."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    rules = [(name, " AND ".join([f"100 * {part} >= {low} * {whole}"] * (low is not None) + [f"100 * {part} <= {high} * {whole}"] * (high is not None))) for name, part, whole, low, high in quality.THRESHOLDS]
    failed = ", ".join(f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in rules)
    return rf"""
WITH docs AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE(text, '') AS text FROM documents),
split AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM docs),
runs AS (SELECT row, unnest(range(1, len(ws) - 1)) AS k, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS run FROM split WHERE len(ws) > 2),
again AS (SELECT row, k FROM (SELECT row, k, COUNT(*) OVER (PARTITION BY row, run) AS n FROM runs) WHERE n > 1),
repeats AS (SELECT row, COUNT(DISTINCT k + j) AS n FROM again, range(3) AS t(j) GROUP BY row),
counts AS (SELECT row, doc_id, len(ws)::BIGINT AS n_words, COALESCE(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, COALESCE(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: lower(w) IN ({stops})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	-
]*\z')))::BIGINT AS n_ellipsis_lines, len(list_filter(ls, lambda x: regexp_matches(x, '\A[ 	-
]*[-*•] ')))::BIGINT AS n_bullet_lines
    FROM split LEFT JOIN repeats USING (row))
SELECT * EXCLUDE (row), NOT base_failed AND len(failed) = 0 AS kept FROM (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM counts)"""


ORACLES = {
    "op11_vector_codes": _lloyd_sql(),
    "op12_quality_rules": _rules_sql(),
    "op13_hard_negatives": f"""
WITH taken AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x)::DOUBLE) AS v
    FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
scored AS MATERIALIZED (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
best AS (SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST, other) <= {negatives.POSITIVES}),
hard AS (SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor, positive ORDER BY score DESC, other_id NULLS LAST, other) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM best JOIN scored USING (anchor, anchor_id) WHERE NOT alike AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score)
SELECT * FROM hard WHERE rank <= {negatives.NEGATIVES}
""",
    "op4_sharding": f"""
WITH RECURSIVE names AS (SELECT unnest([{_SHARDS}]) AS shard, unnest(range({_N})) AS k),
starts AS (SELECT k, shard, CAST('0x' || substr(md5(shard), 1, 8) AS BIGINT) % {_M} AS first,
    CAST('0x' || substr(md5(shard), 9, 8) AS BIGINT) % ({_M} - 1) + 1 AS skip FROM names),
orders AS (SELECT list(p ORDER BY k) AS orders FROM (
    SELECT k, list((first + j * skip) % {_M} ORDER BY j) AS p FROM starts, range({_M}) AS t(j) GROUP BY k)),
fill(step, owner, claimed) AS (
    SELECT 0, list_transform(range({_M}), lambda x: -1), CAST(-1 AS BIGINT)
    UNION ALL
    SELECT step + 1, list_transform(owner, lambda o, i: CASE WHEN i - 1 = slot THEN step % {_N} ELSE o END), slot
    FROM (SELECT step, owner, list_filter(orders[step % {_N} + 1], lambda p: owner[p + 1] < 0)[1] AS slot FROM fill, orders WHERE step < {_M})),
placed AS (SELECT claimed AS slot, shard FROM fill JOIN names ON k = (step - 1) % {_N} WHERE step > 0)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, shard FROM documents
JOIN placed ON slot = CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '\\N')), 1, 8) AS BIGINT) % {_M}
""",
    "op7_mixing": f"""
WITH RECURSIVE hashed AS (SELECT doc_id, source, CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) AS h FROM documents),
placed AS (SELECT doc_id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY h % {mixing.BUCKETS}, h, doc_id) - 1 AS nth FROM hashed),
sources AS (SELECT source, CASE {" ".join(f"WHEN source = '{s}' THEN {w}" for s, w in mixing.TARGETS.items())} ELSE {mixing.DEFAULT_WEIGHT} END AS weight,
    CAST(CEIL(COUNT(*) / {mixing.BLOCK_SIZE}.0) AS BIGINT) AS blocks FROM documents GROUP BY source),
lists AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list(weight ORDER BY source NULLS FIRST) AS w,
    list(blocks ORDER BY source NULLS FIRST) AS n, range(1, COUNT(*) + 1) AS k FROM sources),
run(slot, base, done, began, pick, block) AS (
    SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(k, lambda i: CAST(0 AS BIGINT)), list_transform(k, lambda i: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lists
    UNION ALL
    SELECT slot + 1, CASE WHEN over THEN slot + 2 ELSE base END, after, CASE WHEN over THEN after ELSE began END, pick, block FROM (
        SELECT *, after[pick] = n[pick] AS over FROM (
            SELECT *, done[pick] AS block, list_transform(done, lambda d, i: CASE WHEN i = pick THEN d + 1 ELSE d END) AS after FROM (
                SELECT *, CAST(list_min(list_transform(
                    list_filter(k, lambda i: began[i] < n[i] AND ((done[i] - began[i]) * total) // w[i] <= slot + 1 - base),
                    lambda i: (((done[i] - began[i] + 1) * total + w[i] - 1) // w[i]) * 100000 + i)) % 100000 AS BIGINT) AS pick FROM (
                    SELECT slot, base, done, began, n, w, k, list_sum(list_transform(k, lambda i: CASE WHEN began[i] < n[i] THEN w[i] ELSE 0 END)) AS total
                    FROM run, lists WHERE list_sum(done) < list_sum(n)))))),
slots AS (SELECT s[pick] AS source, block, slot FROM run, lists WHERE slot >= 0)
SELECT p.doc_id, p.source, t.block, t.slot, CAST(p.nth % {mixing.BLOCK_SIZE} AS INTEGER) AS place
FROM placed p JOIN slots t ON p.source IS NOT DISTINCT FROM t.source AND p.nth // {mixing.BLOCK_SIZE} = t.block
""",
    "op1_substring_dedup": rf"""
WITH parts AS (SELECT doc_id, unnest(found) AS part, generate_subscripts(found, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:{SENTENCE_END}|\z)') AS found FROM documents WHERE text IS NOT NULL)),
words AS (SELECT doc_id, i, part, regexp_extract_all(lower(part), '[\p{{L}}\p{{M}}\p{{N}}]+') AS ws FROM parts),
said AS (SELECT doc_id, i, ws, len(ws) AS n, ROW_NUMBER() OVER w AS k, SUM(len(ws)) OVER w - len(ws) AS before FROM words WHERE len(ws) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT a.doc_id, a.k AS k, b.k AS last FROM said a JOIN said b ON a.doc_id = b.doc_id AND b.k > a.k AND b.before + b.n - a.before >= {spans.MIN_WORDS}
    AND (b.k = a.k + 1 OR b.before - a.before < {spans.MIN_WORDS} OR b.before + b.n - a.before - a.n < {spans.MIN_WORDS})),
runs AS (SELECT doc_id, k, MIN(last) AS last FROM pairs GROUP BY doc_id, k UNION SELECT doc_id, MAX(k), last FROM pairs GROUP BY doc_id, last
    UNION SELECT doc_id, k, k FROM said WHERE n >= {spans.LONG_SENTENCE}
    UNION SELECT doc_id, 1, MAX(k) FROM said GROUP BY doc_id HAVING COUNT(*) > 1 AND SUM(n) < {spans.MIN_WORDS}),
spans AS (SELECT r.doc_id, r.k, r.last, md5(string_agg(array_to_string(s.ws, ' '), ' ' ORDER BY s.k)) AS span FROM runs r
    JOIN said s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k AND r.last GROUP BY r.doc_id, r.k, r.last),
later AS (SELECT doc_id, k, last FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY span ORDER BY doc_id, k) AS seen FROM spans) WHERE seen > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM later l JOIN said s ON s.doc_id = l.doc_id AND s.k BETWEEN l.k AND l.last),
kept AS (SELECT p.doc_id, COALESCE(string_agg(p.part, '' ORDER BY p.i) FILTER (g.i IS NULL), '') AS text, CAST(COUNT(g.i) AS INTEGER) AS removed_sentences
    FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN COALESCE(k.text, '') END AS text, length(CASE WHEN d.text IS NOT NULL THEN COALESCE(k.text, '') END) AS n_chars,
    COALESCE(k.removed_sentences, 0) AS removed_sentences FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op2_chat_formatting": r"""
WITH turns AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, replace(role, '\', '\\') AS r, replace(text, '\', '\\') AS t, length(text) AS n, CASE WHEN role = 'user' THEN ((turn + conv_id) % 4 + 4) % 4 ELSE 3 END AS k FROM turns),
long AS (SELECT *, length(r) + length(t) + len(regexp_extract_all(r, '<s>|</s>|<\||\[INST\]|\[/INST\]')) + len(regexp_extract_all(t, '<s>|</s>|<\||\[INST\]|\[/INST\]')) AS chars,
    CASE WHEN k < 3 THEN ROW_NUMBER() OVER (PARTITION BY conv_id, k < 3 ORDER BY turn NULLS FIRST, role, text) - 1 END AS place,
    CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'document' END AS kind,
    CASE k WHEN 0 THEN greatest(1, ceil(n / 14.0) * ceil(n % 300 / 14.0)) WHEN 1 THEN greatest(1, ceil(n * 25 / 16.0)) WHEN 2 THEN greatest(1, n % 9) * 512 ELSE 0 END::BIGINT AS tokens FROM sized)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (SUM(chars) + 23 * COUNT(*) + 7)::BIGINT AS formatted_chars, COUNT(place) AS n_attachments, SUM(tokens)::BIGINT AS expanded_tokens,
    COALESCE(string_agg(kind || ':' || place || ':file-' || COALESCE(turn::VARCHAR, '') || ':' || tokens, ' ' ORDER BY place) FILTER (k < 3), '') AS attached,
    (SUM(chars + CASE WHEN k < 3 THEN length(kind) + length(place::VARCHAR) + 5 + n % 2 * 15 ELSE 0 END) + 23 * COUNT(*) + 7)::BIGINT AS chars_with_parts
FROM long GROUP BY conv_id
""",
}
