"""Quality rules: a table of thresholds compiled into one projection, without user functions.

:func:`measured` counts, in one expression a row, what the rules need: words,
their code points, symbols, stop words, lines, repeated lines, and words in
repeated runs of three. :func:`judged` compiles ``THRESHOLDS`` (name, part,
whole, low, high; a rule holds if ``low <= 100 * part / whole <= high``, ends
that are None are open) into a boolean column each and their conjunction. All
comparisons are of integers, so they are exact. There is no shuffle and no key:
a row is judged by its own text, so nothing can be hot.

A word is a run of characters other than space and U+0009 to U+000D; a line is
what newlines separate, with a word in it. Words in repeated runs are found by
sorting hashes of the runs with their places; neighbours of one hash are then
compared word by word. A text whose hashes are distinct needs no sort. The work for a text is that of a sort of it.

Null and empty texts have no words: all counts are 0 and the row fails. Texts of
any length are measured whole. Repeated rows are judged alike; an empty table
gives no rows. Other columns pass through, and columns of the input that are
named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is for on it as are by this an or from was "
    "le la les de des du et un une en dans est que qui pour sur par au "
    "der die das und ist ein eine zu den dem von mit für auf nicht sich "
    "el los las del y por con se no es su una al lo como"
).split()
STOP_WORDS = tuple(sorted(set(STOP_WORDS)))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")
#: Production rules: name, part, whole, least and greatest value of 100 * part / whole.
THRESHOLDS: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 250, 1400),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 3, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)
SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _count(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """How many words stand in a run of three words that the text has twice or more."""

    zero, three = F.lit(0).cast("bigint"), F.lit(3).cast("bigint")

    def covered(places: Column) -> Column:
        wide = F.transform(places, lambda p, k: F.least(three, F.coalesce(F.get(places, k + 1) - p, three)))
        return F.aggregate(wide, zero, lambda a, x: a + x)

    def equal(pair: Column) -> Column:
        p, q = pair[0].cast("int"), pair[1].cast("int")
        return (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

    def repeated(keys: Column, bits: Column) -> Column:
        """Of neighbours in ``keys`` with one hash, the places (the low ``bits``) where words are equal too."""
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        meets = F.transform(keys, lambda key, k: F.when(F.call_function("shiftrightunsigned", key.bitwiseXOR(F.get(keys, k + 1)), bits) == 0, k))
        pairs = F.transform(F.filter(meets, lambda k: k.isNotNull()), lambda k: F.array(keys[k].bitwiseAND(mask), keys[k + 1].bitwiseAND(mask)))
        return _let(F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, equal)))), covered)

    def sorted_runs(hashes: Column, bits: Column) -> Column:
        keys = F.transform(hashes, lambda h, k: F.call_function("shiftleft", h, bits).bitwiseOR(k.cast("bigint")))
        return _let(F.sort_array(keys), lambda keys: repeated(keys, bits))

    def runs(bits: Column) -> Column:
        hashes = F.transform(words, lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)))
        whole = F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
        return _let(whole, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(sorted_runs(h, bits)))

    return _let(F.length(F.bin(F.size(words).cast("bigint"))), runs)


def measures(text: Column) -> Column:
    """A struct of ``MEASURES``, all bigint."""

    def of_lines(lines: Column) -> list[Column]:
        return [
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.size(lines).cast("bigint").alias("n_lines"),
            _count(lines, lambda x: F.rtrim(x, F.lit(SPACES)).endswith("...") | F.rtrim(x, F.lit(SPACES)).endswith("…")).alias("n_ellipsis_lines"),
            _count(lines, lambda x: F.ltrim(x, F.lit(SPACES)).startswith("- ") | F.ltrim(x, F.lit(SPACES)).startswith("* ") | F.ltrim(x, F.lit(SPACES)).startswith("• ")).alias("n_bullet_lines"),
        ]

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            _repeat_words(words).alias("n_repeat_words"),
            _count(words, lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
        ]

    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return _let(words, lambda words: _let(lines, lambda lines: F.struct(*of_words(words), *of_lines(lines))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for each of ``MEASURES``."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return docs.select(*kept, measures(F.coalesce(F.col(text), F.lit(""))).alias("__measures")).select(*kept, *[F.col(f"__measures.{m}").alias(m) for m in MEASURES])


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated runs."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compiled(rule: tuple[str, str, str, int | None, int | None]) -> Column:
    """Whether a row of counts keeps ``rule``; without a whole it does."""
    _, part, whole, low, high = rule
    held = F.lit(True)
    if low is not None:
        held = held & (100 * F.col(part) >= low * F.col(whole))
    if high is not None:
        held = held & (100 * F.col(part) <= high * F.col(whole))
    return held


def judged(docs: DataFrame, text: str = "text", thresholds: tuple[tuple[str, str, str, int | None, int | None], ...] = THRESHOLDS) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed`` (names of the rules that don't hold, in the table's order) and ``kept``."""
    unknown = {m for _, part, whole, _, _ in thresholds for m in (part, whole)} - set(MEASURES)
    if unknown:
        raise ValueError(f"not measured: {sorted(unknown)}")
    names = F.filter(F.array(*[F.when(~compiled(rule), F.lit(rule[0])) for rule in thresholds]).cast("array<string>"), lambda x: x.isNotNull())
    counted = measured(docs.drop("base_failed", "failed", "kept"), text)
    held = ~base_failed()
    for rule in thresholds:
        held = held & compiled(rule)
    return counted.select(*[F.col(f"`{c}`") for c in counted.columns], base_failed().alias("base_failed"), names.alias("failed"), held.alias("kept"))
