"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``RULES`` has a row for each rule: its name, the measure, the bound and which side fails. ``compiled`` turns the table into
columns of one ``select`` over the measures of the text: word and character counts, symbols, stop words, letter case and
repeated lines and windows. All measures are taken over whole texts; a null text is an empty one.

Repeated words are those in a 3-word window that is found twice or more in the text (windows are compared as 64-bit hashes).
Windows are sorted with their places, so the work on a text of n words grows as n log n. Empty texts fail by length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are this by from or an at not "
    "der die das und ein eine ist in zu den von mit dem auf für als im nicht des "
    "le la les de des du et un une en que qui est au pour par pas dans il elle "
    "el los las y con por una su para es lo se del como"
).split()

#: (rule, measure, comparison that keeps the text, bound). Measures are the columns of ``measures``.
RULES = (
    ("too_short", "n_words", ">=", 50.0),
    ("too_repetitive", "repeat_share", "<=", 0.5),
    ("words_too_short", "mean_word_chars", ">=", 2.0),
    ("words_too_long", "mean_word_chars", "<=", 12.0),
    ("too_many_symbols", "symbol_ratio", "<=", 0.2),
    ("too_few_stop_words", "stop_word_share", ">=", 0.02),
    ("too_many_equal_lines", "equal_line_share", "<=", 0.75),
    ("too_many_shouts", "shout_ratio", "<=", 0.2),
    ("too_few_letters", "letter_share", ">=", 0.6),
)
#: Rules that the contract names apart: failing one of them is ``base_failed``.
BASE_RULES = ("too_short", "too_repetitive")


def _windows(words: Column) -> Column:
    """(hash, place) of each 3-word window, sorted; empty unless there are two windows at least."""
    n = F.size(words)
    starts = F.when(n >= 4, F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))


def _repeated_places(windows: Column) -> Column:
    """Sorted places of the windows whose hash a neighbour has too."""

    def twice(w: Column, k: Column) -> Column:
        return w["h"].eqNullSafe(F.get(windows, k - 1)["h"]) | w["h"].eqNullSafe(F.get(windows, k + 1)["h"])

    return F.sort_array(F.transform(F.filter(windows, twice), lambda w: w["i"]))


def _covered(places: Column) -> Column:
    """Words under the windows at these places: 3 for the last, and for the others 3 or the distance to the next."""
    gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x).cast("long")


def counted(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    raw = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = raw.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    # one column after another: each is made once and then looked up in the next one's lambdas
    split = split.select("*", _windows(F.col("words")).alias("windows"))
    split = split.select("doc_id", "text", "words", _repeated_places(F.col("windows")).alias("places"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    plain = F.translate("text", " \t\n\x0b\x0c\r", "")
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(plain).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
        F.regexp_count(F.lower("text"), F.lit(r"(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?=[\x20\x09-\x0D.,;:]|$)")).cast("long").alias("n_stop_words"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_shouts"),
        F.coalesce(F.length(plain) - F.length(F.translate(plain, "0123456789.,;:!?-_=+/\\()[]{}'\"@~^`" + SYMBOLS, "")), F.lit(0)).cast("long").alias("n_other_chars"),
    )


#: Measures as ratios of counts; no words: 0.
MEASURES = {
    "n_words": "cast(n_words as double)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "mean_word_chars": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbol_ratio": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "stop_word_share": "coalesce(try_divide(n_stop_words, n_words), 0D)",
    "equal_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "shout_ratio": "coalesce(try_divide(n_shouts, n_words), 0D)",
    "letter_share": "coalesce(1 - try_divide(n_other_chars, word_chars), 0D)",
}


def compiled(rules: tuple = RULES) -> list[Column]:
    """One array column with the names of the failed rules: the whole table as one expression over the counts."""
    failed = [F.when(~F.expr(f"{MEASURES[measure]} {keeps} {bound}D"), F.lit(name)) for name, measure, keeps, bound in rules]
    return [F.array_compact(F.array(*failed)).alias("failed")]


def judged(documents: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, the counts, and ``failed``: the names of the rules that the text fails."""
    counts = counted(documents)
    return counts.select("*", *compiled(rules))


def rule_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns, and the names of the failed rules joined by commas."""
    out = judged(documents)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"))
