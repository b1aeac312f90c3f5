"""Quality rules: a threshold table compiled into one projection, without user functions.

The stop words are those of four languages: a text of 50 words or more in another language is rejected unless a caller
passes ``rules`` without that row or with another threshold.

Null and empty texts have no words, so they fail the base rules and are not kept. Every row of the input gives one row;
repeated rows stay repeated, other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this",
    "are", "from", "at", "an", "or",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein",
    "eine", "als", "auch", "es",
    # French
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur",
    "pas", "au", "avec",
    # Spanish
    "el", "los", "y", "se", "del", "las", "por", "con", "no", "para", "su", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text whose ``part / whole`` lies outside [low, high]; both are names of measured columns.

    With ``least`` the rule holds only for texts of so many words, with ``spare`` only where ``part`` is above it.
    """

    part: str
    whole: str
    low: float = float("-inf")
    high: float = float("inf")
    least: int = 0
    spare: int = -1


#: The threshold table. Lengths are in code points for each word, all others are shares. One line said twice is no sign
#: of a bad text of three lines, so repeated lines count from four on.
RULES = (
    Rule("word_chars", "n_words", 2.0, 14.0),
    Rule("n_symbols", "n_words", high=0.25),
    Rule("n_stop_words", "n_words", 0.02, least=50),
    Rule("n_dup_lines", "n_lines", high=0.3, spare=3),
    Rule("n_bullet_lines", "n_lines", high=0.9),
    Rule("n_ellipsis_lines", "n_lines", high=0.3),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shape(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Words, lines and the hashes of all word windows as arrays of the row."""
    body = F.coalesce(F.col(text), F.lit(""))
    # The input row goes along whole; nothing of it is read unless a caller asks for it.
    shaped = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), body.alias("_text")).select(
        "_row",
        "doc_id",
        "_text",
        # One space between words lets the split by a single character skip the pattern engine.
        F.array_remove(F.split(F.regexp_replace("_text", "[\\x09-\\x0D]", " "), " "), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    # Hashes of two, four and eight consecutive words: each step joins an array with itself, shifted.
    shaped = shaped.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    hashes = F.col("_hashes")
    for shift in (1, 2, 4):
        shaped = shaped.withColumn("_windows", hashes)
        hashes = F.zip_with("_windows", F.slice("_windows", shift + 1, F.size("_words")), lambda a, b: F.xxhash64(a, b))
    return shaped.withColumn("_windows", F.slice(hashes, 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))


def _repeated_starts(windows: Column) -> Column:
    """Windows by hash and place; empty, and never sorted, where all hashes of the text differ."""
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(pairs)).otherwise(
        F.slice(pairs, 1, 0)
    )


def _starts(order: str) -> Column:
    """Places of windows that have an equal neighbour in hash order, ascending."""
    order = F.col(order)

    def place(x: Column, k: Column) -> Column:
        twin = F.get(order, k - 1)["h"].eqNullSafe(x["h"]) | F.get(order, k + 1)["h"].eqNullSafe(x["h"])
        return F.when(twin, x["i"])

    return F.sort_array(F.array_compact(F.transform(order, place)))


def _covered(starts: Column) -> Column:
    """Words under windows that start at these ascending places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda state, at: F.struct(
            (state["n"] + F.least(F.lit(WINDOW), at - state["last"])).alias("n"), at.alias("last")
        ),
        lambda state: state["n"].cast("long"),
    )


def _stop_hashes() -> list[int]:
    """Hashes of the stop words as written in a sentence and at its start."""
    forms = {form for word in STOP_WORDS for form in (word, word.capitalize())}
    hashes = [xxhash.xxh64_intdigest(form.encode(), seed=42) for form in sorted(forms)]
    return [h - (1 << 64) if h >> 63 else h for h in hashes]


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts for each document, beside the input row in ``_row``.

    ``n_repeat_words`` counts the words in windows of eight words that the text has at least twice.
    """
    ordered = _shape(docs, doc_id, text).withColumn("_order", _repeated_starts(F.col("_windows")))
    starts = ordered.withColumn("_starts", _starts("_order"))
    lines = F.col("_lines")
    return starts.select(
        "_row",
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_starts")).alias("n_repeat_words"),
        F.size(F.filter("_hashes", lambda h: h.isin(_stop_hashes()))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*\\u2022]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|\\u2026)[\\x20\\x09\\x0D]*\\z"))).cast("long").alias(
            "n_ellipsis_lines"
        ),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one boolean expression: true where no rule rejects."""
    verdict = F.lit(True)
    for rule in rules:
        part, whole = F.col(rule.part), F.col(rule.whole)
        inside = F.lit(True)
        if rule.low > float("-inf"):
            inside = inside & (part >= whole * rule.low)
        if rule.high < float("inf"):
            inside = inside & (part <= whole * rule.high)
        verdict = verdict & ((F.col("n_words") < rule.least) | (part <= rule.spare) | inside)
    return verdict


def _judged(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str, text: str) -> DataFrame:
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (
        measures(docs, doc_id, text)
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & compiled(rules))
    )


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``.

    A text fails the base rules with fewer than 20 words, or if over 30 % of its words are in repeated windows.
    """
    return _judged(docs, rules, doc_id, text).drop("_row")


def quality_filter(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; judged in the row, without a join."""
    # The observation counts what is dropped. It also keeps the filter above the projections: pushed below them, the
    # verdict would hold every array expression many times over.
    counted = [F.count("*").alias("rows"), F.count_if("kept").alias("kept")]
    judged = _judged(docs, rules, doc_id, text).select("_row", "kept").observe("quality_rules", *counted)
    return judged.filter("kept").select("_row.*")
