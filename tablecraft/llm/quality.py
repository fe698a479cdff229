"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Statistics of a text: words are runs of characters other than space and
U+0009 to U+000D. A text of NULL counts as empty: all counts 0, and it fails
the rule on word numbers. A word is repeated if it lies in a window of five
words that occurs twice or more in the same text. A line is repeated if it has
a word and equals an earlier line of the text.

A rule rejects a text. ``cascade`` measures each rule on a sample (its cost: time
over the sample, its selectivity: share rejected), orders the rules by rejection
per cost, and tests a rule only on texts that all earlier rules accept. The order
decides what is spent, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000
SAMPLE_SEED = 11


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, though ``use`` names it in inner functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Array of words, without empty ones."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_chars(text: Column) -> Column:
    """Code points outside blanks."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.translate(line, BLANKS, "") != "",
    )
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _starts_of_repeats(found: Column) -> Column:
    """Places of the windows that occur twice or more, rising: equal neighbours after sorting."""
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(found) - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(found, i + 1, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )

    def twice(x: Column, at: Column, rows: Column) -> Column:
        before = (at > 0) & (F.get(rows, at - 1)["w"] == x["w"])
        return before | F.coalesce(F.get(rows, at + 1)["w"] == x["w"], F.lit(False))

    return bound(
        windows,
        lambda rows: F.sort_array(
            F.transform(F.filter(rows, lambda x, at: twice(x, at, rows)), lambda x: x["i"])
        ),
    )


def repeated_words(found: Column) -> Column:
    """Words inside windows that occur twice or more; ``found`` is the array of words.

    Texts whose window hashes all differ have none. Only the others compare the
    windows themselves, sorted with their places.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        )
        covered = F.aggregate(
            _starts_of_repeats(w),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )
        return (
            F.when(n <= WINDOW, 0)
            .when(F.size(F.array_distinct(hashes)) == n - WINDOW + 1, 0)
            .otherwise(covered)
        )

    return bound(found, count).cast("long")


def stutters(found: Column) -> Column:
    """Words equal to the word before them."""
    return bound(
        found, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))
    ).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects``: a condition over the text column and the array of its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules come first; the others are thresholds of this method.
MIN_WORDS = 10
MAX_REPEATED_WORDS_PCT = 20
MAX_SYMBOLS_PER_WORD_PCT = 20
MAX_REPEATED_LINES_PCT = 40
MEAN_WORD_CHARS = (2, 20)
MAX_STUTTER_PCT = 30

RULES = [
    Rule("few_words", lambda t, w: F.size(w) < MIN_WORDS),
    Rule("repeated_words", lambda t, w: 100 * repeated_words(w) > MAX_REPEATED_WORDS_PCT * F.size(w)),
    Rule("symbols", lambda t, w: 100 * symbols(t) > MAX_SYMBOLS_PER_WORD_PCT * F.size(w)),
    Rule(
        "repeated_lines",
        lambda t, w: 100 * repeated_lines(t)
        > MAX_REPEATED_LINES_PCT * F.size(F.split(F.coalesce(t, F.lit("")), "\n")),
    ),
    Rule(
        "word_length",
        lambda t, w: ~(word_chars(t)).between(MEAN_WORD_CHARS[0] * F.size(w), MEAN_WORD_CHARS[1] * F.size(w)),
    ),
    Rule("stutter", lambda t, w: 100 * stutters(w) > MAX_STUTTER_PCT * F.size(w)),
]


def measured(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds over the sample, share rejected), on about SAMPLE_ROWS rows.

    The sample is drawn from all rows by a seeded fraction, in all tasks of the scan,
    then held in one partition for the measurement only. An empty table measures 0 for each.
    """
    total = docs.count()
    fraction = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = docs.select(F.col(text).alias("t")).sample(fraction, SAMPLE_SEED).repartition(1).persist()
    try:
        n = sample.count()

        def timed(condition: Column) -> tuple[float, int]:
            start = time.perf_counter()
            hits = sample.select(F.count_if(condition).alias("n")).first()["n"]
            return time.perf_counter() - start, hits

        t = F.col("t")
        empty, _ = min(timed(t.isNull()) for _ in range(2))
        found = []
        for rule in rules:
            seconds, hits = timed(~verdict([rule], t, words(t)))
            found.append((rule, max(seconds - empty, 1e-3), hits / n if n else 0.0))
        return found
    finally:
        sample.unpersist()


def ordered(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> list[Rule]:
    """Rules by rejection per cost, the best first; ties keep the given order."""
    return [m[0] for m in sorted(measured(docs, rules, text), key=lambda m: -m[2] / m[1])]


def verdict(rules: list[Rule], text: Column, found: Column) -> Column:
    """True if no rule rejects; a rule is evaluated only when all before it accept."""

    def judge(w: Column) -> Column:
        kept = F.lit(True)
        for rule in reversed(rules):
            kept = F.when(F.coalesce(rule.rejects(text, w), F.lit(False)), F.lit(False)).otherwise(kept)
        return kept

    return bound(found, judge)


def cascade(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns as they are.

    Repeated rows are judged alike. An empty table stays empty. Other columns,
    whatever their names, are carried along.
    """
    best = ordered(docs, rules, text)
    return docs.where(verdict(best, F.col(text), words(F.col(text))))


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base numbers and the verdict of the cascade.

    The rules over numbers that are reported anyway read them instead of the text.
    """
    best = ordered(docs)
    rows = docs.select("doc_id", F.col("text").alias("t"))
    rows = rows.select("doc_id", "t", words(F.col("t")).alias("w"))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("t")).alias("word_chars"),
        symbols(F.col("t")).alias("n_symbols"),
        repeated_lines(F.col("t")).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.split(F.coalesce(F.col("t"), F.lit("")), "\n")).alias("n_lines"),
        stutters(F.col("w")).alias("n_stutters"),
    )
    n = F.col("n_words")
    read = {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEATED_WORDS_PCT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS_PER_WORD_PCT * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > MAX_REPEATED_LINES_PCT * F.col("n_lines"),
        "word_length": ~F.col("word_chars").between(MEAN_WORD_CHARS[0] * n, MEAN_WORD_CHARS[1] * n),
        "stutter": 100 * F.col("n_stutters") > MAX_STUTTER_PCT * n,
    }
    by_number = [Rule(rule.name, lambda t, w, name=rule.name: read[name]) for rule in best]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (read["few_words"] | read["repeated_words"]).alias("base_failed"),
        verdict(by_number, F.lit(None), F.lit(None).cast("array<string>")).alias("kept"),
    )
