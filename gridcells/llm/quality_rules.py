"""Line-first quality rules, in DataFrame expressions only.

Each line with a word is judged alone and fails if
* symbols: more than one ``#*$%&<>`` for each ``per_symbol`` words;
* navigation: more than one separator (``|`` and the like) for each ``per_separator`` words;
* punctuation: fewer than ``heading_words`` words and no sentence mark;
* boilerplate: one of the phrases of page furniture, in a line of fewer than ``phrase_words`` words.
Failing lines are removed.  A document is rejected if its lines lose more than ``max_lost``
percent of their characters, or on the base rules over its whole text: fewer than 50 words, or over half of its words in
repeated 3-word windows.

Everything is one projection of a row: no shuffle, and a long text costs its own task only.
Windows are compared within their text by 64-bit hashes.

Cases.  A null or empty text has no words and is rejected; lines without a word are neither judged nor counted;
a very long text takes time in proportion to its length; repeated rows and ids are judged row by row; an empty table gives no rows; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcells.llm.common import let, texts

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS, SEPARATORS = "#*$%&<>", "|»›·•¦"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MARKS = r"[.!?…。！？]"
PHRASES = ("accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript",
           "javascript is disabled", "log in or sign up", "privacy policy", "share on facebook", "share on twitter",
           "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def window_keys(words: Column) -> Column:
    """Hashes of all 3-word windows."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                       lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(keys)


def repeated_starts(keys: Column) -> Column:
    """Starts of windows whose key comes twice, in order; null if there are none."""
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    twice = let(placed, lambda s: F.filter(s, lambda x, i: x["k"].eqNullSafe(F.get(s, i - 1)["k"])
                                           | x["k"].eqNullSafe(F.get(s, i + 1)["k"])))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.array_sort(F.transform(twice, lambda x: x["i"])))


def covered_words(starts: Column) -> Column:
    """Each start covers three words, or those up to the next start."""
    steps = F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))


def base_counts(text: Column, lines: Column) -> Column:
    words = F.array_remove(F.split(text, SPACE, -1), "")
    return let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        count_of(text, "#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        let(let(window_keys(w), repeated_starts), covered_words).cast("bigint").alias("n_repeat_words")))


def line_fails(line: Column, per_symbol: int, per_separator: int, heading_words: int, phrase_words: int) -> Column:
    lower = F.translate(line, UPPER, LOWER)
    return let(F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))), lambda n: (
        (count_of(line, SYMBOLS) * per_symbol > n) | (count_of(line, SEPARATORS) * per_separator > n)
        | ((n < heading_words) & ~line.rlike(MARKS)) | ((n < phrase_words) & lower.rlike("|".join(PHRASES)))))


def verdict(text: Column, per_symbol: int = 5, per_separator: int = 5, heading_words: int = 12, phrase_words: int = 40,
            max_lost: int = 50) -> Column:
    """Struct of the base counts, ``base_failed``, ``kept``, ``clean`` (text of the kept lines),
    ``n_lines``, ``n_lines_removed``, ``chars`` and ``chars_lost`` of lines with a word."""
    def size(lines):
        return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["line"]))

    def judged(t, every, lines, bad, base):
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        clean = F.when(F.size(bad) == 0, t).otherwise(
            F.array_join(F.transform(F.filter(every, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"))
        return let(F.struct(size(lines).alias("chars"), size(bad).alias("lost")), lambda s: F.struct(
            *(base[c].alias(c) for c in BASE), failed.alias("base_failed"),
            (~failed & (100 * s["lost"] <= max_lost * s["chars"])).alias("kept"), clean.alias("clean"),
            F.size(lines).alias("n_lines"), F.size(bad).alias("n_lines_removed"),
            s["chars"].alias("chars"), s["lost"].alias("chars_lost")))

    def judge(line):                                     # each line once
        has_word = line.rlike(WORD)
        fails = line_fails(line, per_symbol, per_separator, heading_words, phrase_words)
        return F.struct(line.alias("line"), has_word.alias("has_word"), F.when(has_word, fails).otherwise(False).alias("fails"))

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(
        F.transform(F.split(t, "\n", -1), judge), lambda every: let(
            F.filter(every, lambda x: x["has_word"]), lambda lines: let(F.filter(lines, lambda x: x["fails"]), lambda bad: let(
                base_counts(t, F.transform(lines, lambda x: x["line"])), lambda base: judged(t, every, lines, bad, base))))))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row: ``doc_id``, the base counts, ``base_failed``, ``kept``, the cleaned
    text and what the lines lost."""
    return (texts(df, id_col, text_col).select("doc_id", verdict(F.col("text"), **how).alias("q"))
            .select("doc_id", "q.*"))


def keep_good(df: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that are kept, with cleaned texts; ``n_chars`` follows if there is one.  Null and empty texts go; repeated rows
    are judged alike; an empty table gives no rows; other columns are left alone, whatever their names."""
    judged = F.filter(F.array(verdict(F.col(f"`{text_col}`"), **how)), lambda q: q["kept"])
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.explode(judged).alias("q"))

    def column(c):
        if c == text_col:
            return F.col("q.clean").alias(c)
        if c == "n_chars":
            return F.length("q.clean").cast(df.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`")
    return rows.select(*map(column, df.columns))
