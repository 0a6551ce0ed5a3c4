"""Line-first quality rules, from built-in functions only.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols); failing lines are removed,
and a document is rejected if too much of its text went with them. Beside that stand word counts that
reject very short and very repetitive documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space, symbols and the limits of the base rules.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30

#: A line fails as navigation with at least this many separators and one for every so many words, ...
NAV_SEPARATORS, NAV_WORDS_PER_SEPARATOR = 4, 3
#: ... as symbol junk with more than one symbol run for so many words, ...
WORDS_PER_SYMBOL_RUN = 2
#: ... as shouting if it ends in several exclamation or question marks and holds so many such runs, ...
MIN_SHOUTS = 3
#: ... as stutter with so many words that repeat the word before, and more than one in four, ...
MIN_STUTTERS, WORDS_PER_STUTTER = 3, 4
#: ... and as unpunctuated with at least so many words and no sentence sign among them.
LONG_LINE = 30
#: A document that loses more than this share of its word characters is rejected.
MAX_LOSS = 0.5

_SENTENCE = r"[.!?;:,…。！？।؟۔]"
_BOILERPLATE = (
    r"(?i)\b(lorem ipsum|javascript (is|must be) (disabled|enabled)|enable javascript|accept (all )?cookies|use of cookies|cookie policy|privacy policy|terms of (use|service)|"
    r"all rights reserved|click here|sign up (now|for)|log ?in to|subscribe (now|to)|share (this|on)|skip to (main )?content|back to top|page not found)\b"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def line_fails(line: Column) -> Column:
    """Whether one line is navigation, symbol junk, shouting, stutter, boilerplate or an unpunctuated run.

    Blank lines and ordinary short lines (titles, single words) pass.
    """
    n_words = F.regexp_count(line, F.lit(f"{WORD}+"))
    separators = F.regexp_count(line, F.lit(r"(?<!\S)[|»›·•>](?!\S)"))
    symbols = F.regexp_count(line, F.lit(f"{SYMBOL}+"))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    navigation = (separators >= NAV_SEPARATORS) & (separators * NAV_WORDS_PER_SEPARATOR >= n_words)
    junk = (symbols >= 3) & (symbols * WORDS_PER_SYMBOL_RUN > n_words)
    shouting = (shouts >= MIN_SHOUTS) & (shouts * 4 > n_words)
    stutters = F.regexp_count(line, F.lit(r"(?<!\S)(\S++)(?=\s+\1(?!\S))"))
    stutter = (stutters >= MIN_STUTTERS) & (stutters * WORDS_PER_STUTTER > n_words)
    boilerplate = line.rlike(_BOILERPLATE) & (n_words <= 40)
    unpunctuated = ~line.rlike(_SENTENCE) & (n_words >= LONG_LINE)
    return navigation | junk | shouting | stutter | boilerplate | unpunctuated


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more.

    Windows are compared by 64-bit hashes of their words. Only texts in which two windows are equal pay
    for the sort that finds which: there, window hashes sort next to each other with their positions,
    the positions of all repeats are put in order, and each adds the words that the one before does not
    cover.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(r: Column) -> Column:
            # neighbours by index; get() is null beyond both ends
            repeats = F.filter(r, lambda x, k: F.coalesce(x["h"] == F.get(r, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(r, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(repeats, lambda x: x["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(ranked, lambda r: let(starts(r), total))

    def by_hash(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(words, lambda w: let(hashes(w), by_hash)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines_removed, loss, clean_text, kept.

    ``clean_text`` is the text without the lines that fail; blank lines stay, so a text of which no line
    fails is its own clean text, unless no word is left: then it is empty. A null text has no words and
    fails the base rules, as an empty one does. A null doc_id stays null, repeated rows stay repeated,
    other columns are ignored, an empty table gives no rows. Texts of any length are judged whole, in one
    row and one pass without a shuffle or Python.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def measures(t: Column) -> Column:
        return let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    def lines(t: Column) -> Column:
        def of(every: Column, fails: Column) -> Column:
            good = F.filter(every, lambda x, k: x.rlike(WORD) & ~F.get(fails, k))
            worded = F.filter(every, lambda x: x.rlike(WORD))
            return let(worded, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), good.alias("good"), F.size(a).alias("n"), fails.alias("fails")))

        return let(F.split(t, "\n", -1), lambda every: let(F.transform(every, lambda x: x.rlike(WORD) & line_fails(x)), lambda fails: of(every, fails)))

    out = base.select("doc_id", "text", measures(F.col("text")).alias("m"), lines(F.col("text")).alias("l"), F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    out = out.select("doc_id", "text", "m.*", "n_symbols", "l.n_dup_lines", F.col("l.good").alias("good"), F.col("l.n").alias("n_lines"), F.col("l.fails").alias("fails"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    out = out.withColumn("left_chars", F.length(F.regexp_replace(F.array_join("good", "\n"), f"{SPACE}+", "")))
    out = out.withColumn("loss", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1 - F.col("left_chars") / F.col("word_chars")))
    # the flags of the pass that judged the lines, so nothing is searched for
    stays = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.get(F.col("fails"), k)), "\n")
    clean = F.when(F.col("left_chars") == 0, "").when(F.size("good") == F.col("n_lines"), F.col("text")).otherwise(stays)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("n_lines") - F.size("good")).cast("long").alias("n_lines_removed"), "loss", clean.alias("clean_text"),
        (~F.col("base_failed") & (F.col("loss") <= MAX_LOSS)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without the lines that fail, all other
    columns as they were."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    judged = judge(docs.select(others.alias("row"), F.col(f"`{text}`").alias("text")), "row", "text")
    # a row number holds the filter above the measures; below them it would derive them once more
    judged = judged.withColumn("__n", F.monotonically_increasing_id()).where("kept AND __n >= 0")
    return judged.select("doc_id.*", F.col("clean_text").alias(text)).select(*(f"`{c}`" for c in docs.columns))
