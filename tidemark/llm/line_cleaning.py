"""Line-first cleaning: rules for lines, then for what they leave of a document; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, any_of

SYMBOL = r"[#*$%&|<>]"
#: Phrases of notices, menus and banners, in lower case.
BOILERPLATE = r"(?i)(all rights reserved|licen[sc]ed under|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|click here|sign up|log in to|subscribe to|share on|skip to (main )?content|copyright (\(c\)|©|[0-9]{4}))"
LOST = 0.5
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "kept_chars", "kept")


def may_hold_boilerplate(body: Column) -> Column:
    """False only for texts without a match of BOILERPLATE: each of its phrases holds one of these."""
    low = F.lower(body)
    return any_of(low.contains(x) for x in ("rights reserved", "ed under", "terms of", "policy", "cookie", "javascript", "click here", "sign up", "log in", "subscribe", "share on", "skip to", "copyright"))


def fails(line: Column, words: Column, bars: Column, symbols: Column, shouts: Column, notices: Column) -> Column:
    """Whether a line, of these words, is to go: navigation (three bars or more), signs on a tenth of its characters, shouting (signs of exclamation on
    over a third of ten or more words, or most letters capital in five words or more), few different words, notices.

    bars, symbols, shouts, notices: whether the document may have a line for the rule at all; most have not, and their lines skip it. If
    most letters are capital, two in a row are, or the only one is: the letters are counted only then."""
    n = F.size(words)
    return any_of([
        bars & (F.regexp_count(line, F.lit(r"[|»›]")) >= 3),
        symbols & (F.regexp_count(line, F.lit(SYMBOL)) * 10 > F.length(line)),
        (n >= 5) & shouts & (F.regexp_count(line, F.lit("!")) * 3 > n),
        (n >= 5) & line.rlike(r"\p{Lu}\P{L}*\p{Lu}|^\P{L}*\p{Lu}\P{L}*$") & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 5 > F.regexp_count(line, F.lit(r"\p{L}")) * 3),
        (n >= 12) & (F.size(F.array_distinct(words)) * 3 < n),
        notices & line.rlike(BOILERPLATE),
    ])


def with_measures(docs: DataFrame, text: str = "text", lost: float = LOST, prefix: str = "") -> DataFrame:
    """docs with COLUMNS and `clean` (the text without the lines that fail), each named after prefix.

    A document is kept if its base holds (50 words, at most half of them in repeated windows of three) and its failing
    lines hold at most `lost` of the characters of its words. Everything is an expression of the row
    itself: no row moves, so neither copies nor hot sources matter, and a long text costs its length times
    the log of it. A null text has no words and one empty line, so its base fails; empty tables
    give no rows; names that clash are overwritten, so pass a prefix to keep them."""
    c = lambda name: F.col(f"{prefix}{name}")
    put = lambda df, **cols: df.withColumns({f"{prefix}{k}": v for k, v in cols.items()})
    df = put(docs, body=F.coalesce(F.col(text), F.lit("")))
    df = put(df, lines=F.split(c("body"), "\n"), n_symbols=F.regexp_count(c("body"), F.lit(SYMBOL)).cast("long"), notices=may_hold_boilerplate(c("body")), shouts=c("body").contains("!"), bars=any_of(c("body").contains(x) for x in "|»›"))
    df = put(df, by_line=F.transform(c("lines"), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))  # no word spans a line's end
    df = put(df, words=F.flatten(c("by_line")), full=F.filter(c("lines"), lambda x, i: F.size(F.get(c("by_line"), i)) > 0), good=F.filter(c("lines"), lambda x, i: ~fails(x, F.get(c("by_line"), i), c("bars"), c("n_symbols") > 0, c("shouts"), c("notices"))))
    df = put(df, n_words=F.size(c("words")).cast("long"), n_lines=F.size(c("lines")).cast("long"), word_chars=F.length(F.array_join(c("words"), "")).cast("long"))
    # windows of three words by hash; only where one repeats are they put in order, to find the words that repeated ones cover
    w = c("words")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = put(df, n_dup_lines=(F.size(c("full")) - F.size(F.array_distinct(c("full")))).cast("long"), grams=grams, n_lines_removed=c("n_lines") - F.size(c("good")))
    df = put(df, clean=F.when(c("n_lines_removed") == 0, c("body")).otherwise(F.array_join(c("good"), "\n")))
    df = put(df, sorted=F.when(F.size(F.array_distinct(c("grams"))) < F.size(c("grams")), F.array_sort(F.transform(c("grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")), kept_chars=F.when(c("n_lines_removed") == 0, c("word_chars")).otherwise(F.length(F.regexp_replace(c("clean"), r"[\x20\x09-\x0D]+", "")).cast("long")))
    s = c("sorted")
    twice = F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False)))
    df = put(df, places=F.array_sort(F.transform(twice, lambda e: e["i"])))
    p = c("places")
    df = put(df, covers=F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3)))))
    df = put(df, n_repeat_words=F.aggregate(c("covers"), F.lit(0).cast("long"), lambda a, x: a + x))
    df = put(df, base_failed=(c("n_words") < 50) | (c("n_repeat_words") * 100 > c("n_words") * 50))
    df = put(df, kept=~c("base_failed") & (c("word_chars") - c("kept_chars") <= c("word_chars") * lost))
    return df.drop(*(f"{prefix}{x}" for x in ("body", "words", "lines", "by_line", "bars", "shouts", "notices", "full", "good", "grams", "sorted", "places", "covers")))


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns, their text without the lines that fail and, where there is an n_chars, its new length."""
    # the row number keeps the condition above the measures: pushed below them, it would repeat each as often as others use it
    df = with_measures(docs, text, prefix="__clean_").withColumn("__clean_row", F.monotonically_increasing_id())
    df = df.where(F.col("__clean_kept") & (F.col("__clean_row") >= 0)).withColumn(text, F.col("__clean_clean"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
