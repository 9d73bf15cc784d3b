"""Fuzzy line deduplication: keys of normalised lines, edit similarity of those that share one, one of each group; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, join_checked, partitions, staged
from .simhash_links import key_groups

#: Two lines are alike from this edit similarity on; lines of fewer characters are compared as equal only.
ALIKE, LEAST_CHARS = 0.8, 20
#: A line's sketch is minima over hashes of its features, so many of the first and of the second sort; each key is three minima of the first and one of the second.
#: Lines of up to MORE_KEYS characters have few features, of which an edit is a larger share, and so as many keys more, of two and one.
MINIMA, MORE_KEYS = 10, 160
#: Features are words of WORD_BYTES bytes or more and pairs of words in lines of BY_WORDS words or more, windows of WINDOW_CHARS characters in
#: those of BY_CHARS words or fewer: lengths overlap, so that two alike lines have one kind in common. Scripts without spaces have few words.
WORD_BYTES, BY_WORDS, BY_CHARS, WINDOW_CHARS = 4, 8, 9, 5
#: Code points (first, number) that stand for words when distances are counted in words.
SIGNS = (0x4E00, 0x5200)


def normalised(line: Column) -> Column:
    """Lower case, letters and digits only with one space between words, each run of digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}0-9]+", " "), "[0-9]+", "0"))


def word_signs(norm: Column) -> Column:
    """A text with one sign for each word, by its hash; different words have one sign once in some SIGNS[1] times."""
    sign = lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(SIGNS[1])) + SIGNS[0])
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), sign), "")), "UTF-16BE")


def edit_similarity(x: Column, y: Column, least: float) -> Column:
    """1 - edit distance / longer length, and 0 where that is below `least`."""
    longer = F.greatest(F.length(x), F.length(y))
    d = F.call_function("levenshtein", x, y, F.ceil(longer * (1 - least)).cast("int"))  # -1 beyond that distance
    return F.when(d >= 0, 1 - d / longer).otherwise(0.0)


def alike_lines(alike: float) -> Column:
    """Whether two lines have an edit similarity of `alike` or more in words, or in characters; columns x_norm, x_signs (a character a word) and the same with y.

    Characters alone decide if one line has BY_CHARS words or fewer; else words or characters do, whatever the lines' length and however many words are in place. Words come first, as
    the distance in characters costs most."""
    in_words = edit_similarity(F.col("x_signs"), F.col("y_signs"), alike) >= alike
    in_chars = edit_similarity(F.col("x_norm"), F.col("y_norm"), alike) >= alike
    return F.when(F.least(F.length("x_signs"), F.length("y_signs")) <= BY_CHARS, in_chars).otherwise(in_words | in_chars)


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc_id, pos, n_lines, key, norm): each line of each row of docs; key, a hash of the normalised line, is null where nothing is left of it.

    n_lines, the row's number of lines, stands at its first only."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))  # numbered before the lines are made
    lines = rows.select("row", "doc_id", F.size("lines").cast("long").alias("n"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("row", "doc_id", "pos", F.when(F.col("pos") == 0, F.col("n")).alias("n_lines"), normalised(F.col("line")).alias("norm"))
    return lines.select("row", "doc_id", "pos", "n_lines", F.when(F.col("norm") != "", F.xxhash64("norm")).alias("key"), "norm")


def line_sketches(lines: DataFrame, least_chars: int) -> DataFrame:
    """(node, row, size, keys): for each different line of least_chars characters or more, the first row that has it and keys of which two alike lines are likely to share one.

    Features are rows and minima aggregates, so equal lines meet early. Lines without a long word have four minima over pairs of words in their keys."""
    own = lines.where(F.length("norm") >= least_chars).select(F.col("key").alias("node"), "row", F.length("norm").alias("size"), "norm", F.split("norm", " ").alias("w"))
    n = F.size("w")
    own = own.select("node", "row", "size", "w", F.when(n <= BY_CHARS, F.split("norm", "")).alias("c"))
    windows = F.when(n <= BY_CHARS, F.greatest(F.size("c") - WINDOW_CHARS + 1, F.lit(1))).otherwise(0)
    features = own.select("node", "row", "size", "w", "c", F.explode(F.sequence(-windows, F.when(n >= BY_WORDS, n).otherwise(0) - 1)).alias("i"))  # windows below 0, words from 0: lines are read once
    i, window, at = F.col("i"), F.xxhash64(F.slice("c", -F.col("i"), WINDOW_CHARS)), lambda k: F.get("w", F.col("i") + k)
    one = F.when(i < 0, window).when(F.octet_length(at(0)) >= WORD_BYTES, F.xxhash64(at(0)))
    two = F.when(i < 0, window).when(at(1).isNotNull(), F.xxhash64(at(0), at(1)))
    features = features.select("node", "row", "size", F.when(i < 0, "c").otherwise("w").alias("kind"), one.alias("one"), two.alias("two"))
    turn = [(j * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for j in range(2 * MINIMA)]  # the least hash after each exclusive or is any feature's alike
    columns = [(f"{c}{j}", F.col(c)) for c in ("one", "two") for j in range(MINIMA)]
    minima = [F.min(h.bitwiseXOR(F.lit(t))).alias(name) for (name, h), t in zip(columns, turn, strict=True)]
    found = features.groupBy("node", "kind").agg(F.min("row").alias("row"), F.min("size").alias("size"), *minima)
    one = lambda k, other: F.coalesce(f"one{k % MINIMA}", f"two{other % MINIMA}")
    keys = [F.xxhash64("kind", F.lit(k), one(k, k + 1), one(k + 3, k + 2), one(k + 4, k + 3), f"two{k}") for k in range(MINIMA)]
    more = [F.xxhash64("kind", F.lit(MINIMA + k), one(k, k + 1), one(k + 2, k + 3), f"two{k}") for k in range(MINIMA)]
    return found.select("node", "row", "size", F.when(F.col("size") <= MORE_KEYS, F.array(*keys, *more)).otherwise(F.array(*keys)).alias("keys"))


def line_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", alike: float = ALIKE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped), a row for each row of docs; dropped holds the positions, from 0, of the lines to go.

    Lines are equal by their normalised text, whatever their length. Different ones of least_chars characters or more are linked if their edit
    similarity (1 - distance / the longer length), in words or in characters by alike_lines, is `alike` or more; candidates share a key of line_sketches. The first line of each
    connected group stays, by doc_id, null last, and position. Lines are written once, normalised; after that they travel as hashes, equal ones
    are one node whatever their number, and only candidates' texts are looked up, one line each, by its row.

    A null text is one empty line; lines of which nothing is left when normalised always stay; rows with a null doc_id are linked like others; rows that
    repeat an id are rows of their own, in order of storage; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    lines = staged(line_table(docs, key, text), "lines", compression="zstd")  # the one table of the texts' size
    sketches = staged(line_sketches(lines, least_chars), "line-sketches")
    spots = sketches.select("node", "row")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "line-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(spots.withColumnRenamed("node", "key"), "key").distinct()
        wanted, n = counted(wanted, "line-wanted")
        texts = join_checked(lines.select("key", "row", "norm"), wanted, ["key", "row"], rows=n).groupBy("key").agg(F.first("norm").alias("norm"))
        texts = staged(texts.select("key", "norm", word_signs(F.col("norm")).alias("signs")), "line-texts")
        text = lambda key, x: texts.select(F.col("key").alias(key), F.col("norm").alias(f"{x}_norm"), F.col("signs").alias(f"{x}_signs"))
        # distances cost time, not bytes: pairs are dealt to so many tasks by b (each line's own; leads are a) before the join that compares, as filters move below a shuffle after it
        near = pairs.join(text("a", "x"), "a").repartition(partitions(spark), "b")
        return near.join(text("b", "y"), "b").where(alike_lines(alike)).select("a", "b")

    found, n = counted(key_groups(sketches.select("node", "size", "keys"), alike, verify).select(F.col("node").alias("key"), F.col("component").alias("other")), "line-groups")
    known = join_checked(lines.where("key is not null").select("row", "doc_id", "pos", "key"), found, "key", "left", rows=n)
    known = known.select("row", "doc_id", "pos", F.coalesce("other", "key").alias("group"))
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    first, n = counted(known.groupBy("group").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-firsts")
    spare = join_checked(known, first, "group", rows=n).where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    dropped = spare.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))
    none = F.array().cast("array<int>")
    rows = lines.where("pos = 0").select("row", "doc_id", "n_lines").join(dropped, "row", "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def without_lines(docs: DataFrame, decisions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts, for ids that are unique."""
    drop = decisions.where("n_dropped > 0").select(F.col("doc_id").alias(key), F.col("dropped").alias("__dropped"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__dropped", i)), "\n")
    return docs.join(drop, key, "left").withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
