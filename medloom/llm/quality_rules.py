"""Quality rules: counts of each text, and cross-document line frequency per host.

Normalised lines are hashed and counted by the documents of a host that hold them.
Lines above the limit are taken away, and a document is rejected if too little of it
is left. DataFrame functions only; the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, Scratch, lower_ascii, mine, packed, quoted, spread_join, unpacked, words

#: Words of a window, and the share of words in repeated windows (percent) that fails.
WINDOW, MAX_REPEAT_PERCENT, MIN_WORDS = 5, 20, 10
#: A line is boilerplate of its host if more of the host's documents hold it.
MAX_LINE_DOCS = 50
#: A document is depleted if less than this share of its words, or too few words, are left.
MIN_LEFT = 0.2
ROW = ["r1", "r2"]


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to ``docs`` that have the array ``_words``.

    Hashes of the windows rule out most texts: if all differ, no window repeats. For
    the others the windows themselves are sorted, and equal neighbours are repeats.
    """
    last = F.size("_words") - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    window = [lambda i, k=k: F.get(F.col("_words"), i + k) for k in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*[w(i) for w in window]))
    docs = docs.withColumn("_hashes", hashes)
    docs = docs.withColumn("_some", F.size(F.array_distinct("_hashes")) < F.size("_hashes")).drop("_hashes")
    sorted_windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(F.col("_words"), i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(F.col("_some"), sorted_windows))

    def again(x: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get(F.col("_sorted"), j)["w"] == x["w"], F.lit(False))
        return same(k - 1) | same(k + 1)

    docs = docs.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", again), lambda x: x["i"])))
    # Words covered: a start covers the words up to the next start, five at most.
    covered = F.transform("_at", lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col("_at"), k + 1) - x), F.lit(WINDOW)))
    n = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("n_repeat_words", F.coalesce(n, F.lit(0).cast("long"))).drop("_some", "_sorted", "_at")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, r1, r2, the counts of its text, base_failed."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    one = docs.select(F.col(quoted(id_col)).alias("doc_id"), _row(id_col, text_col, host_col).alias("row"), text.alias("_text")).select("doc_id", "row.*", "_text")
    one = one.withColumn("_words", words(F.col("_text")))
    with_word = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    one = one.withColumn("_with_word", with_word)
    one = _repeats(one)
    return one.select(
        "doc_id",
        *ROW,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_with_word") - F.size(F.array_distinct("_with_word"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _row(id_col: str, text_col: str, host_col: str) -> Column:
    """128 bits of hash of the host, id and text of a row; rows that repeat all three get the same verdict."""
    host = F.col(quoted(host_col)).cast("string")
    key = host.isNull(), host, F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    return F.struct(F.xxhash64(*key).alias("r1"), F.xxhash64(F.lit(7), *key).alias("r2"))


def boilerplate(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, host_col: str, max_line_docs: int) -> DataFrame:
    """(r1, r2, n_gone, gone): the words in the boilerplate lines of a document's host, and the positions of these lines, for documents that hold some."""
    trimmed = lambda x: F.btrim(x, F.lit(SPACE_CHARS))
    n_words = lambda x: F.regexp_count(x, F.lit(SPACE.replace("[", "[^") + "+"))
    parts = F.transform(F.split(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), "\n"), trimmed)
    parts = F.transform(parts, lower_ascii)
    # A null host has the hash of no value, an empty one that of an empty value.
    host = F.xxhash64(F.col(quoted(host_col)).cast("string"))
    hashed = F.transform(parts, lambda x, i: F.struct(F.xxhash64(host, x).alias("h"), n_words(x).alias("n"), i.alias("at")))
    # The row's hash is made before the lines are dealt out, not once more for each of them.
    rows = docs.select(_row(id_col, text_col, host_col).alias("row"), F.filter(hashed, lambda x: x["n"] > 0).alias("l"))
    rows = rows.select("row", F.explode("l").alias("l")).select("row.*", "l.h", "l.n", "l.at")
    # A repeated row counts once, and so does a line that its document repeats.
    rows = rows.groupBy(*ROW, "h").agg(F.collect_set(F.struct("at", "n")).alias("lines"))
    rows = scratch.keep(rows)
    frequent = scratch.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_line_docs))
    found = spread_join(rows, frequent, ["h"], "docs", F.col("r1")).where("found IS NOT NULL").groupBy(*ROW).agg(F.flatten(F.collect_list("lines")).alias("lines"))
    n_gone = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return found.select(*ROW, n_gone.alias("n_gone"), F.col("lines.at").alias("gone"))


def _depleted(max_left: Column, n_words: Column, min_left: float) -> Column:
    return (max_left < MIN_WORDS) | (max_left < min_left * n_words)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT
) -> DataFrame:
    """One row for each row of ``docs``: its counts, base_failed, n_left_words, kept.

    A normalised line (white space stripped at its ends, A-Z lower-cased) that more than
    ``max_line_docs`` documents of one host hold is boilerplate. A document is
    depleted if its boilerplate lines leave it under ``min_left`` of its words or under
    ten words. Null texts are empty and fail the base rules; null is a host, and not the
    empty one. Rows that repeat host, id and text are one document and get the same verdict; under
    another host they are another document. Columns of ``docs`` that are not named are not
    read; an empty table gives an empty result. A text is read whole, whatever its length.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    gone = boilerplate(scratch, docs, id_col, text_col, host_col, max_line_docs)
    base = base_counts(docs, id_col, text_col, host_col).join(gone.drop("gone"), ROW, "left")
    left = F.col("n_words") - F.coalesce("n_gone", F.lit(0))
    depleted = F.col("n_gone").isNotNull() & _depleted(F.col("n_left_words"), F.col("n_words"), min_left)
    return base.withColumn("n_left_words", left).withColumn("kept", ~F.col("base_failed") & ~depleted).drop(*ROW, "n_gone")


def cleaned_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, min_left: float = MIN_LEFT
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, their texts without boilerplate lines.

    The lines that stay are joined by ``\\n`` in their order.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    gone = scratch.keep(boilerplate(scratch, docs, id_col, text_col, host_col, max_line_docs))
    base = base_counts(docs, id_col, text_col, host_col).join(gone.drop("gone"), ROW, "left")
    left = F.col("n_words") - F.coalesce("n_gone", F.lit(0))
    # Written first: a filter on what is computed here would compute it once for each mention.
    verdicts = scratch.keep(base.select(*ROW, (F.col("base_failed") | F.col("n_gone").isNotNull() & _depleted(left, F.col("n_words"), min_left)).alias("failed")))
    good = verdicts.where("NOT failed").select(*ROW).distinct()
    rows = packed(docs, _row(id_col, text_col, host_col).alias("row")).select("user", "row.*")
    rows = rows.join(good, ROW, "left_semi").join(gone.select(*ROW, "gone"), ROW, "left")
    lines = F.filter(F.split(mine(text_col).cast("string"), "\n"), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), mine(text_col).cast("string")).otherwise(F.array_join(lines, "\n"))
    out = unpacked(rows.withColumn("user", F.col("user").withField(quoted(text_col), text)), docs.columns)
    return out
