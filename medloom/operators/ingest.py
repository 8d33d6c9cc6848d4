"""OCR candidates and pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_candidate(candidates: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index", "line_no"), tie: str = "rank") -> DataFrame:
    """The most confident candidate of each observation; equal ones by ``tie``. Observations without a text go."""
    best = F.max_by("text", F.struct("confidence", -F.col(tie)))
    return candidates.where(F.col("text").isNotNull()).groupBy(*keys).agg(best.alias("text"), F.max("confidence").alias("confidence"))


def _in_order(order: str, text: Column) -> Column:
    """Texts of a group in the order of a column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.transform(pairs, lambda p: p["t"])


def join_ocr_lines(candidates: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index"), line: str = "line_no", tie: str = "rank") -> DataFrame:
    """Page texts: the best candidates of a page in line order, joined by line breaks."""
    best = top_candidate(candidates, (*keys, line), tie)
    return best.groupBy(*keys).agg(F.array_join(_in_order(line, F.col("text")), "\n").alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages with an empty text where recognition failed."""
    return pages.withColumn("text", F.coalesce("text", F.lit("")))


def page_numbers(pages: DataFrame) -> DataFrame:
    """Pages with their one-based number in their document."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")))


def assemble_pages(pages: DataFrame, kind: str = "image") -> DataFrame:
    """doc_id, text: the pages in order below their headers, with a blank line between.

    An image's number is its index plus one; PDF numbers count the readable pages. Pages
    whose text is empty or null keep their header.
    """
    pages = page_texts(pages)
    if kind == "pdf":
        ordered = _in_order("page_index", F.col("text"))
        whole = pages.where("readable").groupBy("doc_id").agg(ordered.alias("texts"))
        parts = F.transform("texts", lambda t, k: F.concat(F.lit("--- PDF Page "), (k + 1).cast("string"), F.lit(" ---\n"), t))
        return whole.select("doc_id", F.array_join(parts, "\n\n").alias("text"))
    header = F.concat(F.lit("--- Page "), (F.col("page_index") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    return pages.groupBy("doc_id").agg(F.array_join(_in_order("page_index", header), "\n\n").alias("text"))


def nonempty_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with a text that is not empty; white space counts as text."""
    return docs.where(F.length(text) > 0)


def page_report(pages: DataFrame, max_pages: int = 500, max_chars: int = 5_000_000) -> DataFrame:
    """doc_id, n_pages, n_chars, oversize: what ``assemble_pages`` would put together for each document. Nothing is left out for its size; oversize ones may be looked at first."""
    sizes = page_texts(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.char_length("text")).alias("n_chars"))
    return sizes.withColumn("oversize", (F.col("n_pages") > max_pages) | (F.col("n_chars") > max_chars))
