"""Rules of text checks that are learnt from labelled documents by grouped counts.

Languages are profiles: the most frequent letter trigrams of each, by rank, against those of a
document. The gate of medical documents weighs words by how much more often documents
of the kind have them. What is learnt is a small table, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.operators.textprep import tokens

#: Trigrams of a profile, of a language and of a document.
PROFILE = 300
#: Words of a vocabulary, documents that have to have one, what is added to each count, and standard errors that a weight has to differ from 0 by.
VOCABULARY, MIN_DOCS, SMOOTHING, MIN_Z = 1000, 5, 0.5, 3.0


#: Bits of a character in the number of a trigram, so that numbers are ordered as the texts are.
BITS = 21


def flat_letters(text: Column) -> Column:
    """The lower-cased letters of a text, other characters as one space, with a space before and after them."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _trigrams(flat: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of three characters as numbers, in order, and how often each occurs."""
    chars = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(chars[:-2] << 2 * BITS | chars[1:-1] << BITS | chars[2:], return_counts=True)


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) == 1:
        return grams[0], counts[0]
    out, back = np.unique(np.concatenate(grams), return_inverse=True)
    return out, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts of each batch, gram as a number."""
    for batch in batches:
        langs, per = batch.column("lang").to_pylist(), {}
        for lang, flat in zip(langs, batch.column("flat")):
            if flat.is_valid:
                per.setdefault(lang, []).append(_trigrams(flat.as_py()))
        for lang, found in per.items():
            grams, n = _merged(*map(list, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


def language_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 1) of documents (text, lang): the most frequent trigrams of each language, ties by gram. Documents without a language are left out."""
    flat = labelled.where("lang IS NOT NULL").select("lang", flat_letters(F.col("text")).alias("flat"))
    counts = flat.mapInArrow(_label_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return ranked.select("lang", _gram_text(F.col("gram")).alias("gram"), "rank")


def _gram_text(number: Column) -> Column:
    """The three characters of a trigram's number."""
    parts = [F.shiftright(number, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) for k in (2, 1, 0)]
    # Characters beyond two bytes need all four of UTF-32.
    return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in parts])), "UTF-32")


def _nearest(profiles: tuple, grams: np.ndarray, counts: np.ndarray) -> str:
    """The language of a text with these trigrams. ``profiles``: names, then of all languages together grams in order, languages and ranks, and the size."""
    langs, known, lang, rank, size = profiles
    top = grams[np.argsort(-counts, kind="stable")[:size]]
    first, last = np.searchsorted(known, top), np.searchsorted(known, top, "right")
    n = last - first
    if not n.any():
        return "und"
    at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    # What all languages have in common is left out: a place counts for how much nearer it is than a missing one.
    near = size - np.abs(np.repeat(np.arange(1, len(top) + 1), n) - rank[at])
    met = np.bincount(lang[at], minlength=len(langs)) > 0
    return langs[int(np.argmax(np.where(met, np.bincount(lang[at], near, len(langs)), -np.inf)))]


def _judged(profiles) -> Callable:
    """(doc_id, language) of each row with a flat text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_nearest(profiles.value, *_trigrams(flat.as_py() or "")) for flat in batch.column("flat")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "language"])

    return run


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, gram, n) of each row with a flat text; a row without one has a null gram."""
    for batch in batches:
        for k, flat in enumerate(batch.column("flat")):
            grams, n = _trigrams(flat.as_py() or "")
            ids = batch.column("doc_id").take(pa.array([k] * max(len(grams), 1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(grams if len(grams) else [None], pa.int64()), pa.array(n if len(n) else [0], pa.int64())], names=["doc_id", "gram", "n"])


def _judged_together(profiles) -> Callable:
    """(doc_id, language) of one document from the counts of its trigrams."""

    def run(counts: pa.Table) -> pa.Table:
        known = counts.filter(counts.column("gram").is_valid()).sort_by("gram")
        language = _nearest(profiles.value, known.column("gram").to_numpy(), known.column("n").to_numpy()) if known.num_rows else "und"
        return pa.table([counts.column("doc_id").slice(0, 1), pa.array([language], pa.string())], names=["doc_id", "language"])

    return run


def profile_languages(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, language: the one whose profile is nearest to the document's by the places of its trigrams, ties by name.

    A trigram counts the places by which its ranks differ, or ``size`` where the language does
    not have it. A text without letters, or with no trigram of any language, is und. Rows that
    share a doc_id are one document. A text is judged where it is read, without an exchange;
    only the trigrams of rows that share their doc_id meet. The profiles, ``size`` rows for
    each language, are sent to all tasks.
    """
    number = lambda g: sum(ord(c) << k * BITS for c, k in zip(g, (2, 1, 0)))
    rows = [(number(r.gram), r.lang, r["rank"]) for r in profiles.collect()]
    langs = sorted({lang for _, lang, _ in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    table = np.array(sorted((g, place[lang], rank) for g, lang, rank in rows), np.int64).reshape(-1, 3)
    sent = docs.sparkSession.sparkContext.broadcast((langs, *(np.ascontiguousarray(table[:, k]) for k in range(3)), size))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string"
    flat = docs.where("doc_id IS NOT NULL").select("doc_id", flat_letters(F.col("text")).alias("flat"))
    out = flat.mapInArrow(_judged(sent), schema)
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.where("doc_id IS NOT NULL AND n > 1").select("doc_id")
    if not shared.isEmpty():
        grams = flat.join(shared, "doc_id", "left_semi").mapInArrow(_row_counts, f"{schema.partition(',')[0]}, gram long, n long")
        merged = grams.groupBy("doc_id", "gram").agg(F.sum("n").alias("n"))
        out = out.join(shared, "doc_id", "left_anti").unionByName(merged.groupBy("doc_id").applyInArrow(_judged_together(sent), schema))
    # Rows without an id are one document, of no language.
    nobody = docs.where("doc_id IS NULL").select("doc_id").distinct().withColumn("language", F.lit("und"))
    return out.unionByName(nobody)


def term_weights(labelled: DataFrame, size: int = VOCABULARY, min_docs: int = MIN_DOCS, smoothing: float = SMOOTHING, min_z: float = MIN_Z) -> DataFrame:
    """term, weight: log-odds of a word in documents of the kind against the others, of (text, is_target).

    Words whose weight is less than ``min_z`` of its standard errors from 0 are left out as
    noise; of the others the ``size`` ones with the most are taken.
    """
    known = labelled.where("is_target IS NOT NULL").select("is_target", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("terms"))
    totals = known.agg(F.count_if("is_target").alias("n1"), F.count_if(~F.col("is_target")).alias("n0")).first()
    counts = known.select("is_target", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if("is_target").alias("d1"), F.count_if(~F.col("is_target")).alias("d0"))
    share = lambda d, n: F.log((F.col(d) + smoothing) / (n + 2 * smoothing))
    error = F.sqrt(1 / (F.col("d1") + smoothing) + 1 / (F.col("d0") + smoothing))
    rated = counts.where(F.col("d1") + F.col("d0") >= min_docs).select("term", (share("d1", totals.n1) - share("d0", totals.n0)).alias("weight"), error.alias("error"))
    rated = rated.withColumn("z", F.round(F.abs(F.col("weight") / F.col("error")), 9)).where(F.col("z") >= min_z)
    return rated.orderBy(F.col("z").desc(), "term").limit(size).select("term", "weight")


def weighted_gate(docs: DataFrame, weights: DataFrame, threshold: float = 0.0) -> DataFrame:
    """doc_id, n_terms, score, is_medical: the sum of the weights of a document's distinct words against a threshold. No known word: score 0."""
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    found = words.join(weights, "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("score"))
    out = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("is_medical", F.col("score") > threshold)
