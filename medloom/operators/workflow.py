"""From captured pages to saved tests: the steps before and after the model call.

Between the two lies the call itself, which reads the requests and writes the responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as fx
from medloom.operators import extract, ingest, store, textprep, verify


def captured_documents(candidates: DataFrame) -> DataFrame:
    """doc_id, raw_text, text: the best OCR lines of each document's pages below their headers, as captured and with their lines merged. Documents without text go."""
    pages = ingest.join_ocr_lines(candidates)
    docs = ingest.nonempty_docs(ingest.assemble_pages(pages))
    return docs.select("doc_id", F.col("text").alias("raw_text"), fx.normalize_ocr(F.col("text")).alias("text"))


def scan_requests(candidates: DataFrame, owners: DataFrame, profiles: DataFrame, people: DataFrame | None = None, **request) -> tuple[DataFrame, DataFrame]:
    """(documents, requests) of OCR candidates: what stays here, and what may leave, without names and contact data.

    ``owners`` = (doc_id, user_id, ..); a document without an owner is not sent to anyone.
    """
    docs = captured_documents(candidates).join(owners, "doc_id")
    clean = textprep.redact_pii(docs.select("doc_id", "user_id", "text"), profiles, people)
    return docs, extract.extraction_requests(clean, **request)


def answered_documents(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Each document with its markers or its error, see ``extract.extraction_outcome``; a failed one keeps its text as captured."""
    parsed = extract.parse_markers(responses)
    return extract.extraction_outcome(docs.withColumn("text", F.col("raw_text")), parsed)


def reviewed_markers(outcome: DataFrame, corrections: DataFrame, confirmations: DataFrame, loinc: DataFrame) -> DataFrame:
    """doc_id, pos, the fields of a marker, loinc_code, loinc_match, needs_review: what the reviewer confirmed, as corrected."""
    rows = extract.marker_rows(outcome)
    confirmed = verify.confirmed_only(verify.apply_corrections(rows, corrections), confirmations)
    return verify.needs_review(verify.loinc_map(confirmed, loinc))


def save_answers(docs: DataFrame, responses: DataFrame, corrections: DataFrame, confirmations: DataFrame, loinc: DataFrame, path: str) -> None:
    """Save the confirmed documents (doc_id, user_id, date, provider, test_name, raw_text) with their markers and codes, in one change.

    A confirmed document without markers is saved as a test without markers. A rerun, or a
    response that comes twice, adds nothing.
    """
    confirmed = docs.join(confirmations.select("doc_id").distinct(), "doc_id", "left_semi")
    store.Store(docs.sparkSession, path).complete()
    with store.working_folder(docs.sparkSession, path) as written:
        # What is saved already is not worked out again: only its ids are compared.
        confirmed = written(confirmed)
        tests, _ = verify.to_lab_tests(confirmed, extract.marker_rows(confirmed.withColumn("markers", F.array().cast(extract.MARKERS_TYPE))), keep_doc=True)
        ids = written(store.unsaved(tests, path).select("doc_id").distinct())
        if ids.isEmpty():
            return
        # Of answers and corrections only those of these documents are decoded. Codes and the change itself read their rows more than once.
        of_these = lambda df: df.join(ids, "doc_id", "left_semi")
        outcome = written(answered_documents(of_these(confirmed), of_these(responses)))
        markers = written(reviewed_markers(outcome, of_these(corrections), confirmations, loinc))
        tests, rows = verify.to_lab_tests(outcome, markers, codes=True)
        store.save(tests, rows, path)
