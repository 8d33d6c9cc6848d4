"""Registered queries of the health record operators and their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import schemas
from medloom.functions import text as fx
from medloom.operators import consult, extract, ingest, learned, names, profile, ranges, standard, textprep, vault, verify, workflow, zones
from medloom.plans.oracles import ORACLES  # noqa: F401
from medloom.sources import tables
from medloom.sources.standin import StandIn
from medloom.sources.strings import strings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(StandIn(spark, sf_dir))
    return build


def _read_back(df: DataFrame, name: str, schema: T.StructType, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """``df`` written to files of the schema and read by ``read``, in the types of ``df``."""
    path = tables.landing(df.sparkSession, name)
    tables.as_schema(df, schema).write.parquet(path)
    return read(df.sparkSession, path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


@query
def read_ocr_pages(s: StandIn) -> DataFrame:
    return _read_back(s.ocr_pages, "ocr_pages", schemas.OCR_PAGES, tables.read_ocr_pages)


@query
def read_llm_responses(s: StandIn) -> DataFrame:
    return _read_back(s.llm_responses, "llm_responses", schemas.LLM_RESPONSES, tables.read_llm_responses)


@query
def save_tests(s: StandIn) -> DataFrame:
    """Saved twice: the rerun adds nothing."""
    docs = s.lab_tests.withColumnRenamed("test_id", "doc_id")
    tests, markers = verify.to_lab_tests(docs, s.markers_by_test.withColumnRenamed("test_id", "doc_id"), keep_doc=True)
    path = tables.landing(s.spark, "vault")
    for _ in range(2):
        verify.save_tests(tests, markers, path)
    return tables.read_table(s.spark, f"{path}/lab_markers", T.StructType([*markers.drop("doc_id").schema.fields, T.StructField("year", T.IntegerType())]))


def _saved(s: StandIn) -> str:
    """A store with the tests of all orders."""
    tests, markers = verify.to_lab_tests(s.lab_tests.withColumnRenamed("test_id", "doc_id"), s.markers_by_test.withColumnRenamed("test_id", "doc_id"), keep_doc=True)
    path = tables.landing(s.spark, "vault")
    verify.save_tests(tests, markers, path)
    return path


@query
def delete_saved_tests(s: StandIn) -> DataFrame:
    """Saved to files, then the deleted ones taken out of these."""
    path = _saved(s)
    vault.delete_saved_tests(s.spark, s.deleted_ids.select(F.sha2("test_id", 256).alias("test_id")), path)
    tests, markers = (tables.read_saved(s.spark, path, name) for name in ("lab_tests", "lab_markers"))
    return tests.select("test_id", "year").join(markers.select("test_id", "pos", "name"), "test_id", "left")


@query
def scan_requests(s: StandIn) -> DataFrame:
    """From OCR lines to what is sent."""
    _, requests = workflow.scan_requests(s.ocr_candidates, s.owners, s.patients)
    return requests.select("doc_id", F.sha2("payload", 256).alias("payload_sha256"))


@query
def scan_to_saved(s: StandIn) -> DataFrame:
    """From OCR lines to saved tests: captured, answered, corrected, coded, saved to files and read back."""
    docs, _ = workflow.scan_requests(s.ocr_candidates, s.owners, s.patients)
    path = tables.landing(s.spark, "vault")
    for _ in range(2):
        workflow.save_answers(docs, s.llm_responses, s.corrections, s.confirmations, s.loinc_dict, path)
    tests, markers = (tables.read_saved(s.spark, path, name) for name in ("lab_tests", "lab_markers"))
    columns = ["pos", "name", "loinc_code", "value", "unit", "reference_range", "flag"]
    return tests.select("test_id", "user_id", "test_name", "year").join(markers.select("test_id", *columns), "test_id", "left")


@query
def extraction_requests(s: StandIn) -> DataFrame:
    return extract.extraction_requests(s.ocr_text)


@query
def consult_requests(s: StandIn) -> DataFrame:
    return consult.consult_requests(fragment_prompt(s))


@query
def nonempty_docs(s: StandIn) -> DataFrame:
    return ingest.nonempty_docs(s.ocr_text).select("doc_id", F.length("text").alias("n"))


@query
def nonblank_questions(s: StandIn) -> DataFrame:
    return consult.nonblank_questions(s.questions)


@query
def flag_bucket(s: StandIn) -> DataFrame:
    return s.lab_markers.select("test_id", "pos", fx.flag_bucket(F.col("flag")).alias("bucket"), fx.flag_colour(F.col("flag")).alias("colour"))


@query
def reference_label(s: StandIn) -> DataFrame:
    return s.lab_markers.select("test_id", "pos", fx.reference_label(F.col("reference_range")).alias("reference_label"))


@query
def marker_display(s: StandIn) -> DataFrame:
    return vault.marker_display(s.lab_markers).select("test_id", "pos", "value", "unit_text")


@query
def response_status(s: StandIn) -> DataFrame:
    return extract.response_status(s.llm_responses).select("doc_id", "http_status", "status", "error_text")


@query
def chat_source_label(s: StandIn) -> DataFrame:
    source = F.when(F.col("turn") % 2 == 1, "cloud").otherwise("local")
    return s.chat_turns.select("conv_id", "turn", fx.chat_source_label(F.col("role"), source).alias("label"))


@query
def medical_doc_gate(s: StandIn) -> DataFrame:
    return textprep.medical_doc_gate(s.ocr_text, ["the", "with", "und", "les", "para"]).select("doc_id", "medical_hits", "is_medical")


@query
def needs_review(s: StandIn) -> DataFrame:
    return verify.needs_review(verify.loinc_map(s.lab_markers, s.loinc_dict, bound=None)).select("test_id", "pos", "loinc_code", "needs_review")


@query
def sensitive_routing(s: StandIn) -> DataFrame:
    return textprep.sensitive_routing(s.ocr_text).select("doc_id", "pii_hits", "sensitivity", "route")


@query
def reply_compliance(s: StandIn) -> DataFrame:
    tail = F.when(F.col("turn") % 3 == 0, F.lit(f" {consult.DISCLAIMER}")).otherwise(" you have")
    causes = F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, " Possible causes: rest.").otherwise(" The cause of possible causes.")
    replies = s.chat_turns.where("role = 'assistant'").withColumn("text", F.concat("text", causes, tail))
    return consult.reply_compliance(replies).select("conv_id", "turn", "has_stop_word", "has_disclaimer", "careful", "compliant")


@query
def test_markers(s: StandIn) -> DataFrame:
    return vault.test_markers(s.nested_tests).select("test_id", "user_id", "test_name", "pos", "name", "value", "unit", "reference_range", "flag")


def _winners(s: StandIn) -> DataFrame:
    return consult.winning_markers(s.lab_tests, s.lab_markers, users=s.questions.where("user_id IS NOT NULL"))


@query
def context_match(s: StandIn) -> DataFrame:
    return consult.indexed_match(s.questions, _winners(s)).select("question_id", "user_id", "test_name", "name")


@query
def match_report(s: StandIn) -> DataFrame:
    return consult.match_report(s.questions, _winners(s)).where("n_matches > 0").select("part", "n_matches")


@query
def extraction_outcome(s: StandIn) -> DataFrame:
    docs = s.lab_tests.select(F.col("test_id").alias("doc_id"), F.concat_ws(" ", "test_name", "provider").alias("text"))
    out = extract.extraction_outcome(docs, extract.parse_markers(s.llm_responses))
    return out.select("doc_id", F.size("markers").alias("n_markers"), F.col("error_text").alias("error"), "text")


@query
def confirmed_only(s: StandIn) -> DataFrame:
    return verify.confirmed_only(s.markers_by_doc, s.confirmations).select("doc_id", "pos", "name")


@query
def apply_corrections(s: StandIn) -> DataFrame:
    return verify.apply_corrections(s.markers_by_doc, s.corrections)


@query
def delete_tests_cascade(s: StandIn) -> DataFrame:
    tests, markers = vault.delete_tests(s.lab_tests, s.lab_markers, s.deleted_ids)
    return vault.test_markers(tests, markers).select("test_id", "pos", "name")


@query
def delete_profiles_cascade(s: StandIn) -> DataFrame:
    weights = s.table("events").select("user_id", "ts", "value")
    tables = {"profiles": s.profiles, "weight_history": weights, "lab_tests": s.lab_tests}
    left = vault.delete_profiles(tables, s.profiles.where("user_id % 4 = 1"))
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("ids")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def localize(s: StandIn) -> DataFrame:
    gender = F.concat(F.lit("gender_"), F.lower("gender"))
    keys = s.profiles.select("user_id", "preferred_language", F.explode(F.array(gender, F.lit("tab_vault"))).alias("key"))
    return profile.localize(keys, strings(s.spark), "key", "preferred_language").select("user_id", "key", "label")


@query
def loinc_map(s: StandIn) -> DataFrame:
    return verify.loinc_map(s.spelt_markers, s.loinc_dict).select("test_id", "pos", "name", "loinc_code", "loinc_match")


@query
def lab_standard_map(s: StandIn) -> DataFrame:
    markers = s.lab_markers.join(s.lab_tests.select("test_id", "provider"), "test_id")
    return verify.lab_standard_map(markers, s.lab_alias).select("test_id", "pos", "provider", "name", "lab_standard_id")


@query
def standard_markers(s: StandIn) -> DataFrame:
    """Ids from what laboratories say of their names, not from a dictionary."""
    ids = standard.standard_ids(standard.alias_links(s.code_claims, s.name_aliases), tables.landing(s.spark, "standard"))
    markers = s.lab_markers.join(s.lab_tests.select("test_id", "provider"), "test_id")
    return standard.standard_markers(markers, ids).select("test_id", "pos", "provider", "name", "lab_standard_id")


@query
def unusual_values(s: StandIn) -> DataFrame:
    """Two batches are sketched by themselves; their merged sketches give the ranges."""
    coded = verify.loinc_map(s.measured, s.loinc_dict, bound=None)
    batches = [ranges.value_sketches(coded.where(F.col("pos") % 2 == k)) for k in (0, 1)]
    limits = ranges.value_ranges(ranges.merged_sketches(batches[0].unionAll(batches[1])), min_values=50)
    return ranges.unusual_values(coded, limits).select("test_id", "pos", "value", "unusual")


@query
def page_report(s: StandIn) -> DataFrame:
    return ingest.page_report(s.ocr_pages, max_pages=8)


@query
def assemble_pages(s: StandIn) -> DataFrame:
    return ingest.assemble_pages(s.ocr_pages)


@query
def assemble_pdf_pages(s: StandIn) -> DataFrame:
    return ingest.assemble_pages(s.ocr_pages, "pdf")


@query
def join_ocr_lines(s: StandIn) -> DataFrame:
    return ingest.join_ocr_lines(s.ocr_candidates)


@query
def fragments(s: StandIn) -> DataFrame:
    return consult.context_fragments(s.questions, s.lab_tests, s.lab_markers)


@query
def fragment_prompt(s: StandIn) -> DataFrame:
    return consult.fragment_prompt(s.questions, fragments(s))


@query
def page_numbers(s: StandIn) -> DataFrame:
    return ingest.page_numbers(s.ocr_pages).select("doc_id", "page_index", "page_number")


@query
def vault_listing(s: StandIn) -> DataFrame:
    return vault.vault_listing(s.lab_tests).withColumn("day", F.col("day").cast("string"))


@query
def top_candidate(s: StandIn) -> DataFrame:
    return ingest.top_candidate(s.ocr_candidates)


@query
def current_profile(s: StandIn) -> DataFrame:
    return profile.current_profile(s.profiles).select("user_id", "full_name", "preferred_language")


@query
def first_choice(s: StandIn) -> DataFrame:
    return extract.first_choice(s.llm_responses).select("doc_id", "content")


@query
def chat_log(s: StandIn) -> DataFrame:
    turns = s.chat_turns
    welcome = s.profiles.select(F.col("user_id").alias("conv_id"), F.lit("Welcome").alias("text"))
    return consult.chat_log(turns.where("role = 'user'"), turns.where("role = 'assistant' AND turn % 5 <> 1"), welcome)


@query
def profile_upsert(s: StandIn) -> DataFrame:
    return profile.profile_upsert(s.profiles, s.profile_edits)


@query
def normalize_ocr(s: StandIn) -> DataFrame:
    merged = s.ocr_text.select("doc_id", fx.normalize_ocr(F.col("text")).alias("text"))
    return merged.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n"))


@query
def parse_markers(s: StandIn) -> DataFrame:
    parsed = extract.parse_markers(s.llm_responses)
    rows = parsed.select("doc_id", "status", "error_text", F.posexplode_outer("markers").alias("pos", "m"))
    return rows.select("doc_id", "status", "error_text", "pos", "m.name", "m.value", "m.unit", "m.reference_range", "m.flag")


@query
def parse_reply(s: StandIn) -> DataFrame:
    return consult.parse_reply(s.llm_responses).select("doc_id", "status", "reply")


@query
def marker_identity(s: StandIn) -> DataFrame:
    return s.lab_markers.select("test_id", "pos", fx.marker_identity(F.col("name"), F.col("unit")).alias("identity"))


@query
def fragment_text(s: StandIn) -> DataFrame:
    rows = s.lab_markers.join(s.lab_tests, "test_id")
    value = fx.fragment_value(F.col("value"), F.col("unit"), F.col("reference_range"))
    return rows.select("test_id", "pos", fx.fragment_key(F.col("test_name"), F.col("name")).alias("key"), value.alias("value"))


@query
def lowercase_tokens(s: StandIn) -> DataFrame:
    return s.table("part").select("p_partkey", F.array_join(fx.name_tokens(F.col("p_name")), "|").alias("tokens"))


@query
def parse_measure(s: StandIn) -> DataFrame:
    key = F.col("c_custkey")
    kinds = F.when(key % 6 == 0, "72").when(key % 6 == 1, "72.5").when(key % 6 == 2, "72,5").when(key % 6 == 3, " 72").when(key % 6 == 4, "1d")
    text = kinds.otherwise(F.concat((key % 100).cast("string"), F.lit("e2")))
    rows = s.table("customer").select(key.alias("user_id"), text.alias("measure_text"))
    return rows.withColumn("measure", fx.parse_measure(F.col("measure_text")))


@query
def profile_form(s: StandIn) -> DataFrame:
    return profile.profile_form(s.profiles)


@query
def display_day(s: StandIn) -> DataFrame:
    return s.lab_tests.select("test_id", fx.display_day(F.col("date")).cast("string").alias("day"))


@query
def detect_language(s: StandIn) -> DataFrame:
    return s.ocr_text.select("doc_id", textprep.detect_language(F.col("text")).alias("language"))


@query
def profile_languages(s: StandIn) -> DataFrame:
    profiles = learned.language_profiles(s.table("documents").select("text", "lang"))
    return learned.profile_languages(s.ocr_text, profiles)


@query
def weighted_gate(s: StandIn) -> DataFrame:
    return learned.weighted_gate(s.reports, learned.term_weights(s.reports)).select("doc_id", "n_terms", "is_medical")


@query
def stored_upsert(s: StandIn) -> DataFrame:
    """Edits that come twice, the later ones with a larger number, on a stored table."""
    name = f"profiles_{uuid.uuid4().hex}"
    profile.store_profiles(s.profiles, name, 8, tables.landing(s.spark, "profiles"))
    edits = s.profile_edits.withColumn("change_no", F.lit(1))
    later = edits.where("user_id % 2 = 0").withColumns({"full_name": F.lit("A later name"), "change_no": F.lit(2)})
    return profile.stored_upsert(s.spark, name, edits.unionByName(later), 8)


@query
def key_zones(s: StandIn) -> DataFrame:
    line = F.concat("name", F.lit(": "), "value", F.coalesce(F.concat(F.lit(" "), "reference_range"), F.lit("")))
    pages = s.markers_by_doc.select("doc_id", F.col("pos").alias("line_no"), F.lit(0).alias("rank"), line.alias("text"), F.lit(1.0).alias("confidence"))
    return textprep.key_zones(ingest.join_ocr_lines(pages, ("doc_id",)))


@query
def line_zones(s: StandIn) -> DataFrame:
    return zones.line_zones(s.sheets).select("doc_id", "line_no", "label")


@query
def result_zones(s: StandIn) -> DataFrame:
    return zones.result_zones(s.sheets)


@query
def redact_pii(s: StandIn) -> DataFrame:
    return textprep.redact_pii(s.letters, s.patients, s.staff).select("doc_id", "user_id", F.sha2("text", 256).alias("text_sha256"))


@query
def name_spans(s: StandIn) -> DataFrame:
    return names.name_spans(s.letters, s.patients, s.staff)
