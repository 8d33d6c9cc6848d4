"""Schemas of all tables. ``user_id`` is in every table and is the main partition and join key."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(fields: str) -> T.StructType:
    """``name type, ..`` as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


MARKER = "name string, value string, unit string, reference_range string, flag string"

OCR_CANDIDATES = _schema("doc_id string, page_index int, line_no int, rank int, text string, confidence double")
OCR_PAGES = _schema("doc_id string, user_id long, page_index int, text string, readable boolean")
LLM_RESPONSES = _schema("request_id string, doc_id string, http_status int, body string")
LAB_TESTS = _schema("test_id string, user_id long, date timestamp, provider string, test_name string, sample_type string, method string")
LAB_MARKERS = _schema(
    "test_id string, pos int, name string, loinc_code string, value string, unit string, reference_range string, "
    "flag string, is_critical boolean, lab_standard_id string"
)
CORRECTIONS = _schema("doc_id string, pos int, action string, name string, value string, unit string")
CONFIRMATIONS = _schema("doc_id string")
PROFILES = _schema(
    "user_id long, full_name string, birth_date timestamp, gender string, blood_type string, height double, weight double, preferred_language string"
)
PROFILE_EDITS = _schema(
    "user_id long, full_name string, birth_date timestamp, gender string, blood_type string, height_text string, weight_text string, language string"
)
WEIGHT_HISTORY = _schema("user_id long, ts timestamp, value double")
MEDICATIONS = _schema(
    "user_id long, name string, dosage string, frequency string, start_date timestamp, end_date timestamp, purpose string, is_active boolean"
)
HEALTH_EVENTS = _schema("user_id long, date timestamp, type string, title string, event_details string, intensity int, provider string")
ALLERGIES = _schema("user_id long, substance string, reaction string, severity string")
CONDITIONS = _schema("user_id long, name string, diagnosed_date timestamp, status string")
QUESTIONS = _schema("question_id long, user_id long, text string")
CHAT_LOG = _schema("conv_id long, turn int, role string, text string, source string")
STRINGS = _schema("lang string, key string, text string")
LOINC_DICT = _schema("name_norm string, loinc_code string")
LAB_ALIAS = _schema("provider string, name string, lab_standard_id string")

#: Values that a health event's type may have.
EVENT_TYPES = ("Symptom", "Visit", "Surgery")
