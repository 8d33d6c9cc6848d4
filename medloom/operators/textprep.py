"""Checks and redaction of document texts before anything leaves. The rules are our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.operators import names

#: Frequent words of each language; the first language wins a tie.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "with", "for", "was"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "que", "une", "dans"],
    "de": ["der", "die", "das", "und", "zu", "den", "mit", "ist", "von", "ein"],
    "es": ["el", "los", "las", "que", "y", "del", "una", "con", "por", "para"],
    "ru": ["и", "в", "не", "на", "что", "с", "по", "это", "для", "как"],
}
#: Words that only medical documents are likely to have.
MEDICAL_WORDS = ["glucose", "haemoglobin", "hemoglobin", "cholesterol", "blood", "serum", "reference", "result", "mg/dl", "mmol/l", "анализ", "глюкоза", "гемоглобин"]

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(^|[^0-9+])(\+?[0-9][0-9 ()-]{6,13}[0-9])([^0-9 ]|$)"
ADDRESS = r"[0-9]{1,5} [A-Z][a-z]+ (Street|Avenue|Road|Lane|Boulevard|Drive)"
#: Name, value, unit and range of a result line.
RESULT_LINE = r"^\s*(\p{L}[\p{L} ]*?)\s*[:=]?\s+([<>]?[0-9]+(?:[.,][0-9]+)?)\s*([%\p{L}/]+)?\s*(?:\(?(?:ref:?\s*)?([0-9.]+\s*-\s*[0-9.]+)\)?)?\s*$"


def tokens(col: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(col), r"\s+"), lambda x: x != "")


def detect_language(col: Column, stop_words: dict[str, list[str]] | None = None) -> Column:
    """The language with the most stop words, und if there are none."""
    lists = stop_words or STOP_WORDS
    hits = lambda ws: F.size(F.filter(tokens(col), lambda t: t.isin(ws)))
    rated = [F.struct(hits(ws).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(lists.items())]
    best = F.array_max(F.array(*rated))
    return F.when(best["n"] > 0, best["lang"]).otherwise("und")


def medical_doc_gate(docs: DataFrame, vocabulary: list[str] | None = None, min_hits: int = 2, text: str = "text") -> DataFrame:
    """``docs`` with medical_hits, the number of different vocabulary words, and is_medical."""
    vocab = F.array(*[F.lit(w) for w in (vocabulary or MEDICAL_WORDS)])
    hits = F.size(F.array_intersect(tokens(F.col(text)), vocab))
    return docs.withColumn("medical_hits", F.coalesce(hits, F.lit(0))).withColumn("is_medical", F.col("medical_hits") >= min_hits)


def key_zones(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each result line: doc_id, line_no, name, value, unit, reference_range."""
    part = lambda k: F.nullif(F.regexp_extract("line", RESULT_LINE, k), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    found = lines.where(F.col("line").rlike(RESULT_LINE))
    return found.select("doc_id", "line_no", part(1).alias("name"), part(2).alias("value"), part(3).alias("unit"), part(4).alias("reference_range"))


def redact(col: Column) -> Column:
    """E-mails, addresses and phone numbers replaced by their kind."""
    out = F.regexp_replace(col, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, ADDRESS, "[ADDRESS]")
    return F.regexp_replace(out, PHONE, "$1[PHONE]$3")


def redact_pii(docs: DataFrame, profiles: DataFrame, people: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, user_id, ..) with its text redacted: contact data, the user's own names however written, names of ``people``.

    See ``names.with_name_spans`` for what counts as a name. One row for each row, also where a user has several profiles.
    """
    contacts = docs.withColumn(text, redact(F.col(text)))
    found = names.with_name_spans(contacts, profiles, people, text)
    return found.withColumn(text, names.masked(F.col(text))).drop("_segs", "_spans")


def pii_hits(col: Column) -> Column:
    count = lambda pattern: F.regexp_count(col, F.lit(pattern))
    return F.coalesce(count(EMAIL) + count(PHONE) + count(ADDRESS), F.lit(0))


def sensitive_routing(docs: DataFrame, threshold: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with pii_hits, sensitivity and route: documents with many hits go to manual confirmation."""
    out = docs.withColumn("pii_hits", pii_hits(F.col(text)))
    high = F.col("pii_hits") >= threshold
    return out.withColumns({"sensitivity": F.when(high, "SENSITIVE_HIGH").otherwise("NORMAL"), "route": F.when(high, "manual").otherwise("auto")})
