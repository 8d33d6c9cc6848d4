"""Requests to the language model, and strict decoding of its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS_TYPE = "array<struct<name:string,value:string,unit:string,reference_range:string,flag:string>>"
_FIELDS_TYPE = "array<struct<name:variant,value:variant,unit:variant,referenceRange:variant,flag:variant>>"
EXTRACTION_PROMPT = (
    "Extract the lab markers of the text as a JSON object with the key 'markers'. Each marker has name and value "
    "(strings), unit, referenceRange and flag (High, Low, Normal), which may be null. Return the JSON only."
)


def request_payload(model: str, system: Column, user: Column, temperature: float) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", system), message("user", user))
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature")))


def extraction_requests(docs: DataFrame, model: str = "default", prompt: str = EXTRACTION_PROMPT, temperature: float = 0.1) -> DataFrame:
    """doc_id, payload: one request for each document."""
    return docs.select("doc_id", request_payload(model, F.lit(prompt), F.col("text"), temperature).alias("payload"))


_CONTENT = "$.choices[0].message.content"


def _parsed(responses: DataFrame) -> DataFrame:
    """``responses`` with _root, the body as a variant: a step of its own, so that it is parsed once."""
    return responses.withColumn("_root", F.try_parse_json("body"))


def _choice(parsed: DataFrame) -> DataFrame:
    """``_parsed`` with content, null unless the first choice's message has a text."""
    kind = F.schema_of_variant(F.try_variant_get("_root", _CONTENT, "variant"))
    return parsed.withColumn("content", F.when(kind == "STRING", F.try_variant_get("_root", _CONTENT, "string"))).drop("_root")


def first_choice(responses: DataFrame) -> DataFrame:
    """``responses`` with content, null unless the first choice's message has a text."""
    return _choice(_parsed(responses))


def _status(chosen: DataFrame) -> DataFrame:
    """``first_choice`` with status and error_text."""
    code, shaped = F.col("http_status"), F.col("content").isNotNull()
    # Texts of the errors.
    text = (
        F.when(code == 401, "401 Unauthorized — check your API key.")
        .when(code == 404, "404 Not Found — check your Base URL.")
        .when(code == 429, "429 Too Many Requests — slow down.")
        .when(code != 200, F.concat(F.lit("Server returned "), code.cast("string"), F.lit(".")))
        .when(~shaped, "Could not parse API response.")
    )
    status = F.when(code.isNull(), "invalid").when(code != 200, "http_error").when(~shaped, "unparseable").otherwise("ok")
    return chosen.withColumns({"status": status, "error_text": F.when(code.isNull(), "Invalid response from server.").otherwise(text)})


def response_status(responses: DataFrame) -> DataFrame:
    """``responses`` with status and error_text (null if ok)."""
    return _status(first_choice(responses)).select(*responses.columns, "status", "error_text")


def answered(responses: DataFrame) -> DataFrame:
    """``responses`` with content, status and error_text."""
    return _status(first_choice(responses))


def parse_markers(responses: DataFrame) -> DataFrame:
    """``responses`` with status, error_text and markers (array of struct; null unless all of them decode).

    Strict: text around the JSON, a missing or non-string name or value, an optional
    field of another kind, or one bad marker fails the document. An empty list is valid.
    """
    shaped = answered(responses)
    root = F.try_parse_json(F.concat(F.lit("["), F.col("content"), F.lit("]")))
    shaped = shaped.withColumn("_v", F.when(F.col("status") == "ok", root))
    variant = lambda path: F.try_variant_get("_v", path, "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    one = F.col("_v").isNotNull() & variant("$[1]").isNull() & kind(variant("$[0]")).startswith("OBJECT") & kind(variant("$[0].markers")).startswith("ARRAY")
    # One cast for all fields of all markers; a marker that is no object fails it. Fields stay variants, of which the kind is known.
    shaped = shaped.withColumn("_m", F.when(one, F.try_variant_get("_v", "$[0].markers", _FIELDS_TYPE)))

    def good(m: Column) -> Column:
        needed = (kind(m["name"]) == "STRING") & (kind(m["value"]) == "STRING")
        optional = [kind(m[f]).isin("STRING", "VOID", "ABSENT") for f in ("unit", "referenceRange", "flag")]
        return needed & optional[0] & optional[1] & optional[2]

    text = lambda m, name: F.try_variant_get(m[name], "$", "string")
    typed = F.transform(
        "_m",
        lambda m: F.struct(
            text(m, "name").alias("name"), text(m, "value").alias("value"), text(m, "unit").alias("unit"),
            text(m, "referenceRange").alias("reference_range"), text(m, "flag").alias("flag"),
        ),
    )
    markers = F.when(F.forall("_m", good), typed)
    out = shaped.withColumn("markers", markers)
    undecoded = (F.col("status") == "ok") & F.col("markers").isNull()
    return out.withColumns(
        {
            "status": F.when(undecoded, "undecodable").otherwise(F.col("status")),
            "error_text": F.when(undecoded, "The data couldn’t be read because it isn’t in the correct format.").otherwise(F.col("error_text")),
        }
    ).drop("_v", "_m", "content")


def marker_rows(parsed: DataFrame, keep_empty: bool = False) -> DataFrame:
    """doc_id, pos (from 0) and the fields of each decoded marker."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return parsed.select("doc_id", explode("markers").alias("pos", "m")).select("doc_id", "pos", "m.name", "m.value", "m.unit", "m.reference_range", "m.flag")


def one_answer(parsed: DataFrame) -> DataFrame:
    """doc_id, markers, error_text: one row for each document of ``parse_markers``.

    A decoded response goes before a failed one, a larger request_id before a smaller, so a
    retry that worked replaces the failure.
    """
    request = F.col("request_id") if "request_id" in parsed.columns else F.lit("")
    order = F.struct(F.col("markers").isNotNull(), request, F.xxhash64("markers", "error_text"))
    last = F.max_by(F.struct("markers", "error_text"), order)
    return parsed.groupBy("doc_id").agg(last.alias("a")).select("doc_id", "a.*")


def extraction_outcome(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each document with its markers; a failed one has none, and its error before its original text.

    A document without a response failed too. Of several responses of one document one is
    taken, see ``one_answer``.
    """
    answers = one_answer(parsed).withColumn("_answered", F.lit(True))
    out = docs.join(answers, "doc_id", "left")
    error = F.when(F.col("_answered").isNull(), "Invalid response from server.").otherwise(F.col("error_text"))
    # The lines around the error and the text.
    wrapped = F.concat(F.lit("--- SERVER ERROR ---\nAPI Error: "), error, F.lit("\n\n--- ORIGINAL OCR ---\n"), F.col("text"))
    return out.withColumns(
        {
            "text": F.when(error.isNotNull(), wrapped).otherwise(F.col("text")),
            "markers": F.coalesce("markers", F.array().cast(MARKERS_TYPE)),
            "error_text": error,
        }
    ).drop("_answered")
