"""Human corrections, standard codes and the tables of saved tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medloom.operators import store
from medloom.operators.similarity import BOUND, similar_names

KEY = ["doc_id", "pos"]


def confirmed_only(markers: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Markers of confirmed documents."""
    return markers.join(confirmations.select("doc_id").distinct(), "doc_id", "left_semi")


def apply_corrections(markers: DataFrame, corrections: DataFrame) -> DataFrame:
    """``markers`` after the edits, removals and additions of the reviewer.

    An edit replaces name, value and unit, also by an empty text or null; range and flag
    stay. Additions have no range and flag. Of several corrections of one row the
    removal holds, else the last in the order of their fields.
    """
    order = F.when(F.col("action") == "remove", 0).otherwise(1)
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(order, *[F.col(c).desc() for c in ("name", "value", "unit")])) == 1
    one = corrections.where("action IN ('edit', 'remove')").withColumn("_last", last).where("_last")
    changes = one.select(*KEY, F.col("action").alias("_a"), *[F.col(c).alias(f"_{c}") for c in ("name", "value", "unit")])
    edited = markers.join(changes, KEY, "left").where("_a IS NULL OR _a <> 'remove'")
    edit = F.col("_a") == "edit"
    for c in ("name", "value", "unit"):
        edited = edited.withColumn(c, F.when(edit, F.col(f"_{c}")).otherwise(F.col(c)))
    added = corrections.where("action = 'add'").select(
        *KEY, "name", "value", "unit", F.lit(None).cast("string").alias("reference_range"), F.lit(None).cast("string").alias("flag")
    )
    return edited.select(*KEY, "name", "value", "unit", "reference_range", "flag").unionByName(added)


def needs_review(markers: DataFrame) -> DataFrame:
    """``markers`` with needs_review: no standard code (also of an ambiguous name), a blank name or value, a flag outside its domain, or an unusual value if that column of ``ranges.unusual_values`` is there."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    flag = F.col("flag").isNotNull() & ~F.col("flag").isin("High", "Low", "Normal")
    unusual = F.col("unusual") if "unusual" in markers.columns else F.lit(False)
    return markers.withColumn("needs_review", F.col("loinc_code").isNull() | blank("name") | blank("value") | flag | unusual)


def _unique(dictionary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key, so that a join never multiplies rows."""
    return dictionary.groupBy(*keys).agg(F.min(value).alias(value))


#: A similar name is ambiguous if a name of another code comes this close to it.
MARGIN = 0.05


def loinc_map(markers: DataFrame, loinc: DataFrame, bound: float | None = BOUND, margin: float = MARGIN) -> DataFrame:
    """``markers`` with loinc_code and loinc_match: exact, similar, ambiguous or none.

    The lower-cased name without outer spaces is looked up first. A name that is not there
    takes the code of the most similar one (``similarity.similar_names``, from ``bound`` on; None
    looks up only), unless a name of another code is as similar but for ``margin``: then it
    has no code and is left to the reviewer. Each distinct name is compared once,
    however many markers have it.
    """
    codes = _unique(loinc, ["name_norm"], "loinc_code")
    named = markers.drop("loinc_code", "loinc_match").withColumn("name_norm", F.lower(F.trim("name")))
    table = codes.withColumn("loinc_match", F.lit("exact"))
    if bound is not None:
        unknown = named.select("name_norm").distinct().join(codes, "name_norm", "left_anti")
        pairs = similar_names(unknown.select(F.col("name_norm").alias("name")), codes.select(F.col("name_norm").alias("other")), bound)
        rated = pairs.join(codes.withColumnRenamed("name_norm", "other"), "other").groupBy("name", "loinc_code").agg(F.max("similarity").alias("similarity"))
        best = Window.partitionBy("name").orderBy(F.col("similarity").desc(), "loinc_code")
        rated = rated.withColumns({"_rank": F.row_number().over(best), "_next": F.lead("similarity").over(best)}).where("_rank = 1")
        close = F.coalesce(F.col("_next") >= F.col("similarity") - margin, F.lit(False))
        found = rated.select(
            F.col("name").alias("name_norm"), F.when(~close, F.col("loinc_code")).alias("loinc_code"), F.when(close, "ambiguous").otherwise("similar").alias("loinc_match")
        )
        table = table.unionByName(found)
    out = named.join(table, "name_norm", "left").drop("name_norm")
    return out.withColumn("loinc_match", F.coalesce("loinc_match", F.lit("none")))


def lab_standard_map(markers: DataFrame, alias: DataFrame) -> DataFrame:
    """``markers`` (with provider) with lab_standard_id, which makes names of different labs comparable."""
    ids = _unique(alias, ["provider", "name"], "lab_standard_id")
    return markers.drop("lab_standard_id").join(ids, ["provider", "name"], "left")


def to_lab_tests(docs: DataFrame, markers: DataFrame, codes: bool = False, keep_doc: bool = False) -> tuple[DataFrame, DataFrame]:
    """Test and marker tables of confirmed documents (doc_id, user_id, date, provider, test_name).

    The test's id is a hash of its document, so a rerun saves the same rows. With ``codes``
    the loinc_code of the markers is kept, with ``keep_doc`` the doc_id, by which ``store.save`` can join them.
    """
    test_id = F.sha2(F.col("doc_id"), 256).alias("test_id")
    none = F.lit(None).cast("string")
    doc = ["doc_id"] if keep_doc else []
    tests = docs.select(*doc, test_id, "user_id", "date", "provider", "test_name", none.alias("sample_type"), none.alias("method"))
    rows = markers.select(
        *doc, test_id, "pos", "name", (F.col("loinc_code") if codes else none).alias("loinc_code"), "value", "unit", "reference_range", "flag",
        F.lit(False).alias("is_critical"), none.alias("lab_standard_id"),
    )
    return tests, rows


def save_tests(tests: DataFrame, markers: DataFrame, path: str) -> None:
    """Append both tables below ``path`` in one change, partitioned by the year of the test; what is there already is not added again. See ``store.save``."""
    store.save(tests, markers, path, "doc_id" if {"doc_id"} <= {*tests.columns} & {*markers.columns} else None)
