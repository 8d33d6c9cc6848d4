"""Stored tests: listing, markers, display and cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions import text as fx
from medloom.operators import store


def vault_listing(tests: DataFrame) -> DataFrame:
    """user_id, test_id, test_name, day, rank: each user's tests, newest first, ties by test_id."""
    newest = Window.partitionBy("user_id").orderBy(F.col("date").desc(), "test_id")
    return tests.select("user_id", "test_id", "test_name", fx.display_day(F.col("date")).alias("day"), F.row_number().over(newest).alias("rank"))


def test_markers(tests: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Tests with their markers, one row each; a test without markers has one row of nulls.

    Without ``markers`` the tests hold them in the array ``markers``.
    """
    if markers is None:
        numbered = "pos" in tests.schema["markers"].dataType.elementType.names
        each = F.explode_outer("markers").alias("_m") if numbered else F.posexplode_outer("markers").alias("pos", "_m")
        return tests.select("*", each).select("*", "_m.*").drop("markers", "_m")
    return tests.join(markers, "test_id", "left")


def marker_display(markers: DataFrame) -> DataFrame:
    """``markers`` with unit_text, reference_label, bucket and colour, as a detail view shows them."""
    return markers.withColumns(
        {
            "unit_text": F.coalesce("unit", F.lit("")),
            "reference_label": fx.reference_label(F.col("reference_range")),
            "bucket": fx.flag_bucket(F.col("flag")),
            "colour": fx.flag_colour(F.col("flag")),
        }
    )


def delete_tests(tests: DataFrame, markers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tests in ``ids`` (test_id) and their markers."""
    gone = ids.select("test_id").where("test_id IS NOT NULL").distinct()
    return tests.join(gone, "test_id", "left_anti"), markers.join(gone, "test_id", "left_anti")


def delete_saved_tests(spark: SparkSession, ids: DataFrame, path: str) -> list[str]:
    """Delete the tests of ``ids`` (test_id) and their markers from the tables below ``path``; only files that hold some are rewritten. See ``store.delete``."""
    return store.delete(spark, ids, path, schemas.LAB_TESTS, schemas.LAB_MARKERS)


def delete_profiles(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Profiles and their child tables without the users in ``ids``; tests do not belong to a profile and stay."""
    gone = ids.select("user_id").where("user_id IS NOT NULL").distinct()
    owned = ("profiles", "allergies", "conditions", "weight_history")
    return {name: df.join(gone, "user_id", "left_anti") if name in owned else df for name, df in tables.items()}
