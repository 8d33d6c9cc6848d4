"""Profiles: the current one, edits, form defaults and texts in the user's language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.functions.text import parse_measure

LANGUAGES = ("English", "Русский")
FIELDS = ("full_name", "birth_date", "gender", "blood_type", "height", "weight", "preferred_language")


def current_profile(profiles: DataFrame) -> DataFrame:
    """One profile for each user, the first by name and birth date; its language defaults to English."""
    first = F.min_by(F.struct(*FIELDS), F.struct("full_name", "birth_date"))
    one = profiles.groupBy("user_id").agg(first.alias("p")).select("user_id", "p.*")
    return one.withColumn("preferred_language", F.coalesce("preferred_language", F.lit("English")))


def last_edits(edits: DataFrame) -> DataFrame:
    """user_id, new: the last edit of each user as the fields of a profile.

    It is the one with the largest ``change_no``, if edits have that column, and of equal
    ones the last by name and measures. Edits without a user are left out.
    """
    named = edits.where("user_id IS NOT NULL").select(
        "user_id", *[F.col(c) for c in ("change_no",) if c in edits.columns], "full_name", "birth_date", "gender", "blood_type",
        parse_measure(F.col("height_text")).alias("height"), parse_measure(F.col("weight_text")).alias("weight"), F.col("language").alias("preferred_language"),
    )
    new = F.struct(*FIELDS)
    order = F.struct("change_no", new) if "change_no" in edits.columns else new
    return named.groupBy("user_id").agg(F.max_by(new, order).alias("new"))


def profile_upsert(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """``profiles`` with every field of an edited user replaced, also by null, and new users added.

    Of several edits of one user the last holds, see ``last_edits``.
    """
    both = profiles.select("user_id", F.struct(*FIELDS).alias("old")).join(last_edits(edits), "user_id", "full_outer")
    return both.select("user_id", F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("p")).select("user_id", "p.*")


def store_profiles(profiles: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write ``profiles`` as a table bucketed and sorted by user, replacing what is there; below ``path`` if given, else in the warehouse."""
    one = profiles.select("user_id", *FIELDS).repartition(buckets, "user_id")
    writer = one.write.mode("overwrite").format("parquet").bucketBy(buckets, "user_id").sortBy("user_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stored_upsert(spark: SparkSession, table: str, edits: DataFrame, buckets: int) -> DataFrame:
    """``profile_upsert`` on a table of ``store_profiles``: only the edits are dealt out, the stored side stays where its buckets are."""
    last = last_edits(edits).repartition(buckets, "user_id").hint("merge")
    both = spark.table(table).select("user_id", F.struct(*FIELDS).alias("old")).join(last, "user_id", "full_outer")
    return both.select("user_id", F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("p")).select("user_id", "p.*")


def profile_form(profiles: DataFrame) -> DataFrame:
    """Profiles as the texts that a form starts with: empty for what is missing."""
    text: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("blood_type", "height", "weight")]
    return profiles.select("user_id", "full_name", "birth_date", "gender", *text, F.col("preferred_language").alias("language"))


def localize(df: DataFrame, strings: DataFrame, key: str, lang: str, out: str = "label") -> DataFrame:
    """``df`` with the text of the column ``key`` in the language of the column ``lang``.

    Other languages fall back to English, unknown keys to the key itself.
    """
    one = strings.groupBy(F.col("lang").alias("_lang"), F.col("key").alias("_key")).agg(F.min("text").alias("_text"))
    shown = F.when(F.col(lang).isin(*LANGUAGES), F.col(lang)).otherwise("English")
    found = df.join(one, (shown == F.col("_lang")) & (F.col(key) == F.col("_key")), "left")
    return found.withColumn(out, F.coalesce("_text", F.col(key))).drop("_lang", "_key", "_text")
