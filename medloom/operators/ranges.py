"""Ranges of what has been measured, from quantile sketches that are merged.

Each batch of saved markers gives a sketch of the values of each code and unit, of
bounded size. Sketches of batches and years are merged without reading the values
again, and the quartiles of the merged ones give a range outside of which a value is
looked at by a person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.functions.text import parse_measure

#: Size of a sketch: the rank error is about 1.3 % at 200, and falls in proportion.
SKETCH_K = 400
#: Values further than so many interquartile ranges from the quartiles are unusual; fewer values give no range.
FENCE, MIN_VALUES = 3.0, 20
KEY = ["loinc_code", "unit"]


def value_sketches(markers: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """loinc_code, unit, n, sketch of the values that are numbers. Markers without a code are left out; no unit is a unit."""
    values = markers.where("loinc_code IS NOT NULL").select("loinc_code", F.coalesce("unit", F.lit("")).alias("unit"), parse_measure(F.col("value")).alias("v")).where("v IS NOT NULL")
    return values.groupBy(*KEY).agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One row for each code and unit of several tables of ``value_sketches`` put together."""
    return sketches.groupBy(*KEY).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def value_ranges(sketches: DataFrame, fence: float = FENCE, min_values: int = MIN_VALUES) -> DataFrame:
    """loinc_code, unit, n, low, high: the fences around the quartiles of each code and unit."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    quartiles = sketches.where(F.col("n") >= min_values).select(*KEY, "n", at(0.25).alias("q1"), at(0.75).alias("q3"))
    width = F.col("q3") - F.col("q1")
    return quartiles.select(*KEY, "n", (F.col("q1") - fence * width).alias("low"), (F.col("q3") + fence * width).alias("high"))


def unusual_values(markers: DataFrame, ranges: DataFrame) -> DataFrame:
    """``markers`` with unusual: the value is a number outside the range of its code and unit. False where there is no range or no number."""
    keyed = markers.withColumn("_unit", F.coalesce("unit", F.lit("")))
    out = keyed.join(ranges.select("loinc_code", F.col("unit").alias("_unit"), "low", "high"), ["loinc_code", "_unit"], "left")
    value = parse_measure(F.col("value"))
    outside = F.coalesce((value < F.col("low")) | (value > F.col("high")), F.lit(False))
    return out.withColumn("unusual", outside).select(*markers.columns, "unusual")
