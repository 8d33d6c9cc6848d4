"""Names that are nearly the same, by a join on the rare grams of each.

A name is the set of its q-grams. Two sets whose Jaccard similarity reaches a bound share a
gram among the first few of each, when all are ordered alike; ordered from rare to
frequent, these prefixes meet seldom. So names are joined on the grams of their prefixes and by
their sizes, and what meets is verified. No pair that reaches the bound is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.text import char_runs

Q, BOUND = 2, 0.7
#: Stands before and after a name, so that its ends have grams of their own.
EDGE = "\x01"


def grams(name: Column, q: int = Q) -> Column:
    """The distinct q-grams of a name between edges; an empty or null name has none."""
    whole = F.concat(F.lit(EDGE * (q - 1)), name, F.lit(EDGE * (q - 1)))
    return F.when(F.char_length(name) > 0, F.array_distinct(char_runs(whole, q))).otherwise(F.array().cast("array<string>"))


def _prefixes(names: DataFrame, counts: DataFrame, column: str, bound: float) -> DataFrame:
    """``column``, grams, prefix: the grams that a partner has to share one of, rare ones first."""
    rows = names.select(column, "grams", F.explode("grams").alias("gram")).join(counts, "gram")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"])
    sets = rows.groupBy(column).agg(ordered.alias("grams"))
    # A little less than the bound asks for, so that rounding loses nothing.
    length = F.size("grams") - F.ceil(F.size("grams") * bound - 1e-9) + 1
    return sets.withColumn("prefix", F.slice("grams", F.lit(1), length.cast("int")))


def similar_names(asked: DataFrame, known: DataFrame, bound: float = BOUND, q: int = Q) -> DataFrame:
    """name, other, similarity: all pairs of a name of ``asked`` and an ``other`` of ``known`` with a Jaccard similarity of ``bound`` or more.

    Both tables have one column, ``name`` and ``other``; repeated, null and empty names are left out.
    """
    left = asked.select("name").distinct().withColumn("grams", grams(F.col("name"), q)).where("size(grams) > 0")
    right = known.select("other").distinct().withColumn("grams", grams(F.col("other"), q)).where("size(grams) > 0")
    counts = left.select(F.explode("grams").alias("gram")).unionAll(right.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _prefixes(left, counts, "name", bound).select("name", F.col("grams").alias("ga"), F.col("prefix").alias("pa"), F.explode("prefix").alias("gram"))
    b = _prefixes(right, counts, "other", bound).select("other", F.col("grams").alias("gb"), F.col("prefix").alias("pb"), F.explode("prefix").alias("gram"))
    sizes = (F.size("gb") >= F.size("ga") * bound - 1e-9) & (F.size("ga") >= F.size("gb") * bound - 1e-9)
    # A pair meets once for each gram that its prefixes share; the first of them stands for it.
    met = a.join(b, "gram").where(sizes & (F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("gram")))
    shared = F.size(F.array_intersect("ga", "gb"))
    rated = met.select("name", "other", (shared / (F.size("ga") + F.size("gb") - shared)).alias("similarity"))
    return rated.where(F.col("similarity") >= bound)
