"""Standard ids across laboratories: names that are linked, by each other or by a code, are one.

Links are edges between names of laboratories and codes. Ids are the connected
components, found by label propagation: each round takes the smallest label of the
neighbours, then follows labels of labels, until nothing changes. Rounds are written
to tables, so a lost executor costs a read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_node(provider: Column, name: Column) -> Column:
    """The node of a name as one laboratory writes it, case and outer spaces apart."""
    return F.to_json(F.struct(F.lit("name").alias("k"), provider.alias("p"), F.lower(F.trim(name)).alias("n")))


def code_node(code: Column) -> Column:
    return F.to_json(F.struct(F.lit("code").alias("k"), code.alias("c")))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, path: str) -> DataFrame:
    """node, root: the smallest node that each node of ``links`` (a, b) is connected with. ``path`` is a new folder that driver and executors share."""
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = _written(known.select("a", "b").unionAll(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/edges")
    labels = _written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), f"{path}/0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        joined = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        # The label of the label: halves the way to the smallest node each time.
        above = labels.select(F.col("node").alias("next"), F.col("root").alias("above"))
        moved = joined.join(above, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("root"), (F.least("next", F.coalesce("above", "next")) != F.col("root")).alias("moved"))
        written = _written(moved, f"{path}/{turn}")
        labels = written.select("node", "root")
        if written.where("moved").isEmpty():
            return labels


def standard_ids(links: DataFrame, path: str) -> DataFrame:
    """node, lab_standard_id: one id for each component, a hash of its smallest node."""
    found = components(links, path)
    return found.select("node", F.concat(F.lit("S-"), F.substring(F.sha2("root", 256), 1, 16)).alias("lab_standard_id"))


def alias_links(codes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """a, b of ``codes`` (provider, name, code), which code a laboratory gives a name, and ``aliases`` (provider, name, other_provider, other_name), names that are the same."""
    named = codes.where("name IS NOT NULL AND code IS NOT NULL")
    out = named.select(name_node(F.col("provider"), F.col("name")).alias("a"), code_node(F.col("code")).alias("b"))
    if aliases is not None:
        other = name_node(F.col("other_provider"), F.col("other_name")).alias("b")
        out = out.unionAll(aliases.where("name IS NOT NULL AND other_name IS NOT NULL").select(name_node(F.col("provider"), F.col("name")).alias("a"), other))
    return out


def standard_markers(markers: DataFrame, ids: DataFrame) -> DataFrame:
    """``markers`` (provider, name, ..) with lab_standard_id of ``standard_ids``; names without a link have none."""
    keyed = markers.drop("lab_standard_id").withColumn("node", name_node(F.col("provider"), F.col("name")))
    return keyed.join(ids, "node", "left").drop("node")
