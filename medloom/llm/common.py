"""What the training-data operators share: scratch tables, ranks, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it, and the words between it.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder. On a cluster
    that is an error: executors would not see what others wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or _own_root()).rstrip("/")


@cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="medloom-")


#: Name of the struct that holds a user's columns, and bytes of an Arrow batch of whole texts.
USER, BATCH_BYTES = "user", 8 << 20


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` as one struct column ``USER``, so that none of its names meets one of ours, and columns of ours."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(USER), *more)


def unpacked(df: DataFrame, columns: list[str], *more: Column | str) -> DataFrame:
    """The user's columns out of ``USER``, then others, which are made first: names of the user mean nothing in them."""
    if more:
        df = df.select(USER, *more)
    return df.select(*[mine(c).alias(c) for c in columns], *[F.col(quoted(c)) for c in df.columns[1:] if more])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mine(name: str) -> Column:
    """A column of the user inside ``USER``."""
    return F.col(f"{USER}.{quoted(name)}")


class Scratch:
    """Intermediate tables of one operator call in the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it back with the same schema:
    the lineage is cut, and a lost executor costs a read, not a recomputation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        for made in _listening:
            made.append(self.path)
        # Arrow batches end at so many rows; long texts need a bound in bytes as well.
        bound = "spark.sql.execution.arrow.maxBytesPerBatch"
        if int(spark.conf.get(bound, None) or 1 << 31) > BATCH_BYTES:
            spark.conf.set(bound, str(BATCH_BYTES))

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``keep`` that no later result reads."""
        for df in tables:
            self.delete(df._scratch_path)

    def delete(self, path: str) -> None:
        release(self.spark, [path])


#: Lists that get the folder of each call, see ``scratch_folders``.
_listening: list[list[str]] = []


@contextmanager
def scratch_folders() -> Iterator[list[str]]:
    """The folders of all operator calls inside the ``with`` block, for ``release`` once their result is written."""
    made: list[str] = []
    _listening.append(made)
    try:
        yield made
    finally:
        # By identity: two lists can be equal.
        _listening[:] = [x for x in _listening if x is not made]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of intermediate tables, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def worker_cache(owner: str) -> dict:
    """A dict of ``owner`` that lasts as long as the Python worker; those of other owners are dropped."""
    import sys
    import types

    caches = sys.modules.setdefault("_worker_caches", types.ModuleType("_worker_caches")).__dict__.setdefault("caches", {})
    for other in [o for o in caches if o != owner]:
        del caches[other]
    return caches.setdefault(owner, {})


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, all other characters as they are. ``lower`` is faster where all are ASCII."""
    return F.when(F.char_length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col: Column) -> Column:
    """The words of a text: maximal runs of anything but ``SPACE``. Null: none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE + "+"), lambda w: w != "")


def ranked(scratch: Scratch, df: DataFrame, *order: Column | str, within: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its gapless rank from 0 in the given order, as a kept table.

    ``within`` names the leading order column that restarts the count. The rows are
    range-partitioned and sorted in their partitions, so no task holds more than its
    partition; what is joined back is one count for each partition (and value of
    ``within`` in it), a table as small as the number of partitions.
    """
    order = ((F.col(within),) if within else ()) + tuple(F.col(c) if isinstance(c, str) else c for c in order)
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    keys = ["_part"] + ([within] if within else [])
    sizes = dealt.groupBy(keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    span = Window.orderBy("_part") if not within else Window.partitionBy(within).orderBy("_part")
    starts = sizes.withColumn("_start", F.sum("_n").over(span) - F.col("_n")).drop("_n")
    if within:
        starts = starts.withColumnRenamed(within, "_within")
        on = (F.col("_part") == F.col("_p")) & F.col(within).eqNullSafe(F.col("_within"))
    else:
        on = F.col("_part") == F.col("_p")
    out = dealt.join(F.broadcast(starts.withColumnRenamed("_part", "_p")), on)
    return out.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_p", "_within", "_start", "_first")


#: A key is hot if it has more than this share of the rows of all keys, so that at most its inverse is broadcast.
HOT_SHARE = 1e-4


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, spread: Column) -> DataFrame:
    """``rows`` with ``found``: the struct of the other columns of their row of ``table``, a kept table with one row for each key; null if there is none.

    ``count`` tells how many rows a key of ``table`` has, about. Keys that are hot by it are few,
    and are broadcast; rows that they take, and rows without a key, are dealt out by ``spread`` in
    the join of the other keys, so no task gets all rows of a key.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > HOT_SHARE * total
    found = F.struct(*[c for c in table.columns if c not in on])
    first = rows.join(F.broadcast(table.where(hot).select(*on, found.alias("_hot"))), on, "left")
    first = first.withColumn("_key", F.when(F.col("_hot").isNotNull() | F.col(on[0]).isNull(), spread.cast(table.schema[on[0]].dataType)).otherwise(F.col(on[0])))
    rest = table.where(~hot).select(F.col(on[0]).alias("_key"), *on[1:], found.alias("_cold"))
    out = first.join(rest, ["_key", *on[1:]], "left")
    return out.select(*rows.columns, F.when(F.col(on[0]).isNotNull(), F.coalesce("_hot", "_cold")).alias("found"))
