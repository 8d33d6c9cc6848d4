"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` keeps (line hash, documents) in runs: tables bucketed and sorted by the
hash. Each new batch merge-anti-joins the runs, which drops the hashes that are known
to be frequent already, and adds what is left as a run of its own. When a level holds
``fanout`` runs they are merged into one run of the next level. All runs have the
same buckets, so a batch meets them without moving them.

Documents are dealt into batches by a hash of their id, whatever files they come in. A
line is identified by two 64-bit hashes of its key. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, USER, Scratch, lower_ascii, mine, packed, spread_join, unpacked

#: Batches that a table is dealt into; runs of a level that are merged into one of the next.
BATCHES, FANOUT = 12, 3
#: Rows of all runs for each bucket.
BUCKET_ROWS = 1_500_000
HASH = ["h1", "h2"]
RESULT = ["n_lines", "n_dropped", "kept_text"]


def line_keys(lines: Column) -> Column:
    """The lines without white space at both ends, A-Z lower-cased. One step at a time: a lambda repeats what it names twice."""
    return F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS))), lower_ascii)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


class LineRuns:
    """Runs of (h1, h2, n): in how many documents a line hash was found."""

    def __init__(self, scratch: Scratch, saturation: int, buckets: int, fanout: int = FANOUT):
        self.scratch, self.saturation, self.fanout, self.buckets = scratch, saturation, fanout, buckets
        self.spark = scratch.spark
        self.levels: list[list[str]] = []
        #: Runs that batches have added, and levels of the merges so far.
        self.added, self.merges = 0, []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        # One file for each bucket, also where Spark was told to deal rows out wider.
        run = run.coalesce(self.buckets)
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each hash of the runs.

        The files are read without their buckets: grouping a union of bucketed tables
        can leave the exchange out and the hash in several rows.
        """
        files = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.scratch.path}/{name}" for name in names])
        return files.repartition(self.buckets, *HASH).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows (h1, h2, n) of ``batch`` whose hash no run has as frequent: a merge join with each run."""
        batch = batch.repartition(self.buckets, *HASH)
        for name in self._runs():
            known = self.spark.table(name).where(F.col("n") >= self.saturation).select(*HASH)
            batch = batch.join(known.hint("merge"), HASH, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, n): its distinct lines and the number of its documents that have them."""
        name, level = self._write(self.unknown(batch)), 0
        self.added += 1
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            old = self.levels[level]
            name = self._write(self._merged(old))
            self.levels[level] = []
            self._forget(old)
            level += 1
            self.merges.append(level)

    def frequent(self) -> DataFrame:
        """(h1, h2, n) found in at least ``saturation`` documents of all batches; n counts no more once a run has that many."""
        return self._merged(self._runs()).where(F.col("n") >= self.saturation)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.delete(f"{self.scratch.path}/{name}")

    def close(self) -> None:
        self._forget(self._runs())
        self.levels = []


def frequent_lines(scratch: Scratch, batches: list[DataFrame], text_col: str, min_docs: int, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, n) of the lines of at least ``min_docs`` rows, as a kept table. ``batches``: tables with a column ``_batch``, dealt by it."""
    keys = F.array_distinct(F.filter(line_keys(_lines(mine(text_col))), lambda k: k != ""))
    lines = reduce(DataFrame.union, [b.select("_batch", F.explode(F.transform(keys, _hashes)).alias("h")) for b in batches])
    lines = lines.select("_batch", "h.h1", "h.h2").groupBy("_batch", *HASH).agg(F.count(F.lit(1)).alias("n"))
    path = f"{scratch.path}/batches"
    # As many tasks as the grouping has, which grow with the rows and are merged by size where they are small.
    lines.write.partitionBy("_batch").parquet(path)
    dealt = scratch.spark.read.schema("h1 long, h2 long, n long, _batch int").parquet(path)
    sizes = {r["_batch"]: r["count"] for r in dealt.groupBy("_batch").count().collect()}
    most = int(scratch.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    runs = LineRuns(scratch, min_docs, min(most, max(4, -(-sum(sizes.values()) // BUCKET_ROWS))), fanout)
    try:
        for k in sorted(sizes):
            runs.add(dealt.where(F.col("_batch") == k).select(*HASH, "n"))
        if not sizes:
            return scratch.keep(dealt.select(*HASH, "n"))
        return scratch.keep(runs.frequent())
    finally:
        runs.close()
        scratch.delete(path)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: list[DataFrame] | int | None = None, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with its columns and n_lines, n_dropped, kept_text.

    Lines (split at ``\\n``; a null or empty text is one empty line) whose key has a
    character and is found in at least ``min_docs`` rows of all batches lose all their
    occurrences in every document. The other lines stay in their order, joined by ``\\n``.
    ``batches`` is their number (``BATCHES``), or the tables that together are ``docs``. Each row
    counts as a document, so a repeated row counts again. Columns of ``docs`` may have any
    name; those named like the three results are replaced. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    if not isinstance(batches, list):
        turns = [packed(docs, F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches or BATCHES)).cast("int").alias("_batch"))]
    else:
        turns = [packed(b, F.lit(k).alias("_batch")) for k, b in enumerate(batches)]
    frequent = frequent_lines(scratch, turns, text_col, min_docs, fanout)

    # Which lines of which row go. A row is known by 128 bits of hash of its id and text:
    # rows under one hash are copies, of which the same positions go.
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit(7), F.col(id_col), text).alias("r2"))
    # The row's hash is made before the lines are dealt out, not once more for each of them.
    at = docs.select(row.alias("row"), F.transform(line_keys(_lines(F.col(text_col))), _hashes).alias("h")).select("row", F.posexplode("h").alias("pos", "h"))
    at = spread_join(at.select("row.r1", "row.r2", "pos", "h.h1", "h.h2"), frequent, HASH, "n", F.col("r1"))
    gone = scratch.keep(at.where("found IS NOT NULL").groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")))

    out = packed(docs, row.alias("row")).select(USER, "row.r1", "row.r2").join(gone.hint("merge"), ["r1", "r2"], "left")
    out = out.withColumn("lines", _lines(mine(text_col)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(mine(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    results = [F.size("lines").cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"), kept]
    return unpacked(out, [c for c in docs.columns if c.lower() not in RESULT], *[x.alias(name) for x, name in zip(results, RESULT)])

