"""Exact dedup by distributed MSD radix partitioning.

Texts are equal when they are identical after their white space is deleted. No
digest decides that: documents are split by their length and leading bytes, and
each group is split again by its next bytes, wider ones each round, until it is a
single document or has ended. A group that ends with several members is a group of
copies.

Hot groups: each Arrow batch first finds its own copies and sends one
representative of each on, so a text held by a third of all rows is a ten-thousandth
of the rows that are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, quoted, unpacked, worker_cache

#: Bytes that the first split looks at, and how much wider each next block is.
FIRST_BLOCK, WIDENING = 32, 8

LOCAL = "row long, doc_id long, rep long, text_sha256 string, norm binary, rep_rows long, best_points long, best_id long, best_row long"


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside each batch: the first of them represents the others and carries the normalised text. Columns after id and text go along."""
    from pyspark import TaskContext

    worker_cache("exact_dedup")
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        first: dict[bytes, int] = {}
        rep, sha, norms, best, rows = [], [], [], {}, {}
        for i, text in enumerate(texts):
            norm = (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")
            at = first.setdefault(norm, i)
            rep.append(at)
            sha.append(hashlib.sha256(norm).hexdigest() if at == i else sha[at])
            norms.append(norm if at == i else None)
            # Most code points, then the smallest doc_id (null last), then the first row.
            key = (-len(text or ""), ids[i] is None, ids[i] or 0, i)
            best[at] = min(best.get(at, key), key)
            rows[at] = rows.get(at, 0) + 1
        keys = [best[at] for at in rep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(row, row + len(ids)), pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array([row + at for at in rep], pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(norms, pa.binary()),
                pa.array([rows[at] for at in rep], pa.int64()),
                pa.array([-k[0] for k in keys], pa.int64()),
                pa.array([ids[k[3]] for k in keys], pa.int64()),
                pa.array([row + k[3] for k in keys], pa.int64()),
                *batch.columns[2:],
            ],
            names=[*(c.split()[0] for c in LOCAL.split(", ")), *batch.schema.names[2:]],
        )
        row += len(ids)


def _groups(scratch: Scratch, reps: DataFrame, first: int, widening: int) -> DataFrame:
    """(rep, group) of the representatives that have a copy, for reps = (rep, norm)."""
    head = F.substring("norm", 1, first)
    size = F.octet_length("norm")
    keys = reps.select("rep", size.alias("size"), head.alias("head"))
    shared = keys.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("group")).where("n > 1")
    active = keys.join(shared, ["size", "head"]).select("rep", "group")
    # Only documents that share their first bytes and length take their texts along.
    active = scratch.keep(active.join(reps, "rep").select("rep", "group", "norm"))
    done = [active.where(F.octet_length("norm") <= first).select("rep", "group")]
    rest = active.where(F.octet_length("norm") > first).select("rep", "group", F.expr(f"substring(norm, {first + 1})").alias("rest"))
    width, seen = first * widening, [active]
    while not rest.isEmpty():
        split = rest.select("rep", "group", F.substring("rest", 1, width).alias("block"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        shared = split.groupBy("group", "block").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("next")).where("n > 1")
        active = scratch.keep(split.join(shared, ["group", "block"]).select("rep", F.col("next").alias("group"), "rest"))
        done.append(active.where(F.octet_length("rest") == 0).select("rep", "group"))
        rest = active.where(F.octet_length("rest") > 0)
        width *= widening
        seen.append(active)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = scratch.keep(out)
    scratch.drop(*seen)
    return out


def _kept_rows(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, first_block: int, widening: int, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``LOCAL`` and ``more``; rep, best_row, group_id, group_row, size of the representatives that have a copy)."""
    rows = scratch.keep(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"), *more).mapInArrow(_local_groups, _schema(docs, *more)))
    reps = rows.where("row = rep")
    groups = _groups(scratch, reps.select("rep", "norm"), first_block, widening)

    # min() of this struct is the keeper: null ids last, ties to the first row.
    key = F.struct(-F.col("best_points"), F.col("best_id").isNull(), F.col("best_id"), F.col("best_row").alias("row"))
    members = groups.join(reps.select("rep", "rep_rows", "best_row", key.alias("key")), "rep")
    best = members.groupBy("group").agg(F.min("key").alias("key"), F.sum("rep_rows").alias("size"))
    of_rep = members.select("rep", "group", "best_row").join(best, "group")
    return rows, scratch.keep(of_rep.select("rep", "best_row", F.col("key.best_id").alias("group_id"), F.col("key.row").alias("group_row"), "size"))


def _schema(docs: DataFrame, *more: Column) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(LOCAL).fields, *docs.select(*more).schema.fields])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = FIRST_BLOCK, widening: int = WIDENING) -> DataFrame:
    """Each row of ``docs`` with the copy of it that stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row
    with the most code points in its original text stays, then the smallest doc_id;
    a null doc_id comes after all others. Of rows that tie in both (repeated rows)
    one stays, the first that the scan meets. A null text
    is an empty one, and empty texts are equal. An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    rows, of_rep = _kept_rows(Scratch(docs.sparkSession, "exact"), docs, id_col, text_col, first_block, widening)
    alone = F.col("size").isNull()
    return (
        rows.select("row", "doc_id", "rep", "text_sha256", "rep_rows", "best_id", F.col("best_row").alias("best"))
        .join(of_rep.drop("best_row"), "rep", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("best_id")).otherwise(F.col("group_id")).alias("keep_id"),
            F.coalesce("size", "rep_rows").alias("group_size"),
            (F.col("row") == F.coalesce("group_row", "best")).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = FIRST_BLOCK, widening: int = WIDENING) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; see ``exact_groups``.

    Rows are told apart by their numbers in the scan, so one stays of rows that repeat each other.
    """
    user = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(USER)
    rows, of_rep = _kept_rows(Scratch(docs.sparkSession, "exact"), docs, id_col, text_col, first_block, widening, user)
    # Only the best row of each batch's copies can stay, and few of those go: their numbers alone are joined.
    gone = of_rep.where("best_row <> group_row").select(F.col("best_row").alias("row"))
    return unpacked(rows.where("row = best_row").select("row", USER).join(gone, "row", "left_anti"), docs.columns)
