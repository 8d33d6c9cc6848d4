"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id, number of the row), so equal texts lie
together and no two rows have one key. Each round counts the exact bytes between candidate
boundaries of the key, 256 for each splitter that is still open, and goes on between the
two candidates around the splitter's target. A splitter is set at the first candidate
within the tolerance; one that falls into a large group of equal texts is refined on by
doc_id inside it, and one that falls among rows that repeat both by their numbers. Only then
rows move, once: each goes to the part that the splitters give it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, packed, quoted, unpacked

#: Bits that one round resolves, of each of the three 64-bit parts of the key.
ROUND_BITS = 8
TOLERANCE = 0.005
#: Parts of a shard, each sorted by one task, and the share of one by which they may differ.
PARTS, PART_SLACK = 8, 0.1
_TOP = -(2**63)
_LAST = 2**63 - 1
_KEY = ["_group", "_id", "_at"]


def _unsigned(col: Column) -> Column:
    """Longs whose bits, read as unsigned, are in the order of the signed values."""
    return col.bitwiseXOR(F.lit(_TOP))


@dataclass
class _Splitter:
    """Rows with a key below ``key`` are before the splitter, ``rows`` of them. ``fixed`` has the parts of the key that are set; the prefix is one of the next part, unsigned."""

    target: float
    slack: float
    below: int = 0
    prefix: int = 0
    bits: int = 0
    fixed: tuple[int, ...] = ()
    key: tuple[int, ...] | None = None
    rows: int = 0

    def set(self, prefix: int) -> None:
        inside = prefix < (1 << self.bits)
        value = (prefix << (64 - self.bits)) + _TOP if inside else _LAST
        self.key = (*self.fixed, value, *[_TOP if inside else _LAST] * (2 - len(self.fixed)))

    def narrow(self, counts: dict[int, tuple[int, int]]) -> None:
        """Go on with the (bytes, rows) of each candidate prefix inside the current one."""
        self.bits += ROUND_BITS
        first, upto, rows = self.prefix << ROUND_BITS, self.below, 0
        for prefix in range(first, first + (1 << ROUND_BITS)):
            size, rows = counts.get(prefix, (0, 0))
            upto = self.below + size
            if upto >= self.target:
                break
            self.below, self.rows = upto, self.rows + rows
        else:
            # All of them are before the target.
            self.set(prefix + 1)
            return
        self.prefix = prefix
        # One row is not cut: the nearer side of it is as good as it gets.
        exhausted = rows <= 1 or self.bits == 64 and len(self.fixed) == 2
        if self.target - self.below <= self.slack or exhausted and self.target - self.below <= upto - self.target:
            self.set(prefix)
        elif upto - self.target <= self.slack or exhausted:
            self.rows += rows
            self.set(prefix + 1)
        elif self.bits == 64:
            self.fixed, self.prefix, self.bits = (*self.fixed, prefix + _TOP), 0, 0


def splitters(rows: DataFrame, n_parts: int, slack: Callable[[int], float], total: int) -> list[tuple[tuple[int, int, int], int]]:
    """Keys, each with the number of rows below it, that cut ``rows`` = (_group, _id, _at, size) into parts of near equal size: cut k misses its target by ``slack(k)`` bytes, or by less than a row.

    All open splitters look at the same bits of the same part of the key, so a round is one
    job. What comes to the driver is at most 256 sums for each open splitter.
    """
    cuts = [_Splitter(total * k / n_parts, slack(k)) for k in range(1, n_parts)]
    while total and (todo := [c for c in cuts if c.key is None]):
        bits, level = todo[0].bits, len(todo[0].fixed)
        groups = sorted({c.fixed for c in todo})
        prefix = F.shiftrightunsigned(_unsigned(F.col(_KEY[level])), 64 - bits - ROUND_BITS)
        which = F.lit(None).cast("int")
        for g, fixed in enumerate(groups):
            inside = F.shiftrightunsigned("prefix", ROUND_BITS).isin(sorted({c.prefix for c in todo if c.fixed == fixed})) if bits else F.lit(True)
            for name, value in zip(_KEY, fixed):
                inside &= F.col(name) == value
            which = F.when(inside, g).otherwise(which)
        some = rows.withColumn("prefix", prefix).select(which.alias("which"), "prefix", "size").where("which IS NOT NULL")
        sums = some.groupBy("which", "prefix").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        found: dict[int, dict[int, tuple[int, int]]] = {}
        for r in sums:
            found.setdefault(r.which, {})[r.prefix + 2**64 if r.prefix < 0 else r.prefix] = r["size"], r.n
        for c in todo:
            c.narrow(found.get(groups.index(c.fixed), {}))
    return [(c.key, c.rows) for c in cuts] if total else []


def parts_of(keys: list[np.ndarray], cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """Number of cuts that are not above each key: by the first part of the key, and where that is a cut's own, by the others."""
    group, *rest = keys
    of_cuts = np.array([c[0] for c in cuts], dtype=np.int64)
    part = np.searchsorted(of_cuts, group, side="left")
    for k in np.flatnonzero(np.isin(of_cuts, group)):
        same = np.flatnonzero(group == of_cuts[k])
        a, b = (x[same] for x in rest)
        part[same] += (a > cuts[k][1]) | (a == cuts[k][1]) & (b >= cuts[k][2])
    return part


def shard(
    rows: DataFrame, n_shards: int = 8, group_col: str = "group", id_col: str = "doc_id", size_col: str = "size", tolerance: float = TOLERANCE, parts: int = PARTS
) -> DataFrame:
    """``rows`` with shard (from 0) and slot (gapless from 0 in each shard), by the law of near equal sizes.

    ``group_col`` is a long that is equal for rows that should lie together, such as a
    hash of the text; a group is cut only where a splitter would otherwise miss its
    target by more than ``tolerance`` of a shard. Rows that repeat group and id are
    cut by their number in the scan, one by one. Null ids come first in their group. A shard is
    put in order by ``parts`` tasks. Texts are not read, so their length does not matter;
    an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    group, at = F.coalesce(F.col(quoted(group_col)), F.lit(0)).cast("long"), F.coalesce(F.col(quoted(id_col)), F.lit(_TOP)).cast("long")
    size = F.coalesce(F.col(quoted(size_col)), F.lit(0)).cast("long")
    # Written with the numbers of the rows, so that these stay what they are.
    numbered = scratch.keep(packed(rows, group.alias("_group"), at.alias("_id"), F.monotonically_increasing_id().alias("_at"), size.alias("size")))
    thin = numbered.select(*_KEY, "size")
    total = thin.agg(F.sum("size")).first()[0] or 0
    # Cuts inside of a shard only deal out its work.
    found = splitters(thin, n_shards * parts, lambda k: total / n_shards * (tolerance if k % parts == 0 else PART_SLACK / parts), total)
    cuts, n_parts = [key for key, _ in found], len(found) + 1

    def dealt(batches):
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4)]
            part = parts_of(keys, cuts) if cuts else np.zeros(batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[USER, *_KEY, "_part"])

    rows_in = numbered.select(USER, *_KEY)
    with_part = rows_in.mapInArrow(dealt, T.StructType([*rows_in.schema.fields, T.StructField("_part", T.IntegerType())]))
    below = [0, *[n for _, n in found]]
    starts = [n - below[k // parts * parts] for k, n in enumerate(below)]
    # The one exchange. A part is a partition, in order, so the place in it is the low half of the number.
    moved = with_part.repartitionById(n_parts, F.col("_part")).sortWithinPartitions("_part", *_KEY)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_part"))
    out = moved.withColumn("_slot", place).select(USER, F.floor(F.col("_part") / parts).cast("int").alias("shard"), (first + F.col("_slot")).alias("slot"))
    return unpacked(out, [c for c in rows.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and size (UTF-8 bytes of the text plus 1), group, shard, slot. Null text: no bytes.

    Columns of ``docs`` may have any name; those named like these four are replaced.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in ("size", "group")]
    rows = docs.select(*kept, (F.octet_length(text).cast("long") + 1).alias("size"), F.xxhash64(text).alias("group"))
    return shard(rows, n_shards, "group", id_col, "size")
