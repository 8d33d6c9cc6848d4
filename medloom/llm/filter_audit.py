"""Interaction of quality filters over all of their orders.

Each document fails some of the filters; what any order of the filters does with it
follows from that set alone. So documents are counted by part, set of failures (mask) and
labels, and only these cells are folded: for each order of a constant array the filters
are gone through with ``aggregate``, and ``transform`` does so for all orders. A cell
gives one struct for each order and step, weighted by its documents; the cells of a part
are merged by elementwise sums. DataFrame functions only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, packed, quoted

#: The filters, in the order of the bits of a mask.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_NULL_SALTS = 1 << 16


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (many capitals) and D (a symbol). Null: empty."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [words, n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * F.char_length(text), text.rlike(SYMBOLS)]


def _mask(failures: list[Column]) -> Column:
    out = F.lit(0)
    for bit, failed in enumerate(failures):
        out = out + F.when(failed, 1 << bit).otherwise(0)
    return out


def failure_cells(scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, set of failed filters and labels, as a kept table.

    Texts are compared by their SHA-256, so they are read once and never shuffled. Rows that
    share id, text and part are counted before anything else, and the rows of one text are
    reduced to one for each part and label before its smallest id is looked up.
    """
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    # The words are a column of their own, so that they are split once.
    rows = docs.select(
        F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"), text.alias("_text")
    )
    words, *failed = text_failures(F.col("_text"))
    rows = rows.withColumn("_words", words)
    rows = rows.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("key"), _mask(failed).alias("mask"))
    counted = scratch.keep(rows.groupBy("id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n")))

    # Rows without an id have no label; they are dealt out, so that no task gets them all.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(_NULL_SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    given = packed(labels, F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("_id IS NOT NULL")
    given = given.groupBy("_id").agg(F.coalesce(F.max("g"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    left = counted.withColumn("_salt", salt).withColumn("_id", F.coalesce("id", F.lit(0).cast(counted.schema["id"].dataType)))
    labelled = left.join(given.withColumn("_salt", F.lit(0).cast("long")), ["_id", "_salt"], "left")
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # One row of a text for each part and label; its copies are those above the smallest id of all.
    group = ["key", "part", "mask", "good", "toxic"]
    with_id = F.col("id").isNotNull()
    merged = labelled.groupBy(*group).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(with_id, F.col("n"))), F.lit(0)).alias("n_ids"), F.min("id").alias("first"), F.min_by(F.when(with_id, F.col("n")), "id").alias("n_first")
    )
    merged = scratch.keep(merged)
    smallest = merged.groupBy("key").agg(F.min("first").alias("smallest"))
    both = merged.join(smallest, "key")
    copies = F.col("n_ids") - F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    last = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask").alias("m"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + last).alias("m"), copies.alias("n")))
    cells = both.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "c.m", "good", "toxic", "c.n").where("n > 0")
    out = scratch.keep(cells.groupBy("part", F.col("m").alias("mask"), "good", "toxic").agg(F.sum("n").alias("n")))
    scratch.drop(counted, merged)
    return out


def order_names(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def folded(mask: Column, good: Column, toxic: Column, n: Column, filters: str = FILTERS) -> Column:
    """Structs of ``COUNTS`` of one cell, one for each order and step, order by order.

    The orders are an array of constants in the plan, 120 orders of five bits.
    """
    bits = F.array(*[F.array(*[F.lit(1 << filters.index(f)) for f in order]) for order in order_names(filters)])
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, alive = mask.bitwiseAND(bit) != 0, state["alive"]
        here = alive & fails
        count = lambda what: F.when(what, n).otherwise(zero)
        counts = [alive & ~fails, here, fails & ~alive, mask == bit, here & good, here & toxic]
        row = F.struct(*[count(c).alias(name) for c, name in zip(counts, COUNTS)])
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["rows"], F.array(row)).alias("rows"))

    empty = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(True).alias("alive"), empty.alias("rows"))
    return F.flatten(F.transform(bits, lambda order: F.aggregate(order, start, step, lambda state: state["rows"])))


def added(a: Column, b: Column) -> Column:
    """Elementwise sums of two arrays of structs of ``COUNTS``."""
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; see ``COUNTS``, and shapley.

    Filters: A few words, B few distinct words, C many capitals, D a symbol, E a text that
    a smaller id has too, in any part. A null text is empty and goes through the filters as
    such, however long texts are they are read whole, and a null part is the empty one. A
    row counts as a document, so repeated rows count again; they share their id, so none
    is a copy of the other. A row without an id is no copy and has no label. ``labels`` are
    (doc_id, quality, toxic); of several rows for one document any that says 1 holds.
    Other columns, of any name, are not read. An empty table has no parts and gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    cells = failure_cells(scratch, docs, labels, id_col, text_col, part_col)
    # Dealt out one by one: a fold is 600 structs, and cells are few and small.
    folds = cells.repartition("part", "mask", "good", "toxic").select("part", folded(F.col("mask"), F.col("good"), F.col("toxic"), F.col("n")).alias("rows"))
    # A part has 32 masks times four labels at most.
    merged = folds.groupBy("part").agg(F.collect_list("rows").alias("all"))
    total = F.aggregate(F.slice("all", 2, 4 << len(FILTERS)), F.get("all", F.lit(0)), added)
    merged = scratch.keep(merged.select("part", total.alias("rows")))

    names = order_names()
    # Of each filter, what it removes over all orders: the entries of the steps where it stands.
    places = [[o * len(FILTERS) + order.index(f) for o, order in enumerate(names)] for f in FILTERS]
    shapley = F.array(*[F.aggregate(F.array(*map(F.lit, at)), F.lit(0).cast("long"), lambda a, i: a + F.get(F.col("rows"), i)["removed"]) for at in places])
    rows = merged.select("part", shapley.alias("_shapley"), F.posexplode("rows").alias("_at", "_row"))
    orders = F.array(*map(F.lit, names))
    order = F.get(orders, F.floor(F.col("_at") / len(FILTERS)).cast("int"))
    step = F.col("_at") % len(FILTERS) + 1
    rows = rows.select("part", order.alias("filter_order"), step.cast("int").alias("step"), "_row.*", "_shapley")
    which = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    return rows.select("part", "filter_order", "step", *COUNTS, F.get("_shapley", which).alias("shapley"))
