"""Zones of a report over several lines: which lines are results, and what belongs together.

Each line has points for each label by its form, and each pair of neighbouring labels by how
they go together. The labels of a text are those with the most points in all, found line by line
(Viterbi) for all texts of an Arrow batch side by side. So a name, its value and its
range are one result also where the scan has put them on lines of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.operators.textprep import RESULT_LINE

LABELS = ["other", "row", "name", "value", "range"]
#: A name by itself, a value with what may follow it, a range by itself.
NAME_LINE = r"^[ \t]*(\p{L}[\p{L} .,()/-]{0,38}?)[ \t]*:?[ \t]*$"
VALUE_LINE = r"^[ \t]*([<>]?[0-9]+(?:[.,][0-9]+)?)[ \t]*([%\p{L}/]+)?[ \t]*(?:\(?(?:ref:?[ \t]*)?([0-9.]+[ \t]*-[ \t]*[0-9.]+)\)?)?[ \t]*$"
RANGE_LINE = r"^[ \t]*\(?(?:[Rr]ef[a-z]*:?[ \t]*)?([0-9.]+[ \t]*-[ \t]*[0-9.]+)\)?[ \t]*$"
#: Points of a label where the line has its form; "other" fits every line, and the other labels cost where the form is not there.
FITS, MISSES = {"other": 1, "row": 4, "name": 1, "value": 2, "range": 3}, -9
#: Points from a label to the next one; 0 where none are named.
FOLLOWS = {
    ("name", "value"): 3, ("name", "other"): -1, ("name", "row"): -1, ("name", "name"): -1, ("name", "range"): -5, ("value", "range"): 1,
    ("other", "value"): -3, ("row", "value"): -3, ("value", "value"): -3, ("range", "value"): -3, ("other", "range"): -3, ("range", "range"): -3,
}


def line_form(line: Column) -> Column:
    """Which of the four forms a line has, as the bits of a number."""
    # What a form cannot be without is looked for first: few lines meet more than one of the longer patterns.
    digit = line.rlike("[0-9]")
    forms = [digit & line.rlike(RESULT_LINE), ~digit & line.rlike(NAME_LINE), digit & line.rlike(VALUE_LINE), line.contains("-") & line.rlike(RANGE_LINE)]
    return sum((F.when(form, 1 << k).otherwise(0) for k, form in enumerate(forms)), F.lit(0))


def _points() -> tuple[np.ndarray, np.ndarray]:
    """Points of each label (column) for each number of ``line_form``, and from each label (row) to the next one."""
    has = np.array([[True, *(form >> k & 1 for k in range(len(LABELS) - 1))] for form in range(1 << len(LABELS) - 1)], bool)
    return np.where(has, [FITS[x] for x in LABELS], MISSES), np.array([[FOLLOWS.get((a, b), 0) for b in LABELS] for a in LABELS])


def _best_labels(forms: pa.Array) -> pa.Array:
    """Numbers of the labels of the lines of each text, as if after an "other" line; of ways with equal points the one with smaller numbers, from the end."""
    fits, follows = _points()
    n = forms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    form, ends = forms.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)
    # The texts with the most lines come first, so those that still have a line are always the first ones.
    order = np.argsort(-n, kind="stable")
    first, steps = (ends - n)[order], int(n.max(initial=0))
    live = len(n) - np.cumsum(np.bincount(n, minlength=steps + 1))
    scores = np.full((len(n), len(LABELS)), -(10**6))
    scores[:, 0] = 0
    before = np.empty((len(form), len(LABELS)), np.int8)
    for k in range(steps):
        at = first[: live[k]] + k
        ways = scores[: live[k], :, None] + follows
        before[at] = ways.argmax(1)
        scores[: live[k]] = ways.max(1) + fits[form[at]]
    label, out = scores.argmax(1), np.empty(len(form), np.int32)
    for k in range(steps - 1, -1, -1):
        at = first[: live[k]] + k
        out[at] = label[: live[k]]
        label[: live[k]] = before[at, out[at]]
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out), mask=forms.is_null())


def _labelled(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, _lines and _labels of each text."""

    @F.arrow_udf("array<int>")
    def labels(forms: pa.Array) -> pa.Array:
        return _best_labels(forms)

    lines = docs.select(F.col(id_col).alias("doc_id"), F.split(text, "\n").alias("_lines"))
    return lines.withColumn("_labels", labels(F.transform("_lines", line_form)))


def line_zones(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, label, line: every line of each text with its label. A null text has no lines."""
    numbered = _labelled(docs, id_col, text)
    each = numbered.select("doc_id", F.posexplode(F.arrays_zip("_labels", "_lines")).alias("line_no", "x"))
    return each.select("doc_id", "line_no", F.get(F.array(*map(F.lit, LABELS)), F.col("x._labels")).alias("label"), F.col("x._lines").alias("line"))


def result_zones(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, n_lines, name, value, unit, reference_range: one row for each result, on one line or on up to three."""
    numbered = _labelled(docs, id_col, text)
    label, line = lambda k: F.get("_labels", k), lambda k: F.get("_lines", k)
    is_label = lambda k, name: F.coalesce(label(k) == LABELS.index(name), F.lit(False))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda k: is_label(k, "row") | is_label(k, "name") & is_label(k + 1, "value"))
    found = numbered.select("doc_id", "_labels", "_lines", F.explode(starts).alias("line_no"))
    at = F.col("line_no")
    row, ranged = is_label(at, "row"), is_label(at + 2, "range")
    found = found.select("doc_id", "line_no", row.alias("row"), line(at).alias("first"), line(at + 1).alias("second"), F.when(ranged, line(at + 2)).alias("third"))
    part = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    pick = lambda k, name, value: F.when(F.col("row"), part(F.col("first"), RESULT_LINE, k)).otherwise(value).alias(name)
    second = lambda k: part(F.col("second"), VALUE_LINE, k)
    own_range = F.coalesce(second(3), part(F.col("third"), RANGE_LINE, 1))
    n_lines = F.when(F.col("row"), 1).when(F.col("third").isNotNull() & second(3).isNull(), 3).otherwise(2)
    return found.select(
        "doc_id", "line_no", n_lines.alias("n_lines"), pick(1, "name", part(F.col("first"), NAME_LINE, 1)), pick(2, "value", second(1)), pick(3, "unit", second(2)), pick(4, "reference_range", own_range)
    )
