"""Labels of lines against every way to label them, and results over several lines."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from medloom.operators import zones
from medloom.operators.textprep import RESULT_LINE

L = r"[^\W\d_]"
PATTERNS = [p.replace(r"[\p{L} .,()/-]", r"(?:[^\W\d_]|[ .,()/-])").replace(r"[\p{L} ]", r"(?:[^\W\d_]|[ ])").replace(r"[%\p{L}/]", r"(?:[^\W\d_]|[%/])").replace(r"\p{L}", L) for p in (RESULT_LINE, zones.NAME_LINE, zones.VALUE_LINE, zones.RANGE_LINE)]


def points(line):
    return [zones.FITS["other"]] + [zones.FITS[label] if re.search(p, line) else zones.MISSES for label, p in zip(zones.LABELS[1:], PATTERNS)]


def total(labels, lines):
    names = ["other", *[zones.LABELS[k] for k in labels]]
    return sum(points(x)[k] for k, x in zip(labels, lines)) + sum(zones.FOLLOWS.get(p, 0) for p in zip(names, names[1:]))


LINES = ["Glucose", "Glucose: 5.2 mmol/L 3.9-6.1", "5.2", "7.1 mmol/l", "3.9 - 6.1", "(ref: 1-2)", "Lab of the town, 2020-01-01", "", "WBC 7", "Haemoglobin:", "140 g/L (120 - 160)", "RESULTS", "12 12", "<0.5"]


def test_labels_have_the_most_points(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = {}
    for r in zones.line_zones(docs).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((zones.LABELS.index(r.label), r.line))
    for k, text in enumerate(texts):
        lines = text.split("\n")
        labels = [x for x, _ in got[str(k)]]
        assert [x for _, x in got[str(k)]] == lines
        best = max(itertools.product(range(5), repeat=len(lines)), key=lambda way: (total(way, lines), [-x for x in reversed(way)]))
        assert total(labels, lines) == total(best, lines) and tuple(labels) == best, text


@pytest.mark.parametrize(
    "text,want",
    [
        ("RESULTS\nGlucose: 5.2 mmol/L (3.9 - 6.1)\nend", [(1, 1, "Glucose", "5.2", "mmol/L", "3.9 - 6.1")]),
        ("Glucose\n5.2 mmol/L\n3.9 - 6.1\nWBC 7", [(0, 3, "Glucose", "5.2", "mmol/L", "3.9 - 6.1"), (3, 1, "WBC", "7", None, None)]),
        ("Haemoglobin:\n140 g/L (120 - 160)\nUrea\n4", [(0, 2, "Haemoglobin", "140", "g/L", "120 - 160"), (2, 2, "Urea", "4", None, None)]),
        ("Lab\nTown\n\nGlucose\n5,2", [(3, 2, "Glucose", "5,2", None, None)]),
        ("just text\nand more text", []), ("42\n43", []), ("", []), (None, []),
    ],
)
def test_results_over_lines(spark, text, want):
    got = zones.result_zones(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in got] == want


def test_many_lines(spark):
    """20,000 lines in one text: the fold grows by pieces."""
    n = 4000
    text = "\n".join(["Heading of the page", "Glucose", "5.2 mmol/L", "3.9 - 6.1", "WBC: 7"] * n)
    got = zones.result_zones(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert got.groupBy("name", "n_lines").count().orderBy("name").collect() == [("Glucose", 3, n), ("WBC", 1, n)]
    assert zones.line_zones(spark.createDataFrame([("d", text)], "doc_id string, text string")).where(F.col("label") == "other").count() == n


def test_labels_without_a_fold(spark):
    """Texts of very different lengths side by side; the labels are no expression that is worked out line by line."""
    texts = [(str(k), None if k == 3 else "\n".join(LINES[(k + j) % len(LINES)] for j in range(k % 5 * k))) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    got = zones.line_zones(docs)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    together = {}
    for r in got.orderBy("doc_id", "line_no").collect():
        together.setdefault(r.doc_id, []).append(r.label)
    alone = {}
    for r in zones.line_zones(docs.repartition(40, "doc_id")).orderBy("doc_id", "line_no").collect():
        alone.setdefault(r.doc_id, []).append(r.label)
    assert together == alone and {k: len(v) for k, v in together.items()} == {k: len(t.split("\n")) for k, t in texts if t is not None}
