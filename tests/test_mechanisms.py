"""Gram index, standard ids and value ranges against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from medloom import schemas
from medloom.operators import consult, ingest, ranges, standard, verify


def contents(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_gives_the_rows_of_the_plain_join(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    # A third of the questions and names belong to one account; parts repeat.
    user = lambda k: 1 if k % 3 == 0 else rng.choice([2, 3, 4, None])
    questions = [(k, user(k), " ".join(word() for _ in range(rng.randint(0, 8))).title()) for k in range(150)] + [(900, 1, None), (901, 1, ""), (902, 2, "Vitamin D")]
    names = [(user(k), f"test {k % 2}", " ".join(word() for _ in range(rng.randint(0, 3)))) for k in range(120)] + [(2, "t", "vitamin  d"), (2, "t", "D"), (2, "t", ""), (2, "t", None), (2, "t", "  ")]
    asked = spark.createDataFrame(questions, "question_id long, user_id long, text string").repartition(3)
    named = spark.createDataFrame(list({*names}), "user_id long, test_name string, name string")
    columns = ["question_id", "user_id", "test_name", "name"]
    plain = contents(consult.context_match(asked, named).select(columns))
    assert plain and contents(consult.indexed_match(asked, named).select(columns)) == plain
    candidates = consult.match_candidates(asked, named)
    pairs = {(u, n) for u, _, n in names if u is not None and n}
    everything = sum(len((n or "").split()) for _, u, _ in questions for v, n in pairs if v == u)
    assert candidates.count() == candidates.distinct().count() < everything / 3
    report = {r.part: (r.n_candidates, r.n_matches) for r in consult.match_report(asked, named).collect()}
    assert sum(c for c, _ in report.values()) == candidates.count() and all(c >= m for c, m in report.values())
    assert all(c == m for part, (c, m) in report.items() if len(part) <= consult.GRAM)
    for df in (consult.indexed_match(asked.limit(0), named), consult.indexed_match(asked, named.limit(0))):
        assert df.count() == 0


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def union_find(links):
    parent = {}
    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(parent, a), find(parent, b)))
            parent[y] = x
    return {n: find(parent, n) for n in list(parent)}


def test_components_equal_union_find(spark, tmp_path):
    rng = random.Random(3)
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(150)]
    hub = [("hub", f"h{k:03}") for k in range(200)]
    links = chain + hub + [(f"r{rng.randrange(120)}", f"r{rng.randrange(120)}") for _ in range(70)] + [("x", "x"), ("y", None), (None, None), ("c000", "c001")]
    rng.shuffle(links)
    got = standard.components(spark.createDataFrame(links, "a string, b string"), f"file://{tmp_path}/parts").collect()
    assert {r.node: r.root for r in got} == union_find(links) and len(got) == len(union_find(links))
    assert standard.components(spark.createDataFrame([], "a string, b string"), f"file://{tmp_path}/none").count() == 0


def test_standard_markers(spark, tmp_path):
    codes = spark.createDataFrame([("A", "Hb", "718-7"), ("B", " haemoglobin", "718-7"), ("A", "Glucose", "2345-7"), ("C", "none", None)], "provider string, name string, code string")
    aliases = spark.createDataFrame([("B", "Haemoglobin", "C", "HGB"), ("C", "hgb", "D", "Hémoglobine")], "provider string, name string, other_provider string, other_name string")
    ids = standard.standard_ids(standard.alias_links(codes, aliases), f"file://{tmp_path}/ids")
    rows = [(1, "A", "hb"), (2, "B", "HAEMOGLOBIN"), (3, "C", "HGB "), (4, "D", "hémoglobine"), (5, "A", "glucose"), (6, "A", "HGB"), (7, "C", "none"), (8, None, "hb"), (9, "A", None)]
    got = {r.k: r.lab_standard_id for r in standard.standard_markers(spark.createDataFrame(rows, "k int, provider string, name string"), ids).collect()}
    assert len(got) == 9 and got[1] == got[2] == got[3] == got[4] != got[5] and got[5] and not any(got[k] for k in (6, 7, 8, 9))


def test_ranges_from_merged_sketches(spark):
    rng = random.Random(11)
    values = {("a", "u"): [rng.gauss(100, 10) for _ in range(6000)], ("a", None): [rng.uniform(0, 1) for _ in range(300)], ("b", "u"): [5.0] * 50, ("c", "u"): [1.0, 2.0, 900.0]}
    rows = [(f"t{k}", k, code, unit, repr(v)) for (code, unit), vs in values.items() for k, v in enumerate(vs)]
    odd = [("o", 0, "a", "u", "900"), ("o", 1, "a", "u", "-50"), ("o", 2, "a", "u", "negative"), ("o", 3, "a", "u", None), ("o", 4, None, "u", "1e9"), ("o", 5, "b", "u", "5.1"), ("o", 6, "c", "u", "1e9"), ("o", 7, "a", None, "40")]
    markers = spark.createDataFrame(rows, "test_id string, pos int, loinc_code string, unit string, value string").repartition(4)
    batches = [ranges.value_sketches(markers.where(F.col("pos") % 3 == k)) for k in range(3)]
    merged = ranges.merged_sketches(batches[0].unionAll(batches[1]).unionAll(batches[2]))
    limits = {(r.loinc_code, r.unit): r for r in ranges.value_ranges(merged).collect()}
    assert {k: r.n for k, r in limits.items()} == {("a", "u"): 6000, ("a", ""): 300, ("b", "u"): 50}
    # The rank of each estimated quartile is within the error that the sketch's size stands for.
    at = merged.where("loinc_code = 'a' AND unit = 'u'")
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        estimate = at.select(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("x")).first().x
        assert abs(sum(v <= estimate for v in values["a", "u"]) / 6000 - q) < 0.02
    got = {r.pos: r.unusual for r in ranges.unusual_values(spark.createDataFrame(odd, markers.schema), ranges.value_ranges(merged)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True}
    assert ranges.unusual_values(markers, ranges.value_ranges(merged)).where("unusual").count() < 10
    assert ranges.value_ranges(ranges.value_sketches(markers.limit(0))).count() == 0
    reviewed = verify.needs_review(ranges.unusual_values(spark.createDataFrame([("o", 0, "a", "u", "900", "n", None), ("o", 1, "a", "u", "101", "n", None)], "test_id string, pos int, loinc_code string, unit string, value string, name string, flag string"), ranges.value_ranges(merged)))
    assert {r.pos: r.needs_review for r in reviewed.collect()} == {0: True, 1: False}


@pytest.mark.parametrize(
    "text,careful,compliant",
    [("All fine.", True, True), ("Possible causes: rest.", True, True), ("The cause is rest.", False, False), ("Causes? Possible causes: x", False, False), ("Возможные причины: сон", True, True), ("Причина: сон", False, False)],
)
def test_wording_of_causes(spark, text, careful, compliant):
    row = consult.reply_compliance(spark.createDataFrame([(f"{text} {consult.DISCLAIMER}",)], "text string")).first()
    assert (row.careful, row.compliant, row.has_stop_word) == (careful, compliant, False)


def test_page_report(spark):
    pages = spark.createDataFrame([("d", 1, k, "x" * k, True) for k in range(4)] + [("e", 1, 0, None, True)], schemas.OCR_PAGES)
    got = {r.doc_id: (r.n_pages, r.n_chars, r.oversize) for r in ingest.page_report(pages, max_pages=3).collect()}
    assert got == {"d": (4, 6, True), "e": (1, 0, False)}
