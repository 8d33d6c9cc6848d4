"""Rule tests on hand-written rows, one for each branch."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions import text as fx
from medloom.operators import consult, extract, ingest, profile, textprep, vault, verify
from medloom.sources.strings import TEXTS, strings


def column(spark, values, expression, schema="x string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(expression(F.col("x"))).collect()]


def merged(text):
    """Line merging with a buffer, in plain Python."""
    out, held = [], ""
    for line in re.split("[\n\x0b\x0c\r\x85\u2028\u2029]", text):
        line = line.strip(" \t\xa0")
        if not line:
            continue
        if len(line) < 30 and (line[-1] in ":-" or not any(c.isdigit() for c in line)):
            held += line + " "
        else:
            out.append(held + line)
            held = ""
    return "\n".join(out + ([held.rstrip()] if held else []))


def test_normalize_ocr(spark):
    texts = [
        "Glucose:\n5.2", "Short line\nvalue 5.2", "a" * 29 + "\nb 1", "a" * 30 + "\nb 1", "1 range -\n2", "a\nb\nc\nd 4", "x 1\nlast", "\n  \n\t\n", "a:\r\n1",
        "\xa0\tGlucose 5\t\xa0", "", "--- Page 1 ---\nGlucose 5.2", "one\u2028two 2", "y" * 40,
    ]
    assert column(spark, texts, fx.normalize_ocr) == [merged(t) for t in texts]
    assert column(spark, ["Glucose:\n5.2", None], fx.normalize_ocr) == ["Glucose: 5.2", None]
    # 28 letters and two combining marks are fewer than 30 characters.
    assert column(spark, ["e\u0301" * 2 + "a" * 26 + "\n1"], fx.normalize_ocr) == ["e\u0301" * 2 + "a" * 26 + " 1"]


def test_pages(spark):
    rows = [("d", 1, 1, "two", True), ("d", 1, 0, "one", True), ("d", 1, 2, None, False), ("d", 1, 3, None, True), ("e", 1, 0, "x", True)]
    pages = spark.createDataFrame(rows, schemas.OCR_PAGES)
    got = dict(ingest.assemble_pages(pages).collect())
    assert got["d"] == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo\n\n--- Page 3 ---\n\n\n--- Page 4 ---\n" and got["e"] == "--- Page 1 ---\nx"
    assert dict(ingest.assemble_pages(pages, "pdf").collect())["d"] == "--- PDF Page 1 ---\none\n\n--- PDF Page 2 ---\ntwo\n\n--- PDF Page 3 ---\n"
    assert [r.page_number for r in ingest.page_numbers(pages).where("doc_id = 'd'").orderBy("page_index").collect()] == [1, 2, 3, 4]
    assert ingest.nonempty_docs(spark.createDataFrame([("",), (" ",), (None,)], "text string")).count() == 1


def test_ocr_lines(spark):
    rows = [("d", 0, 1, 0, "second", 0.5), ("d", 0, 0, 0, "bad", 0.1), ("d", 0, 0, 1, "first", 0.9), ("d", 0, 2, 0, None, 0.9), ("d", 0, 3, 0, "tie", 0.5), ("d", 0, 3, 1, "late", 0.5)]
    got = ingest.join_ocr_lines(spark.createDataFrame(rows, schemas.OCR_CANDIDATES)).collect()
    assert [r.text for r in got] == ["first\nsecond\ntie"]


def body(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


GOOD = {"name": "Glucose", "value": "5.2", "unit": "mmol/l", "referenceRange": "3-6", "flag": "Normal"}


@pytest.mark.parametrize(
    "content,expected",
    [
        (json.dumps({"markers": [GOOD]}), 1),
        (json.dumps({"markers": [GOOD | {"unit": None, "flag": None}]}), 1),
        (json.dumps({"markers": [{"name": "a", "value": ""}]}), 1),
        (json.dumps({"markers": [GOOD | {"extra": 1}], "more": 2}), 1),
        ('{"markers":[]}', 0),
        (json.dumps({"markers": [{"value": "1"}]}), None),
        ('{"markers":[{"name":"a","value":1.50}]}', None),
        ('{"markers":[{"name":"a","value":"1","unit":5}]}', None),
        ('{"markers":[null]}', None),
        (json.dumps({"markers": [GOOD, {"name": "b"}]}), None),
        ('```json\n{"markers":[]}\n```', None),
        ('{"markers":[]} Done.', None),
        ('{"markers":[]},{"markers":[]}', None),
        ("[]", None),
        ('{"markers":null}', None),
        ("", None),
    ],
)
def test_parse_markers(spark, content, expected):
    row = extract.parse_markers(spark.createDataFrame([("r", "d", 200, body(content))], schemas.LLM_RESPONSES)).first()
    assert (None if row.markers is None else len(row.markers)) == expected
    assert row.status == ("ok" if expected is not None else "undecodable") and (row.error_text is None) == (expected is not None)


def test_responses(spark):
    rows = [("r", str(k), code, b) for k, (code, b) in enumerate([(200, body("hi")), (401, ""), (404, None), (429, "x"), (500, body("hi")), (200, "no json"), (200, '{"choices":[]}'), (200, '{"choices":[{"message":{"content":5}}]}')])]
    responses = spark.createDataFrame(rows, schemas.LLM_RESPONSES)
    got = extract.response_status(responses).orderBy("doc_id").collect()
    assert [r.status for r in got] == ["ok"] + ["http_error"] * 4 + ["unparseable"] * 3
    assert got[4].error_text == "Server returned 500." and got[5].error_text == "Could not parse API response."
    assert [r.reply for r in consult.parse_reply(responses).orderBy("doc_id").collect()] == ["hi"] + [None] * 7
    docs = spark.createDataFrame([("0", "raw"), ("1", "raw"), ("9", "raw")], "doc_id string, text string")
    out = {r.doc_id: r for r in extract.extraction_outcome(docs, extract.parse_markers(responses)).collect()}
    assert out["1"].markers == [] and out["1"].text == "--- SERVER ERROR ---\nAPI Error: 401 Unauthorized — check your API key.\n\n--- ORIGINAL OCR ---\nraw"
    assert out["9"].error_text == "Invalid response from server." and len(out) == 3


TESTS = [("t1", 1, dt.datetime(2020, 1, 1), "lab", "Blood", None, None), ("t2", 1, dt.datetime(2021, 1, 1), "lab", "Blood", None, None), ("t3", 2, dt.datetime(2020, 1, 1), "lab", "Blood", None, None)]
MARKERS = [
    ("t1", 1, "Vitamin D", None, "old", None, None, None, False, None), ("t2", 1, "Vitamin D", None, "new", "u", "1-2", "High", False, None),
    ("t2", 2, "vitamin d", None, "other", "u", None, "LOW", False, None), ("t3", 1, "Vitamin D", None, "theirs", None, None, "abnormal", False, None),
    ("t1", 2, "", None, "nameless", None, None, "", False, None),
]


@pytest.fixture(scope="module")
def lab(spark):
    return spark.createDataFrame(TESTS, schemas.LAB_TESTS), spark.createDataFrame(MARKERS, schemas.LAB_MARKERS)


def test_fragments(spark, lab):
    questions = spark.createDataFrame([(1, 1, "my VITAMIN level"), (2, 1, "bloo"), (3, 1, "sadness"), (4, 2, "vitamin"), (5, None, "vitamin")], schemas.QUESTIONS)
    fragments = consult.context_fragments(questions, *lab)
    got = {(r.question_id, r.key): r.value for r in fragments.collect()}
    assert got[1, "Blood — Vitamin D"] == "old  (ref: n/a)" and got[1, "Blood — vitamin d"] == "other u (ref: n/a)"
    assert (2, "Blood — Vitamin D") not in got and (3, "Blood — Vitamin D") in got  # the part d is in sadness
    assert got[4, "Blood — Vitamin D"] == "theirs  (ref: n/a)" and not any(q == 5 for q, _ in got)
    newest = {(r.question_id, r.key): r.value for r in consult.context_fragments(questions, *lab, prefer="latest").collect()}
    assert newest[1, "Blood — Vitamin D"] == "new u (ref: 1-2)"
    prompts = {r.question_id: r for r in consult.fragment_prompt(questions, fragments, "S").collect()}
    assert prompts[2].prompt == "S" and len(prompts) == 5
    assert prompts[4].prompt == "S\n\n--- HEALTH PASSPORT FRAGMENTS ---\n• Blood — Vitamin D: theirs  (ref: n/a)\n--- END FRAGMENTS ---"
    payload = json.loads(consult.consult_requests(consult.fragment_prompt(questions, fragments, "S")).where("question_id = 2").first().payload)
    assert payload["messages"] == [{"role": "system", "content": "S"}, {"role": "user", "content": "bloo"}] and payload["temperature"] == 0.2
    asked = spark.createDataFrame([(1, 1, " \n a\u00a0"), (2, 1, "\t\n ")], schemas.QUESTIONS)
    assert [r.text for r in consult.nonblank_questions(asked).collect()] == ["a"]


def test_reduce_before_the_join_is_reduce_after_it(spark, lab):
    tests, markers = lab
    questions = spark.createDataFrame([(1, 1, "vitamin"), (4, 2, "vitamin d")], schemas.QUESTIONS)
    joined = markers.join(tests, "test_id")
    hits = consult.context_match(questions, joined)
    after = hits.groupBy("question_id", "test_name", "name").agg(F.min_by("value", F.struct("date")).alias("value")).collect()
    before = consult.context_match(questions, consult.winning_markers(tests, markers)).collect()
    assert {(r.question_id, r.name, r.value) for r in after} == {(r.question_id, r.name, r.value) for r in before}


def test_vault(spark, lab):
    tests, markers = lab
    ranks = {r.test_id: r["rank"] for r in vault.vault_listing(tests).collect()}
    assert ranks == {"t2": 1, "t1": 2, "t3": 1}
    left, rows = vault.delete_tests(tests, markers, spark.createDataFrame([("t2",), ("none",), (None,)], "test_id string"))
    assert {r.test_id for r in left.collect()} == {"t1", "t3"} and {r.test_id for r in rows.collect()} == {"t1", "t3"}
    lonely = tests.unionByName(spark.createDataFrame([("t4", 3, None, None, "x", None, None)], schemas.LAB_TESTS))
    assert vault.test_markers(lonely, markers.drop("sample_type")).where("test_id = 't4' AND name IS NULL").count() == 1
    nested = lonely.join(markers.groupBy("test_id").agg(F.collect_list(F.struct("pos", "name")).alias("markers")), "test_id", "left")
    assert vault.test_markers(nested).count() == vault.test_markers(lonely, markers).count()
    shown = {(r.test_id, r.pos): r for r in vault.marker_display(markers).collect()}
    assert [shown["t2", 1].bucket, shown["t2", 2].colour, shown["t3", 1].colour, shown["t1", 2].bucket] == ["high", "orange", "gray", None]
    assert shown["t2", 1].reference_label == "Reference: 1-2" and shown["t2", 2].reference_label is None and shown["t1", 1].unit_text == ""
    kept = vault.delete_profiles({"allergies": tests.select("user_id"), "lab_tests": tests}, spark.createDataFrame([(1,)], "user_id long"))
    assert kept["allergies"].count() == 1 and kept["lab_tests"].count() == 3


def test_corrections(spark):
    markers = spark.createDataFrame([("d", 0, "a", "1", "u", "r", "High"), ("d", 1, "b", "2", None, None, None), ("d", 2, "c", "3", None, None, None)], "doc_id string, pos int, " + schemas.MARKER)
    fixes = spark.createDataFrame([("d", 0, "edit", "", "", None), ("d", 1, "remove", None, None, None), ("d", 1, "edit", "z", "z", "z"), ("d", 9, "add", "", "", None)], schemas.CORRECTIONS)
    got = sorted(map(tuple, verify.apply_corrections(markers, fixes).collect()), key=lambda r: r[1])
    assert got == [("d", 0, "", "", None, "r", "High"), ("d", 2, "c", "3", None, None, None), ("d", 9, "", "", None, None, None)]
    assert verify.confirmed_only(markers, spark.createDataFrame([("d",), ("d",)], schemas.CONFIRMATIONS)).count() == 3


def test_codes_and_save(spark, lab, tmp_path):
    tests, markers = lab
    loinc = spark.createDataFrame([("vitamin d", "1989-3"), ("vitamin d", "9999-9")], schemas.LOINC_DICT)
    coded = verify.loinc_map(markers, loinc)
    assert coded.count() == markers.count() and coded.where("loinc_code = '1989-3'").count() == 4
    review = {(r.test_id, r.pos): r.needs_review for r in verify.needs_review(coded).collect()}
    assert review == {("t1", 1): False, ("t2", 1): False, ("t2", 2): True, ("t3", 1): True, ("t1", 2): True}
    alias = spark.createDataFrame([("lab", "Vitamin D", "S1")], schemas.LAB_ALIAS)
    assert verify.lab_standard_map(markers.withColumn("provider", F.lit("lab")), alias).where("lab_standard_id = 'S1'").count() == 3
    docs = tests.withColumnRenamed("test_id", "doc_id")
    saved, rows = verify.to_lab_tests(docs, markers.withColumnRenamed("test_id", "doc_id"))
    verify.save_tests(saved, rows, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/lab_markers")
    assert back.count() == 5 and {r.year for r in back.select("year").distinct().collect()} == {2020, 2021}
    assert back.where("loinc_code IS NULL AND NOT is_critical AND lab_standard_id IS NULL").count() == 5
    # A rerun adds nothing; new tests are added to what is there.
    verify.save_tests(saved, rows, str(tmp_path))
    more = [df.withColumn("test_id", F.concat(F.lit("new "), "test_id")) for df in (saved, rows)]
    verify.save_tests(saved.unionByName(more[0]), rows.unionByName(more[1]), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/lab_markers").count() == 10
    assert spark.read.parquet(f"{tmp_path}/lab_tests").count() == 2 * saved.count()


def test_pairs_that_make_one_key(spark):
    """A name with the sign between test and marker in it: the oldest test's value holds. Nulls count as empty."""
    day = lambda n: dt.datetime(2020, 1, n)
    tests = spark.createDataFrame([("t1", 1, day(2), "p", "A — B", None, None), ("t2", 1, day(1), "p", "A", None, None), ("t3", 1, day(3), "p", None, None, None)], schemas.LAB_TESTS)
    rows = [("t1", 0, "C", "1"), ("t2", 0, "B — C", "2"), ("t3", 0, "C", None)]
    markers = spark.createDataFrame(rows, "test_id string, pos int, name string, value string").withColumns({c: F.lit(None).cast("string") for c in ("unit", "reference_range")})
    questions = spark.createDataFrame([(7, 1, "what of C and b?")], "question_id long, user_id long, text string")
    for prefer, value in (("oldest", "2"), ("latest", "1")):
        got = consult.context_fragments(questions, tests, markers, prefer).orderBy("key").collect()
        assert [(r.key, r.value) for r in got] == [(" — C", "  (ref: n/a)"), ("A — B — C", f"{value}  (ref: n/a)")]


def test_profiles(spark):
    born = dt.datetime(1980, 1, 1)
    profiles = spark.createDataFrame([(1, "A", born, "Male", None, 180.0, 80.0, None), (2, "B", born, "Unknown", "A+", None, None, "Русский")], schemas.PROFILES)
    edits = spark.createDataFrame([(1, "A2", born, "Other", "", "180.5", "heavy", "English"), (3, "C", born, "Female", "", "1e2", "", "Deutsch")], schemas.PROFILE_EDITS)
    got = {r.user_id: r for r in profile.profile_upsert(profiles, edits).collect()}
    assert (got[1].height, got[1].weight, got[1].blood_type) == (180.5, None, "") and got[3].height == 100.0 and got[2].full_name == "B"
    assert column(spark, ["72", "72.5", "72,5", " 72", "1d", "", "1e2", ".5", "5.", "-3", None], fx.parse_measure) == [72.0, 72.5, None, None, None, None, 100.0, 0.5, 5.0, -3.0, None]
    forms = {r.user_id: r for r in profile.profile_form(profiles).collect()}
    assert (forms[1].blood_type, forms[1].height, forms[2].weight) == ("", "180.0", "")
    assert profile.current_profile(profiles).where("user_id = 1").first().preferred_language == "English"
    keys = spark.createDataFrame([("tab_vault", "Русский"), ("tab_vault", "Deutsch"), ("gender_unknown", "English"), ("tab_vault", None)], "key string, lang string")
    got = profile.localize(keys, strings(spark), "key", "lang").collect()
    assert sorted(r.label for r in got) == sorted(["Сейф", "Vault", "gender_unknown", "Vault"]) and len(TEXTS) == 35


def test_chat(spark):
    turns = "conv_id long, turn int, text string"
    questions, replies = spark.createDataFrame([(1, 1, "q"), (2, 1, "q")], turns), spark.createDataFrame([(1, 2, "a")], turns)
    log = consult.chat_log(questions, replies, spark.createDataFrame([(1, "hello"), (3, "hello")], "conv_id long, text string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.source) for r in log] == [(1, "user", "local"), (1, "assistant", "cloud"), (2, "user", "local"), (3, "assistant", "local")]
    rows = spark.createDataFrame([("user", "local"), ("assistant", "cloud"), ("assistant", "local")], "role string, source string")
    assert [r[0] for r in rows.select(fx.chat_source_label(F.col("role"), F.col("source"), "X")).collect()] == ["You", "X ☁️", "X 📱"]
    replies = spark.createDataFrame([(f"Possible causes. {consult.DISCLAIMER}",), (f"You have flu. {consult.DISCLAIMER}",), ("ok",)], "text string")
    assert [r.compliant for r in consult.reply_compliance(replies).collect()] == [True, False, False]


def test_text_checks(spark):
    assert column(spark, ["the cat and the dog", "le chat et la souris", "", None], textprep.detect_language) == ["en", "fr", "und", "und"]
    docs = spark.createDataFrame([("1", 1, "Ann Lee, +49 170 1234567, ann@x.org, 12 Main Street"), ("2", 2, "card 1234567890123456 ok"), ("3", 3, None)], "doc_id string, user_id long, text string")
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "")], "user_id long, full_name string")
    got = {r.doc_id: r.text for r in textprep.redact_pii(docs, people).collect()}
    assert got == {"1": "[NAME], [PHONE], [EMAIL], [ADDRESS]", "2": "card 1234567890123456 ok", "3": None}
    assert {r.doc_id: r.route for r in textprep.sensitive_routing(docs).collect()} == {"1": "manual", "2": "auto", "3": "auto"}
    gate = textprep.medical_doc_gate(spark.createDataFrame([("Blood glucose 5 mmol/l",), ("hello",), (None,)], "text string")).collect()
    assert [r.is_medical for r in gate] == [True, False, False]
    lines = spark.createDataFrame([("d", "Lab report\nGlucose: 5.2 mmol/L (3.9 - 6.1)\nWBC 7")], "doc_id string, text string")
    zones = [tuple(r) for r in textprep.key_zones(lines).orderBy("line_no").collect()]
    assert zones == [("d", 1, "Glucose", "5.2", "mmol/L", "3.9 - 6.1"), ("d", 2, "WBC", "7", None, None)]
    payload = json.loads(extract.extraction_requests(lines).first().payload)
    assert payload["messages"][1]["content"].startswith("Lab report") and payload["temperature"] == 0.1
