"""Names in texts against a plain-Python version, and similar names against all pairs."""

import random
import re

import pytest

from medloom import schemas
from medloom.operators import extract, names, textprep, verify, workflow
from medloom.operators.similarity import similar_names

SEGMENT = re.compile(r"[^\W_]+|[\W_]+")


def brute_mask(text, own, people):
    """Words one by one; islands as ranges that grow."""
    segs = SEGMENT.findall(text)
    hits = {k for k, s in enumerate(segs) if s.lower() in own}
    bridge = lambda k: 0 < k < len(segs) - 1 and re.fullmatch(r"[ \t\n\r]{0,4}[,.'’-]?[ \t\n\r]{0,4}", segs[k])
    pairs = set()
    for name in people:
        w = [x.lower() for x in re.findall(r"[^\W_]+", name)]
        for x in range(len(w)):
            for y in range(len(w)):
                if x != y:
                    pairs |= {p for p in ((w[x], w[y]), (w[x][0], w[y]), (w[x], w[y][0])) if max(map(len, p)) >= 3}
    for k in range(len(segs) - 2):
        if segs[k][0].isupper() and segs[k + 2][0].isupper() and bridge(k + 1) and (segs[k].lower(), segs[k + 2].lower()) in pairs:
            hits |= {k, k + 2}
    out, k = [], 0
    while k < len(segs):
        if k not in hits:
            out.append(segs[k])
            k += 1
            continue
        last = k
        while last + 2 in hits and bridge(last + 1):
            last += 2
        island = range(k, last + 1)
        out.append("[NAME]" if any(len(segs[j]) >= 3 for j in island[::2]) else "".join(segs[j] for j in island))
        k = last + 1
    return "".join(out)


@pytest.mark.parametrize(
    "text,want",
    [
        ("ann lee; Lee, Ann", "[NAME]; [NAME]"), ("ANN", "[NAME]"), ("Annette and Lee-Ann", "Annette and [NAME]"), ("J. Lee", "[NAME]"), ("J. was here", "J. was here"),
        ("Ann  \n Lee", "[NAME]"), ("Ann (Lee)", "[NAME] ([NAME])"), ("Dr. Bob Stone and B. Stone saw bob stone", "Dr. [NAME] and [NAME] saw bob stone"), ("Stone Bob", "[NAME]"),
        ("a Stone", "a Stone"), ("", ""), ("lee", "[NAME]"), ("Ann", "[NAME]"), ("x Ann", "x [NAME]"), ("Ann Bob Stone Lee.", "[NAME]."),
    ],
)
def test_ways_to_write_a_name(spark, text, want):
    docs = spark.createDataFrame([("d", 1, text)], "doc_id string, user_id long, text string")
    profiles = spark.createDataFrame([(1, "Ann J. Lee"), (1, "Ann Lee"), (2, "Bob")], "user_id long, full_name string")
    people = spark.createDataFrame([("Bob Stone",)], "full_name string")
    got = textprep.redact_pii(docs, profiles, people).collect()
    assert [r.text for r in got] == [want] == [brute_mask(text, {"ann", "j", "lee"}, ["Bob Stone"])]


def test_names_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["Ann", "Lee", "de", "J", "O'Neil", "Été", "Bob", "Stone", "stone", "ANN", "word", "other", "Lee", "42"]
    gaps = [" ", " ", ", ", ". ", "-", "\n", "  ", "; ", " (", "    ", "’"]
    texts = ["".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(0, 14))) for _ in range(200)] + ["word " * 30000 + "Ann Lee", "Ann " * 20000]
    rows = [(str(k), [1, 2, None, 99][k % 4], t) for k, t in enumerate(texts)] + [("n", 1, None), ("0", 1, texts[0]), ("0", 1, texts[0])]
    profiles = [(1, "Ann Lee"), (1, "Lee J"), (1, None), (2, "Été de O'Neil"), (2, ""), (None, "word")]
    people = ["Bob Stone", "Bob Stone", "J. Ann", None, ""]
    words = {1: {"ann", "lee", "j"}, 2: {"été", "de", "o", "neil"}}
    docs = spark.createDataFrame(rows, "doc_id string, user_id long, text string").repartition(3)
    table = spark.createDataFrame(profiles, "user_id long, full_name string")
    known = spark.createDataFrame([(p,) for p in people], "full_name string")
    for directory in (None, known):
        found = textprep.names.with_name_spans(docs, table, directory)
        got = [(r.doc_id, r.text, r.masked) for r in found.withColumn("masked", names.masked(found["text"])).collect()]
        names_of = [p for p in people if p] if directory is not None else []
        assert len(got) == len(rows)
        users = {r[0]: r[1] for r in rows}
        for doc, text, masked in got:
            assert masked == (None if text is None else brute_mask(text, words.get(users[doc], set()), names_of)), text[:80]
    spans = names.name_spans(docs.where("doc_id < '5'"), table, known).collect()
    texts_of = {r[0]: r[2] for r in rows}
    assert spans and all(texts_of[r.doc_id][r.start : r.start + len(r["name"])] == r["name"] for r in spans)
    assert textprep.redact_pii(docs.limit(0), table, known).count() == 0 and textprep.redact_pii(docs, table.limit(0), known.limit(0)).count() == len(rows)


def brute_pairs(asked, known, bound, q=2):
    def grams(x):
        x = "\x01" * (q - 1) + x + "\x01" * (q - 1)
        return {x[i : i + q] for i in range(len(x) - q + 1)}

    out = {}
    for a in {x for x in asked if x}:
        for b in {x for x in known if x}:
            s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if s >= bound:
                out[a, b] = s
    return out


@pytest.mark.parametrize("bound,q", [(0.7, 2), (0.5, 2), (0.6, 3), (1.0, 2), (0.4, 1)])
def test_similar_names_against_all_pairs(spark, bound, q):
    rng = random.Random(9)
    base = ["haemoglobin", "glucose", "cholesterol", "vitamin d", "vitamin b12", "alt", "ast", "creatinine", "urea", "глюкоза", "a", "aa", "aaaaaaaa", "aaaa"]
    known = base + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(120)] + [None, "", "alt"]

    def slip(x):
        k = rng.randrange(len(x) + 1)
        return rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abcdeé") + x[k:], x[:k] + rng.choice("xyz") + x[k + 1 :]])

    asked = [slip(x) for x in known if x for _ in range(2)] + [None, "", "alt"]
    got = similar_names(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in known], "other string"), bound, q).collect()
    want = brute_pairs(asked, known, bound, q)
    assert len(got) == len(want) > 0 and {(r["name"], r.other): r.similarity for r in got} == want


def test_codes_of_misspelt_names(spark):
    loinc = spark.createDataFrame([("haemoglobin", "718-7"), ("glucose", "2345-7"), ("vitamin b1", "1"), ("vitamin b2", "2"), ("cholesterol", "2093-3"), ("kolesterol", "2093-3")], schemas.LOINC_DICT)
    rows = ["Haemoglobin ", "hemoglobin", "Glucosse", "vitamin b", "cholesterl", "something else", "", None, "hemoglobin"]
    markers = spark.createDataFrame([(f"t{k}", k, n, "1", None) for k, n in enumerate(rows)], "test_id string, pos int, name string, value string, flag string")
    got = {r.pos: (r.loinc_code, r.loinc_match) for r in verify.loinc_map(markers, loinc).collect()}
    none = (None, "none")
    assert got == {0: ("718-7", "exact"), 1: ("718-7", "similar"), 2: ("2345-7", "similar"), 3: (None, "ambiguous"), 4: ("2093-3", "similar"), 5: none, 6: none, 7: none, 8: ("718-7", "similar")}
    assert {r.pos for r in verify.needs_review(verify.loinc_map(markers, loinc)).where("NOT needs_review").collect()} == {0, 1, 2, 4, 8}
    exact = {r.pos: r.loinc_match for r in verify.loinc_map(markers, loinc, bound=None).collect()}
    assert exact[0] == "exact" and {v for k, v in exact.items() if k} == {"none"}
    assert verify.loinc_map(markers, loinc.limit(0)).where("loinc_match = 'none'").count() == len(rows) and verify.loinc_map(markers.limit(0), loinc).count() == 0


def test_one_answer_of_several(spark):
    """A retry that worked replaces the failure; a document is one row."""
    body = lambda name: '{"choices":[{"message":{"content":"{\\"markers\\":[{\\"name\\":\\"%s\\",\\"value\\":\\"1\\"}]}"}}]}' % name
    rows = [("r1", "d", 429, None), ("r2", "d", 200, body("a")), ("r3", "d", 500, None), ("r1", "e", 200, body("b")), ("r2", "e", 200, body("c")), ("r1", "f", 500, None), ("r2", "f", 401, None)]
    docs = spark.createDataFrame([("d", "D"), ("e", "E"), ("f", "F"), ("g", "G")], "doc_id string, text string")
    got = {r.doc_id: r for r in extract.extraction_outcome(docs, extract.parse_markers(spark.createDataFrame(rows, schemas.LLM_RESPONSES))).collect()}
    assert len(got) == 4 and [m.name for k in "def" for m in got[k].markers] == ["a", "c"]
    assert got["d"].error_text is None and got["f"].error_text.startswith("401") and got["g"].error_text.startswith("Invalid")


def test_scan_to_request(spark):
    """What leaves has no name of the owner, and a header stands before the line that it was merged with."""
    lines = [("d", 0, 0, 0, "Glucose:", 0.9), ("d", 0, 1, 0, "5.2", 0.9), ("d", 0, 1, 1, "9.9", 0.5), ("d", 1, 0, 0, "Patient: LEE, Ann 12 January 2020", 0.9), ("x", 0, 0, 0, "no owner", 0.9)]
    candidates = spark.createDataFrame(lines, schemas.OCR_CANDIDATES)
    owners = spark.createDataFrame([("d", 1)], "doc_id string, user_id long")
    docs, requests = workflow.scan_requests(candidates, owners, spark.createDataFrame([(1, "Ann Lee")], "user_id long, full_name string"))
    assert [r.text for r in docs.collect()] == ["--- Page 1 --- Glucose: 5.2\n--- Page 2 --- Patient: LEE, Ann 12 January 2020"]
    sent = requests.collect()
    assert len(sent) == 1 and "Patient: [NAME] 12 January 2020" in sent[0].payload and "Glucose: 5.2" in sent[0].payload
