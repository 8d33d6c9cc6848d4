"""What is learnt from labelled documents: against plain versions and on documents that were not learnt from."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medloom import schemas
from medloom.operators import learned, profile
from medloom.sources.standin import StandIn

SF = "/root/testdata/sf0.001"


def grams(text):
    flat = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip(" ") + " "
    return [flat[k : k + 3] for k in range(len(flat) - 2)] if text is not None else []


def ranked(counts, size):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size], 1)}


def test_profiles_against_a_plain_version(spark):
    texts = [("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the dog and the cat", "en"), ("the end", "en"), ("nothing known", None), (None, "en"), ("", "fr")]
    profiles = learned.language_profiles(spark.createDataFrame(texts, "text string, lang string"), 20)
    want = {lang: ranked(Counter(g for t, x in texts if x == lang for g in grams(t)), 20) for lang in ("de", "fr", "en")}
    assert {(r.lang, r.gram): r["rank"] for r in profiles.collect()} == {(lang, g): k for lang, p in want.items() for g, k in p.items()}
    asked = [("a", "the cat and the dog"), ("b", "die katze"), ("c", "12345"), ("d", None), ("e", ""), ("f", "x"), ("g", "Le CHIEN!")]
    near = lambda t, lang: sum(20 - abs(k - want[lang][g]) for g, k in ranked(Counter(grams(t)), 20).items() if g in want[lang])
    got = {r.doc_id: r.language for r in learned.profile_languages(spark.createDataFrame(asked, "doc_id string, text string"), profiles, 20).collect()}
    for doc, text in asked:
        known = {lang: near(text, lang) for lang in want if set(grams(text)) & set(want[lang])}
        assert got[doc] == (min(known, key=lambda x: (-known[x], x)) if known else "und"), doc
    assert got["a"] == "en" and got["b"] == "de" and got["g"] == "fr" and got["c"] == got["d"] == got["e"] == "und"


def test_texts_are_judged_where_they_are(spark):
    """No trigram of a text is a row; those of rows that share an id are counted together."""
    texts = [("der hund und die katze", "de"), ("the dog and the cat 𝒶𝒷𝒸", "en")]
    profiles = learned.language_profiles(spark.createDataFrame(texts, "text string, lang string"), 20)
    asked = [("a", "the cat"), ("a", "und die katze der hund"), ("b", None), ("b", "the dog"), ("c", None), ("c", None), ("d", "𝒶𝒷𝒸"), (None, "the dog"), (None, "hund")]
    docs = spark.createDataFrame(asked, "doc_id string, text string")
    got = sorted(map(tuple, learned.profile_languages(docs, profiles, 20).collect()), key=str)
    assert got == [("a", "de"), ("b", "en"), ("c", "und"), ("d", "en"), (None, "und")]
    single = learned.profile_languages(docs.where("text LIKE 'the dog'"), profiles, 20)
    assert "Generate" not in single._jdf.queryExecution().executedPlan().toString()


def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''")
    profiles = learned.language_profiles(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    got = learned.profile_languages(rest, profiles).join(rest.select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).first()
    assert right.n > 400 and right.share > 0.97, right


def test_gate_against_a_plain_version(spark):
    texts = [("blood glucose high", True), ("blood test", True), ("invoice of march", False), ("the blood test invoice", None), ("march weather", False), (None, False), ("Blood", True)]
    rows = spark.createDataFrame(texts, "text string, is_target boolean")
    got = {r.term: r.weight for r in learned.term_weights(rows, size=5, min_docs=1, min_z=0.5).collect()}
    sets = [(set((t or "").lower().split()), y) for t, y in texts if y is not None]
    n1, n0 = sum(y for _, y in sets), sum(not y for _, y in sets)
    weight = lambda w: math.log((sum(w in s for s, y in sets if y) + 0.5) / (n1 + 1)) - math.log((sum(w in s for s, y in sets if not y) + 0.5) / (n0 + 1))
    error = lambda w: math.sqrt(1 / (sum(w in s for s, y in sets if y) + 0.5) + 1 / (sum(w in s for s, y in sets if not y) + 0.5))
    z = {w: round(abs(weight(w) / error(w)), 9) for s, _ in sets for w in s}
    words = sorted((w for w in z if z[w] >= 0.5), key=lambda w: (-z[w], w))[:5]
    assert set(got) == set(words) and all(got[w] == pytest.approx(weight(w)) for w in words)
    asked = spark.createDataFrame([("a", "blood blood"), ("b", "march"), ("c", "unknown"), ("d", None)], "doc_id string, text string")
    out = {r.doc_id: (r.n_terms, r.is_medical) for r in learned.weighted_gate(asked, learned.term_weights(rows, 5, 1, min_z=0.5)).collect()}
    assert out == {"a": (1, True), "b": (1, False), "c": (0, False), "d": (0, False)}
    assert learned.term_weights(rows.limit(0)).count() == 0


def test_gate_on_unseen_documents(spark):
    """Precision and recall on reports that were not learnt from, each with one line of a result."""
    docs = StandIn(spark, "/root/testdata/sf0.01").reports.withColumn("half", F.xxhash64("doc_id") % 2 == 0)
    weights = learned.term_weights(docs.where("half"))
    rest = docs.where("NOT half")
    got = learned.weighted_gate(rest, weights, threshold=0.0).join(rest.select("doc_id", "is_target"), "doc_id").groupBy("is_target", "is_medical").count().collect()
    n = {(r.is_target, r.is_medical): r["count"] for r in got}
    precision, recall = n[True, True] / (n[True, True] + n.get((False, True), 0)), n[True, True] / (n[True, True] + n.get((True, False), 0))
    assert precision > 0.9 and recall > 0.8, (precision, recall)


def test_stored_upsert(spark):
    s = StandIn(spark, SF)
    edits = s.profile_edits.withColumn("change_no", F.lit(1))
    later = edits.where("user_id % 2 = 0").withColumns({"full_name": F.lit("A later name"), "height_text": F.lit(None).cast("string"), "change_no": F.lit(2)})
    both = later.unionByName(edits).unionByName(edits.limit(1).withColumn("user_id", F.lit(None).cast("long")))
    profile.store_profiles(s.profiles, "stored_profiles", 4)
    try:
        conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merged = profile.stored_upsert(spark, "stored_profiles", both, 4)
        rows = sorted(map(tuple, merged.collect()))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        stored = plan[: plan.index("stored_profiles")].splitlines()
        # Between the join and the scan of the stored table there is no exchange.
        join = max(k for k, line in enumerate(stored) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in stored[join:])
        assert rows == sorted(map(tuple, profile.profile_upsert(s.profiles, both).collect()))
        named = {r[0]: r[1] for r in rows}
        assert all(named[r.user_id] == "A later name" for r in later.collect()) and len(rows) == len(named)
    finally:
        spark.sql("DROP TABLE IF EXISTS stored_profiles")


def test_last_edit_by_number(spark):
    columns = "user_id long, full_name string, birth_date timestamp, gender string, blood_type string, height_text string, weight_text string, language string"
    rows = [(1, "Zoe", None, None, None, "1", "1", None), (1, "Ann", None, None, None, None, "2", None)]
    edits = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], columns + ", change_no int")
    old = spark.createDataFrame([], schemas.PROFILES)
    assert [(r.full_name, r.height) for r in profile.profile_upsert(old, edits).collect()] == [("Ann", None)]
    assert [r.full_name for r in profile.profile_upsert(old, edits.drop("change_no")).collect()] == ["Zoe"]
