"""The filter audit against every document going through every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from medloom.llm import filter_audit
from medloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, part string, mask int, `a.b` string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """{(part, order, step): counts} with one dict for each document and order."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    out, shapley = defaultdict(Counter), Counter()
    for i, text, source in rows:
        part, text = source or "", text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i,
        }
        for order in map("".join, permutations("ABCDE")):
            alive = True
            for step, f in enumerate(order, 1):
                here = alive and fails[f]
                got = out[part, order, step]
                got.update(kept=alive and not fails[f], removed=here, redundant=fails[f] and not alive, unique_fails=fails[f] and sum(fails.values()) == 1)
                got.update(good_lost=here and i in good, toxic_lost=here and i in toxic)
                shapley[part, f] += here
                alive = alive and not fails[f]
    return {key: (*(v[c] for c in filter_audit.COUNTS), shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def documents():
    rng = random.Random(6)
    vocab = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(90):
        text = " ".join(rng.choice(vocab[: rng.choice([20, 400])]) for _ in range(rng.choice([3, 150, 250])))
        text = text.upper() if k % 9 == 0 else text
        rows.append((k, text + rng.choice(["", "", " 100%", "\n|"]), ["web", "books", None, ""][k % 4]))
    rows += [(100 + k, rows[5][1], ["web", "books"][k % 2]) for k in range(50)]
    rows += [rows[7], rows[7], (200, None, "web"), (201, "", "only"), (None, rows[5][1], "web"), (None, None, None), (None, "alone", "web"), (7, "other text of the same id", "web")]
    return rows + [(300, "x" * 50000, "web"), (301, "a B " * 20000, "web"), (302, "Aé" * 10, "ß")]


LABELS = [(k, k % 2, k % 5 == 0) for k in range(0, 100, 3)] + [(5, 1, 1), (6, None, None), (None, 1, 1), (120, 1, 1), (6, 1, 0), (6, 0, 0), (999, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, "clash", 9, "d") for r in documents()], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in LABELS], "doc_id long, quality int, toxic int")
    return docs, labels


def test_against_every_document(tables):
    got = filter_audit.audit(*tables).collect()
    want = brute(documents(), [(d, q, t) for d, q, t in LABELS if d is not None])
    assert len(got) == len(want) == 600 * 5
    assert {(r.part, r.filter_order, r.step): (*(r[c] for c in filter_audit.COUNTS), r.shapley) for r in got} == want


def test_cells_hold_every_document(spark, tables):
    cells = filter_audit.failure_cells(Scratch(spark, "t"), *tables, "doc_id", "text", "source").collect()
    assert sum(r.n for r in cells) == len(documents()) and len({(r.part, r.mask, r.good, r.toxic) for r in cells}) == len(cells)


def test_shapley_adds_up(tables):
    """Over all orders each document that fails something is removed once an order."""
    got = filter_audit.audit(*tables).collect()
    for part in {r.part for r in got}:
        own = [r for r in got if r.part == part]
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in own}.values()) == sum(r.removed for r in own)
        assert len({r.kept for r in own if r.step == 5}) == 1


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    one = filter_audit.audit(docs.where("doc_id = 302"), labels.limit(0)).collect()
    assert len(one) == 600 and all(r.part == "ß" and r.good_lost == r.toxic_lost == 0 for r in one)
