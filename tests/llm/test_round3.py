"""Rows that repeat, hosts that share a document, shards against a plain version, texts of 10 MB."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from medloom.llm import quality_rules, sharding


def test_one_document_on_two_hosts(spark):
    """The boilerplate of each host is taken from its own copy only."""
    own = " ".join(f"w{k}" for k in range(8))
    text = f"line of host a with six\nline of host b with six\n{own}"
    rows = [(7, text, "a"), (7, text, "b"), (7, text, "a")]
    rows += [(100 + k, f"line of host a with six\n{' '.join(f'x{k}y{j}' for j in range(20))}", "a") for k in range(5)]
    rows += [(200 + k, f"line of host b with six\n{' '.join(f'x{k}z{j}' for j in range(20))}", "b") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in quality_rules.quality_rules(df, max_line_docs=4).collect() if r.doc_id == 7]
    assert len(got) == 3 and {(r.n_words, r.n_left_words, r.kept) for r in got} == {(20, 14, True)}
    cleaned = {(r.source, r.text) for r in quality_rules.cleaned_documents(df, max_line_docs=4).where("doc_id = 7").collect()}
    assert cleaned == {("a", f"line of host b with six\n{own}"), ("b", f"line of host a with six\n{own}")}


def law_holds(rows, n_shards, tolerance=sharding.TOLERANCE):
    """Shards as cuts of the rows in the order of their keys, each as near to its target as the tolerance or one row allows."""
    total, largest = sum(r.size for r in rows), max((r.size for r in rows), default=0)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.group, -(2**63) if r.doc_id is None else r.doc_id) for r in order]
    assert keys == sorted(keys)
    slots = defaultdict(list)
    upto = Counter()
    for r in order:
        slots[r.shard].append(r.slot)
        upto[r.shard] += r.size
    assert all(s == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n_shards))
    below = 0
    for k in range(n_shards - 1):
        below += upto[k]
        assert abs(below - total * (k + 1) / n_shards) <= max(tolerance * total / n_shards, largest), k
    return upto


@pytest.mark.parametrize("kind", ["repeats", "nulls", "one_text", "all_same", "distinct", "few", "wide"])
def test_shards_by_bytes(spark, kind):
    rng = random.Random(3)
    wide = lambda: rng.randrange(-(2**62), 2**62)
    many = {
        "repeats": [(5, 77, 10) if k % 3 == 0 else (k, wide(), 10) for k in range(3000)],
        "nulls": [(None, 77, 9) if k % 3 == 0 else (k, wide(), rng.randint(1, 20)) for k in range(3000)],
        "one_text": [(k, 77, 10) if k % 2 else (k, wide(), rng.randint(1, 50)) for k in range(3000)],
        "all_same": [(1, 1, 7)] * 900, "distinct": [(k, wide(), rng.randint(1, 2000)) for k in range(2000)],
        "few": [(k, k, 5) for k in range(5)], "wide": [(k, rng.choice([-(2**63), 2**63 - 1, 0, -1]), 3) for k in range(1000)],
    }[kind]
    df = spark.createDataFrame(many, "doc_id long, group long, size long").repartition(4)
    got = sharding.shard(df, 8).collect()
    assert Counter((r.doc_id, r.group, r["size"]) for r in got) == Counter(many)
    law_holds([type("R", (), {**r.asDict()}) for r in got], 8)
    again = sharding.shard(df.repartition(3), 8).select("doc_id", "group", "shard", "slot").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r.group, r.shard, r.slot) for r in got)


def test_equal_texts_lie_together(spark):
    """But for groups that a splitter has to cut."""
    rng = random.Random(6)
    rows = [(k, rng.randrange(400), rng.randint(1, 30)) for k in range(4000)]
    shards = defaultdict(set)
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, group long, size long"), 8).collect():
        shards[r.group].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


@pytest.mark.parametrize("shards,parts", [(1, 1), (3, 5), (40, 1)])
def test_numbers_of_shards_and_parts(spark, shards, parts):
    rng = random.Random(8)
    rows = [(k if k % 5 else 0, rng.randrange(300), rng.randint(1, 9)) for k in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, group long, size long"), shards, parts=parts).collect()
    upto = law_holds([type("R", (), {**r.asDict()}) for r in got], shards)
    assert len(upto) == shards


def test_shard_columns_of_any_name(spark):
    rows = [(k, "same" if k % 4 == 0 else f"text {k}", "x", 1, 2.5) for k in range(60)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, user string, _at int, `a.b` double")
    out = sharding.shard_documents(df, 4)
    assert out.columns == ["doc_id", "text", "user", "_at", "a.b", "size", "group", "shard", "slot"]
    assert Counter(map(tuple, out.select(*[F.col(f"`{c}`") for c in df.columns]).collect())) == Counter(rows)
    assert sharding.shard_documents(df.limit(0)).count() == 0
