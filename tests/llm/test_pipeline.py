"""The pipeline, stage by stage, against what plain Python makes of each stage's own input."""

import os
import re
from collections import Counter

import corpus_pipeline
from medloom.llm import bpe, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, inputs, outputs = documents, [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == documents.columns
        outputs.append(docs.collect())
    assert {r.doc_id for r in outputs[0]} == {r.doc_id for r in inputs[0]}  # clean prose stays

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in inputs[1]:
        best[norm(r.text)] = min(best.get(norm(r.text), (1, 0)), (-len(r.text), r.doc_id))
    assert Counter(r.doc_id for r in outputs[1]) == Counter(i for _, i in best.values())

    prints, kept, seen = {r.doc_id: simhash.fingerprint(r.text, 5) for r in inputs[2]}, set(), set()
    for i in sorted(prints):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [j for j in prints if j not in seen and (prints[j] ^ prints[x]).bit_count() <= simhash.NEAR_RADIUS]
    assert Counter(r.doc_id for r in outputs[2]) == Counter(kept)

    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect() if r.copies}
    assert Counter(r.doc_id for r in outputs[3]) == Counter(copies)

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(theirs.encode_ordinary(r.text))) for r in inputs[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in outputs[4]) == want


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def folders(marks):
    return [f.removeprefix("file://") for m in marks for f in corpus_pipeline._left.get(m, [])]


def test_stages_chained_and_mixed(spark, tmp_path):
    """Without a write between stages nothing is deleted under them; two runs in one session leave each other alone; what a written result was read from goes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    stages = [stage for _, stage in corpus_pipeline.STAGES[:3]]
    marks = lambda df: [f.metadata[corpus_pipeline.MARK] for f in df.schema.fields if corpus_pipeline.MARK in f.metadata]
    chained = docs
    for stage in stages:
        chained = stage(spark, chained, SF)
    want = rows_of(chained)
    assert sum(want.values()) > 0

    first = {k: stages[0](spark, docs, SF) for k in "ab"}
    held = {k: folders(marks(df)) for k, df in first.items()}
    assert held["a"] and held["b"] and all(os.path.isdir(f) for f in held["a"] + held["b"])
    first["a"].write.parquet(f"{tmp_path}/a")
    second = stages[1](spark, spark.read.parquet(f"{tmp_path}/a"), SF)
    assert not any(os.path.isdir(f) for f in held["a"]) and all(os.path.isdir(f) for f in held["b"])
    first["b"].write.parquet(f"{tmp_path}/b")
    third = stages[2](spark, second, SF)
    assert rows_of(third) == want
    assert rows_of(stages[2](spark, stages[1](spark, spark.read.parquet(f"{tmp_path}/b"), SF), SF)) == want
