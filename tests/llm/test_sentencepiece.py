"""The score-ordered agenda against the sentencepiece library."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece

from medloom.llm import catalog, sentencepiece_bpe
from medloom.llm.sentencepiece_bpe import Mismatch, PieceCodec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded string, `a.b` string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as file:
        return PieceCodec(file.read())


def texts():
    rng = random.Random(3)
    alphabet = "abcdefgh  \n\t.,▁éßñ中文字кириллица🙂́﻿\xa0\0<s></s>0123456789"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    out += ["", " ", "  ", "▁", "▁▁ a", " a", "a ", "the  the   the", "<s> </s> <unk> <0x41>", "\n", "🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, " " * 1000, "Hello world " * 50]
    return [*out, "中" * 500, "don't stop. " * 20, "▁x", "é" * 300]


def test_ids_and_texts(codec, library):
    for text in texts():
        ids = codec.encode(text)
        assert list(ids) == library.encode(text, add_bos=True, add_eos=True), text
        assert codec.decode(ids) == library.decode(list(ids)), text


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(5)
    byte_ids = sorted(codec.is_byte)
    for _ in range(500):
        ids = [rng.choice(byte_ids) if rng.random() < 0.5 else rng.randrange(1, 32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_stretches_do_not_touch(codec):
    """A text cut into stretches has the ids of the agenda over the whole text."""
    for text in texts():
        whole = PieceCodec._marked(text)
        if whole:
            assert codec.merged(whole) == codec.merged_short(whole) == list(codec.encode(text))[1:-1]


def test_forgotten_stretches_are_worked_out_anew(library):
    with open(MODEL, "rb") as file:
        small = PieceCodec(file.read(), max_stretches=3)
    for text in texts()[:60]:
        assert list(small.encode(text)) == library.encode(text, add_bos=True, add_eos=True)
    assert len(small.stretches) == 3


def test_long_texts(codec, library, monkeypatch):
    """A text of 10 MB, cut at stretches, and one of 200,000 characters that has no place to cut."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(1_800_000))
    assert len(long) > 9_000_000 and len(list(codec._spans(long.replace(" ", "▁")))) > 5
    ids = codec.encode(long)
    assert ids == array("I", library.encode(long, add_bos=True, add_eos=True)) and codec.decode(ids) == long
    run = "".join(rng.choice("ab") for _ in range(200_000))
    assert list(codec.encode(run)) == library.encode(run, add_bos=True, add_eos=True)


def test_encode_table(spark, library):
    rows = [(k, t, "clash", "clash", "d") for k, t in enumerate([*texts(), None])] + [(None, "no id", None, None, None), (3, "again", None, None, None), (3, "again", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sentencepiece_bpe.encode(docs, MODEL, decoded_col="decoded")
    assert got.columns == ["doc_id", "text", "a.b", "ids", "decoded"] and got.count() == len(rows)
    for r in got.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == array("I", ids).tobytes() and r.decoded == library.decode(ids)
    back = sentencepiece_bpe.decode(got.drop("text"), MODEL).collect()
    assert all(r.text == r.decoded for r in back)
    empty = spark.createDataFrame([], SCHEMA)
    assert sentencepiece_bpe.encode(empty, MODEL).count() == 0 and sentencepiece_bpe.decode(sentencepiece_bpe.encode(empty, MODEL), MODEL).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert [(r.doc_id, r.text) for r in sentencepiece_bpe.decode(nothing, MODEL).orderBy("doc_id").collect()] == [(1, None), (2, "")]


def test_a_difference_is_not_kept(codec):
    ids = [codec.encode("some text"), codec.encode("another")]
    codec.check(["some text", "another"], ids, ["some text", "another"])
    ids[1][1] += 1
    with pytest.raises(Mismatch):
        codec.check(["some text", "another"], ids)
    with pytest.raises(Mismatch):
        codec.check(["some text"], ids[:1], ["some texts"])
    with open(MODEL, "rb") as file:
        wrong = PieceCodec(file.read())
    wrong.encode("a  few words ▁ \n  ")
    wrong.check_new()
    assert wrong.stretches.new == []
    wrong.scores = {piece: score for piece, score in wrong.scores.items() if len(piece) <= 2}
    wrong.encode("words worth")
    with pytest.raises(Mismatch):
        wrong.check_new()


def test_query(spark, library, tmp_path):
    rows = [(k, t) for k, t in enumerate([*texts()[:40], None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op12_sentencepiece(spark, str(tmp_path), MODEL).collect()}
    for k, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want
