"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the token ids of each document.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import bpe, exact_dedup, language_id, mixing, simhash
from medloom.llm.common import Scratch, release, scratch_folders


#: Folders of intermediate tables that the result of a stage reads, by the mark on that result.
_left: dict[str, list[str]] = {}
#: Key of the mark in the metadata of the first column, which Parquet files keep.
MARK = "medloom.stage"


def _stage(work):
    """A stage whose result is marked.

    A stage that begins on a written copy of a marked result deletes what that result was
    read from; on the result itself, or on one of another run, it deletes nothing. So
    stages can be chained without a write between, and runs in one session do not meet.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = next((f.metadata[MARK] for f in docs.schema.fields if MARK in f.metadata), None)
        folders = _left.get(before, [])
        if folders and not any(folder in file for file in docs.inputFiles() for folder in folders):
            release(spark, _left.pop(before))
        with scratch_folders() as made:
            out = work(spark, docs, sf_dir)
        mark, first = uuid.uuid4().hex, out.schema.fields[0]
        _left[mark] = made
        return out.withMetadata(first.name, {**first.metadata, MARK: mark})

    return run_stage


@_stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; others go."""
    return language_id.keep_known_languages(docs)


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near SimHash fingerprints."""
    return simhash.near_dedup(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


@_stage
def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, drop_text=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_documents),
]

#: Three stages (a fitted classifier, thresholds of rounding, BPE) are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written and read again, and deleted once the next one's is written."""
    scratch, docs, kept = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            scratch.drop(*kept)
            kept = [docs]
    return docs
