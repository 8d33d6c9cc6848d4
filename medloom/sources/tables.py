"""Readers and writers with explicit schemas; nothing is inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom import schemas
from medloom.operators.ingest import page_texts
from medloom.operators.store import Store


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Parquet, JSON lines, CSV or ORC files as a table of the given schema."""
    reader = spark.read.schema(schema)
    return (reader.option("header", "true") if fmt == "csv" else reader).format(fmt).load(path)


def read_ocr_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page texts with their index; a page that failed has an empty text."""
    return page_texts(read_table(spark, path, schemas.OCR_PAGES, fmt))


def read_llm_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Response bodies with their HTTP status."""
    return read_table(spark, path, schemas.LLM_RESPONSES, fmt)


def read_saved(spark: SparkSession, path: str, table: str, years: list[int] | None = None) -> DataFrame:
    """``lab_tests`` or ``lab_markers`` below ``path`` as of the last change, with their year; of some years only if given."""
    schema = schemas.LAB_TESTS if table == "lab_tests" else schemas.LAB_MARKERS
    saved = Store(spark, path)
    saved.complete()
    df = saved.read(table, schema, years)
    return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])) if df is None else df


def write_requests(requests: DataFrame, path: str, fmt: str = "parquet") -> None:
    requests.write.mode("append").format(fmt).save(path)


def landing(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one for a session on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='medloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``df`` that the schema names, in its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns])
