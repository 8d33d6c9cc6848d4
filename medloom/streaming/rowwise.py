"""Row-wise operators on streams of newly captured documents.

The inventory has no stateful stream. These operators see one row at a time, so the same
expressions run on a stream of new page or response files without a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medloom import schemas
from medloom.functions.text import normalize_ocr
from medloom.operators.extract import parse_markers
from medloom.operators.textprep import redact


def stream_responses(spark: SparkSession, path: str) -> DataFrame:
    """Decoded markers of response files as they arrive."""
    return parse_markers(spark.readStream.schema(schemas.LLM_RESPONSES).parquet(path))


def stream_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Pages with their lines merged and contact data redacted, as files arrive."""
    pages = spark.readStream.schema(schemas.OCR_PAGES).parquet(path)
    return pages.withColumn("text", redact(normalize_ocr(F.coalesce("text", F.lit("")))))


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream once up to now, exactly once per input file."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
