"""Row-wise operators on files as they arrive give what the batch gives."""

import json

from pyspark.sql import functions as F

from medloom import schemas
from medloom.functions.text import normalize_ocr
from medloom.operators.textprep import redact
from medloom.sources.tables import read_llm_responses, read_ocr_pages, write_requests
from medloom.streaming.rowwise import append_to, stream_page_texts, stream_responses


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, 0, "Glucose:\n5.2", True), ("d", 1, 1, None, True)], schemas.OCR_PAGES)
    pages.write.parquet(f"{tmp_path}/pages")
    append_to(stream_page_texts(spark, f"{tmp_path}/pages"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    batch = read_ocr_pages(spark, f"{tmp_path}/pages").select(redact(normalize_ocr(F.col("text"))).alias("text"))
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r.text for r in batch.collect()) == ["", "Glucose: 5.2"]
    body = json.dumps({"choices": [{"message": {"content": '{"markers":[{"name":"a","value":"1"}]}'}}]})
    write_requests(spark.createDataFrame([("r", "d", 200, body)], schemas.LLM_RESPONSES), f"{tmp_path}/responses")
    assert read_llm_responses(spark, f"{tmp_path}/responses").count() == 1
    append_to(stream_responses(spark, f"{tmp_path}/responses"), f"{tmp_path}/decoded", f"{tmp_path}/at2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/decoded").first().markers[0].name == "a"
