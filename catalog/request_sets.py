"""Queries on requests, errors and result shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.operators import requests as rq
from docspark.operators import results as rs
from docspark.session import work_folder
from docspark.streaming.triage import stream_triage

QUERIES = {}
ORACLE = {}


def _query(name, sql):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return keep


_REQUESTS = f"WITH {si.REQUESTS_SQL}"
_FIELDS = "dpi, keep_pdf, format, output_mode, merge_pages, preserve_page_headings, output_dir"


@_query(
    "apply_defaults",
    f"{_REQUESTS} SELECT request_id, tool, {_FIELDS}, sheet_names FROM defaulted",
)
def apply_defaults(spark, sf_dir):
    return rq.apply_defaults(si.requests(spark, sf_dir)).select(
        "request_id", "tool", *_FIELDS.split(", "), F.array_join("sheet_names", ",").alias("sheet_names")
    )


@_query(
    "validate_requests",
    f"""{_REQUESTS} SELECT request_id, dpi, format, output_mode, input_message AS error_message,
    CASE WHEN input_message IS NOT NULL THEN 'INVALID_TOOL_INPUT' END AS error_code FROM validated""",
)
def validate_requests(spark, sf_dir):
    return si.flat_error(
        rq.validate_requests(si.requests(spark, sf_dir)), "request_id", "dpi", "format", "output_mode"
    ).drop("error_context")


@_query(
    "check_exists",
    f"""{_REQUESTS} SELECT request_id, file_path,
    CASE WHEN path IS NULL AND file_path IS NOT NULL THEN 'FILE_NOT_FOUND' END AS error_code,
    CASE WHEN path IS NULL AND file_path IS NOT NULL THEN 'File not found: ' || file_path END AS error_message
    FROM requests_in LEFT JOIN files_in ON path = file_path""",
)
def check_exists(spark, sf_dir):
    checked = rq.check_exists(si.requests(spark, sf_dir), si.known_files(spark, sf_dir))
    return si.flat_error(checked, "request_id", "file_path").drop("error_context")


@_query(
    "missing_files",
    f"""{_REQUESTS} SELECT CAST(request_id AS VARCHAR) AS key, 'FILE_NOT_FOUND' AS error_code,
    'File not found: ' || file_path AS error_message FROM requests_in
    WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT path FROM files_in)""",
)
def missing_files(spark, sf_dir):
    missing = rq.missing_files(si.requests(spark, sf_dir), si.known_files(spark, sf_dir))
    return si.flat_error(missing, "key").drop("error_context")


@_query(
    "triage",
    f"{_REQUESTS} SELECT request_id, tool, file_path, dpi, format, error_code, error_message FROM triage_out",
)
def triage(spark, sf_dir):
    judged = rq.triage(si.requests(spark, sf_dir), si.known_files(spark, sf_dir))
    return si.flat_error(judged, "request_id", "tool", "file_path", "dpi", "format").drop("error_context")


@_query(
    "split_errors",
    f"""{_REQUESTS} SELECT CAST(request_id AS VARCHAR) AS key, error_code, error_message FROM triage_out
    WHERE error_code IS NOT NULL""",
)
def split_errors(spark, sf_dir):
    judged = rq.triage(si.requests(spark, sf_dir), si.known_files(spark, sf_dir))
    _, bad = rq.split_errors(judged, "request_id")
    return si.flat_error(bad, "key").drop("error_context")


@_query(
    "accepted_requests",
    f"{_REQUESTS} SELECT request_id, tool, file_path FROM triage_out WHERE error_code IS NULL",
)
def accepted_requests(spark, sf_dir):
    judged = rq.triage(si.requests(spark, sf_dir), si.known_files(spark, sf_dir))
    good, _ = rq.split_errors(judged, "request_id")
    return good.select("request_id", "tool", "file_path")


@_query(
    "coalesce_pdf_path",
    f"""{_REQUESTS} SELECT request_id,
    CASE WHEN keep_pdf THEN '/tmp/' || request_id || '.pdf' END AS pdf_path FROM defaulted""",
)
def coalesce_pdf_path(spark, sf_dir):
    path = F.concat(F.lit("/tmp/"), F.col("request_id"), F.lit(".pdf"))
    return rq.apply_defaults(si.requests(spark, sf_dir)).select(
        "request_id", rq.coalesce_pdf_path(F.col("keep_pdf"), path).alias("pdf_path")
    )


@_query(
    "stream_triage",
    f"""{_REQUESTS} SELECT request_id, tool, file_path, error_code, error_message,
    CASE WHEN lower(file_path) LIKE '%.xlsx' THEN 'excel' WHEN lower(file_path) LIKE '%.pdf' THEN 'pdf'
         WHEN lower(file_path) LIKE '%.doc%' THEN 'word' END AS category FROM triage_out""",
)
def stream(spark, sf_dir):
    """Requests arrive as files; what the stream wrote is read back."""
    folder = work_folder(spark, "stream")
    si.requests(spark, sf_dir).write.parquet(f"{folder}/in")
    query = stream_triage(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", si.known_files(spark, sf_dir)
    )
    query.awaitTermination()
    judged = spark.read.parquet(f"{folder}/out")
    return si.flat_error(judged, "request_id", "tool", "file_path", "category").drop("error_context")


@_query(
    "parse_helper_results",
    f"""WITH {si.HELPER_SQL} SELECT event_id,
    CASE WHEN case_no IN (0, 1, 9) THEN true END AS ok,
    CASE WHEN case_no = 0 THEN '/tmp/' || event_id || '.pdf' END AS pdf_path,
    CASE WHEN case_no = 0 THEN 'print-area' END AS render_strategy,
    CASE WHEN case_no = 0 THEN user_id END AS sheet_count,
    CASE WHEN case_no NOT IN (0, 1, 9) THEN 'LIBREOFFICE_UNO_CONVERSION_FAILED' END AS error_code,
    CASE WHEN case_no IN (4, 5) THEN 'Python UNO helper returned invalid JSON'
         WHEN case_no = 2 THEN 'failed ' || event_id
         WHEN case_no IN (3, 6, 7, 8) THEN 'Python UNO conversion failed' END AS error_message,
    bad_stdout AS error_stdout, CASE WHEN bad_stdout IS NOT NULL THEN stderr END AS error_stderr,
    CASE WHEN bad_stdout IS NOT NULL THEN CAST(case_no AS VARCHAR) END AS error_exit,
    CASE case_no WHEN 2 THEN 'UNO' WHEN 7 THEN 'ZERO' END AS helper_code FROM helper_in""",
)
def parse_helper_results(spark, sf_dir):
    parsed = rs.parse_helper_results(si.helper_output(spark, sf_dir), "stdout")
    context = F.col("error.context")
    return parsed.select(
        "event_id",
        "result.ok",
        "result.pdf_path",
        "result.render_strategy",
        "result.sheet_count",
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
        context["stdout"].alias("error_stdout"),
        context["stderr"].alias("error_stderr"),
        context["exitCode"].alias("error_exit"),
        context["errorCode"].alias("helper_code"),
    )


@_query(
    "select_format",
    """SELECT doc_id, 'word' AS source_type, CASE doc_id % 2 WHEN 0 THEN 'text' ELSE 'markdown' END AS text_format,
    CASE doc_id % 2 WHEN 0 THEN text ELSE '# ' || text END AS content FROM documents""",
)
def select_format(spark, sf_dir):
    texts = si.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "concat('# ', text) AS markdown",
        "CASE doc_id % 2 WHEN 0 THEN 'text' ELSE 'markdown' END AS wanted",
    )
    return rs.select_format(texts, F.col("wanted")).drop("wanted")


@_query(
    "result_envelope",
    """SELECT doc_id, '{"sourceType":' || to_json(source)::VARCHAR || ',"textFormat":"text","content":'
    || to_json(text)::VARCHAR
    || CASE WHEN doc_id % 2 = 0 THEN ',"pageCount":' || n_chars ELSE '' END || '}' AS text FROM documents""",
)
def result_envelope(spark, sf_dir):
    documents = si.table(spark, sf_dir, "documents").withColumn(
        "page_count", F.expr("CASE WHEN doc_id % 2 = 0 THEN n_chars END")
    )
    fields = {
        "sourceType": "source",
        "textFormat": F.lit("text"),
        "content": "text",
        "pageCount": "page_count",
    }
    return rs.result_envelope(documents, fields, ["doc_id"]).select("doc_id", "text")
