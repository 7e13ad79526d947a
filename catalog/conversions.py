"""Conversion requests from triage to results, over given converter outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.plans.convert import convert_results

QUERIES = {}
ORACLE = {}

# A request per event: tools in turn, some with a bad dpi, some for a file that is not
# there. The helper ran for even workbook requests; conversations are the page images.
_TOOL = """CASE event_id % 3 WHEN 0 THEN 'convert_excel_to_images' WHEN 1 THEN 'convert_word_to_images'
  ELSE 'convert_pdf_to_images' END"""
_FILE = "concat('/in/', user_id, CASE event_id % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' ELSE '.pdf' END)"
_KEEP = "event_id % 4 = 1"
_HELPED = "event_id % 3 = 0 AND event_id % 2 = 0"


def _inputs(spark, sf_dir):
    events = si.table(spark, sf_dir, "events")
    requests = events.selectExpr(
        "event_id AS request_id",
        f"{_TOOL} AS tool",
        f"{_FILE} AS file_path",
        "CASE event_id % 11 WHEN 5 THEN 71.0 WHEN 6 THEN 300.0 END AS dpi",
        f"CASE WHEN {_KEEP} THEN true END AS keep_pdf",
        "cast(NULL AS string) AS format",
        "cast(NULL AS string) AS output_mode",
    )
    names = F.explode(F.array(*[F.lit(x) for x in (".xlsx", ".docx", ".pdf")]))
    documents = si.table(spark, sf_dir, "documents").select("doc_id", names.alias("x"))
    files = documents.select(F.concat(F.lit("/in/"), "doc_id", "x").alias("path"))
    converted = events.where("event_id % 3 < 2").selectExpr(
        "event_id AS request_id",
        "concat('/tmp/', event_id, '.pdf') AS pdf_path",
        f"""CASE WHEN {_HELPED} THEN CASE event_id % 5 WHEN 1 THEN concat('no json ', event_id)
            WHEN 2 THEN '{{"ok":false,"error":{{"code":"UNO","message":"failed"}}}}'
            WHEN 3 THEN '{{"ok":true}}'
            ELSE concat('{{"ok":true,"pdfPath":"/uno/', event_id, '.pdf"}}') END END AS stdout""",
        "event_type AS stderr",
        "cast(event_id % 2 AS int) AS exit_code",
    )
    images = events.join(
        si.table(spark, sf_dir, "conversations").select("conv_id", "turn"), F.col("user_id") == F.col("conv_id")
    ).selectExpr("event_id AS request_id", "concat('/img/', event_id, '/page-', lpad(turn + 1, 3, '0'), '.png') AS image_path")
    return requests, files, converted, images


_SQL = f"""WITH listed AS (
  SELECT event_id, count(*) AS page_count, string_agg('"/img/' || event_id || '/page-' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0')
         || '.png"', ',' ORDER BY turn) AS images
  FROM events JOIN conversations ON user_id = conv_id GROUP BY event_id),
judged AS (
  SELECT e.event_id, e.event_id % 3 AS tool, page_count, images,
         CASE WHEN {_KEEP.replace("event_id", "e.event_id")} AND e.event_id % 3 < 2 THEN
           CASE WHEN {_HELPED.replace("event_id", "e.event_id")} AND e.event_id % 5 NOT IN (1, 2, 3)
                THEN '/uno/' ELSE '/tmp/' END || e.event_id || '.pdf' END AS pdf_path,
         CASE WHEN e.event_id % 3 = 0 THEN CASE WHEN e.event_id % 2 = 0 THEN 'libreoffice-uno-print-area'
              ELSE 'libreoffice-cli' END END AS strategy,
         CASE WHEN e.event_id % 11 = 5 THEN 'INVALID_TOOL_INPUT'
              WHEN user_id NOT IN (SELECT doc_id FROM documents) THEN 'FILE_NOT_FOUND'
              WHEN {_HELPED.replace("event_id", "e.event_id")} AND e.event_id % 5 IN (1, 2) THEN 'LIBREOFFICE_UNO_CONVERSION_FAILED'
              WHEN page_count IS NULL THEN 'PDF_RENDER_FAILED' END AS error_code
  FROM events e LEFT JOIN listed l ON l.event_id = e.event_id)"""
_RESULT = """SELECT event_id AS request_id, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
  '{{"sourceType":"' || CASE tool WHEN 0 THEN 'excel' WHEN 1 THEN 'word' ELSE 'pdf' END || '"'
  || CASE WHEN pdf_path IS NOT NULL THEN ',"pdfPath":"' || pdf_path || '"' ELSE '' END
  || ',"images":[' || images || '],"pageCount":' || page_count
  || CASE WHEN strategy IS NOT NULL THEN ',"renderStrategy":"' || strategy || '"' ELSE '' END || '}}' AS text
FROM judged WHERE error_code IS NULL AND tool = {}"""


def _of(number, tool):
    def query(spark, sf_dir):
        requests, *given = _inputs(spark, sf_dir)
        results, _ = convert_results(requests.where(F.col("tool") == tool), *given)
        return results.select("request_id", "part_no", "part_count", "text")

    QUERIES[tool] = query
    ORACLE[tool] = f"{_SQL} {_RESULT.format(number)}"


for _number, _name in enumerate(("convert_excel_to_images", "convert_word_to_images", "convert_pdf_to_images")):
    _of(_number, _name)


def convert_errors(spark, sf_dir):
    _, errors = convert_results(*_inputs(spark, sf_dir))
    return errors.select("key", F.col("error.code").alias("error_code"))


QUERIES["convert_errors"] = convert_errors
ORACLE["convert_errors"] = (
    f"{_SQL} SELECT CAST(event_id AS VARCHAR) AS key, error_code FROM judged WHERE error_code IS NOT NULL"
)
