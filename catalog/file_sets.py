"""Queries on files: sources, sinks and the plans from files to results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import archives as ar
from catalog import stand_ins as si
from docspark.functions.paths import file_category
from docspark.plans.excel_text import excel_text
from docspark.plans.word_text import word_text
from docspark.plans.workbook_text import workbooks_to_markdown
from docspark.session import work_folder
from docspark.sources.docx import extract_docx
from docspark.sources.files import attachment_rows, scan_files, valid_png
from docspark.sources.sink import write_results
from docspark.sources.workbook import extract_workbook_cells

QUERIES = {}
ORACLE = {}


def _query(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


@_query("list_table_files")
def list_table_files(spark, sf_dir):
    """The tables' own files, sorted by path; no bytes are read."""
    return scan_files(spark, sf_dir, ".parquet").select("path", "length")


@_query(
    "scan_files",
    """SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY lang""",
)
def scan_files_query(spark, sf_dir):
    """Documents written as text files by language, then read back as files."""
    folder = work_folder(spark, "texts")
    (
        si.table(spark, sf_dir, "documents")
        .select("lang", "text")
        .write.option("maxRecordsPerFile", 10_000)
        .partitionBy("lang")
        .text(folder)
    )
    files = scan_files(spark, folder, ".txt", content=True)
    text = F.decode("content", "UTF-8")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        files.select(
            F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"), "length", breaks.alias("breaks")
        )
        .groupBy("lang")
        .agg(F.sum("length").alias("bytes"), F.sum("breaks").cast("bigint").alias("lines"))
    )


@_query(
    "attachment_rows",
    f"""WITH {si.PATHS_SQL} SELECT p.path, 'blob' AS type, base64(encode(d.text)) AS data,
    CASE lower(raw_ext) WHEN '.jpeg' THEN 'image/jpeg' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp'
    ELSE 'image/png' END AS mime_type, name AS display_name
    FROM path_parts p JOIN documents d ON d.doc_id = p.doc_id""",
)
def attachments(spark, sf_dir):
    files = si.table(spark, sf_dir, "documents").selectExpr(
        f"{si.PATH} AS path", "encode(text, 'UTF-8') AS content"
    )
    return attachment_rows(files)


@_query(
    "valid_png",
    """SELECT doc_id, CASE kind WHEN 'png' THEN 4 + strlen(text) WHEN 'text' THEN strlen(text) ELSE 0 END AS length,
    kind = 'png' AS is_png FROM documents, (VALUES ('png'), ('text'), ('empty')) AS k(kind)""",
)
def valid_png_query(spark, sf_dir):
    """Each document as an image, as a text and as an empty file."""
    kinds = F.explode(F.array(F.lit("png"), F.lit("text"), F.lit("empty")))
    files = si.table(spark, sf_dir, "documents").withColumn("kind", kinds).selectExpr(
        "doc_id",
        """CASE kind WHEN 'png' THEN concat(X'89504E47', encode(text, 'UTF-8'))
           WHEN 'text' THEN encode(text, 'UTF-8') ELSE X'' END AS content""",
    )
    files = files.withColumn("length", F.octet_length("content").cast("bigint"))
    return valid_png(files).select("doc_id", "length", "is_png")


@_query(
    "write_results",
    f"""WITH {si.PATHS_SQL} SELECT p.doc_id, d.text AS content,
    CASE WHEN lower(raw_ext) IN ('.xlsx', '.xls', '.xlsm', '.xlsb') THEN 'excel'
         WHEN lower(raw_ext) IN ('.docx', '.doc', '.odt') THEN 'word'
         WHEN lower(raw_ext) = '.pdf' THEN 'pdf' ELSE 'other' END AS source_type
    FROM path_parts p JOIN documents d ON d.doc_id = p.doc_id""",
)
def write_results_query(spark, sf_dir):
    """Results written by source type and read back."""
    results = si.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        F.coalesce(file_category(F.expr(si.PATH)), F.lit("other")).alias("source_type"),
    )
    return spark.read.parquet(write_results(results, work_folder(spark, "results")))


@_query(
    "workbook_cells",
    f"""WITH {ar.BOOKS_SQL} SELECT doc, sheet, CAST(sheet_ord AS INTEGER) AS sheet_ord,
    CAST(row_ord AS INTEGER) AS row_ord, CAST(cell_ord AS INTEGER) AS cell_ord, address, value, result, formula, type
    FROM book_cells""",
)
def workbook_cells(spark, sf_dir):
    return extract_workbook_cells(ar.workbooks(spark, sf_dir)).cells


@_query(
    "workbook_sheets",
    f"WITH {ar.BOOKS_SQL} SELECT doc, sheet, CAST(sheet_ord AS INTEGER) AS sheet_ord FROM book_sheets",
)
def workbook_sheets(spark, sf_dir):
    return extract_workbook_cells(ar.workbooks(spark, sf_dir)).sheets


@_query(
    "workbook_merges",
    f"""WITH {ar.BOOKS_SQL} SELECT doc, sheet, CAST(0 AS INTEGER) AS merge_ord, 'A1:B1' AS ref
    FROM read_books GROUP BY doc, sheet
    UNION ALL SELECT doc, sheet, 1, concat('C1:D', count(*)) FROM read_books GROUP BY doc, sheet""",
)
def workbook_merges(spark, sf_dir):
    return extract_workbook_cells(ar.workbooks(spark, sf_dir)).merges


@_query(
    "workbook_errors",
    f"""WITH {ar.BOOKS_SQL} SELECT DISTINCT replace(doc, 'book-', 'broken-') AS key,
    'EXCEL_TEXT_EXTRACTION_FAILED' AS error_code,
    'Failed to read Excel file: File is not a zip file' AS error_message,
    '{{"filePath":"' || replace(doc, 'book-', 'broken-') || '"}}' AS error_context FROM books WHERE book % 7 = 1""",
)
def workbook_errors(spark, sf_dir):
    return si.flat_error(extract_workbook_cells(ar.workbooks(spark, sf_dir)).errors, "key")


@_query(
    "workbooks_to_markdown",
    f"""WITH {ar.BOOKS_SQL} SELECT doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
    string_agg(markdown, chr(10) ORDER BY sheet_ord) AS markdown FROM book_blocks GROUP BY doc""",
)
def workbooks_markdown(spark, sf_dir):
    documents, _ = workbooks_to_markdown(ar.workbooks(spark, sf_dir), merged_cells=True)
    return documents


@_query(
    "extract_docx",
    f"WITH {ar.WORD_SQL} SELECT doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, text, markdown FROM word_in",
)
def docx(spark, sf_dir):
    return extract_docx(ar.word_files(spark, sf_dir)).documents


@_query(
    "docx_errors",
    f"""WITH {ar.WORD_SQL} SELECT doc AS key,
    CASE WHEN is_docx THEN 'WORD_TEXT_EXTRACTION_FAILED' ELSE 'UNSUPPORTED_FORMAT' END AS error_code,
    CASE WHEN is_docx THEN 'Failed to extract text from Word file: File is not a zip file'
         ELSE 'Only .docx files are supported for text extraction. Received: ' || doc END AS error_message,
    CASE WHEN is_docx THEN '{{"filePath":"' || doc || '"}}' END AS error_context FROM word_bad""",
)
def docx_errors(spark, sf_dir):
    return si.flat_error(extract_docx(ar.word_files(spark, sf_dir)).errors, "key")


# Word text requests: every document is asked for as text, as Markdown and in a format
# that does not exist; a fourth request asks for a file that is not there, that cannot
# be read or that has the wrong extension, and for the document itself elsewhere.

_ASKED = [
    "doc_id * 4 + k AS request_id",
    "'extract_word_text' AS tool",
    f"""CASE WHEN k < 3 THEN {ar.WORD_PATH}
        WHEN doc_id % 10 = 7 THEN concat('/word/none-', doc_id, '.docx')
        WHEN doc_id % 11 = 5 THEN concat('/word/broken-', doc_id, '.docx')
        WHEN doc_id % 13 = 6 THEN concat('/word/', doc_id, '.doc') ELSE {ar.WORD_PATH} END AS file_path""",
    "CASE k WHEN 0 THEN 'text' WHEN 2 THEN 'html' END AS format",
]


def _word_requests(spark, sf_dir):
    four = F.explode(F.array(*map(F.lit, range(4))))
    return (
        si.table(spark, sf_dir, "documents")
        .withColumn("k", four)
        .selectExpr(*_ASKED, "cast(NULL AS double) AS dpi", "cast(NULL AS string) AS output_mode")
    )


_WORD = f"""WITH {ar.WORD_SQL},
asked AS (SELECT {', '.join(_ASKED)}, k, doc_id FROM documents, (VALUES (0), (1), (2), (3)) AS v(k)),
judged AS (
  SELECT a.*, w.text, w.markdown,
         CASE WHEN k = 2 THEN 'INVALID_TOOL_INPUT'
              WHEN NOT file_path LIKE '%.docx' THEN 'UNSUPPORTED_FORMAT'
              WHEN file_path LIKE '/word/none-%' THEN 'FILE_NOT_FOUND'
              WHEN file_path LIKE '/word/broken-%' THEN 'WORD_TEXT_EXTRACTION_FAILED' END AS error_code
  FROM asked a JOIN word_in w ON w.doc_id = a.doc_id)"""


@_query(
    "word_text",
    f"""{_WORD} SELECT request_id, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
    '{{"sourceType":"word","textFormat":"' || CASE k WHEN 0 THEN 'text' ELSE 'markdown' END || '","content":'
    || to_json(CASE k WHEN 0 THEN text ELSE markdown END)::VARCHAR || '}}' AS text
    FROM judged WHERE error_code IS NULL""",
)
def word_text_query(spark, sf_dir):
    results, _ = word_text(_word_requests(spark, sf_dir), ar.word_files(spark, sf_dir))
    return results.select("request_id", "part_no", "part_count", "text")


@_query(
    "word_text_errors",
    f"{_WORD} SELECT CAST(request_id AS VARCHAR) AS key, error_code FROM judged WHERE error_code IS NOT NULL",
)
def word_text_errors(spark, sf_dir):
    _, failed = word_text(_word_requests(spark, sf_dir), ar.word_files(spark, sf_dir))
    return failed.select("key", F.col("error.code").alias("error_code"))


# Workbook text requests: events ask for the documents of their users; conversations are the pages.
# Every conversation is a good document, and some are failing ones too, which other events ask for.

_EXCEL_FILE = "concat('/in/', {0}, '.xlsx')"
_ASKED_FILE = "concat('/in/', CASE WHEN event_id % 4 = 3 THEN 'bad-' ELSE '' END, user_id, '.xlsx')"


def _excel_inputs(spark, sf_dir):
    requests = si.table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        "'extract_excel_text' AS tool",
        f"{_ASKED_FILE} AS file_path",
        "CASE event_id % 4 WHEN 0 THEN 71.0 WHEN 1 THEN 300.0 END AS dpi",
        "cast(NULL AS string) AS format",
        "cast(NULL AS string) AS output_mode",
    )
    documents = si.table(spark, sf_dir, "documents")
    files = documents.selectExpr("explode(array('', 'bad-')) AS kind", "doc_id").selectExpr(
        "concat('/in/', kind, doc_id, '.xlsx') AS path"
    )
    turns = si.table(spark, sf_dir, "conversations")
    good = turns.selectExpr(
        f"{_EXCEL_FILE.format('conv_id')} AS doc",
        f"{si.PAGE_PATH} AS image_path",
        "text AS content",
        "cast(NULL AS string) AS call_error",
    )
    bad = turns.where("conv_id % 5 = 2 OR conv_id % 7 = 3").selectExpr(
        "concat('/in/bad-', conv_id, '.xlsx') AS doc",
        f"{si.PAGE_PATH} AS image_path",
        "CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN '' ELSE text END AS content",
        "CASE WHEN conv_id % 7 = 3 THEN concat('no answer ', turn) END AS call_error",
    )
    return requests, files, good.unionAll(bad)


_EXCEL = f"""WITH replies AS (
  SELECT concat('/in/', kind, conv_id, '.xlsx') AS doc, text,
         concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '.png') AS image_path,
         kind = 'bad-' AND conv_id % 7 = 3 AS is_broken, kind = 'bad-' AND conv_id % 5 = 2 AND turn = 1 AS is_empty
  FROM conversations, (VALUES (''), ('bad-')) AS k(kind) WHERE kind = '' OR conv_id % 5 = 2 OR conv_id % 7 = 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY image_path) AS page_no FROM replies),
documents_out AS (
  SELECT doc, count(*) AS page_count, string_agg(to_json(image_path)::VARCHAR, ',' ORDER BY page_no) AS images,
         bool_or(is_broken OR is_empty) AS is_failed,
         CASE WHEN count(*) = 1 THEN max(text)
              ELSE string_agg('## Page ' || page_no || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_no)
              END AS content
  FROM numbered GROUP BY doc),
asked AS (
  SELECT event_id AS request_id, event_id % 4 = 0 AS is_invalid, {_ASKED_FILE} AS doc,
         user_id IN (SELECT doc_id FROM documents) AS is_there FROM events)"""


@_query(
    "excel_text",
    f"""{_EXCEL} SELECT request_id, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
    '{{"sourceType":"excel","textFormat":"markdown","content":' || to_json(content)::VARCHAR
    || ',"images":[' || images || '],"pageCount":' || page_count || '}}' AS text
    FROM asked JOIN documents_out USING (doc) WHERE NOT is_invalid AND is_there AND NOT is_failed""",
)
def excel_text_query(spark, sf_dir):
    results, _ = excel_text(*_excel_inputs(spark, sf_dir))
    return results.select("request_id", "part_no", "part_count", "text")


@_query(
    "excel_text_errors",
    f"""{_EXCEL} SELECT CAST(request_id AS VARCHAR) AS key,
    CASE WHEN is_invalid THEN 'INVALID_TOOL_INPUT' WHEN NOT is_there THEN 'FILE_NOT_FOUND'
         WHEN page_count IS NULL THEN 'PDF_RENDER_FAILED' ELSE 'COPILOT_MARKDOWN_FAILED' END AS error_code
    FROM asked LEFT JOIN documents_out USING (doc)
    WHERE is_invalid OR NOT is_there OR page_count IS NULL OR is_failed""",
)
def excel_text_errors(spark, sf_dir):
    _, failed = excel_text(*_excel_inputs(spark, sf_dir))
    return failed.select("key", F.col("error.code").alias("error_code"))


# Requests for one speaker's pages, for all, and for a sheet that no page shows.


@_query(
    "excel_text_sheets",
    f"""WITH shown AS (
      SELECT event_id, text, image_path, row_number() OVER (PARTITION BY event_id ORDER BY image_path) AS page_no,
             count(*) OVER (PARTITION BY event_id) AS page_count
      FROM (SELECT event_id, event_id % 4 AS way, {_EXCEL_FILE.format('user_id')} AS doc, user_id FROM events)
      JOIN (SELECT conv_id, role, text, concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '.png')
            AS image_path FROM conversations) ON conv_id = user_id
      WHERE user_id IN (SELECT doc_id FROM documents) AND (way = 0 OR way = 1 OR (way = 2 AND role = 'user')))
    SELECT event_id AS request_id, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
      '{{"sourceType":"excel","textFormat":"markdown","content":' || to_json(string_agg(
        CASE WHEN page_count = 1 THEN text ELSE '## Page ' || page_no || chr(10) || chr(10) || text END,
        chr(10) || chr(10) ORDER BY page_no))::VARCHAR
      || ',"images":[' || string_agg(to_json(image_path)::VARCHAR, ',' ORDER BY page_no) || '],"pageCount":'
      || count(*) || '}}' AS text
    FROM shown GROUP BY event_id""",
)
def excel_text_sheets(spark, sf_dir):
    requests, files, pages = _excel_inputs(spark, sf_dir)
    requests = requests.withColumn("_path", F.col("file_path"))
    names = """CASE request_id % 4 WHEN 1 THEN cast(array() AS array<string>)
        WHEN 2 THEN array('user', 'user', 'nobody') WHEN 3 THEN array('nobody') END"""
    requests = requests.drop("dpi", "file_path").selectExpr(
        "*", "cast(NULL AS double) AS dpi", f"{names} AS sheet_names", "replace(_path, 'bad-', '') AS file_path"
    )
    pages = si.table(spark, sf_dir, "conversations").selectExpr(
        f"{_EXCEL_FILE.format('conv_id')} AS doc",
        f"{si.PAGE_PATH} AS image_path",
        "role AS sheet",
        "text AS content",
        "cast(NULL AS string) AS call_error",
    )
    results, _ = excel_text(requests, files, pages)
    return results.select("request_id", "part_no", "part_count", "text")


@_query(
    "workbooks_to_markdown_asked",
    f"""WITH {ar.BOOKS_SQL}, asked AS (SELECT DISTINCT concat('/books/book-', n_nationkey, '.xlsx') AS doc FROM nation)
    SELECT doc AS key, string_agg(markdown, chr(10) ORDER BY sheet_ord) AS outcome
    FROM book_blocks JOIN asked USING (doc) GROUP BY doc
    UNION ALL SELECT doc, 'File not found: ' || doc FROM asked WHERE doc NOT IN (SELECT doc FROM book_blocks)""",
)
def workbooks_asked(spark, sf_dir):
    """Workbooks of some numbers, of which some may not be there."""
    asked = si.table(spark, sf_dir, "nation").selectExpr(
        "concat('/books/book-', n_nationkey, '.xlsx') AS doc", "cast(NULL AS array<string>) AS sheet_names"
    )
    documents, failed = workbooks_to_markdown(ar.workbooks(spark, sf_dir), asked, merged_cells=True)
    return documents.select(F.col("doc").alias("key"), F.col("markdown").alias("outcome")).unionAll(
        failed.select("key", "error.message")
    )
