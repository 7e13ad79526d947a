"""Driver tables shaped like the inputs of each operator, in Spark and in SQL.

Every stand-in uses all rows of its table. The Spark side is a DataFrame, the
SQL side a list of common table expressions with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_error(df: DataFrame, *keep: str) -> DataFrame:
    """Error structs as plain columns, the context as JSON."""
    return df.select(
        *keep,
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
        F.to_json("error.context").alias("error_context"),
    )


# Pages: a conversation is a document and its turns are pages. Where conv_id is a
# multiple of three every turn is a document of its own, so one-page documents occur.

PAGE_DOC = "CASE WHEN conv_id % 3 = 0 THEN concat(conv_id, '-', turn) ELSE concat(conv_id, '') END"
PAGE_PATH = "concat('/out/', conv_id, '/page-', lpad(cast(turn + 1 AS string), 3, '0'), '.png')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        f"{PAGE_DOC} AS doc", f"{PAGE_PATH} AS image_path", "text AS content"
    )


PAGES_SQL = """
pages_in AS (
  SELECT CASE WHEN conv_id % 3 = 0 THEN concat(conv_id, '-', turn) ELSE concat(conv_id, '') END AS doc,
         concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '.png') AS image_path,
         text AS content
  FROM conversations)"""

# Replies of the model: every text padded with blanks; beside these, by arithmetic, blank
# ones, and documents of their own with a missing, empty or failed reply and a good one.

_VARIANTS = """CASE WHEN (conv_id * 5 + turn) % 23 IN (0, 1, 3) THEN {0}'good', 'bad', 'more'{1}
  WHEN (conv_id * 5 + turn) % 23 = 2 THEN {0}'good', 'blank'{1} ELSE {0}'good'{1} END"""
_REPLY_DOC = f"concat({PAGE_DOC}, CASE WHEN variant IN ('bad', 'more') THEN '-bad' ELSE '' END)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``doc, image_path, content, call_error``."""
    own = table(spark, sf_dir, "conversations").withColumn(
        "variant", F.explode(F.expr(_VARIANTS.format("array(", ")")))
    )
    return own.selectExpr(
        f"{_REPLY_DOC} AS doc",
        f"replace({PAGE_PATH}, '.png', concat('-', variant, '.png')) AS image_path",
        r"""CASE WHEN variant = 'blank' THEN ' \t\n '
            WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 0 THEN NULL
            WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 1 THEN ''
            ELSE concat('﻿ \n', text, '\t\r\n') END AS content""",
        "CASE WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 3 THEN concat('timeout on turn ', turn) END AS call_error",
    )


REPLIES_SQL = f"""
reply_variants AS (
  SELECT *, unnest({_VARIANTS.format("[", "]")}) AS variant FROM conversations),
replies_in AS (
  SELECT {_REPLY_DOC} AS doc,
         concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '-', variant, '.png') AS image_path,
         CASE WHEN variant = 'blank' THEN concat(' ', chr(9), chr(10), chr(160))
              WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 0 THEN NULL
              WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 1 THEN ''
              ELSE concat(chr(65279), ' ', chr(10), text, chr(9), chr(13), chr(10)) END AS content,
         CASE WHEN variant = 'bad' AND (conv_id * 5 + turn) % 23 = 3 THEN concat('timeout on turn ', turn) END AS call_error,
         text
  FROM reply_variants),
replies_out AS (
  SELECT doc, image_path,
         CASE WHEN call_error IS NOT NULL OR content IS NULL OR content = '' THEN 'COPILOT_MARKDOWN_FAILED' END
           AS error_code,
         CASE WHEN call_error IS NOT NULL THEN 'GitHub Copilot SDK failed to convert image to Markdown'
              WHEN content IS NULL OR content = '' THEN 'No Markdown content received from GitHub Copilot' END
           AS error_message,
         CASE WHEN call_error IS NOT NULL THEN '{{"message":"' || call_error || '"}}' END AS error_context,
         CASE WHEN call_error IS NOT NULL OR content IS NULL OR content = '' THEN NULL
              WHEN content = concat(' ', chr(9), chr(10), chr(160)) THEN ''
              ELSE text END AS content
  FROM replies_in)"""

# Paths: made from documents, with extensions of every kind and odd names among them.

PATH = """concat('/data/', source, '/', CASE doc_id % 14
  WHEN 0 THEN concat('Book', doc_id, '.XLSX') WHEN 1 THEN concat('old', doc_id, '.xls')
  WHEN 2 THEN concat('macro', doc_id, '.xlsm') WHEN 3 THEN concat('bin', doc_id, '.Xlsb')
  WHEN 4 THEN concat('paper', doc_id, '.docx') WHEN 5 THEN concat('letter', doc_id, '.doc')
  WHEN 6 THEN concat('doc', doc_id, '.ODT') WHEN 7 THEN concat('file', doc_id, '.PDF')
  WHEN 8 THEN concat('scan', doc_id, '.jpeg') WHEN 9 THEN concat('anim', doc_id, '.GIF/')
  WHEN 10 THEN concat('.hidden', doc_id) WHEN 11 THEN concat('v', doc_id, '.tar.webp')
  WHEN 12 THEN concat('notes', doc_id) ELSE '..' END)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATH} AS path")


PATHS_SQL = f"""
paths_in AS (SELECT doc_id, {PATH} AS path FROM documents),
path_names AS (
  SELECT doc_id, path, list_extract(string_split(rtrim(path, '/'), '/'), -1) AS name FROM paths_in),
path_parts AS (
  SELECT doc_id, path, name,
         CASE WHEN name = '..' OR strpos(substr(name, 2), '.') = 0 THEN ''
              ELSE '.' || list_extract(string_split(name, '.'), -1) END AS raw_ext
  FROM path_names)"""

# Workbooks as tables: a workbook per nation, a sheet per market segment, a row per
# customer, spread over columns A, C, D and AA, with duplicates, empty cells and
# addresses that name a row but are never looked up.

_CELLS = """
  SELECT c_nationkey, c_mktsegment, c_custkey, {ord} AS cell_ord, {address} AS address,
         {value} AS value, {result} AS result, {formula} AS formula, {type} AS type FROM customer {where}"""


def _cell_rows(text: str, num) -> str:
    def rows(ord, address, value, result="NULL", formula="NULL", type="'3'", where=""):
        return _CELLS.format(
            ord=ord, address=address, value=value, result=result, formula=formula, type=type, where=where
        )

    at = "c_custkey + 2"
    return " UNION ALL ".join(
        [
            rows(0, f"concat('A', {at})", "c_name"),
            rows(1, f"concat('C', {at})", f"CASE WHEN c_acctbal >= 0 THEN {num('c_acctbal')} END", type="'2'"),
            rows(
                2,
                f"concat('D', {at})",
                "NULL",
                result=f"CASE WHEN c_custkey % 4 > 0 THEN {num('c_custkey * 2')} END",
                formula=f"concat('C', {at}, '*2')",
                type="'6'",
            ),
            rows(3, f"concat('AA', {at})", f"CASE WHEN c_custkey % 3 > 0 THEN concat('x|', c_custkey) ELSE '' END"),
            rows(4, f"concat('A', {at})", "concat('again ', c_name)", where="WHERE c_custkey % 10 = 0"),
            rows(5, f"concat('B0', {at})", "'unseen'", where="WHERE c_custkey % 17 = 0"),
            rows(6, "'E'", "'no row'", where="WHERE c_custkey % 50 = 7"),
        ]
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "c_custkey + 2"
    customers = table(spark, sf_dir, "customer")
    number = "regexp_replace(cast(cast({} AS decimal(38,17)) AS string), '\\\\.?0+$', '')"

    def cell(ord, address, value, result="NULL", formula="NULL", type="'3'", when="true"):
        return (
            f"CASE WHEN {when} THEN struct(cast({ord} AS int) AS cell_ord, {address} AS address, "
            f"cast({value} AS string) AS value, cast({result} AS string) AS result, "
            f"cast({formula} AS string) AS formula, {type} AS type) END"
        )

    listed = [
        cell(0, f"concat('A', {at})", "c_name"),
        cell(
            1,
            f"concat('C', {at})",
            f"CASE WHEN c_acctbal >= 0 THEN {number.format('c_acctbal')} END",
            type="'2'",
        ),
        cell(
            2,
            f"concat('D', {at})",
            "NULL",
            result="CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 2 END",
            formula=f"concat('C', {at}, '*2')",
            type="'6'",
        ),
        cell(3, f"concat('AA', {at})", "CASE WHEN c_custkey % 3 > 0 THEN concat('x|', c_custkey) ELSE '' END"),
        cell(4, f"concat('A', {at})", "concat('again ', c_name)", when="c_custkey % 10 = 0"),
        cell(5, f"concat('B0', {at})", "'unseen'", when="c_custkey % 17 = 0"),
        cell(6, "'E'", "'no row'", when="c_custkey % 50 = 7"),
    ]
    # a row at a time becomes its cells: no shuffle
    return (
        customers.selectExpr(
            "concat('nation-', c_nationkey) AS doc",
            "c_mktsegment AS sheet",
            f"{SHEET_ORD} AS sheet_ord",
            "cast(c_custkey AS int) AS row_ord",
            f"explode(array_compact(array({', '.join(listed)}))) AS cell",
        )
        .select("doc", "sheet", "sheet_ord", "row_ord", "cell.*")
    )


SHEET_ORD = "cast(ascii(c_mktsegment) AS int)"
EMPTY_ORD = 1000


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = (
        table(spark, sf_dir, "customer")
        .selectExpr("concat('nation-', c_nationkey) AS doc", "c_mktsegment AS sheet", f"{SHEET_ORD} AS sheet_ord")
        .distinct()
    )
    empty = table(spark, sf_dir, "nation").selectExpr(
        "concat('nation-', n_nationkey) AS doc", "'Empty' AS sheet", f"{EMPTY_ORD} AS sheet_ord"
    )
    return used.unionByName(empty)


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('nation-', c_nationkey) AS doc",
        "CASE WHEN c_custkey % 9 = 0 THEN 'Empty' ELSE c_mktsegment END AS sheet",
        "cast(c_custkey AS int) AS merge_ord",
        "concat('A', c_custkey + 2, ':C', c_custkey + 2) AS ref",
    )


_DUCK_NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"

CELLS_SQL = f"""
cells_raw AS ({_cell_rows("VARCHAR", lambda v: f"({_DUCK_NUMBER.format(v)})")}),
cells_in AS (
  SELECT concat('nation-', c_nationkey) AS doc, c_mktsegment AS sheet,
         CAST(ascii(c_mktsegment) AS INTEGER) AS sheet_ord, CAST(c_custkey AS INTEGER) AS row_ord,
         CAST(cell_ord AS INTEGER) AS cell_ord, address, CAST(value AS VARCHAR) AS value,
         CAST(result AS VARCHAR) AS result, CAST(formula AS VARCHAR) AS formula, type
  FROM cells_raw),
sheets_in AS (
  SELECT DISTINCT doc, sheet, sheet_ord FROM cells_in
  UNION ALL SELECT concat('nation-', n_nationkey), 'Empty', {EMPTY_ORD} FROM nation),
merges_in AS (
  SELECT concat('nation-', c_nationkey) AS doc,
         CASE WHEN c_custkey % 9 = 0 THEN 'Empty' ELSE c_mktsegment END AS sheet,
         CAST(c_custkey AS INTEGER) AS merge_ord, concat('A', c_custkey + 2, ':C', c_custkey + 2) AS ref
  FROM customer),
placed AS (
  SELECT *, coalesce(result, value, '') AS text, regexp_replace(address, '[0-9]', '', 'g') AS col,
         TRY_CAST(regexp_extract(regexp_replace(address, '[A-Za-z]', '', 'g'), '^[0-9]+') AS BIGINT) AS rn
  FROM cells_in),
last_cells AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY doc, sheet, address ORDER BY row_ord DESC, cell_ord DESC) AS newest
    FROM placed) WHERE newest = 1),
sheet_cols AS (
  SELECT doc, sheet, col, row_number() OVER (PARTITION BY doc, sheet ORDER BY length(col), col) AS col_no
  FROM (SELECT DISTINCT doc, sheet, col FROM placed)),
sheet_rows AS (
  SELECT doc, sheet, rn, row_number() OVER (PARTITION BY doc, sheet ORDER BY rn) = 1 AS is_header
  FROM (SELECT DISTINCT doc, sheet, rn FROM placed WHERE rn IS NOT NULL)),
dense AS (
  SELECT r.doc, r.sheet, r.rn, r.is_header, c.col_no, c.col, coalesce(l.text, '') AS text
  FROM sheet_rows r JOIN sheet_cols c ON c.doc = r.doc AND c.sheet = r.sheet
  LEFT JOIN last_cells l ON l.doc = r.doc AND l.sheet = r.sheet AND l.address = concat(c.col, r.rn)),
table_lines AS (
  SELECT doc, sheet, rn, is_header,
         '| ' || string_agg(text, ' | ' ORDER BY col_no) || ' |'
         || CASE WHEN is_header THEN chr(10) || '|' || repeat(' --- |', CAST(count(*) AS INTEGER)) ELSE '' END AS line
  FROM dense GROUP BY doc, sheet, rn, is_header),
tables AS (
  SELECT doc, sheet, string_agg(line, chr(10) ORDER BY rn) AS body FROM table_lines GROUP BY doc, sheet),
notes AS (
  SELECT doc, sheet, string_agg(ref, ', ' ORDER BY merge_ord) AS note FROM merges_in GROUP BY doc, sheet),
sheet_texts AS (
  SELECT s.doc, s.sheet, s.sheet_ord,
         '## Sheet: ' || s.sheet || chr(10) || chr(10)
         || CASE WHEN t.body IS NULL THEN '_Empty sheet_' || chr(10)
                 ELSE t.body || chr(10)
                      || coalesce(chr(10) || '_Merged cells: ' || n.note || '_' || chr(10), '') END AS markdown
  FROM sheets_in s LEFT JOIN tables t ON t.doc = s.doc AND t.sheet = s.sheet
  LEFT JOIN notes n ON n.doc = s.doc AND n.sheet = s.sheet)"""

# Requests: events name a tool by type and arithmetic, with missing and broken fields.

TOOL = """CASE event_type
  WHEN 'signup' THEN 'convert_excel_to_images' WHEN 'purchase' THEN 'extract_word_text'
  WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'convert_pdf_to_images' ELSE 'render_document' END
  WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'extract_excel_text' WHEN 1 THEN 'convert_word_to_images'
                                      ELSE 'convert_pdf_images_to_markdown' END
  ELSE CASE event_id % 3 WHEN 0 THEN 'get_capabilities' WHEN 1 THEN NULL ELSE 'print_document' END END"""
FILE = "concat('/in/', {0}, CASE {0} % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' ELSE '.DOC' END)"
DPI = """CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN floor(value) WHEN 3 THEN 72.0
  WHEN 4 THEN 600.0 ELSE 601.0 END"""
FORMAT = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text' WHEN 2 THEN 'markdown' ELSE 'html' END"
MODE = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'images' WHEN 2 THEN 'text' WHEN 3 THEN 'markdown' WHEN 4 THEN 'all' ELSE 'video' END"
PATH_OR_NULL = f"CASE WHEN event_id % 11 > 0 THEN {FILE.format('user_id')} END"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id",
        f"{TOOL} AS tool",
        f"{PATH_OR_NULL} AS file_path",
        "CASE WHEN event_id % 5 = 0 THEN '/out' END AS output_dir",
        f"cast({DPI} AS double) AS dpi",
        "CASE event_id % 3 WHEN 0 THEN array('Summary') WHEN 1 THEN cast(array() AS array<string>) END AS sheet_names",
        "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS keep_pdf",
        f"{FORMAT} AS format",
        f"{MODE} AS output_mode",
        "CASE WHEN event_id % 9 = 0 THEN false END AS merge_pages",
        "CASE WHEN event_id % 10 = 0 THEN false END AS preserve_page_headings",
    )


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist: the labelled documents."""
    return table(spark, sf_dir, "labels").selectExpr(f"{FILE.format('doc_id')} AS path")


REQUESTS_SQL = f"""
requests_in AS (
  SELECT event_id AS request_id, {TOOL} AS tool, {PATH_OR_NULL} AS file_path,
         CASE WHEN event_id % 5 = 0 THEN '/out' END AS output_dir, CAST({DPI} AS DOUBLE) AS dpi,
         CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS keep_pdf,
         CASE event_id % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN '' END AS sheet_names,
         {FORMAT} AS format, {MODE} AS output_mode,
         CASE WHEN event_id % 9 = 0 THEN false END AS merge_pages,
         CASE WHEN event_id % 10 = 0 THEN false END AS preserve_page_headings
  FROM events),
files_in AS (SELECT DISTINCT {FILE.format('doc_id')} AS path FROM labels),
fields(name, output_dir, dpi, sheet_names, keep_pdf, format, output_mode, pages, file) AS (VALUES
  ('convert_excel_to_images', true, true, true, true, false, false, false, true),
  ('convert_word_to_images', true, true, false, true, false, false, false, true),
  ('convert_pdf_to_images', true, true, false, false, false, false, false, true),
  ('extract_excel_text', false, true, true, false, false, false, false, true),
  ('extract_word_text', false, false, false, false, true, false, false, true),
  ('convert_pdf_images_to_markdown', false, true, false, false, false, false, true, true),
  ('render_document', true, true, false, false, false, true, false, true),
  ('get_capabilities', false, false, false, false, false, false, false, false)),
defaulted AS (
  SELECT r.request_id, r.tool, r.file_path, f.name,
         CASE WHEN f.name IS NULL OR f.output_dir THEN r.output_dir END AS output_dir,
         CASE WHEN f.name IS NULL THEN r.dpi WHEN f.dpi THEN coalesce(r.dpi, 150.0) END AS dpi,
         CASE WHEN f.name IS NULL OR f.sheet_names THEN r.sheet_names END AS sheet_names,
         CASE WHEN f.name IS NULL THEN r.keep_pdf WHEN f.keep_pdf THEN coalesce(r.keep_pdf, false) END AS keep_pdf,
         CASE WHEN f.name IS NULL THEN r.format WHEN f.format THEN coalesce(r.format, 'markdown') END AS format,
         CASE WHEN f.name IS NULL THEN r.output_mode WHEN f.output_mode THEN coalesce(r.output_mode, 'images') END
           AS output_mode,
         CASE WHEN f.name IS NULL THEN r.merge_pages WHEN f.pages THEN coalesce(r.merge_pages, true) END AS merge_pages,
         CASE WHEN f.name IS NULL THEN r.preserve_page_headings
              WHEN f.pages THEN coalesce(r.preserve_page_headings, true) END AS preserve_page_headings,
         f.file AS needs_file
  FROM requests_in r LEFT JOIN fields f ON f.name = r.tool),
validated AS (
  SELECT *, CASE WHEN name IS NULL THEN 'Unknown tool: ' || coalesce(tool, '')
                 WHEN needs_file AND file_path IS NULL THEN 'filePath is required'
                 WHEN dpi <> floor(dpi) OR dpi NOT BETWEEN 72 AND 600 THEN 'dpi must be an integer from 72 to 600'
                 WHEN format NOT IN ('text', 'markdown') THEN 'format must be one of text, markdown'
                 WHEN output_mode NOT IN ('images', 'text', 'markdown', 'all')
                   THEN 'outputMode must be one of images, text, markdown, all' END AS input_message
  FROM defaulted),
triaged AS (
  SELECT v.*, CASE WHEN input_message IS NOT NULL THEN 'INVALID_TOOL_INPUT'
              WHEN tool = 'extract_word_text' AND NOT lower(file_path) LIKE '%.docx' THEN 'UNSUPPORTED_FORMAT'
              WHEN path IS NULL AND (tool LIKE 'convert%images' OR tool LIKE 'extract%') THEN 'FILE_NOT_FOUND' END
              AS error_code
  FROM validated v LEFT JOIN files_in ON path = file_path),
triage_out AS (
  SELECT *, CASE error_code WHEN 'INVALID_TOOL_INPUT' THEN input_message
                 WHEN 'UNSUPPORTED_FORMAT'
                   THEN 'Only .docx files are supported for text extraction. Received: ' || file_path
                 WHEN 'FILE_NOT_FOUND' THEN 'File not found: ' || file_path END AS error_message
  FROM triaged)"""

# Output of the converter helper: events' properties in its shape, a share of it broken.

HELPER = """CASE event_id % 10
  WHEN 0 THEN concat(' {"ok": true, "pdfPath": "/tmp/', event_id, '.pdf", "renderStrategy": "print-area", "sheetCount": ', user_id, '}\\n')
  WHEN 1 THEN concat('{"ok": true, "props": ', props, '}')
  WHEN 2 THEN concat('{"ok": false, "error": {"code": "UNO", "message": "failed ', event_id, '"}}')
  WHEN 3 THEN '{"ok": false}' WHEN 4 THEN concat('not-json ', props) WHEN 5 THEN 'null' WHEN 6 THEN '[]'
  WHEN 7 THEN '{"ok": 0, "error": {"code": "ZERO"}}' WHEN 8 THEN '{"error": {"message": null}}'
  ELSE '{"ok": 1, "pdfPath": null}' END"""


def helper_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{HELPER} AS stdout", "event_type AS stderr", "cast(event_id % 10 AS int) AS exit_code"
    )


HELPER_SQL = """
helper_in AS (
  SELECT event_id, event_id % 10 AS case_no, event_type AS stderr, user_id,
         CASE event_id % 10 WHEN 4 THEN concat('not-json ', props) WHEN 5 THEN 'null' END AS bad_stdout
  FROM events)"""
