"""Queries on files that executors wrote to the shared folder: listed, opened by path, converted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.plans.workbook_text import workbooks_to_markdown
from docspark.session import work_folder
from docspark.sources.docx import extract_docx
from docspark.sources.files import list_files
from docspark.sources.workbook import extract_workbook_cells

QUERIES = {}
ORACLE = {}
# Orders per workbook: bounds the group that one task turns into a file.
PER_BOOK = 500
NAME = "regexp_extract({}, '[^/]*$', 0)"


def _query(name, sql):
    def keep(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return keep


def _put(folder: str):
    """Writes a file; a task that runs again writes the same bytes to the same place."""

    def put(name, data):
        import re

        from pyarrow import fs

        if "://" in folder and not folder.startswith("file:"):
            system, root = fs.FileSystem.from_uri(folder)
        else:
            system, root = fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)

    return put


def _write(rows: DataFrame, files, folder: str) -> None:
    """Run ``files`` over each batch of rows and write the (name, bytes) it gives."""
    put = _put(folder)

    def written(batches):
        import pandas as pd

        for batch in batches:
            n = 0
            for name, data in files(batch):
                put(name, data)
                n += 1
            yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(written, "n long").agg(F.sum("n")).collect()


# A file per document, and an empty one beside some.


def _text_files():
    def build(batch):
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            yield f"{doc_id}.txt", text.encode()
            if doc_id % 7 == 3:
                yield f"{doc_id}-empty.txt", b""

    return build


@_query(
    "list_files",
    """SELECT concat(doc_id, '.txt') AS name, strlen(text) AS length, true AS has_time FROM documents
    UNION ALL SELECT concat(doc_id, '-empty.txt'), 0, true FROM documents WHERE doc_id % 7 = 3""",
)
def list_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "listed")
    _write(si.table(spark, sf_dir, "documents").select("doc_id", "text"), _text_files(), folder)
    recent = F.col("modificationTime") > F.current_timestamp() - F.expr("interval 1 day")
    return list_files(spark, folder, ".txt").select(
        F.expr(NAME.format("path")).alias("name"), "length", recent.alias("has_time")
    )


# Workbooks of orders: a sheet for each status, with dates in both date systems and formulas
# that cells share; every third has a sheet that is not well formed.


def _book_files(folder: str):
    put = _put(folder)

    def build(key, rows):
        import io
        import zipfile

        import pandas as pd

        (book,) = key
        since = pd.Timestamp("1904-01-01") if book % 2 else pd.Timestamp("1899-12-30")
        sheets = []
        for status, group in rows.sort_values("o_orderkey").groupby("o_orderstatus"):
            body = []
            for n, o in enumerate(group.itertuples(), start=1):
                day = (o.o_orderdate.normalize() - since).days
                second = o.o_orderkey % 86_400
                shared = [
                    f' si="{i}" ref="{c}1:{c}{len(group)}">{f}</f>' if n == 1 else f' si="{i}"/>'
                    for i, (c, f) in enumerate((("E", "D1*2+$A$1+SUM(B$1:B1)"), ("F", "B1+1")))
                ]
                body.append(
                    f'<row r="{n}"><c r="A{n}"><v>{o.o_orderkey}</v></c><c r="B{n}" s="1"><v>{day}</v></c>'
                    f'<c r="C{n}" s="2"><v>{day + second / 86_400!r}</v></c><c r="D{n}" s="3"><v>{o.o_totalprice!r}</v></c>'
                    f'<c r="E{n}"><f t="shared"{shared[0]}<v>{n}</v></c>'
                    f'<c r="F{n}" s="1"><f t="shared"{shared[1]}<v>{day + 1}</v></c></row>'
                )
            sheets.append((status, f"<sheetData>{''.join(body)}</sheetData>"))
        if book % 3 == 0:
            sheets.append(("Broken", "<sheetData>"))
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, 1))
            system = '<workbookPr date1904="1"/>' if book % 2 else ""
            archive.writestr("xl/workbook.xml", f'{head}<workbook xmlns:r="urn:r">{system}<sheets>{listed}</sheets></workbook>')
            links = "".join(
                f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
            )
            archive.writestr("xl/_rels/workbook.xml.rels", f"{head}<Relationships>{links}</Relationships>")
            formats = (
                r'<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\-mm\-dd\ hh:mm:ss"/>'
                '<numFmt numFmtId="165" formatCode="#,##0.00 &quot;days&quot;"/></numFmts>'
                '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
                '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
            )
            archive.writestr("xl/styles.xml", f"{head}<styleSheet>{formats}</styleSheet>")
            for i, (_, xml) in enumerate(sheets, 1):
                archive.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet>{xml}</worksheet>")
        put(f"orders-{book}.xlsx", out.getvalue())
        return pd.DataFrame({"n": [1]})

    return build


def _books(spark: SparkSession, sf_dir: str) -> str:
    folder = work_folder(spark, "order-books")
    orders = si.table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {PER_BOOK}").alias("book"), "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"
    )
    orders.groupBy("book").applyInPandas(_book_files(folder), "n long").agg(F.sum("n")).collect()
    return folder


_BOOKS = f"""WITH books AS (
  SELECT o_orderkey // {PER_BOOK} AS book, concat('orders-', o_orderkey // {PER_BOOK}, '.xlsx') AS doc, o_orderstatus AS sheet, *,
         row_number() OVER (PARTITION BY o_orderkey // {PER_BOOK}, o_orderstatus ORDER BY o_orderkey) AS n,
         dense_rank() OVER (PARTITION BY o_orderkey // {PER_BOOK} ORDER BY o_orderstatus) - 1 AS sheet_ord
  FROM orders),
dated AS (
  SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day,
         o_orderkey % 86400 AS s, {si._DUCK_NUMBER.format("o_totalprice")} AS price FROM books),
cells AS (
  SELECT book, doc, sheet, sheet_ord, n, cell_ord, col || n AS address,
    CASE cell_ord WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN day WHEN 3 THEN price
      WHEN 2 THEN day || CASE WHEN s = 0 THEN '' ELSE
        format('T{{:02d}}:{{:02d}}:{{:02d}}', s // 3600, s // 60 % 60, s % 60) END END AS value,
    CASE cell_ord WHEN 4 THEN n::VARCHAR WHEN 5 THEN next_day END AS result,
    CASE cell_ord WHEN 4 THEN format('D{{}}*2+$A$1+SUM(B$1:B{{}})', n, n) WHEN 5 THEN format('B{{}}+1', n) END AS formula,
    CASE cell_ord WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 2 THEN '4' WHEN 3 THEN '2' ELSE '6' END AS type
  FROM dated, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E'), (5, 'F')) AS k(cell_ord, col))"""


@_query(
    "order_book_cells",
    f"{_BOOKS} SELECT doc, sheet, address, value, result, formula, type FROM cells WHERE book % 3 <> 0",
)
def order_book_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and shared formulas of all workbooks that can be read whole."""
    cells = extract_workbook_cells(list_files(spark, _books(spark, sf_dir), ".xlsx")).cells
    return cells.select(F.expr(NAME.format("doc")).alias("doc"), "sheet", "address", "value", "result", "formula", "type")


@_query(
    "order_book_errors",
    f"""{_BOOKS} SELECT DISTINCT doc AS key, 'EXCEL_TEXT_EXTRACTION_FAILED' AS error_code FROM books WHERE book % 3 = 0""",
)
def order_book_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = extract_workbook_cells(list_files(spark, _books(spark, sf_dir), ".xlsx")).errors
    return failed.select(F.expr(NAME.format("key")).alias("key"), F.col("error.code").alias("error_code"))


@_query(
    "order_books_to_markdown",
    f"""{_BOOKS}, lines AS (
      SELECT book, doc, sheet, n, '| ' || string_agg(coalesce(result, value), ' | ' ORDER BY cell_ord) || ' |'
        || CASE WHEN n = 1 THEN chr(10) || '|' || repeat(' --- |', 6) ELSE '' END AS line
      FROM cells WHERE sheet IN ('F', 'P') GROUP BY book, doc, sheet, n),
    sheets AS (
      SELECT book, doc, sheet, '## Sheet: ' || sheet || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) AS markdown
      FROM lines GROUP BY book, doc, sheet)
    SELECT doc, string_agg(markdown, chr(10) ORDER BY sheet) AS outcome FROM sheets GROUP BY book, doc
    UNION ALL SELECT 'none.xlsx', 'FILE_NOT_FOUND'""",
)
def order_books_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From disk to Markdown: two sheets of each workbook; a sheet nobody asks for may be broken."""
    folder = _books(spark, sf_dir)
    files = list_files(spark, folder, ".xlsx")
    paths = files.select("path").unionAll(spark.createDataFrame([("/none.xlsx",)], "path string"))
    asked = paths.select(F.col("path").alias("doc"), F.array(F.lit("P"), F.lit("F"), F.lit("none")).alias("sheet_names"))
    documents, failed = workbooks_to_markdown(files, asked)
    name = F.expr(NAME.format("doc")).alias("doc")
    return documents.select(name, F.col("markdown").alias("outcome")).unionAll(
        failed.select(F.col("key").alias("doc"), "error.code").select(name, "code")
    )


# Word files with a paragraph for each line, by the line's number modulo seven: bold and plain,
# numbered items on two levels, bullets, links and tables.


def _list_files():
    def build(batch):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        def p(text, properties=""):
            return f'<w:p>{properties}<w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'

        def item(number, level):
            return f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr></w:pPr>'

        head = '<?xml version="1.0" encoding="UTF-8"?>'
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            body = []
            for i, line in enumerate(text.split("\n")):
                line = escape(line)
                if i % 7 == 0:
                    body.append(
                        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>\ue000</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r>"
                        f'<w:r><w:t xml:space="preserve"> {line}</w:t></w:r></w:p>'
                    )
                elif i % 14 == 1:
                    body.append(p(line, item(1, 0)))
                elif i % 7 in (2, 3):
                    body.append(p(line, item(1, 1)))
                elif i % 7 == 4:
                    body.append(p(line, item(2, 0)))
                elif i % 7 == 5:
                    body.append(f'<w:p><w:hyperlink r:id="l"><w:r><w:t xml:space="preserve">{line}</w:t></w:r></w:hyperlink></w:p>')
                elif i % 7 == 6:
                    rows = (p(line), p("x|y")), (p(i), "<w:p/>")
                    drawn = "".join(f"<w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in cells)}</w:tr>" for cells in rows)
                    body.append(f"<w:tbl><w:tblPr/>{drawn}</w:tbl>")
                else:
                    body.append(p(line))
            levels = (
                '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl>'
                '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum>'
                '<w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
                '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num>'
            )
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                space = 'xmlns:w="urn:w" xmlns:r="urn:r"'
                archive.writestr("word/document.xml", f"{head}<w:document {space}><w:body>{''.join(body)}</w:body></w:document>")
                archive.writestr("word/numbering.xml", f"{head}<w:numbering {space}>{levels}</w:numbering>")
                link = f'<Relationship Id="l" Type="hyperlink" Target="https://example.org/{doc_id}?a=1&amp;b=2"/>'
                archive.writestr("word/_rels/document.xml.rels", f"{head}<Relationships>{link}</Relationships>")
            yield f"{doc_id}.docx", out.getvalue()

    return build


_LINE = """CASE
  WHEN i % 7 = 0 THEN '**' || chr(57344) || 'x** ' || l || chr(10) || chr(10)
  WHEN i % 14 = 1 THEN (3 + i // 14) || '. ' || l || chr(10) || chr(10)
  WHEN i % 7 IN (2, 3) THEN '  ' || (i % 7 - 1 + CASE WHEN i % 14 >= 7 THEN 2 ELSE 0 END) || '. ' || l || chr(10) || chr(10)
  WHEN i % 7 = 4 THEN '- ' || l || chr(10) || chr(10)
  WHEN i % 7 = 5 AND trim(l) <> '' THEN '[' || l || '](https://example.org/' || doc_id || '?a=1&b=2)' || chr(10) || chr(10)
  WHEN i % 7 = 6 THEN '| ' || replace(l, '|', '\\|') || ' | x\\|y |' || chr(10) || '| --- | --- |' || chr(10)
    || '| ' || i || ' |  |' || chr(10) || chr(10)
  ELSE l || chr(10) || chr(10) END"""
_PLAIN = """CASE WHEN i % 7 = 0 THEN chr(57344) || 'x ' || l
  WHEN i % 7 = 6 THEN l || chr(10) || chr(10) || 'x|y' || chr(10) || chr(10) || i || chr(10) || chr(10) ELSE l END || chr(10) || chr(10)"""


@_query(
    "word_lists_and_tables",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    SELECT concat(doc_id, '.docx') AS doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
           string_agg({_PLAIN}, '' ORDER BY i) AS text, string_agg({_LINE}, '' ORDER BY i) AS markdown
    FROM lines GROUP BY doc_id""",
)
def word_lists_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files from disk: numbers that go on through a document, links, tables."""
    folder = work_folder(spark, "word-lists")
    _write(si.table(spark, sf_dir, "documents").select("doc_id", "text"), _list_files(), folder)
    found = extract_docx(list_files(spark, folder, ".docx")).documents
    return found.withColumn("doc", F.expr(NAME.format("doc")))
