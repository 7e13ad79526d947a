"""Office files built by Spark from the driver tables: a file per row, never on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.session import write_and_read

# Customers per workbook: bounds the group that one task turns into a file.
PER_BOOK = 50
_FILE = "path string, length bigint, content binary"


def _book_builder():
    def build(key, rows):
        import io
        import zipfile
        from xml.sax.saxutils import escape, quoteattr

        import pandas as pd

        (book,) = key
        path = f"/books/book-{book}.xlsx"
        files = []
        if book % 7 == 1:
            broken = b"no archive at all"
            files.append((f"/books/broken-{book}.xlsx", len(broken), broken))
        shared, sheets = [], []
        for segment, group in rows.sort_values("c_custkey").groupby("c_mktsegment"):
            body = []
            for n, c in enumerate(group.itertuples(), start=1):
                shared.append(c.c_name)
                rich = "" if c.c_custkey % 4 else "rich"
                named = (
                    f'<c r="A{n}" t="inlineStr"><is><r><t xml:space="preserve">{escape(c.c_name)} </t></r>'
                    f"<r><t>{rich}</t></r></is></c>"
                    if rich
                    else f'<c r="A{n}" t="s"><v>{len(shared) - 1}</v></c>'
                )
                body.append(
                    f'<row r="{n}">{named}<c r="B{n}"><v>{c.c_acctbal!r}</v></c>'
                    f'<c r="C{n}" t="b"><v>{int(c.c_acctbal > 0)}</v></c>'
                    f'<c r="D{n}" t="str"><f>UPPER(A{n}) &amp; "&lt;"</f><v>{escape(c.c_name.upper())}&lt;</v></c>'
                    f'<c r="E{n}"><f>B{n}*0</f><v>0</v></c><c r="F{n}"/></row>'
                )
            merged = f'<mergeCells count="2"><mergeCell ref="A1:B1"/><mergeCell ref="C1:D{len(group)}"/></mergeCells>'
            sheets.append((f"{segment} & more", f"<sheetData>{''.join(body)}</sheetData>{merged}"))
        sheets.append(("Empty", "<sheetData/>"))
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            listed = "".join(
                f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, 1)
            )
            space = 'xmlns="urn:s" xmlns:r="urn:r"'
            archive.writestr("xl/workbook.xml", f"{head}<workbook {space}><sheets>{listed}</sheets></workbook>")
            links = "".join(
                f'<Relationship Id="rId{i}" Type="sheet" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>'
                for i in range(1, len(sheets) + 1)
            )
            archive.writestr("xl/_rels/workbook.xml.rels", f"{head}<Relationships>{links}</Relationships>")
            strings = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
            archive.writestr("xl/sharedStrings.xml", f"{head}<sst>{strings}</sst>")
            for i, (_, xml) in enumerate(sheets, 1):
                archive.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet>{xml}</worksheet>")
        files.append((path, out.tell(), out.getvalue()))
        return pd.DataFrame(files, columns=["path", "length", "content"])

    return build


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per 50 customers with a sheet per segment; an unreadable one beside every seventh."""
    customers = si.table(spark, sf_dir, "customer").select(
        F.expr(f"c_custkey div {PER_BOOK}").alias("book"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )
    built = customers.groupBy("book").applyInPandas(_book_builder(), _FILE)
    return write_and_read(built, "books")


BOOKS_SQL = f"""
books AS (
  SELECT concat('/books/book-', c_custkey // {PER_BOOK}, '.xlsx') AS doc, c_custkey // {PER_BOOK} AS book,
         c_mktsegment || ' & more' AS sheet, c_custkey, c_name, c_acctbal,
         row_number() OVER (PARTITION BY c_custkey // {PER_BOOK}, c_mktsegment ORDER BY c_custkey) AS n,
         dense_rank() OVER (PARTITION BY c_custkey // {PER_BOOK} ORDER BY c_mktsegment) - 1 AS sheet_ord
  FROM customer),
read_books AS (SELECT * FROM books),
book_cells AS (
  SELECT doc, sheet, sheet_ord, n - 1 AS row_ord, cell_ord, col || n AS address, n, col,
         CASE cell_ord WHEN 0 THEN c_name || CASE WHEN c_custkey % 4 = 0 THEN ' rich' ELSE '' END
                       WHEN 1 THEN {si._DUCK_NUMBER.format("c_acctbal")}
                       WHEN 2 THEN CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END END AS value,
         CASE cell_ord WHEN 3 THEN upper(c_name) || '<' WHEN 4 THEN '0' END AS result,
         CASE cell_ord WHEN 3 THEN concat('UPPER(A', n, ') & "<"') WHEN 4 THEN concat('B', n, '*0') END AS formula,
         CASE cell_ord WHEN 0 THEN CASE WHEN c_custkey % 4 = 0 THEN '8' ELSE '3' END
                       WHEN 1 THEN '2' WHEN 2 THEN '9' ELSE '6' END AS type
  FROM read_books, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')) AS k(cell_ord, col)),
book_sheets AS (
  SELECT DISTINCT doc, sheet, sheet_ord FROM read_books
  UNION ALL SELECT doc, 'Empty', max(sheet_ord) + 1 FROM read_books GROUP BY doc),
book_lines AS (
  SELECT doc, sheet, sheet_ord, n,
         '| ' || string_agg(coalesce(result, value), ' | ' ORDER BY cell_ord) || ' |'
         || CASE WHEN n = 1 THEN chr(10) || '|' || repeat(' --- |', 5) ELSE '' END AS line
  FROM book_cells GROUP BY doc, sheet, sheet_ord, n),
book_blocks AS (
  SELECT doc, sheet, sheet_ord, '## Sheet: ' || sheet || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n)
         || chr(10) || chr(10) || '_Merged cells: A1:B1, C1:D' || max(n) || '_' || chr(10) AS markdown
  FROM book_lines GROUP BY doc, sheet, sheet_ord
  UNION ALL SELECT doc, sheet, sheet_ord, '## Sheet: Empty' || chr(10) || chr(10) || '_Empty sheet_' || chr(10)
  FROM book_sheets WHERE sheet = 'Empty')"""


def _docx_builder():
    def record(rows):
        import pyarrow as pa

        kinds = {"path": pa.string(), "length": pa.int64(), "content": pa.binary()}
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=[*kinds])

    def build(batches):
        import io
        import math
        import zipfile
        from xml.sax.saxutils import escape

        for batch in batches:
            rows, size = [], 0
            for at in range(batch.num_rows):
                doc_id, path, text = (column[at].as_py() for column in batch.columns)
                doc_id = math.nan if doc_id is None else doc_id
                # files of a few MB of text at a time
                if size > (1 << 22):
                    yield record(rows)
                    rows, size = [], 0
                size += len(text)
                if doc_id % 11 == 5:
                    rows.append((f"/word/broken-{doc_id}.docx", 4, b"PK\x03\x04"))
                paragraphs = []
                for i, line in enumerate(text.split("\n")):
                    style = f'<w:pPr><w:pStyle w:val="Heading{1 + doc_id % 6}"/></w:pPr>' if i == 0 else ""
                    first, space, rest = line.partition(" ")
                    paragraphs.append(
                        f'<w:p w:rsidR="{i}">{style}<w:hyperlink r:id="x"><w:r><w:t xml:space="preserve">'
                        f"{escape(first)}{space}</w:t></w:r></w:hyperlink>"
                        f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{escape(rest)}</w:t></w:r>'
                        f"<w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>"
                    )
                half = len(paragraphs) // 2
                body = (
                    "".join(paragraphs[:half])
                    + "<w:tbl><w:tr><w:tc>"
                    + "".join(paragraphs[half:])
                    + "</w:tc></w:tr></w:tbl><w:sectPr/>"
                )
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(
                        "word/document.xml",
                        '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="urn:w" xmlns:r="urn:r">'
                        f"<w:body>{body}</w:body></w:document>",
                    )
                rows.append((path, out.tell(), out.getvalue()))
                if doc_id % 13 == 6:
                    rows.append((path[:-1], out.tell(), out.getvalue()))
            yield record(rows)

    return build


WORD_PATH = "concat('/word/', doc_id, '.docx')"


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Word file per document, a paragraph per line, the second half in a table.

    Beside some stands an unreadable one, beside some a copy with the wrong extension.
    """
    documents = si.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{WORD_PATH} AS path", "text"
    )
    built = documents.repartition("doc_id").mapInArrow(_docx_builder(), _FILE)
    return write_and_read(built, "word-files")


# The first word of a line is a link and plain, the rest is bold up to the blanks around it.
_REST = "substr(l, position(' ' IN l) + 1)"
_BOLD_REST = f"""CASE WHEN position(' ' IN l) = 0 OR trim({_REST}) = '' THEN l
  ELSE left(l, position(' ' IN l)) || left({_REST}, length({_REST}) - length(ltrim({_REST})))
    || '**' || trim({_REST}) || '**' || substr({_REST}, length(rtrim({_REST})) + 1) END"""
# The first half of the lines are paragraphs, the rest are one cell of a table.
_CELL = f"""replace(array_to_string(list_filter(list_transform(lines[len(lines) // 2 + 1:], lambda l: {_BOLD_REST}),
  lambda t: t <> ''), '<br>'), '|', '\\|')"""
_HALF = f"""array_to_string(list_transform(lines[:len(lines) // 2], lambda l, i: CASE WHEN i = 1 THEN
  repeat('#', CAST(1 + doc_id % 6 AS INTEGER)) || ' ' ELSE '' END || {_BOLD_REST} || chr(10) || chr(10)), '')"""
WORD_SQL = f"""
word_in AS (
  SELECT doc_id, {WORD_PATH} AS doc,
         replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) AS text,
         {_HALF} || '| ' || {_CELL} || ' |' || chr(10) || '| --- |' || chr(10) || chr(10) AS markdown
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)),
word_bad AS (
  SELECT concat('/word/broken-', doc_id, '.docx') AS doc, true AS is_docx FROM documents WHERE doc_id % 11 = 5
  UNION ALL SELECT concat('/word/', doc_id, '.doc'), false FROM documents WHERE doc_id % 13 = 6)"""
