import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docspark.operators.ordering import Splitting
from docspark.plans.excel_text import excel_text
from docspark.plans.word_text import word_text
from docspark.plans.workbook_text import workbooks_to_markdown
from docspark.sources import archive
from docspark.sources.docx import extract_docx
from docspark.sources.files import attachment_rows, scan_files, valid_png
from docspark.sources.sink import write_results
from docspark.sources.workbook import extract_workbook_cells
from tests.test_requests import asked

FILES = "path string, length bigint, content binary"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def book(sheets, strings="", prefix=""):
    """A workbook from {name: sheet XML}, listed in reverse part order."""
    x = f"{prefix}:" if prefix else ""
    names = list(sheets)
    parts = {
        "xl/workbook.xml": f"<{x}workbook><{x}sheets>"
        + "".join(f'<{x}sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names))
        + f"</{x}sheets></{x}workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>"
        + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{len(names) - i}.xml"/>' for i in range(len(names))
        )
        + '<Relationship Id="z" Target="styles.xml"/></Relationships>',
    }
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst>{strings}</sst>"
    for i, n in enumerate(names):
        parts[f"xl/worksheets/sheet{len(names) - i}.xml"] = f"<{x}worksheet>{sheets[n]}</{x}worksheet>"
    return zipped(parts)


def files(spark, **content):
    rows = [(name.replace("__", "."), len(data), data) for name, data in content.items()]
    return spark.createDataFrame(rows, FILES)


def word(*paragraphs):
    body = "".join(paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}<w:sectPr/></w:body></w:document>'})


def p(text, style=None):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def test_three_by_three_workbook(spark):
    grid = [["Name", "Age", "City"], ["Alice", 30, "Tokyo"], ["Bob", 25, "Osaka"]]
    strings, rows = [], []
    for r, row in enumerate(grid, 1):
        cells = ""
        for c, v in zip("ABC", row):
            if isinstance(v, str):
                cells += f'<c r="{c}{r}" t="s"><v>{len(strings)}</v></c>'
                strings.append(f"<si><t>{v}</t></si>")
            else:
                cells += f'<c r="{c}{r}"><v>{v}</v></c>'
        rows.append(f'<row r="{r}">{cells}</row>')
    sheet = f"<sheetData>{''.join(rows)}</sheetData>"
    out, errors = workbooks_to_markdown(files(spark, t__xlsx=book({"TestSheet": sheet}, "".join(strings))))
    assert out.first().markdown == (
        "## Sheet: TestSheet\n\n| Name | Age | City |\n| --- | --- | --- |\n| Alice | 30 | Tokyo |\n| Bob | 25 | Osaka |\n"
    )
    assert errors.isEmpty()


CELLS = """<x:sheetData><x:row r="2"><x:c r="A2" t="s"><x:v>1</x:v></x:c><x:c r="B2"><x:v>1.1000000000000001</x:v></x:c>
<x:c r="C2" t="b"><x:v>1</x:v></x:c><x:c r="D2" t="e"><x:v>#DIV/0!</x:v></x:c><x:c r="E2"/></x:row><x:row r="3"/>
<!-- <row r="9"><c r="A9"><v>no</v></c></row> --><x:row r="4"><x:c r="A4" t="s"><x:v>0</x:v></x:c>
<x:c r="B4"><x:f>A1&gt;2</x:f><x:v>4.50</x:v></x:c><x:c r="C4" t="str"><x:f t="shared" si="0"/><x:v>s</x:v></x:c>
<x:c r="D4" t="inlineStr"><x:is><x:t> in </x:t></x:is></x:c><x:c r="E4" t="d"><x:v>2024-01-02</x:v></x:c></x:row>
</x:sheetData><x:mergeCells><x:mergeCell ref="A2:B2"/><x:mergeCell ref="A4:A5"/></x:mergeCells>"""
STRINGS = '<si><t xml:space="preserve"> a &amp; b </t></si><si><r><t>ri</t></r><r><t xml:space="preserve"> ch</t></r></si>'


@pytest.mark.parametrize("block_chars", [1, 256 * 1024])
def test_cell_kinds(spark, monkeypatch, block_chars):
    monkeypatch.setattr(archive.archive_blocks, "__defaults__", (block_chars,))
    data = book({"One": CELLS, "Two": "<x:sheetData/>"}, STRINGS, prefix="x")
    tables = extract_workbook_cells(files(spark, b__xlsx=data, bad__xlsx=b"zz"))
    got = {r.address: (r.row_ord, r.value, r.result, r.formula, r.type) for r in tables.cells.collect()}
    assert got == {
        "A2": (0, "ri ch", None, None, "8"),
        "B2": (0, "1.1", None, None, "2"),
        "C2": (0, "true", None, None, "9"),
        "D2": (0, "#DIV/0!", None, None, "10"),
        "A4": (2, " a & b ", None, None, "3"),
        "B4": (2, None, "4.5", "A1>2", "6"),
        "C4": (2, None, "s", None, "6"),
        "D4": (2, " in ", None, None, "3"),
        "E4": (2, "2024-01-02", None, None, "3"),
    }
    assert [(r.sheet, r.sheet_ord) for r in tables.sheets.orderBy("sheet_ord").collect()] == [("One", 0), ("Two", 1)]
    assert [(r.sheet, r.ref) for r in tables.merges.orderBy("merge_ord").collect()] == [("One", "A2:B2"), ("One", "A4:A5")]


def test_word_formats(spark):
    r = lambda text, *on: f'<w:r><w:rPr>{"".join(on)}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'
    b, i = "<w:b/>", '<w:i w:val="true"/>'
    item = lambda level, *runs: (
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr></w:pPr>{"".join(runs)}</w:p>'
    )
    body = [
        f"<w:p>{r('plain ')}{r('bold ', b)}{r('more', b)}{r(' and ')}{r('both', b, i)}{r('slanted', i)}</w:p>",
        f"""<w:p>{r('off', '<w:b w:val="0"/>', "<w:i w:val='false'/>")}{r(' ', b)}{r('end', '<w:bCs/>', '<w:iCs/>')}</w:p>""",
        item(0, r("one")),
        item(2, r("two", i)),
        '<w:p><w:pPr><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr><w:r><w:t>no item</w:t></w:r></w:p>',
    ]
    found = extract_docx(files(spark, a__docx=word(*body))).documents.first()
    assert found.text == "plain bold more and bothslanted\n\noff end\n\none\n\ntwo\n\nno item\n\n"
    assert found.markdown == (
        "plain **bold more** and **_both_**_slanted_\n\noff end\n\n- one\n\n    - _two_\n\nno item\n\n"
    )


def test_unreadable_workbooks_are_rows(spark):
    broken = zipped({"xl/workbook.xml": "<workbook><sheets></workbook>"})
    cut_off = book({"S": '<sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData>'})[:-30]
    data = files(spark, a__xlsx=b"bad workbook", b__xlsx=zipped({"x": "y"}), c__xlsx=broken, d__xlsx=cut_off)
    large = spark.createDataFrame([("e.xlsx", 1 << 32, None)], FILES)
    tables = extract_workbook_cells(data.unionByName(large))
    errors = {r.key: r.error for r in tables.errors.collect()}
    assert set(errors) == {"a.xlsx", "b.xlsx", "c.xlsx", "d.xlsx", "e.xlsx"}
    assert "e.xlsx" in errors["e.xlsx"].message  # no such file
    assert {e.code for e in errors.values()} == {"EXCEL_TEXT_EXTRACTION_FAILED"}
    assert errors["a.xlsx"].message == "Failed to read Excel file: File is not a zip file"
    assert errors["a.xlsx"].context == {"filePath": "a.xlsx"}
    assert tables.cells.isEmpty() and tables.sheets.isEmpty()


def test_sheet_choice_and_merge_note(spark):
    sheet = '<sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells>'
    data = files(spark, a__xlsx=book({"S": sheet, "T": sheet}))
    asked_for = spark.createDataFrame([("a.xlsx", ["T"])], "doc string, sheet_names array<string>")
    out, _ = workbooks_to_markdown(data, asked_for, merged_cells=True)
    assert out.first().markdown == "## Sheet: T\n\n| 1 |\n| --- |\n\n_Merged cells: A1:B1_\n"


@pytest.mark.parametrize("block_chars", [1, 256 * 1024])
def test_word_files(spark, block_chars):
    lines = ["Hello World", "This is a test document.", "Third line of text."]
    rich = (
        '<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r>'
        '<w:hyperlink r:id="x"><w:r><w:t xml:space="preserve"> link </w:t></w:r></w:hyperlink>'
        "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>&lt;in&gt;</w:t></w:r></w:ins></w:p>"
    )
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    boxed = f"<w:p><w:r><w:t>out</w:t></w:r><w:r><w:txbxContent>{p('box')}</w:txbxContent></w:r></w:p>"
    data = files(
        spark,
        three__docx=word(*map(p, lines)),
        rich__docx=word(p("Top", "Heading2"), rich, table, "<w:p/>", boxed, p("t", "Title")),
        empty__docx=word(),
        bad__docx=b"PK",
        old__doc=word(p("x")),
    )
    out = extract_docx(data, part_bytes=20, block_chars=block_chars)
    got = {}
    for r in sorted(out.documents.collect(), key=lambda r: r.part_no):
        text, markdown = got.get(r.doc, ("", ""))
        got[r.doc] = text + r.text, markdown + r.markdown
    assert got["three.docx"] == ("".join(x + "\n\n" for x in lines),) * 2
    rest = "a\tb link <in>\n\n{}\n\n\n\nout\n\nt\n\n"
    assert got["rich.docx"] == ("Top\n\n" + rest.format("cell"), "## Top\n\n" + rest.format("| cell |\n| --- |"))
    assert got["empty.docx"] == ("", "")
    assert set(got) == {"three.docx", "rich.docx", "empty.docx"}
    errors = {r.key: r.error for r in out.errors.collect()}
    assert errors["bad.docx"].code == "WORD_TEXT_EXTRACTION_FAILED"
    assert errors["bad.docx"].context == {"filePath": "bad.docx"}
    assert errors["old.doc"].message == "Only .docx files are supported for text extraction. Received: old.doc"
    assert set(errors) == {"bad.docx", "old.doc"}


def test_utf_16_part(spark):
    text = '<?xml version="1.0" encoding="UTF-16"?><w:document xmlns:w="w"><w:body>' + p("Grüße") + "</w:body></w:document>"
    data = files(spark, a__docx=zipped({"word/document.xml": text.encode("utf-16")}))
    assert extract_docx(data).documents.first().text == "Grüße\n\n"


def test_word_text_plan(spark):
    data = files(spark, a__docx=word(p("Hi", "Heading1")), b__docx=b"")
    requests = asked(
        spark,
        {"tool": "extract_word_text", "file_path": "a.docx", "format": "text"},
        {"tool": "extract_word_text", "file_path": "a.docx"},
        {"tool": "extract_word_text", "file_path": "b.docx"},
        {"tool": "extract_word_text", "file_path": "c.docx"},
        {"tool": "convert_pdf_to_images", "file_path": "a.docx"},
    )
    results, errors = word_text(requests, data)
    got = {r.request_id: json.loads(r.text) for r in results.collect()}
    assert got == {
        0: {"sourceType": "word", "textFormat": "text", "content": "Hi\n\n"},
        1: {"sourceType": "word", "textFormat": "markdown", "content": "# Hi\n\n"},
    }
    assert {r.key: r.error.code for r in errors.collect()} == {"2": "WORD_TEXT_EXTRACTION_FAILED", "3": "FILE_NOT_FOUND"}


def test_excel_text_plan(spark):
    names = ["two", "one", "bad", "none"]
    known = spark.createDataFrame([(f"/{n}.xlsx",) for n in names], "path string")
    pages = spark.createDataFrame(
        [
            ("/two.xlsx", "p2", " # Page 2 content", None),
            ("/two.xlsx", "p1", "# Page 1 content ", None),
            ("/one.xlsx", "p1", "# Single page", None),
            ("/bad.xlsx", "p1", "x", None),
            ("/bad.xlsx", "p2", None, "late"),
            ("/other.xlsx", "p1", "never asked for", None),
        ],
        "doc string, image_path string, content string, call_error string",
    )
    requests = asked(spark, *[{"tool": "extract_excel_text", "file_path": f"/{n}.xlsx"} for n in [*names, "missing"]])
    results, errors = excel_text(requests, known, pages)
    got = {r.request_id: json.loads(r.text) for r in results.collect()}
    assert got == {
        0: {
            "sourceType": "excel",
            "textFormat": "markdown",
            "content": "## Page 1\n\n# Page 1 content\n\n## Page 2\n\n# Page 2 content",
            "images": ["p1", "p2"],
            "pageCount": 2,
        },
        1: {"sourceType": "excel", "textFormat": "markdown", "content": "# Single page", "images": ["p1"], "pageCount": 1},
    }
    assert {r.key: r.error.code for r in errors.collect()} == {
        "2": "COPILOT_MARKDOWN_FAILED",
        "3": "PDF_RENDER_FAILED",
        "4": "FILE_NOT_FOUND",
    }
    parted, _ = excel_text(requests, known, pages, part_bytes=5, how=Splitting(slices=4, min_rows=1))
    parts = sorted((r.request_id, r.part_no, r.structured.content) for r in parted.collect())
    assert "".join(c for i, _, c in parts if i == 0 and c) == got[0]["content"]


def test_scan(spark, folder):
    for name in ("b.png", "a.png", "c.PNG", "d.png.txt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"\x89PNGdata" if name == "a.png" else b"" if name == "b.png" else b"x")
    listed = [r.path for r in scan_files(spark, folder, ".png").collect()]
    assert listed == [f"{folder}/a.png", f"{folder}/b.png"]
    assert scan_files(spark, folder).count() == 4
    read = scan_files(spark, folder, content=True)
    assert {r.path[len(folder) + 1 :]: r.is_png for r in valid_png(read).collect()} == {
        "a.png": True,
        "b.png": False,
        "c.PNG": False,
        "d.png.txt": False,
    }
    plan = scan_files(spark, folder, ".txt")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_scan_of_names_with_odd_characters(spark, folder):
    for name in ("a b+c%20.txt", "Ä.txt", "[x]{y}.txt"):
        open(f"{folder}/{name}", "w").close()
    open(f"{folder}/full é.txt", "w").write("x")
    listed = scan_files(spark, folder, ".txt").collect()
    assert {r.path[len(folder) + 1 :]: r.length for r in listed} == {
        "a b+c%20.txt": 0,
        "Ä.txt": 0,
        "[x]{y}.txt": 0,
        "full é.txt": 1,
    }


def test_large_files_have_no_content(spark, folder):
    for name, size in (("small", 5), ("large", 50)):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10)
    try:
        rows = scan_files(spark, folder, content=True).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.path[len(folder) + 1 :]: (r.length, r.content) for r in rows} == {
        "small": (5, b"xxxxx"),
        "large": (50, None),
    }


def test_attachments(spark):
    data = bytes(range(256)) * 3
    row = attachment_rows(spark.createDataFrame([("/x/Pic.JPG", 1, data)], FILES)).first()
    assert base64.b64decode(row.data) == data and "\n" not in row.data and "\r" not in row.data
    assert (row.type, row.mime_type, row.display_name) == ("blob", "image/jpeg", "Pic.JPG")


def test_sink_refuses_a_used_folder(spark, folder):
    df = spark.range(5).withColumn("source_type", F.lit("word"))
    out = write_results(df, f"{folder}/new/out")
    assert spark.read.parquet(out).count() == 5
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_results(df, out)


def test_word_files_are_built_a_few_mb_at_a_time():
    import pyarrow as pa

    from catalog import archives

    text = "some words\n" * 100_000
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4, 5, 6], "path": [f"/word/{i}.docx" for i in range(1, 7)], "text": [text] * 6})
    made = [*archives._docx_builder()([batch])]
    assert max(b.num_rows for b in made) < 6
    paths = [p for b in made for p in b.column("path").to_pylist()]
    assert paths == [*(f"/word/{i}.docx" for i in range(1, 5)), "/word/broken-5.docx", "/word/5.docx", "/word/6.docx", "/word/6.doc"]
