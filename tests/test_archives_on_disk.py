import os
import time

import pytest
from pyspark.sql import functions as F

from docspark.functions.dates import is_date_format, serial_date
from docspark.functions.formulas import column_label, column_number, formula_tokens, shared_formula
from docspark.operators.ordering import Splitting
from docspark.plans.workbook_text import workbooks_to_markdown
from docspark.sources import archive
from docspark.sources.docx import extract_docx
from docspark.sources.files import list_files, scan_files
from docspark.sources.workbook import extract_workbook_cells
from tests.test_sources import book, files, p, word, zipped

ROW = '<sheetData><row r="1"><c r="A1"><v>{}</v></c></row></sheetData>'


def put(folder, content):
    for name, data in content.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(data)


def test_listing_by_executors(spark, folder):
    put(folder, {"b.txt": b"xy", "a.txt": b"", "c.TXT": b"1", "sub/d.txt": b"z", "_hidden/e.txt": b"z"})
    before = time.time() - 60
    found = {r.path: r for r in list_files(spark, folder).collect()}
    assert set(found) == {f"{folder}/{n}" for n in ("a.txt", "b.txt", "c.TXT")}
    assert found[f"{folder}/a.txt"].length == 0 and all(r.modificationTime.timestamp() > before for r in found.values())
    assert list_files(spark, f"file://{folder}/", ".txt").count() == 2
    deep = [r.path for r in scan_files(spark, folder, ".txt").collect()]
    assert deep == [f"{folder}/a.txt", f"{folder}/b.txt", f"{folder}/sub/d.txt"]
    read = {r.path: r.content for r in scan_files(spark, folder, ".txt", content=True).collect()}
    assert read == {f"{folder}/a.txt": b"", f"{folder}/b.txt": b"xy", f"{folder}/sub/d.txt": b"z"}
    os.mkdir(f"{folder}/nothing")
    assert list_files(spark, f"{folder}/nothing").count() == 0


def test_archives_larger_than_a_value_are_read_by_path(spark, folder):
    put(folder, {"a.xlsx": book({"S": ROW.format(7)}), "b.docx": word(p("hi"))})
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10)
    try:
        out, errors = workbooks_to_markdown(scan_files(spark, folder, ".xlsx", content=True))
        assert "| 7 |" in out.first().markdown and errors.isEmpty()
        listed = list_files(spark, folder)
        assert "content" not in listed.columns
        assert extract_workbook_cells(listed.where("path like '%.xlsx'")).cells.first().value == "7"
        assert extract_docx(listed.where("path like '%.docx'")).documents.first().text == "hi\n\n"
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_sheet_nobody_asks_for_is_never_inflated(spark, folder):
    good, broken = ROW.format(1), "<sheetData>"
    put(folder, {"a.xlsx": book({"Good": good, "Broken": broken}), "b.xlsx": book({"Good": good, "Other": good})})
    listed = list_files(spark, folder)
    asked = listed.select(F.col("path").alias("doc"), F.array(F.lit("Good")).alias("sheet_names"))
    out, errors = workbooks_to_markdown(listed, asked)
    assert {r.doc[len(folder) + 1 :] for r in out.collect()} == {"a.xlsx", "b.xlsx"} and errors.isEmpty()
    whole, errors = workbooks_to_markdown(listed)
    assert [r.doc for r in whole.collect()] == [f"{folder}/b.xlsx"]
    (failed,) = errors.collect()
    assert failed.key == f"{folder}/a.xlsx" and failed.error.code == "EXCEL_TEXT_EXTRACTION_FAILED"


def test_files_that_are_no_archives(spark, folder):
    put(folder, {"a.xlsx": b"", "b.xlsx": b"zz", "c.xlsx": zipped({"x": "y"}), "d.xlsx": book({"S": ROW.format(1)})[:-30]})
    gone = spark.createDataFrame([(f"{folder}/gone.xlsx", 1, None)], "path string, length long, modificationTime timestamp")
    tables = extract_workbook_cells(list_files(spark, folder).unionByName(gone))
    assert tables.errors.count() == 5 and tables.cells.isEmpty() and tables.sheets.isEmpty()


def test_a_fault_late_in_a_part_leaves_no_rows(spark, folder):
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 40_000))
    data = book({"S": f"<sheetData>{rows}</sheetData><open>"})
    put(folder, {"a.xlsx": data})
    for given in (list_files(spark, folder), files(spark, a__xlsx=data)):
        tables = extract_workbook_cells(given)
        assert tables.errors.count() == 1 and tables.cells.isEmpty() and tables.merges.isEmpty()
        assert tables.sheets.isEmpty()


@pytest.mark.parametrize(
    "formula, first, at, want",
    [
        ("B1*2+$A1+A$1+$A$1", "C1", "D3", "C3*2+$A3+B$1+$A$1"),
        ("SUM(A1:B2)&\"A1 \"\"B2\"\"\"&'My A1'!C3", "B2", "C2", "SUM(B1:C2)&\"A1 \"\"B2\"\"\"&'My A1'!D3"),
        ("LOG10(A1)+Q1!B2+tax_1+ZZZ1+ABC1234567", "A1", "B2", "LOG10(B2)+Q1!C3+tax_1+ZZZ1+ABC1234567"),
        ("A:A+$B:C+3:4+$3:4+1.5E3+TRUE", "A1", "B2", "B:B+$B:D+4:5+$3:5+1.5E3+TRUE"),
        ("A1+XFD1048576", "A2", "A1", "#REF!+XFD1048575"),
        ("A1+XFD1048576", "A1", "B1", "B1+#REF!"),
        ("Z1+AZ1+ZZ1", "A1", "B1", "AA1+BA1+AAA1"),
        ("[1]S!A1+T[Col A1]+Ä1+_xlfn.STDEV.S(a1)", "A1", "A2", "[1]S!A2+T[Col A1]+Ä1+_xlfn.STDEV.S(A2)"),
    ],
)
def test_shared_formulas_move(spark, formula, first, at, want):
    row = spark.createDataFrame([(formula, first, at)], "f string, a string, b string")
    tokens = formula_tokens(F.col("f"))
    moved = row.select(shared_formula(tokens, F.col("a"), F.col("b")), F.array_join(tokens, "")).first()
    assert moved[1] == formula
    assert moved[0] == want


def test_column_labels(spark):
    odd = spark.range(1, 16_385).where(column_number(column_label(F.col("id"))) != F.col("id"))
    assert odd.count() == 0
    assert spark.range(16_384, 16_385).select(column_label(F.col("id"))).first()[0] == "XFD"


def test_dates(spark):
    cases = [
        ("45356", False, "2024-03-05"), ("45356.270833333336", False, "2024-03-05T06:30:00"),
        ("43894", True, "2024-03-05"), ("0.25", False, "06:00:00"), ("0", True, "1904-01-01"),
        ("1.0000057870", False, "1899-12-31T00:00:00.500"), ("2958465", False, "9999-12-31"),
        ("2958466", False, None), ("-1", False, None), ("x", False, None), ("NaN", False, None), (None, False, None),
    ]
    rows = spark.createDataFrame(cases, "v string, since_1904 boolean, want string")
    assert rows.where(~serial_date(F.col("v"), F.col("since_1904")).eqNullSafe(F.col("want"))).count() == 0
    formats = [
        (14, None, True), (22, None, True), (0, None, False), (46, None, False), (164, r"yyyy\-mm", True),
        (165, '#,##0 "days"', False), (166, "[h]:mm", False), (167, "General", False), (168, "[Red]0.00", False),
        (169, "[$-409]d mmm", True), (170, "0.00E+00", False), (171, "h:mm AM/PM", True), (172, r"0\d", False),
    ]
    rows = spark.createDataFrame(formats, "n int, code string, want boolean")
    assert rows.where(is_date_format(F.col("n"), F.col("code")) != F.col("want")).count() == 0


def test_cells_with_dates_and_shared_formulas(spark, monkeypatch):
    sheet = """<sheetData><row r="1"><c r="A1" s="1"><v>2.5</v></c><c r="B1"><f t="shared" si="0" ref="B1:B3">A1*2</f><v>5</v></c>
    <c r="C1" s="2"><v>7</v></c></row><row r="2"><c r="A2" s="1" t="str"><v>3</v></c><c r="B2"><f t="shared" si="0"/></c>
    <c r="C2" s="9"><v>4</v></c></row><row r="3"><c r="B3" s="1"><f t="shared" si="0"/><v>1</v></c>
    <c r="C3"><f t="shared" si="8"/><v>1</v></c><c r="D3"><f t="shared" si="8"/></c><c r="E3" s="1"><v>-3</v></c></row></sheetData>"""
    monkeypatch.setattr(archive.archive_blocks, "__defaults__", (1,))
    data = book({"One": sheet, "Two": sheet.replace("A1*2", "Z1")})
    styles = "<styleSheet><cellXfs><xf/><xf numFmtId='14'/><xf numFmtId='46'/></cellXfs></styleSheet>"
    import io
    import zipfile

    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/styles.xml", styles)
    cells = extract_workbook_cells(files(spark, a__xlsx=out.getvalue())).cells
    got = {(r.sheet, r.address): (r.value, r.result, r.formula, r.type) for r in cells.collect()}
    one = {a: v for (s, a), v in got.items() if s == "One"}
    assert one == {
        "A1": ("1900-01-01T12:00:00", None, None, "4"),
        "B1": (None, "5", "A1*2", "6"),
        "C1": ("7", None, None, "2"),
        "A2": ("3", None, None, "3"),
        "B2": (None, None, "A2*2", "6"),
        "C2": ("4", None, None, "2"),
        "B3": (None, "1899-12-31", "A3*2", "6"),
        "C3": (None, "1", None, "6"),
        "E3": ("-3", None, None, "2"),
    }
    assert got["Two", "B3"][2] == "Z3"


def item(text, number, level=0):
    return (
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr></w:pPr>'
        f"<w:r><w:t>{text}</w:t></w:r></w:p>"
    )


NUMBERING = """<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:start w:val="4"/>
<w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerRoman"/></w:lvl>
<w:lvl w:ilvl="2"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="5"/>
<w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num></w:numbering>"""


@pytest.mark.parametrize("block_chars", [1, 300, 256 * 1024])
def test_numbers_go_on_from_block_to_block(spark, block_chars):
    listed = [(1, 0), (1, 1), (2, 0), (1, 1), (1, 2), (1, 1), (1, 0), (1, 1), (3, 0), (2, 0), (2, 1), (1, 1), (1, 0), (2, 1)]
    body = [p("text") if i % 5 == 4 else "" for i in range(len(listed))]
    body = "".join(b + item(f"i{i}", n, level) for i, (b, (n, level)) in enumerate(zip(body, listed)))
    data = zipped(
        {
            "word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>',
            "word/numbering.xml": NUMBERING,
        }
    )
    # by the rules, one item after another
    state, want = {}, ""
    for i, (n, level) in enumerate(listed):
        want += "text\n\n" if i % 5 == 4 else ""
        for deeper in range(level + 1, 9):
            state[n, deeper] = 0
        state[n, level] = state.get((n, level), 0) + 1
        first = {(1, 0): 4, (2, 0): 9, (1, 1): 1, (2, 1): 1}.get((n, level))
        want += "  " * level + (f"{first - 1 + state[n, level]}. " if first else "- ") + f"i{i}\n\n"
    given = files(spark, a__docx=data, b__docx=word(item("alone", 1)))
    found = extract_docx(given, part_bytes=60, how=Splitting(slices=3, min_rows=1), block_chars=block_chars).documents
    parts = {r.doc: [x for x in found.collect() if x.doc == r.doc] for r in found.collect()}
    assert "".join(x.markdown for x in sorted(parts["a.docx"], key=lambda x: x.part_no)) == want
    assert parts["b.docx"][0].markdown == "- alone\n\n"


@pytest.mark.parametrize("block_chars", [1, 256 * 1024])
def test_links_tables_and_private_characters(spark, block_chars):
    marks = "\ue000a\ue002 \ue001b"
    link = '<w:hyperlink r:id="{}" w:history="1"><w:r><w:t>{}</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>!</w:t></w:r></w:hyperlink>'
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}{p('ner')}</w:tc><w:tc>{p('x')}</w:tc></w:tr></w:tbl>"
    table = (
        f"<w:tbl><w:tr><w:tc>{p('H|1')}</w:tc><w:tc>{p('H2', 'Heading1')}</w:tc></w:tr>"
        f"<w:tr><w:tc>{p('a')}<w:p/>{p('b')}</w:tc><w:tc>{inner}{p('after')}</w:tc></w:tr></w:tbl>"
    )
    body = [
        p(marks),
        f'<w:p>see {link.format("r1", "here")}{link.format("gone", "there")}<w:hyperlink w:anchor="top"><w:r><w:t>up</w:t></w:r></w:hyperlink></w:p>',
        table,
        "<w:tbl><w:tr/></w:tbl>",
        p("end"),
    ]
    parts = {
        "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="r"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="https://a.example/?x=1&amp;y=2"/></Relationships>',
    }
    data = files(spark, a__docx=zipped(parts))
    found = extract_docx(data, block_chars=block_chars).documents.first()
    plain = [marks, "here!there!up", "H|1", "H2", "a", "", "b", "in", "ner", "x", "after", "end"]
    assert found.text == "".join(x + "\n\n" for x in plain)
    linked = "[here**!**](https://a.example/?x=1&y=2)there**!**[up](#top)\n\n"
    drawn = "| H\\|1 | H2 |\n| --- | --- |\n| a<br>b | in<br>ner<br>x<br>after |\n\n"
    assert found.markdown == f"{marks}\n\n{linked}{drawn}\nend\n\n"
    flat = extract_docx(data, tables=False).documents.first().markdown
    assert flat == f"{marks}\n\n{linked}" + "".join(x + "\n\n" for x in ["H|1", "# H2", *plain[4:]])


def test_files_of_one_listing_are_opened_by_many_tasks(spark, folder, monkeypatch):
    put(folder, {f"{i}.docx": word(p(f"text {i}")) for i in range(12)} | {"bad.docx": b"zz"})
    opened = []
    kept = archive._kept
    monkeypatch.setattr(archive, "_kept", lambda blocks, purpose: opened.append(blocks.rdd.getNumPartitions()) or kept(blocks, purpose))
    monkeypatch.setattr(archive, "_FILE_BYTES", 1000)
    listed = list_files(spark, folder, ".docx")
    assert listed.rdd.getNumPartitions() == 1
    found = extract_docx(listed)
    assert {r.text for r in found.documents.collect()} == {f"text {i}\n\n" for i in range(12)}
    assert [r.key for r in found.errors.collect()] == [f"{folder}/bad.docx"]
    total = sum(r.length + archive._OPEN_COST for r in listed.collect())
    assert opened == [-(-total // 1000)]


def test_parts_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, folder, monkeypatch):
    put(folder, {f"{i}.xlsx": book({"One": ROW.format(i), "Two": ROW.format(-i)}) for i in range(6)})
    opened = []
    kept = archive._kept
    monkeypatch.setattr(archive, "_kept", lambda blocks, purpose: opened.append((purpose, blocks.rdd.getNumPartitions())) or kept(blocks, purpose))
    monkeypatch.setattr(archive, "_PART_BYTES", 1000)
    tables = extract_workbook_cells(list_files(spark, folder))
    assert sorted(int(r.value) for r in tables.cells.collect()) == sorted([*range(6), *range(-5, 1)])
    assert tables.errors.isEmpty()
    # twelve sheets, each of a few bytes and the cost to open it
    assert dict(opened)["workbook-parts"] >= 12 * archive._OPEN_COST / 1000
