import pytest
from pyspark.sql import functions as F

from docspark.functions import cells as C
from docspark.functions import paths as P
from docspark.functions.text import JS_SPACE, js_number, js_trim


def mapped(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_extension(spark):
    cases = {
        "/tmp/book.XLSX": ".xlsx",
        ".bashrc": "",
        "a.tar.gz": ".gz",
        "/a.b/c": "",
        "a.": ".",
        "/x/.hid.pdf": ".pdf",
        "notes": "",
        "a.docx/": ".docx",
        "..": "",
        "/x/..": "",
        "line\nbreak.pdf": ".pdf",
        "": "",
    }
    assert mapped(spark, P.file_extension, cases) == list(cases.values())


def test_basename(spark):
    assert mapped(spark, P.file_basename, ["/a/b.PDF", "b", "/a/b.c/", ""]) == ["b.PDF", "b", "b.c", ""]
    stems = mapped(spark, lambda c: P.file_basename(c, True), ["/a/b.PDF", ".bashrc", "a.tar.gz", ".."])
    assert stems == ["b", ".bashrc", "a.tar", ".."]


def test_category(spark):
    cases = {"book.XLSX": "excel", "doc.ODT": "word", "file.PDF": "pdf", "sheet.xlsm": "excel", "notes.txt": None}
    assert mapped(spark, P.file_category, cases) == list(cases.values())
    wrong, right = mapped(spark, P.file_category_error, ["notes.TXT", "a.pdf"])
    assert right is None and wrong.code == "UNSUPPORTED_FORMAT"
    assert wrong.message == (
        "Unsupported file format: .txt. Supported: .xlsx, .xls, .xlsm, .xlsb, .docx, .doc, .odt, .pdf"
    )
    assert mapped(spark, P.is_word, ["letter.doc", "a.pdf"]) == [True, False]
    assert mapped(spark, P.is_docx, ["paper.docx", "letter.doc"]) == [True, False]


def test_mime_type(spark):
    cases = {
        "a.JPG": "image/jpeg",
        "a.jpeg": "image/jpeg",
        "a.gif": "image/gif",
        "a.webp": "image/webp",
        "a.png": "image/png",
        "a": "image/png",
    }
    assert mapped(spark, P.mime_type, cases) == list(cases.values())


def test_js_trim(spark):
    values = [f"{JS_SPACE}# Hello{JS_SPACE}", "a​b​", JS_SPACE, "", "x y", None]
    assert mapped(spark, js_trim, values) == ["# Hello", "a​b​", "", "", "x y", None]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("30.0", "30"),
        ("30", "30"),
        ("0.1", "0.1"),
        ("0.30000000000000004", "0.30000000000000004"),
        ("1.1000000000000001", "1.1"),
        ("4.50", "4.5"),
        ("1E-3", "0.001"),
        ("1e-6", "0.000001"),
        ("12345678.25", "12345678.25"),
        ("1.2E7", "12000000"),
        ("1e20", "100000000000000000000"),
        ("-0.0", "0"),
        ("-7.25", "-7.25"),
        ("100", "100"),
        ("0.000125", "0.000125"),
        ("word", None),
        (None, None),
        ("1e-20", "1e-20"),
        ("1.5E-18", "1.5e-18"),
        ("-1.2345678901234567E-5", "-0.000012345678901234568"),
        ("1e21", "1e+21"),
        ("-2.5e30", "-2.5e+30"),
        ("5e22", "5e+22"),
        ("123456789012345680000", "123456789012345680000"),
        ("0.30000000000000004", "0.30000000000000004"),
        ("1.7976931348623157e308", "1.7976931348623157e+308"),
        ("NaN", "NaN"),
        ("-Infinity", "-Infinity"),
    ],
)
def test_js_number(spark, text, wanted):
    assert mapped(spark, js_number, [text]) == [wanted]


def test_js_number_of_doubles(spark):
    assert mapped(spark, js_number, [30.0, 1.5, 1e7, 1 / 3], "double") == [
        "30",
        "1.5",
        "10000000",
        "0.3333333333333333",
    ]


def test_cell_text(spark):
    rows = spark.createDataFrame([("a", None), (None, None), (None, "3"), ("x", "y"), ("", None)], "v string, r string")
    out = [r[0] for r in rows.select(C.cell_text(F.col("v"), F.col("r"))).collect()]
    assert out == ["a", "", "3", "y", ""]


def test_split_address(spark):
    cases = {
        "A1": ("A", 1),
        "AA10": ("AA", 10),
        "A01": ("A", 1),
        "ABC": ("ABC", None),
        "12": ("", 12),
        "$A$1": ("$A$", None),
        "B2x3": ("Bx", 23),
        "A1.5": ("A.", 1),
    }
    assert [tuple(x) for x in mapped(spark, C.split_address, cases)] == list(cases.values())


def test_column_order(spark):
    labels = ["AA", "B", "Z", "A", "AZ", "BA", "b", "AAA"]
    keys = mapped(spark, C.column_order, labels)
    assert [x for _, x in sorted(zip(keys, labels))] == ["A", "b", "B", "Z", "AA", "AZ", "BA", "AAA"]
