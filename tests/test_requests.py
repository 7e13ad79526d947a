import json

import pytest
from pyspark.sql import functions as F

from docspark.operators import requests as rq
from docspark.operators import results as rs
from docspark.streaming import triage as triage_module
from docspark.streaming.triage import REQUEST_SCHEMA, batch_triage, stream_triage


def asked(spark, *requests):
    names = [f.split()[0] for f in REQUEST_SCHEMA.split(", ")]
    rows = [tuple({"request_id": i, "file_path": "/a.docx", **r}.get(n) for n in names) for i, r in enumerate(requests)]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def errors(df):
    return [r.error and (r.error.code, r.error.message) for r in df.orderBy("request_id").collect()]


@pytest.mark.parametrize(
    "tool, filled",
    [
        ("convert_excel_to_images", {"dpi": 150.0, "keep_pdf": False}),
        ("convert_word_to_images", {"dpi": 150.0, "keep_pdf": False}),
        ("convert_pdf_to_images", {"dpi": 150.0}),
        ("extract_excel_text", {"dpi": 150.0}),
        ("extract_word_text", {"format": "markdown"}),
        ("convert_pdf_images_to_markdown", {"dpi": 150.0, "merge_pages": True, "preserve_page_headings": True}),
        ("render_document", {"dpi": 150.0, "output_mode": "images"}),
        ("get_capabilities", {}),
    ],
)
def test_defaults(spark, tool, filled):
    row = rq.apply_defaults(asked(spark, {"tool": tool})).first().asDict()
    assert {k: row[k] for k in rq.DEFAULTS if row[k] is not None} == filled


def test_given_values_stay_and_foreign_fields_go(spark):
    row = rq.apply_defaults(
        asked(spark, {"tool": "extract_excel_text", "dpi": 300.0, "keep_pdf": True, "sheet_names": ["S"], "format": "x"})
    ).first()
    assert (row.dpi, row.keep_pdf, row.sheet_names, row.format) == (300.0, None, ["S"], None)


def test_validation(spark):
    bad_dpi = ("INVALID_TOOL_INPUT", "dpi must be an integer from 72 to 600")
    cases = [
        ({"tool": "convert_pdf_to_images", "dpi": 72.0}, None),
        ({"tool": "convert_pdf_to_images", "dpi": 600.0}, None),
        ({"tool": "convert_pdf_to_images", "dpi": 71.0}, bad_dpi),
        ({"tool": "convert_pdf_to_images", "dpi": 601.0}, bad_dpi),
        ({"tool": "convert_pdf_to_images", "dpi": 150.5}, bad_dpi),
        ({"tool": "convert_pdf_to_images", "dpi": float("nan")}, bad_dpi),
        ({"tool": "extract_word_text", "dpi": 1.0}, None),
        ({"tool": "extract_word_text", "format": "html"}, ("INVALID_TOOL_INPUT", "format must be one of text, markdown")),
        ({"tool": "render_document", "output_mode": "all"}, None),
        (
            {"tool": "render_document", "output_mode": "video"},
            ("INVALID_TOOL_INPUT", "outputMode must be one of images, text, markdown, all"),
        ),
        ({"tool": "print", "file_path": None}, ("INVALID_TOOL_INPUT", "Unknown tool: print")),
        ({"tool": None}, ("INVALID_TOOL_INPUT", "Unknown tool: ")),
        ({"tool": "extract_excel_text", "file_path": None}, ("INVALID_TOOL_INPUT", "filePath is required")),
        ({"tool": "extract_excel_text", "file_path": ""}, None),
        ({"tool": "get_capabilities", "file_path": None}, None),
    ]
    assert errors(rq.validate_requests(asked(spark, *[c for c, _ in cases]))) == [e for _, e in cases]


def test_triage_order(spark):
    files = spark.createDataFrame([("/a.docx",), ("/a.docx",), ("/b.doc",)], "path string")
    docx_only = "Only .docx files are supported for text extraction. Received: "
    cases = [
        ({"tool": "extract_word_text"}, None),
        ({"tool": "extract_word_text", "file_path": "/b.doc"}, ("UNSUPPORTED_FORMAT", f"{docx_only}/b.doc")),
        ({"tool": "extract_word_text", "file_path": "/c.doc"}, ("UNSUPPORTED_FORMAT", f"{docx_only}/c.doc")),
        ({"tool": "extract_word_text", "file_path": "/c.docx"}, ("FILE_NOT_FOUND", "File not found: /c.docx")),
        (
            {"tool": "extract_word_text", "file_path": "/c.doc", "format": "x"},
            ("INVALID_TOOL_INPUT", "format must be one of text, markdown"),
        ),
        ({"tool": "convert_pdf_to_images", "file_path": "/b.doc"}, None),
        ({"tool": "convert_pdf_to_images", "file_path": "/no.pdf"}, ("FILE_NOT_FOUND", "File not found: /no.pdf")),
        (
            {"tool": "extract_excel_text", "file_path": "/no", "dpi": 1.0},
            ("INVALID_TOOL_INPUT", "dpi must be an integer from 72 to 600"),
        ),
        ({"tool": "get_capabilities", "file_path": None}, None),
    ]
    judged = rq.triage(asked(spark, *[c for c, _ in cases]), files)
    assert errors(judged) == [e for _, e in cases]
    good, bad = rq.split_errors(judged, "request_id")
    assert good.count() == 3 and "error" not in good.columns
    assert {r.key for r in bad.collect()} == {str(i) for i, (_, e) in enumerate(cases) if e}
    exists = rq.check_exists(asked(spark, *[c for c, _ in cases]), files)
    assert [e and e[0] for e in errors(exists)] == [None, None] + ["FILE_NOT_FOUND"] * 3 + [None] + ["FILE_NOT_FOUND"] * 2 + [None]


def test_stream_equals_batch_and_handles_only_what_is_new(spark, folder):
    files = spark.createDataFrame([("/a.docx",)], "path string")
    first = asked(spark, {"tool": "extract_word_text"}, {"tool": "extract_word_text", "file_path": "/b.docx"}, {"tool": "x"})
    second = asked(spark, {"tool": "convert_pdf_to_images", "request_id": 9, "file_path": "/a.pdf"})
    where = [f"{folder}/{x}" for x in ("in", "out", "checkpoint")]
    for arriving in (first, second):
        arriving.write.mode("append").parquet(where[0])
        stream_triage(spark, *where, files).awaitTermination()
    out = spark.read.parquet(where[1])
    batch = rq.triage(first.unionByName(second), files)
    assert errors(out) == errors(batch) and out.count() == 4
    assert [r.category for r in out.orderBy("request_id").collect()] == ["word", "word", "word", "pdf"]


def test_a_batch_that_runs_again_gives_no_row_twice(spark, folder):
    files = spark.createDataFrame([("/a.docx",)] * 3, "path string")
    requests = asked(spark, {"tool": "extract_word_text"}, {"tool": "x"})
    handle = batch_triage(files, folder)
    for number in (0, 0, 1, 1, 0):
        handle(requests, number)
    out = spark.read.parquet(folder)
    assert out.count() == 4 and sorted(r.batch for r in out.collect()) == [0, 0, 1, 1]


def test_a_failed_stream_goes_on_without_rows_twice(spark, folder, monkeypatch):
    files = spark.createDataFrame([("/a.docx",)], "path string")
    where = [f"{folder}/{x}" for x in ("in", "out", "checkpoint")]
    asked(spark, {"tool": "extract_word_text"}, {"tool": "x"}).write.parquet(where[0])
    whole = triage_module.batch_triage

    def failing(*given):
        handle = whole(*given)

        def fails_after_writing(requests, number):
            handle(requests, number)
            raise RuntimeError("lost")

        return fails_after_writing

    monkeypatch.setattr(triage_module, "batch_triage", failing)
    with pytest.raises(Exception, match="lost"):
        stream_triage(spark, *where, files).awaitTermination()
    monkeypatch.undo()
    stream_triage(spark, *where, files).awaitTermination()
    assert spark.read.parquet(where[1]).count() == 2


def test_helper_results(spark):
    failed = "Python UNO conversion failed"
    invalid = "Python UNO helper returned invalid JSON"
    cases = [
        (' {"ok":true,"pdfPath":"/tmp/o.pdf","renderStrategy":"s","sheetCount":2}\n', (True, "/tmp/o.pdf", "s", 2), None),
        ('{"ok":1}', (True, None, None, None), None),
        ('{"ok":"false"}', (True, None, None, None), None),
        ("not-json", None, (invalid, {"stdout": "not-json", "stderr": "oops", "exitCode": "1"})),
        ("", None, (invalid, {"stdout": "", "stderr": "oops", "exitCode": "1"})),
        ("null", None, (invalid, {"stdout": "null", "stderr": "oops", "exitCode": "1"})),
        ("[]", None, (failed, {})),
        ('{"ok":false,"error":{"code":"UNO","message":"failed"}}', None, ("failed", {"errorCode": "UNO"})),
        ('{"ok":false}', None, (failed, {})),
        ('{"ok":0}', None, (failed, {})),
        ('{"ok":0.0}', None, (failed, {})),
        ('{"ok":""}', None, (failed, {})),
        ('{"ok":null,"error":{"message":null,"code":"X"}}', None, (failed, {"errorCode": "X"})),
        ('{"ok":[]}', (True, None, None, None), None),
    ]
    df = spark.createDataFrame([(i, c[0], "oops", 1) for i, c in enumerate(cases)], "i int, stdout string, stderr string, exit_code int")
    rows = rs.parse_helper_results(df, "stdout").orderBy("i").collect()
    for (text, result, error), row in zip(cases, rows):
        assert (row.result and tuple(row.result)) == result, text
        assert (row.error and (row.error.message, row.error.context)) == error, text
        assert not row.error or row.error.code == "LIBREOFFICE_UNO_CONVERSION_FAILED"


def test_envelope_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([(1, "word", None, 'a "b"\n'), (2, "excel", 3, "")], "id int, kind string, n int, content string")
    out = rs.result_envelope(df, {"sourceType": "kind", "pageCount": "n", "content": "content"}, ["id"]).orderBy("id").collect()
    assert [json.loads(r.text) for r in out] == [
        {"sourceType": "word", "content": 'a "b"\n'},
        {"sourceType": "excel", "pageCount": 3, "content": ""},
    ]
    assert out[0].structured.pageCount is None


def test_format_choice_and_pdf_path(spark):
    df = spark.createDataFrame([(1, "plain text", "# markdown", "text"), (2, "t", "m", "markdown")], "id int, text string, markdown string, f string")
    assert [r.content for r in rs.select_format(df, F.col("f")).orderBy("id").collect()] == ["plain text", "m"]
    row = rs.select_format(df, "markdown").first()
    assert (row.source_type, row.text_format) == ("word", "markdown")
    kept = spark.createDataFrame([(True, "/p"), (False, "/p"), (None, "/p")], "k boolean, p string")
    assert [r[0] for r in kept.select(rq.coalesce_pdf_path(F.col("k"), F.col("p"))).collect()] == ["/p", None, None]
