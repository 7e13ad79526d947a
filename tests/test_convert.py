from docspark.operators.ordering import Splitting
from docspark.plans.convert import convert_results


def test_results_and_errors(spark):
    columns = "request_id long, tool string, file_path string, dpi double, keep_pdf boolean, format string, output_mode string"
    rows = [
        (1, "convert_excel_to_images", "/a.xlsx", None, True, None, None),
        (2, "convert_excel_to_images", "/a.xlsx", None, None, None, None),
        (3, "convert_word_to_images", "/b.docx", None, True, None, None),
        (4, "convert_pdf_to_images", "/c.pdf", 300.0, None, None, None),
        (5, "convert_pdf_to_images", "/c.pdf", 20.0, None, None, None),
        (6, "convert_pdf_to_images", "/gone.pdf", None, None, None, None),
        (7, "convert_excel_to_images", "/a.xlsx", None, None, None, None),
        (8, "convert_word_to_images", "/b.docx", None, None, None, None),
        (9, "extract_word_text", "/b.docx", None, None, None, None),
    ]
    requests = spark.createDataFrame(rows, columns)
    files = spark.createDataFrame([("/a.xlsx",), ("/b.docx",), ("/c.pdf",)], "path string")
    helper = [
        (1, "/out/1.pdf", '{"ok":true,"pdfPath":"/uno/1.pdf"}', "", 0),
        (2, "/out/2.pdf", None, "", 0),
        (3, "/out/3.pdf", None, "", 0),
        (7, "/out/7.pdf", '{"ok":false,"error":{"code":"UNO","message":"failed"}}', "", 1),
    ]
    converted = spark.createDataFrame(helper, "request_id long, pdf_path string, stdout string, stderr string, exit_code int")
    shots = [(i, f"/img/{i}/page-{n}.png") for i in (1, 2, 3, 4, 5, 6, 7) for n in (2, 1)]
    images = spark.createDataFrame(shots, "request_id long, image_path string")
    for how in (None, Splitting(slices=8, min_rows=1)):
        results, errors = convert_results(requests, files, converted, images, how=how)
        found = {r.request_id: r.text for r in results.collect()}
        pages = lambda i: f'"images":["/img/{i}/page-1.png","/img/{i}/page-2.png"],"pageCount":2'
        assert found == {
            1: f'{{"sourceType":"excel","pdfPath":"/uno/1.pdf",{pages(1)},"renderStrategy":"libreoffice-uno-print-area"}}',
            2: f'{{"sourceType":"excel",{pages(2)},"renderStrategy":"libreoffice-cli"}}',
            3: f'{{"sourceType":"word","pdfPath":"/out/3.pdf",{pages(3)}}}',
            4: f'{{"sourceType":"pdf",{pages(4)}}}',
        }
        assert {r.key: r.error.code for r in errors.collect()} == {
            "5": "INVALID_TOOL_INPUT",
            "6": "FILE_NOT_FOUND",
            "7": "LIBREOFFICE_UNO_CONVERSION_FAILED",
            "8": "PDF_RENDER_FAILED",
        }
