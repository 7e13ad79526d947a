import pytest

from docspark.operators import pages as pg
from docspark.operators.ordering import Splitting

HOT = Splitting(slices=8, min_rows=4)
PAGES = "doc string, image_path string, content string"


def whole(parts):
    out = {}
    for p in sorted(parts.collect(), key=lambda p: p.part_no):
        out[p.doc] = out.get(p.doc, "") + p.content
    return out


@pytest.fixture(scope="module")
def pages(spark):
    data = [("two", f"/tmp/out/page-{i}.png", f"# Page {i} content") for i in (2, 1)]
    data.append(("one", "/tmp/out/page-1.png", "# Single page"))
    data += [("many", f"/m/page-{i:03d}.png", f"text {i}") for i in range(60, 0, -1)]
    data.append(("none", "/n/page-1.png", None))
    return spark.createDataFrame(data, PAGES).repartition(3)


@pytest.mark.parametrize("how", [Splitting(), HOT])
@pytest.mark.parametrize("part_bytes", [20, 1 << 20])
def test_assembly(pages, how, part_bytes):
    got = whole(pg.assemble_pages(pages, part_bytes=part_bytes, how=how))
    assert got["two"] == "## Page 1\n\n# Page 1 content\n\n## Page 2\n\n# Page 2 content"
    assert got["one"] == "# Single page"
    assert got["none"] == ""
    assert got["many"] == "\n\n".join(f"## Page {i}\n\ntext {i}" for i in range(1, 61))


@pytest.mark.parametrize("how", [Splitting(), HOT])
def test_assembly_options(pages, how):
    plain = whole(pg.assemble_pages(pages, headings=False, how=how))
    assert plain["two"] == "# Page 1 content\n\n# Page 2 content"
    single = {(r.doc, r.page_no): r.content for r in pg.assemble_pages(pages, merge=False, how=how).collect()}
    assert single["two", 2] == "## Page 2\n\n# Page 2 content" and single["one", 1] == "# Single page"
    bare = pg.assemble_pages(pages, merge=False, headings=False, how=how).collect()
    assert {(r.doc, r.page_no): r.content for r in bare}["many", 60] == "text 60"


def test_numbers_follow_path_order(spark):
    pages = spark.createDataFrame([("d", f"page-{i}.png", "x") for i in (1, 2, 10)], PAGES)
    got = {r.image_path: r.page_no for r in pg.number_pages(pages).collect()}
    assert got == {"page-1.png": 1, "page-10.png": 2, "page-2.png": 3}


@pytest.mark.parametrize("how", [Splitting(), HOT])
def test_manifest(spark, pages, how):
    documents = spark.createDataFrame([("two",), ("blank",), ("many",)], "doc string")
    got = {}
    for r in sorted(pg.page_manifest(documents, pages, part_rows=7, how=how).collect(), key=lambda r: r.part_no):
        got.setdefault(r.doc, []).append(r)
    assert got["two"][0].images == ["/tmp/out/page-1.png", "/tmp/out/page-2.png"]
    assert got["two"][0].page_count == 2 and got["two"][0].error is None
    assert sum((r.images for r in got["many"]), []) == [f"/m/page-{i:03d}.png" for i in range(1, 61)]
    assert {r.page_count for r in got["many"]} == {60} and len(got["many"]) > 1
    (blank,) = got["blank"]
    assert blank.images is None and blank.page_count == 0
    assert (blank.error.code, blank.error.message) == ("PDF_RENDER_FAILED", "No images were generated from PDF")


def test_responses_and_failures(spark):
    data = [
        ("good", "p1", "  # Hello  ", None),
        ("good", "p2", " \n ", None),
        ("empty", "p1", "fine", None),
        ("empty", "p3", "", None),
        ("empty", "p2", None, None),
        ("failed", "p2", "", None),
        ("failed", "p1", "text", "Error: boom"),
    ]
    replies = pg.normalise_responses(spark.createDataFrame(data, f"{PAGES}, call_error string"))
    kept, failures = pg.fail_whole_document(replies)
    assert {(r.doc, r.image_path, r.content) for r in kept.collect()} == {("good", "p1", "# Hello"), ("good", "p2", "")}
    errors = {r.key: r.error for r in failures.collect()}
    assert set(errors) == {"empty", "failed"}
    assert errors["empty"].message == "No Markdown content received from GitHub Copilot"
    assert errors["empty"].context is None
    assert errors["failed"].message == "GitHub Copilot SDK failed to convert image to Markdown"
    assert errors["failed"].context == {"message": "Error: boom"}
    assert {e.code for e in errors.values()} == {"COPILOT_MARKDOWN_FAILED"}
