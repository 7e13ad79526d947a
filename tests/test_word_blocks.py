"""Blocks of Word texts, as they are cut from archives."""

import io
import zipfile

from docspark.sources import docx
from docspark.sources.archive import archive_blocks


def test_runs_come_in_groups(spark):
    """Tags are replaced in the pass that cuts blocks: wrappers and empty links go, links are groups."""
    body = (
        '<w:p><w:pPr><w:tabs/></w:pPr><w:ins w:id="1"><w:r><w:rPr><w:b w:val="true"/><w:i/><w:bCs/></w:rPr><w:tab/></w:r></w:ins>'
        '<w:hyperlink r:id="x"><w:r><w:t>a</w:t></w:r></w:hyperlink><w:hyperlink r:id="y"/></w:p><w:p/>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="w" xmlns:r="r"><w:body>{body}</w:body></w:document>')
        archive.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="x" Target="https://a.b"/></Relationships>')
    files = spark.createDataFrame([("a.docx", bytearray(out.getvalue()))], "path string, content binary")
    blocks = archive_blocks(files, docx.PARTS, docx.REQUIRED_PART, "docx")
    assert [r.xml for r in blocks.where("element = 'i'").collect()] == [
        '<b><i k="p"><w:p><g><w:pPr><w:tabs/></w:pPr><w:r><w:rPr><b>1</b><i>1</i><w:bCs/></w:rPr><t>&#9;</t></w:r>'
        '</g><g r:id="x"><w:r><w:t>a</w:t></w:r></g><g></g></w:p></i><i k="p"><w:p/></i></b>'
    ]
    (found,) = docx.extract_docx(files).documents.collect()
    assert found.text == "\ta\n\n\n\n"
    assert found.markdown == "**_\t_**[a](https://a.b)\n\n\n\n"


def test_xml_is_shuffled_once(spark):
    """By document: not to leave out files that failed, to meet list numbers, nor to fold texts."""

    def word(rels):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>a</w:t></w:r></w:p></w:document>')
            archive.writestr("word/_rels/document.xml.rels", rels)
        return bytearray(out.getvalue())

    for broken in ([], [("b.docx", word("<Relationships>"))]):
        files = spark.createDataFrame([("a.docx", word("<Relationships/>")), *broken], "path string, content binary")
        found = docx.extract_docx(files)
        plan = found.documents._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_COL" in line]
        assert len(sent) == 2 and plan.count("SortMergeJoin") > 0  # of the XML, and of numbers and links
        assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftAnti" in line]
        assert [tuple(r) for r in found.documents.collect()] == [("a.docx", 1, 1, "a\n\n", "a\n\n")]
        assert [r.key for r in found.errors.collect()] == [path for path, _ in broken]
