"""Workbooks (.xlsx) to tables of sheets, cells, merged ranges and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import errors
from docspark.functions.dates import is_date_format, serial_date
from docspark.functions.formulas import formula_tokens, shared_formula
from docspark.functions.text import js_number
from docspark.operators.grid import filter_sheets
from docspark.session import write_and_read
from docspark.sources.archive import (
    XML_OPTIONS,
    archive_blocks,
    archive_index,
    part_blocks,
    without_failed,
)

SHEET_PART = r"xl/worksheets/[^/]+\.xml"
STRINGS_PART = "xl/sharedStrings.xml"
HEAD = {
    r"xl/workbook\.xml": ["sheet", "workbookPr"],
    r"xl/_rels/workbook\.xml\.rels": ["Relationship"],
    r"xl/styles\.xml": ["numFmts", "cellXfs"],
}
BODY = {r"xl/sharedStrings\.xml": ["si"], SHEET_PART: ["row", "mergeCell"]}
REQUIRED_PART = "xl/workbook.xml"

_RICH = "t:string,r:array<struct<t:string>>"
_CELL = (
    "struct<_r:string,_t:string,_s:int,f:struct<_VALUE:string,_t:string,_si:string>,v:string,"
    f"is:struct<{_RICH}>>"
)

# Value type codes of cells, as text.
NUMBER_TYPE = "2"
STRING_TYPE = "3"
DATE_TYPE = "4"
FORMULA_TYPE = "6"
RICH_TEXT_TYPE = "8"
BOOLEAN_TYPE = "9"
ERROR_TYPE = "10"


@dataclass(frozen=True)
class WorkbookTables:
    """``sheets``, ``cells`` and ``merges`` of readable files, ``errors`` for the others."""

    sheets: DataFrame
    cells: DataFrame
    merges: DataFrame
    errors: DataFrame


def extract_workbook_cells(files: DataFrame, requests: DataFrame | None = None) -> WorkbookTables:
    """Open every workbook in ``files`` (``path``, and ``content`` if it is at hand).

    Without ``content`` files are read by path in two phases: what is in each workbook
    first, then the sheets that ``requests`` (``doc``, ``sheet_names``; all without it) ask
    for, each in a task of its own. Other sheets are never inflated.

    Cells keep their address, text, formula and type code; numbers are printed
    without exponent or trailing zeros, and numbers in a date format as ISO dates, formula
    results too. Each cell of a shared formula has its own, with references moved along. A
    file that cannot be read gives one error row and no others.
    """
    if "content" in files.columns:
        blocks = archive_blocks(files, HEAD | BODY, REQUIRED_PART, "workbooks")
        sheets = _asked(_sheets(blocks), requests)
        return _tables(blocks, blocks, sheets, blocks.where("element = 'error'"))
    index = archive_index(files, HEAD, [*BODY], REQUIRED_PART, "workbook-index")
    sheets = _asked(_sheets(index), requests)
    present = index.where("element = 'part'").select("path", "part", F.col("start").alias("size"))
    named = present.join(sheets.select(F.col("doc").alias("path"), "part"), ["path", "part"], "left_semi")
    strings = present.where(F.col("part") == STRINGS_PART).join(named, "path", "left_semi")
    body = part_blocks(named.unionByName(strings), BODY, "workbook-parts")
    late = body.where("element = 'error'")
    return _tables(
        without_failed(index, late), body, without_failed(sheets.withColumnRenamed("doc", "path"), late).withColumnRenamed("path", "doc"),
        index.where("element = 'error'").unionByName(late),
    )


def _asked(sheets: DataFrame, requests: DataFrame | None) -> DataFrame:
    return sheets if requests is None else filter_sheets(sheets, requests)


def _tables(head: DataFrame, body: DataFrame, sheets: DataFrame, failed: DataFrame) -> WorkbookTables:
    # one error a file, whichever of its parts failed
    first = failed.groupBy("path").agg(F.min_by("message", F.coalesce("part", F.lit(""))).alias("message"))
    return WorkbookTables(
        sheets.select("doc", "sheet", "sheet_ord"),
        _cells(head, body, sheets),
        _merges(body, sheets),
        _errors(first),
    )


def _elements(blocks: DataFrame, element: str, schema: str, *keep: str) -> DataFrame:
    """Parse blocks of one kind: a row per element with its position ``ord`` in the part.

    The outer form of explode keeps Spark from adding a filter on the array, which
    would parse every block twice.
    """
    parsed = F.from_xml("xml", f"{element} array<{schema}>", XML_OPTIONS)
    return (
        blocks.filter(F.col("element") == element)
        .select(*keep, "start", parsed[element].alias("_list"))
        .select(*keep, "start", F.posexplode_outer("_list").alias("_at", "item"))
        .filter("_at IS NOT NULL")
        .select(*keep, (F.col("start") + F.col("_at")).cast("int").alias("ord"), "item")
    )


def _sheets(blocks: DataFrame) -> DataFrame:
    """Worksheets in workbook order with the part that holds each."""
    named = _elements(blocks, "sheet", "struct<_name:string,_id:string>", "path").select(
        "path", F.col("item._name").alias("sheet"), F.col("item._id").alias("rel"), F.col("ord").alias("sheet_ord")
    )
    target = F.col("item._Target")
    part = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(
        F.concat(F.lit("xl/"), target)
    )
    linked = (
        _elements(blocks, "Relationship", "struct<_Id:string,_Target:string>", "path")
        .select("path", F.col("item._Id").alias("rel"), part.alias("part"))
        .filter(F.col("part").rlike(f"^{SHEET_PART}$"))
    )
    return named.join(linked, ["path", "rel"]).select(
        F.col("path").alias("doc"), "sheet", "sheet_ord", "part"
    )


def _date_styles(head: DataFrame) -> DataFrame:
    """``path, dates, since_1904``: for each style of a workbook whether it shows a date.

    A workbook has at most some 65,000 styles, fixed by its format.
    """
    formats = F.from_xml(
        "xml", "numFmts struct<numFmt:array<struct<_numFmtId:int,_formatCode:string>>>", XML_OPTIONS
    )["numFmts"]["numFmt"]
    codes = (
        head.filter(F.col("element") == "numFmts")
        .select("path", F.explode(formats).alias("f"))
        .select("path", F.col("f._numFmtId").alias("format"), F.col("f._formatCode").alias("code"))
        .groupBy("path", "format")
        .agg(F.max("code").alias("code"))
    )
    styles = F.from_xml("xml", "cellXfs struct<xf:array<struct<_numFmtId:int>>>", XML_OPTIONS)["cellXfs"]["xf"]
    used = (
        head.filter(F.col("element") == "cellXfs")
        .select("path", F.posexplode(styles).alias("style", "xf"))
        .select("path", "style", F.coalesce("xf._numFmtId", F.lit(0)).alias("format"))
    )
    is_date = F.coalesce(is_date_format(F.col("format"), F.col("code")), F.lit(False))
    in_order = F.sort_array(F.collect_list(F.struct("style", is_date.alias("is_date"))))
    dates = used.join(codes, ["path", "format"], "left").groupBy("path").agg(in_order.alias("dates"))
    system = _elements(head, "workbookPr", "struct<_date1904:string>", "path").select(
        "path", F.col("item._date1904").isin("1", "true", "on").alias("since_1904")
    )
    return (
        dates.select("path", F.transform("dates", lambda x: x["is_date"]).alias("dates"))
        .join(system.groupBy("path").agg(F.max("since_1904").alias("since_1904")), "path", "full")
    )


def _in_sheets(blocks: DataFrame, element: str, sheets: DataFrame, *more: str) -> DataFrame:
    """Sheet blocks with their sheet's name: joined as blocks, before rows multiply."""
    names = sheets.select(F.col("doc").alias("path"), "part", "sheet", "sheet_ord", *more)
    return blocks.filter(F.col("element") == element).join(names, ["path", "part"])


def _rich_text(item: str) -> Column:
    """Plain text, or all runs of rich text one after another."""
    runs = F.array_join(F.transform(f"{item}.r", lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return F.coalesce(F.col(f"{item}.t"), runs)


def _cells(head: DataFrame, body: DataFrame, sheets: DataFrame) -> DataFrame:
    styles = _date_styles(head).withColumnRenamed("path", "doc")
    rows = _elements(
        _in_sheets(body, "row", sheets.join(styles, "doc", "left"), "dates", "since_1904"),
        "row",
        f"struct<c:array<{_CELL}>>",
        "path",
        "sheet",
        "sheet_ord",
        "dates",
        "since_1904",
    )
    raw = rows.select(
        "path",
        "sheet",
        "sheet_ord",
        F.col("ord").alias("row_ord"),
        "dates",
        "since_1904",
        F.posexplode_outer("item.c").alias("cell_ord", "c"),
    ).filter("cell_ord IS NOT NULL")
    kind = F.coalesce("c._t", F.lit("n"))
    # the styles' list ends here: a cell knows whether it shows a date, and how
    shows_date = F.coalesce((kind == "n") & F.get("dates", F.coalesce("c._s", F.lit(0))), F.lit(False))
    date = F.when(shows_date, serial_date(F.col("c.v"), F.coalesce("since_1904", F.lit(False))))
    # cells without a shared string get keys of their own below zero, so that they
    # spread over all tasks of the join and match nothing
    index = F.when(kind == "s", F.col("c.v").try_cast("bigint"))
    nowhere = -1 - F.pmod(F.xxhash64("path", "sheet", "row_ord", "cell_ord"), F.lit(1 << 40))
    keyed = raw.withColumns({"kind": kind, "index": F.coalesce(index, nowhere), "date": date}).drop("dates", "since_1904")
    strings = _elements(body, "si", f"struct<{_RICH}>", "path").select(
        "path",
        F.col("ord").cast("bigint").alias("index"),
        _rich_text("item").alias("shared"),
        F.col("item.r").isNotNull().alias("is_rich"),
    )
    v = F.col("c.v")
    text = (
        F.when(F.col("kind") == "s", F.col("shared"))
        .when(F.col("kind") == "inlineStr", _rich_text("c.is"))
        .when(F.col("kind") == "b", F.when(v == "1", "true").when(v == "0", "false"))
        .when(F.col("kind") == "n", F.coalesce("date", js_number(v), v))
        .otherwise(v)
    )
    # says where text is, without making it
    has_text = (
        F.when(F.col("kind") == "s", F.col("shared").isNotNull())
        .when(F.col("kind") == "inlineStr", F.col("c.is.t").isNotNull() | F.col("c.is.r").isNotNull())
        .when(F.col("kind") == "b", v.isin("0", "1"))
        .otherwise(v.isNotNull())
    )
    has_formula = F.col("c.f").isNotNull()
    code = (
        F.when(has_formula, FORMULA_TYPE)
        .when(F.col("is_rich") | F.col("c.is.r").isNotNull(), RICH_TEXT_TYPE)
        .when(F.col("kind") == "b", BOOLEAN_TYPE)
        .when(F.col("kind") == "e", ERROR_TYPE)
        .when(F.col("date").isNotNull(), DATE_TYPE)
        .when(F.col("kind") == "n", NUMBER_TYPE)
        .otherwise(STRING_TYPE)
    )
    cells = keyed.join(strings, ["path", "index"], "left").select(
        F.col("path").alias("doc"),
        "sheet",
        "sheet_ord",
        "row_ord",
        "cell_ord",
        F.col("c._r").alias("address"),
        F.when(~has_formula, text).alias("value"),
        F.when(has_formula, text).alias("result"),
        F.col("c.f._VALUE").alias("formula"),
        code.alias("type"),
        has_text.alias("_has_text"),
        # cells that follow no other get numbers of their own, as strings' cells do above
        F.coalesce(
            F.when((F.col("c.f._t") == "shared") & F.col("c.f._VALUE").isNull(), F.col("c.f._si")),
            F.concat(F.lit("-"), F.xxhash64("path", "sheet", "row_ord", "cell_ord").cast("string")),
        ).alias("_si"),
    )
    # written, so that Spark may split the cells of a formula that a third of all follow
    firsts = write_and_read(_shared_formulas(body, sheets), "shared-formulas")
    followed = cells.join(firsts, ["doc", "sheet", "_si"], "left")
    own = F.coalesce("formula", F.when(F.col("_tokens").isNotNull(), shared_formula(F.col("_tokens"), F.col("_first"), F.col("address"))))
    return followed.withColumn("formula", own).filter(F.col("_has_text") | F.col("formula").isNotNull()).drop(
        "_has_text", "_si", "_tokens", "_first"
    )


def _shared_formulas(body: DataFrame, sheets: DataFrame) -> DataFrame:
    """``doc, sheet, _si, _first, _tokens``: where a shared formula is written down, once a sheet and number."""
    written = _in_sheets(body, "row", sheets).filter(F.contains("xml", F.lit("shared")))
    cell = "struct<_r:string,f:struct<_VALUE:string,_t:string,_si:string>>"
    found = (
        _elements(written, "row", f"struct<c:array<{cell}>>", "path", "sheet")
        .select(F.col("path").alias("doc"), "sheet", F.explode("item.c").alias("c"))
        .where("c.f._t = 'shared' and c.f._VALUE is not null and c.f._si is not null")
        .groupBy("doc", "sheet", F.col("c.f._si").alias("_si"))
        .agg(F.min_by(F.struct(F.col("c._r").alias("r"), F.col("c.f._VALUE").alias("f")), F.col("c._r")).alias("w"))
    )
    return found.select("doc", "sheet", "_si", F.col("w.r").alias("_first"), formula_tokens(F.col("w.f")).alias("_tokens"))


def _merges(blocks: DataFrame, sheets: DataFrame) -> DataFrame:
    return _elements(
        _in_sheets(blocks, "mergeCell", sheets), "mergeCell", "struct<_ref:string>", "path", "sheet"
    ).select(
        F.col("path").alias("doc"), "sheet", F.col("ord").alias("merge_ord"), F.col("item._ref").alias("ref")
    )


def _errors(failed: DataFrame) -> DataFrame:
    error = errors.error(
        errors.EXCEL_TEXT_EXTRACTION_FAILED,
        F.concat(F.lit(errors.EXCEL_READ_PREFIX), F.col("message")),
        filePath=F.col("path"),
    )
    return failed.select(F.col("path").alias("key"), error.alias("error"))
