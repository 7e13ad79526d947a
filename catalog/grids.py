"""Queries on cells, sheets and their Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.operators import grid
from docspark.operators.ordering import Splitting

QUERIES = {}
ORACLE = {}
# Cuts every sheet that holds more than 1/16 of the cells, so that slices show at test size.
FINE = Splitting(slices=64, min_rows=50)


def _query(name, select):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = f"WITH {si.CELLS_SQL} {select}"
        return fn

    return keep


@_query(
    "drop_empty_cells",
    "SELECT doc, sheet, row_ord, cell_ord, address, type FROM cells_in"
    " WHERE NOT (value IS NULL AND result IS NULL AND formula IS NULL)",
)
def drop_empty_cells(spark, sf_dir):
    return grid.drop_empty_cells(si.cells(spark, sf_dir)).select(
        "doc", "sheet", "row_ord", "cell_ord", "address", "type"
    )


@_query(
    "filter_sheets",
    """SELECT doc, sheet, row_ord, cell_ord, address FROM cells_in JOIN nation ON doc = concat('nation-', n_nationkey)
    WHERE n_nationkey % 3 < 2 OR sheet IN ('BUILDING', 'MACHINERY')""",
)
def filter_sheets(spark, sf_dir):
    asked = si.table(spark, sf_dir, "nation").selectExpr(
        "concat('nation-', n_nationkey) AS doc",
        """CASE n_nationkey % 3 WHEN 1 THEN cast(array() AS array<string>)
           WHEN 2 THEN array('BUILDING', 'MACHINERY') END AS sheet_names""",
    )
    return grid.filter_sheets(si.cells(spark, sf_dir), asked).select(
        "doc", "sheet", "row_ord", "cell_ord", "address"
    )


@_query(
    "dedupe_cells",
    "SELECT doc, sheet, address, row_ord, cell_ord, value, result FROM ("
    " SELECT *, row_number() OVER (PARTITION BY doc, sheet, address ORDER BY row_ord DESC, cell_ord DESC) AS newest"
    " FROM cells_in) WHERE newest = 1",
)
def dedupe_cells(spark, sf_dir):
    return grid.dedupe_cells(si.cells(spark, sf_dir)).select(
        "doc", "sheet", "address", "row_ord", "cell_ord", "value", "result"
    )


@_query(
    "sheet_axes",
    """SELECT c.doc, c.sheet, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, c.columns, r.row_numbers FROM
    (SELECT doc, sheet, string_agg(col, ',' ORDER BY col_no) AS columns FROM sheet_cols GROUP BY doc, sheet) c
    JOIN (SELECT doc, sheet, string_agg(rn, ',' ORDER BY rn) AS row_numbers FROM sheet_rows GROUP BY doc, sheet) r
    ON r.doc = c.doc AND r.sheet = c.sheet""",
)
def sheet_axes(spark, sf_dir):
    return grid.sheet_axes(si.cells(spark, sf_dir)).select(
        "doc",
        "sheet",
        "part_no",
        "part_count",
        F.array_join("columns", ",").alias("columns"),
        F.array_join("row_numbers", ",").alias("row_numbers"),
    )


@_query("mark_header", "SELECT doc, sheet, rn, is_header FROM sheet_rows")
def mark_header(spark, sf_dir):
    return grid.mark_header(grid.row_axis(si.cells(spark, sf_dir)))


@_query(
    "densify_grid",
    "SELECT doc, sheet, rn, is_header, CAST(col_no AS INTEGER) AS col_no, col, text FROM dense",
)
def densify_grid(spark, sf_dir):
    return grid.densify_grid(si.sheets(spark, sf_dir), si.cells(spark, sf_dir))


_SHEETS = "SELECT doc, sheet, sheet_ord, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, markdown FROM sheet_texts"


@_query("grid_to_markdown", _SHEETS)
def grid_to_markdown(spark, sf_dir):
    return grid.grid_to_markdown(
        si.sheets(spark, sf_dir), si.cells(spark, sf_dir), si.merges(spark, sf_dir)
    )


@_query("grid_to_markdown_one_sheet", """, one AS (
  SELECT rn, text, col_no, is_header FROM (
    SELECT l.rn, l.col_no, l.is_header, coalesce(c.text, '') AS text
    FROM (SELECT r.rn, k.col, k.col_no, r.rn = (SELECT min(rn) FROM placed) AS is_header
          FROM (SELECT DISTINCT rn FROM placed WHERE rn IS NOT NULL) r,
               (SELECT col, row_number() OVER (ORDER BY length(col), col) AS col_no
                FROM (SELECT DISTINCT col FROM placed)) k) l
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY row_ord DESC, cell_ord DESC)
               AS newest FROM placed) WHERE newest = 1) c ON c.address = concat(l.col, l.rn))),
one_lines AS (
  SELECT rn, '| ' || string_agg(text, ' | ' ORDER BY col_no) || ' |'
    || CASE WHEN is_header THEN chr(10) || '|' || repeat(' --- |', CAST(count(*) AS INTEGER)) ELSE '' END AS line
  FROM one GROUP BY rn, is_header)
SELECT 'all' AS doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, '## Sheet: all' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rn) || chr(10) AS markdown
FROM one_lines""")
def grid_to_markdown_one_sheet(spark, sf_dir):
    """All customers on one sheet: a hot key, cut to slices and put together again."""
    one = {"doc": F.lit("all"), "sheet": F.lit("all"), "sheet_ord": F.lit(0)}
    cells = si.cells(spark, sf_dir).withColumns(one)
    sheets = si.table(spark, sf_dir, "region").select(
        *[c.alias(n) for n, c in one.items()]
    ).distinct()
    parts = grid.grid_to_markdown(sheets, cells, how=FINE)
    return parts.select("doc", "part_no", "part_count", "markdown")


@_query(
    "workbook_markdown",
    """SELECT doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, string_agg(markdown, chr(10) ORDER BY sheet_ord) AS markdown
    FROM sheet_texts GROUP BY doc""",
)
def workbook_markdown(spark, sf_dir):
    sheets = grid.grid_to_markdown(
        si.sheets(spark, sf_dir), si.cells(spark, sf_dir), si.merges(spark, sf_dir)
    )
    return grid.workbook_markdown(sheets)


@_query("sheet_count", "SELECT doc, count(*) AS sheet_count FROM sheets_in GROUP BY doc")
def sheet_count(spark, sf_dir):
    return grid.sheet_count(si.sheets(spark, sf_dir))


@_query("merged_note", "SELECT doc, sheet, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, note FROM notes")
def merged_note(spark, sf_dir):
    return grid.merged_note(si.merges(spark, sf_dir))
