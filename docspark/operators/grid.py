"""Sparse cells to dense Markdown tables.

Cells of a sheet are shuffled twice: by row and column, to let the last duplicate
win with map-side combine, and by sheet (and slice, where a sheet is hot), after
which row building, the join to the sheet's layout, ordering and folding all
use the same partitioning. A row is at most as wide as the sheet format allows
(16,384 columns); the number of rows per sheet is not bounded anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.cells import address_column, address_row, cell_text, column_order
from docspark.operators.lookup import lookup
from docspark.operators.ordering import (
    DEFAULT_PART_BYTES,
    SLICE,
    Slicing,
    Splitting,
    fold_slices,
    join_in_order,
    list_in_order,
    slicing,
    text_in_order,
)

SHEET = ["doc", "sheet"]


def filter_sheets(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Keep the sheets a request names; no list or an empty one keeps all.

    ``requests`` holds ``doc`` and ``sheet_names``, one row per document. Works
    on any table with ``doc`` and ``sheet`` columns.
    """
    names = F.col("sheet_names")
    wanted = F.when(F.size(names) > 0, F.array_contains(names, F.col("sheet"))).otherwise(True)
    asked = requests.select("doc", "sheet_names", F.lit(True).alias("_asked"))
    return (
        lookup(cells, asked, ["doc"])
        .filter(F.col("_asked") & wanted)
        .drop("sheet_names", "_asked")
    )


def drop_empty_cells(cells: DataFrame) -> DataFrame:
    """Cells with neither value, result nor formula vanish; empty text stays."""
    return cells.filter(
        F.col("value").isNotNull() | F.col("result").isNotNull() | F.col("formula").isNotNull()
    )


def place_cells(cells: DataFrame) -> DataFrame:
    """Cells with printed text, column label ``col`` and row number ``rn``.

    All cells given count, also those that print nothing; readers of files leave
    empty ones out with ``drop_empty_cells``.
    """
    return cells.select(
        *SHEET,
        "row_ord",
        "cell_ord",
        "address",
        cell_text(F.col("value"), F.col("result")).alias("text"),
        address_column(F.col("address")).alias("col"),
        address_row(F.col("address")).alias("rn"),
    )


def dedupe_cells(cells: DataFrame) -> DataFrame:
    """One row per address: the last one in (row_ord, cell_ord) order wins.

    Texts combine map-side by sorting, so tasks get even shares of the cells first: what a
    task reads may become many times as many bytes of cells.
    """
    kept = [c for c in cells.columns if c not in (*SHEET, "address")]
    return (
        cells.hint("rebalance")
        .groupBy(*SHEET, "address")
        .agg(F.max_by(F.struct(*kept), F.struct("row_ord", "cell_ord")).alias("_last"))
        .select(*SHEET, "address", *[F.col(f"_last.{c}").alias(c) for c in kept])
    )


def column_axis(cells: DataFrame) -> DataFrame:
    """Per sheet the distinct column labels in sheet order, as an array."""
    labels = F.transform("_keys", lambda k: k["col"])
    return _axis(place_cells(cells)).select(*SHEET, labels.alias("columns"))


def row_axis(cells: DataFrame) -> DataFrame:
    """The distinct row numbers of each sheet, a row each."""
    return place_cells(cells).filter("rn IS NOT NULL").select(*SHEET, "rn").distinct()


def sheet_axes(
    cells: DataFrame, part_rows: int = 100_000, how: Splitting | None = Splitting()
) -> DataFrame:
    """Columns and ordered row numbers of each sheet.

    Row numbers come in parts of ``part_rows``; nearly every sheet has one part.
    """
    rows = row_axis(cells)
    cut = slicing(rows, SHEET, ["rn"], how)
    parts = fold_slices(
        cut.spread(rows), cut, F.lit(1), part_rows, row_numbers=list_in_order("rn", ["rn"])
    )
    return (
        column_axis(cells)
        .join(parts, SHEET, "left")
        .select(
            *SHEET,
            F.coalesce("part_no", F.lit(1)).alias("part_no"),
            F.coalesce("part_count", F.lit(1)).alias("part_count"),
            "columns",
            F.coalesce("row_numbers", F.array().cast("array<bigint>")).alias("row_numbers"),
        )
    )


def _axis(placed: DataFrame) -> DataFrame:
    # labels combine map-side, at most 16,384 per sheet; bad addresses have columns too
    labels = placed.groupBy(*SHEET, "col").agg(F.min("rn").alias("rn"))
    label = F.struct(column_order(F.col("col")).alias("key"), F.col("col").alias("col"))
    return labels.groupBy(*SHEET).agg(
        F.sort_array(F.collect_list(label)).alias("_keys"), F.min("rn").alias("first_rn")
    )


def mark_header(rows: DataFrame) -> DataFrame:
    """Add ``is_header``: true on the smallest populated row of each sheet."""
    first = rows.groupBy(*SHEET).agg(F.min("rn").alias("_first"))
    return (
        lookup(rows, first, SHEET)
        .withColumn("is_header", F.col("rn") == F.col("_first"))
        .drop("_first")
    )


def sheet_count(sheets: DataFrame) -> DataFrame:
    """Sheets per workbook, empty ones included."""
    return sheets.groupBy("doc").agg(F.count(F.lit(1)).alias("sheet_count"))


def merged_note(
    merges: DataFrame,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> DataFrame:
    """Merged ranges of each sheet joined by comma and space, in parts."""
    return join_in_order(merges, SHEET, ["merge_ord"], "ref", ", ", "note", part_bytes, how)


def _layout(sheets: DataFrame, placed: DataFrame, merges: DataFrame | None) -> DataFrame:
    """One row per sheet with rows: its columns, first row and the ends of its merge list."""
    blank = lambda k: F.struct(
        k["key"].alias("key"), F.lit(0).alias("is_cell"), k["col"].alias("text")
    )
    axis = _axis(placed).filter("first_rn IS NOT NULL")
    layout = sheets.select(*SHEET, "sheet_ord").join(
        axis.select(*SHEET, F.transform("_keys", blank).alias("_blanks"), "first_rn"), SHEET
    )
    if merges is None:
        none = F.lit(None).cast("bigint")
        return layout.withColumns({"first_merge": none, "last_merge": none})
    ends = merges.groupBy(*SHEET).agg(
        F.min("merge_ord").alias("first_merge"), F.max("merge_ord").alias("last_merge")
    )
    return layout.join(ends, SHEET, "left")


def _grid_rows(
    sheets: DataFrame, cells: DataFrame, merges: DataFrame | None, how: Splitting | None
) -> tuple[DataFrame, Slicing]:
    """Rows with their cells as one array and the sheet's layout, spread by sheet and slice.

    Merged ranges join the stream as rows of kind 1, so that they follow the
    cells and are sliced like them.
    """
    placed = place_cells(cells)
    # a cell whose address is not its column and row put together is never looked
    # up: it leaves no text behind, yet its row exists
    found = F.col("address") == F.concat(F.col("col"), F.col("rn").cast("string"))
    stream = placed.filter("rn IS NOT NULL").select(
        *SHEET,
        F.lit(0).alias("kind"),
        F.col("rn").alias("at"),
        F.when(found, F.col("col")).alias("col"),
        F.when(found, F.col("text")).alias("text"),
        F.struct(
            F.col("row_ord").cast("bigint").alias("row_ord"),
            F.col("cell_ord").cast("bigint").alias("cell_ord"),
        ).alias("seen"),
    )
    if merges is not None:
        stream = stream.unionByName(
            merges.select(
                *SHEET,
                F.lit(1).alias("kind"),
                F.col("merge_ord").cast("bigint").alias("at"),
                F.col("ref").alias("text"),
                F.struct(
                    F.col("merge_ord").cast("bigint").alias("row_ord"),
                    F.lit(0).cast("bigint").alias("cell_ord"),
                ).alias("seen"),
            ),
            allowMissingColumns=True,
        )
    # counting needs no more than the keys of all rows
    counted = cells.select(*SHEET)
    if merges is not None:
        counted = counted.unionAll(merges.select(*SHEET))
    cut = slicing(stream, SHEET, ["kind", "at"], how, counted)
    # duplicates meet by row and column, combined map-side, before rows are put together
    last = (
        cut.place(stream)
        .groupBy(*cut.columns, "kind", "at", "col")
        .agg(F.max_by("text", "seen").alias("text"))
    )
    shown = (F.col("kind") == 1) | F.col("col").isNotNull()
    entry = F.struct(
        F.coalesce(column_order(F.col("col")), F.lit("")).alias("key"),
        F.lit(1).alias("is_cell"),
        "text",
    )
    rows = (
        last.select(*cut.columns, "kind", "at", F.when(shown, entry).alias("entry"))
        .repartition(*cut.columns)
        .groupBy(*cut.columns, "kind", "at")
        .agg(F.collect_list("entry").alias("_entries"))
    )
    layout = _layout(sheets, placed, merges)
    if cut.bounds is not None:
        # a hot sheet's layout goes to each of its slices
        ends = F.broadcast(cut.bounds.select(*SHEET, F.size("_bounds").alias("_last_slice")))
        each = F.sequence(F.lit(0), F.coalesce("_last_slice", F.lit(0)))
        layout = layout.join(ends, SHEET, "left").withColumn(SLICE, F.explode(each))
        layout = layout.drop("_last_slice")
    return rows.join(layout, cut.columns), cut


def _aligned() -> Column:
    """Blank per column and cells of the row, sorted: each blank opens its column."""
    return F.sort_array(F.concat("_blanks", "_entries"))


def densify_grid(
    sheets: DataFrame, cells: DataFrame, how: Splitting | None = Splitting()
) -> DataFrame:
    """Every populated row by every column of the sheet, blank where there is no cell.

    Gives ``doc, sheet, rn, is_header, col_no, col, text``. The columns of a
    sheet travel as one array, so no row is paired with others in a join.
    """
    rows, _ = _grid_rows(sheets, cells, None, how)
    aligned = rows.select(
        *SHEET,
        F.col("at").alias("rn"),
        (F.col("at") == F.col("first_rn")).alias("is_header"),
        _aligned().alias("_all"),
    )
    # a column's blank is followed by its cell, if the row has one
    shifted = F.slice("_all", F.lit(2), F.size("_all"))
    pairs = F.arrays_zip(F.col("_all").alias("a"), shifted.alias("b"))
    text = lambda p: F.when(p["b"]["is_cell"] == 1, p["b"]["text"]).otherwise("")
    dense = F.transform(
        F.filter("_pairs", lambda p: p["a"]["is_cell"] == 0),
        lambda p: F.struct(p["a"]["text"].alias("col"), text(p).alias("text")),
    )
    return (
        aligned.select(*SHEET, "rn", "is_header", pairs.alias("_pairs"))
        # outer, lest Spark filters on the array and so builds it twice
        .select(*SHEET, "rn", "is_header", F.posexplode_outer(dense).alias("_at", "_cell"))
        .select(
            *SHEET, "rn", "is_header", (F.col("_at") + 1).alias("col_no"), "_cell.col", "_cell.text"
        )
    )


def _piece() -> Column:
    """The text a row or a merged range adds to its sheet."""
    # a separator at each blank, the text at each cell
    parts = F.transform(
        _aligned(), lambda e: F.when(e["is_cell"] == 0, " | ").otherwise(e["text"])
    )
    line = F.concat(F.lit("| "), F.substr(F.array_join(parts, ""), F.lit(4)), F.lit(" |\n"))
    title = F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("_blanks")), F.lit("\n"))
    opening = F.when(F.col("at") == F.col("first_merge"), "\n_Merged cells: ").otherwise(", ")
    closing = F.when(F.col("at") == F.col("last_merge"), "_\n").otherwise("")
    return (
        F.when(F.col("kind") == 1, F.concat(opening, F.col("_entries")[0]["text"], closing))
        .when(F.col("at") == F.col("first_rn"), F.concat(title, line, rule))
        .otherwise(line)
    )


def grid_to_markdown(
    sheets: DataFrame,
    cells: DataFrame,
    merges: DataFrame | None = None,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> DataFrame:
    """Markdown of every sheet: ``doc, sheet, sheet_ord, part_no, part_count, markdown``.

    Blank rows and columns are left out, the smallest populated row is the
    header, values are not escaped. A sheet without valid rows says so. Without
    ``merges`` no note on merged cells is written.
    """
    rows, cut = _grid_rows(sheets, cells, merges, how)
    pieces = rows.select(*cut.columns, "sheet_ord", "kind", "at", _piece().alias("piece"))
    filled = fold_slices(
        pieces,
        cut,
        F.octet_length("piece"),
        part_bytes,
        sheet_ord=F.max("sheet_ord"),
        markdown=text_in_order("piece", ["kind", "at"]),
    ).select(*SHEET, "sheet_ord", "part_no", "part_count", "markdown")
    populated = _axis(place_cells(cells)).filter("first_rn IS NOT NULL")
    empty = sheets.join(populated.select(*SHEET), SHEET, "left_anti").select(
        *SHEET,
        "sheet_ord",
        F.lit(1).cast("bigint").alias("part_no"),
        F.lit(1).cast("bigint").alias("part_count"),
        F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n_Empty sheet_\n")).alias("markdown"),
    )
    return filled.unionByName(empty)


def workbook_markdown(
    sheet_parts: DataFrame,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
    counted: DataFrame | None = None,
    counted_weight: Column | None = None,
) -> DataFrame:
    """Sheets of each workbook in order, a line break between them.

    Gives ``doc, part_no, part_count, markdown``. Hot workbooks are looked for in
    ``counted``, such as the table of cells with the bytes that each prints as
    ``counted_weight``, so that the grid is built once unless a workbook is hot.
    """
    # a sheet's first part always has number 1
    between = F.when(F.col("sheet_part") == 1, "\n").otherwise("")
    return join_in_order(
        sheet_parts.withColumnRenamed("part_no", "sheet_part").drop("part_count"),
        ["doc"],
        ["sheet_ord", "sheet_part"],
        "markdown",
        between,
        "markdown",
        part_bytes,
        how,
        counted,
        F.octet_length("markdown"),
        counted_weight,
    )
