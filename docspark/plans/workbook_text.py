"""Workbooks to Markdown, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import errors
from docspark.operators.grid import grid_to_markdown, workbook_markdown
from docspark.operators.ordering import DEFAULT_PART_BYTES, Splitting
from docspark.session import write_and_read
from docspark.sources.workbook import extract_workbook_cells


def workbooks_to_markdown(
    files: DataFrame,
    requests: DataFrame | None = None,
    merged_cells: bool = False,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> tuple[DataFrame, DataFrame]:
    """Markdown parts of each readable workbook and the errors of the others.

    ``files`` has ``path`` alone, as a listing does, or ``content`` too. ``requests``
    (``doc``, ``sheet_names``) restricts documents and their sheets: only files asked for
    are opened, by path only sheets asked for are inflated, and files that are not there are
    errors. Cells are written once before the grid is built, since the grid asks for
    them several times.
    """
    missing = None
    if requests is not None:
        paths = requests.select(F.col("doc").alias("path")).where("path IS NOT NULL").distinct()
        gone = paths.join(files.select("path"), "path", "left_anti")
        message = F.concat(F.lit(errors.FILE_NOT_FOUND_PREFIX), F.col("path"))
        missing = gone.select(
            F.col("path").alias("key"), errors.error(errors.FILE_NOT_FOUND, message).alias("error")
        )
        files = files.join(paths, "path", "left_semi")
    tables = extract_workbook_cells(files, requests)
    failed = tables.errors if missing is None else tables.errors.unionByName(missing)
    sheets = tables.sheets
    cells = write_and_read(tables.cells.drop("formula", "type", "sheet_ord"), "cells")
    merges = tables.merges if merged_cells else None
    parts = grid_to_markdown(sheets, cells, merges, part_bytes, how)
    # a cell prints its text and three characters around it
    printed = F.octet_length(F.coalesce("result", "value", F.lit(""))) + 3
    return workbook_markdown(parts, part_bytes, how, cells, printed), failed
