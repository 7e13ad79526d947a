"""Functions on single spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def cell_text(value: Column, result: Column) -> Column:
    """What a cell prints: its formula result, else its value, else nothing.

    ``value`` is NULL wherever the source value is an object holding a result.
    """
    return F.coalesce(result, value, F.lit(""))


def address_column(address: Column) -> Column:
    """Column label: the address without its digits."""
    return F.translate(address, "0123456789", "")


def address_row(address: Column) -> Column:
    """Row number: leading integer once letters are gone, NULL when there is none."""
    rest = F.translate(address, _UPPER + _LOWER, "")
    # the pattern only runs where more than an integer is left
    leading = F.regexp_extract(rest, r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(rest.try_cast("bigint"), leading.try_cast("bigint"))


def split_address(address: Column) -> Column:
    """Struct of column label and row number."""
    return F.struct(address_column(address).alias("col"), address_row(address).alias("rn"))


def column_order(col: Column) -> Column:
    """Sort key that puts A, B, Z before AA: by length, then letters.

    One string, so that sorting compares bytes. Labels of one length compare
    case-blind first, and lower case goes before upper case on a tie.
    """
    # for labels in capitals, as nearly all are, swapped case is lower case
    swapped = F.when(col == F.upper(col), F.lower(col)).otherwise(
        F.translate(col, _UPPER + _LOWER, _LOWER + _UPPER)
    )
    return F.concat(F.lpad(F.length(col).cast("string"), 6, "0"), F.lower(col), swapped)
