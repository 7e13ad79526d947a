"""Formulas that cells share: references moved along with the cell.

A formula is cut to tokens once, where it is written down. A cell that shares it gets
the tokens with every relative reference moved by as many rows and columns as the cell
is away. Names, functions, texts in quotes, sheet names and references to other books
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.cells import address_column, address_row

# The last column and row of a sheet.
LAST_COLUMN, LAST_ROW = 16_384, 1_048_576

# with what follows a function or sheet name, so that LOG10( and Q1! are no cells
_WORD = r"[\p{L}_\\][\p{L}\p{N}_.\\]*[(!]?"
_COLUMN, _ROW = r"\$?[A-Za-z]{1,3}", r"\$?[1-9][0-9]{0,6}"
# a reference ends where no longer name, function or sheet name begins
_END = r"(?![\p{L}\p{N}_.(!\\])"
_TOKENS = "|".join(
    [
        r'"(?:[^"]|"")*"',
        r"'(?:[^']|'')*'!?",
        r"\[[^\]]*\]",
        rf"{_COLUMN}{_ROW}{_END}",
        rf"{_COLUMN}:{_COLUMN}{_END}",
        rf"{_ROW}:{_ROW}{_END}",
        r"[0-9]+(?:\.[0-9]*)?(?:[Ee][+-]?[0-9]+)?",
        _WORD,
        r"[\s\S]",
    ]
)
_CELL = r"^(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]{0,6})$"
_COLUMNS = r"^(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})$"
_ROWS = r"^(\$?)([1-9][0-9]{0,6}):(\$?)([1-9][0-9]{0,6})$"
_LOST = "#REF!"


def column_number(label: Column) -> Column:
    """1 for A, 27 for AA; labels of one to three letters."""
    letters = F.split(F.upper(label), "")
    return F.aggregate(letters, F.lit(0), lambda n, ch: F.when(ch == "", n).otherwise(n * 26 + F.ascii(ch) - 64))


def column_label(number: Column) -> Column:
    """A for 1, AA for 27; numbers up to that of XFD."""
    # without a zero digit: 26 is Z and not A0
    digits = [number - 1, F.floor((number - 27) / 26), F.floor((number - 703) / 676)]
    # each letter exists from its first number on: A, AA, AAA
    letters = [
        F.when(number >= first, F.char(65 + F.pmod(digit, F.lit(26)).cast("int"))).otherwise("")
        for digit, first in zip(digits, (1, 27, 703))
    ]
    return F.concat(*reversed(letters))


def formula_tokens(formula: Column) -> Column:
    """A formula's tokens, which make it when put one after another."""
    return F.regexp_extract_all(formula, F.lit(f"({_TOKENS})"), 1)


def _moved_column(dollar: Column, label: Column, by: Column) -> Column:
    at = column_number(label) + by
    inside = (at >= 1) & (at <= LAST_COLUMN)
    return F.when(dollar == "$", F.concat(dollar, label)).when(inside, column_label(at))


def _moved_row(dollar: Column, row: Column, by: Column) -> Column:
    at = row.cast("bigint") + by
    inside = (at >= 1) & (at <= LAST_ROW)
    return F.when(dollar == "$", F.concat(dollar, row)).when(inside, at.cast("string"))


def _moved_token(token: Column, rows: Column, columns: Column) -> Column:
    def part(pattern, n):
        return F.regexp_extract(token, pattern, n)

    # names such as ABC1234567 or ZZZ1 look like cells, but no sheet has them
    real = (column_number(part(_CELL, 2)) <= LAST_COLUMN) & (part(_CELL, 4).cast("int") <= LAST_ROW)
    cell = F.concat(
        _moved_column(part(_CELL, 1), part(_CELL, 2), columns), _moved_row(part(_CELL, 3), part(_CELL, 4), rows)
    )
    whole_columns = F.concat(
        _moved_column(part(_COLUMNS, 1), part(_COLUMNS, 2), columns),
        F.lit(":"),
        _moved_column(part(_COLUMNS, 3), part(_COLUMNS, 4), columns),
    )
    whole_rows = F.concat(
        _moved_row(part(_ROWS, 1), part(_ROWS, 2), rows), F.lit(":"), _moved_row(part(_ROWS, 3), part(_ROWS, 4), rows)
    )
    return (
        F.when(token.rlike(_CELL), F.when(real, F.coalesce(cell, F.lit(_LOST))).otherwise(token))
        .when(token.rlike(_COLUMNS), F.coalesce(whole_columns, F.lit(_LOST)))
        .when(token.rlike(_ROWS), F.coalesce(whole_rows, F.lit(_LOST)))
        .otherwise(token)
    )


def shared_formula(tokens: Column, first: Column, address: Column) -> Column:
    """The formula of the cell at ``address`` that shares the ``tokens`` written at ``first``.

    References that would leave the sheet become ``#REF!``.
    """
    rows = address_row(address) - address_row(first)
    columns = column_number(address_column(address)) - column_number(address_column(first))
    # arrays of one value, so that the distance is worked out once
    by = F.array(F.struct(rows.alias("rows"), columns.alias("columns")))
    moved = F.transform(by, lambda d: F.array_join(F.transform(tokens, lambda t: _moved_token(t, d["rows"], d["columns"])), ""))
    return F.get(moved, 0)
