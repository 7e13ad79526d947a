import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import grid
from docspark.operators.ordering import Splitting

CELLS = (
    "doc string, sheet string, sheet_ord int, row_ord int, cell_ord int, address string,"
    " value string, result string, formula string, type string"
)
SHEETS = "doc string, sheet string, sheet_ord int"
MERGES = "doc string, sheet string, merge_ord int, ref string"
HOT = Splitting(slices=8, min_rows=5)


def make(spark, sheets):
    """Tables from {sheet: [(address, value) or (address, value, result, formula)]}."""
    cells, names = [], []
    for ord, (sheet, listed) in enumerate(sheets.items()):
        names.append(("d", sheet, ord))
        for i, cell in enumerate(listed):
            address, value, result, formula = (*cell, None, None)[:4]
            cells.append(("d", sheet, ord, i, 0, address, value, result, formula, "3"))
    return spark.createDataFrame(names, SHEETS), spark.createDataFrame(cells, CELLS)


def brute(sheet, listed, merges=()):
    """The format, stated on plain Python data."""
    listed = [(*c, None, None)[:4] for c in listed]
    text = {a: (r if r is not None else v if v is not None else "") for a, v, r, _ in listed}
    digits = "0123456789"
    cols = sorted({"".join(ch for ch in a if ch not in digits) for a in text}, key=lambda c: (len(c), c))
    rows = sorted({int("".join(ch for ch in a if ch in digits)) for a in text if any(ch in digits for ch in a)})
    if not cols or not rows:
        return f"## Sheet: {sheet}\n\n_Empty sheet_\n"
    lines = ["| " + " | ".join(text.get(f"{c}{r}", "") for c in cols) + " |" for r in rows]
    lines.insert(1, "|" + " --- |" * len(cols))
    out = f"## Sheet: {sheet}\n\n" + "\n".join(lines) + "\n"
    return out + (f"\n_Merged cells: {', '.join(merges)}_\n" if merges else "")


def markdown(parts):
    out = {}
    for p in sorted(parts.collect(), key=lambda p: (p.sheet_ord, p.part_no)):
        out[p.sheet] = out.get(p.sheet, "") + p.markdown
    return out


def test_summary_and_empty_sheet(spark):
    sheets, cells = make(
        spark,
        {"Summary": [("A1", "Title"), ("B1", None, "3", "SUM(B2:B3)"), ("A2", "Row 1"), ("B2", "1")], "Empty": []},
    )
    merges = spark.createDataFrame([("d", "Summary", 0, "A1:B1"), ("d", "Empty", 0, "A1:B2")], MERGES)
    parts = grid.grid_to_markdown(sheets, cells, merges)
    assert markdown(parts) == {
        "Summary": "## Sheet: Summary\n\n| Title | 3 |\n| --- | --- |\n| Row 1 | 1 |\n\n_Merged cells: A1:B1_\n",
        "Empty": "## Sheet: Empty\n\n_Empty sheet_\n",
    }
    whole = grid.workbook_markdown(parts).collect()
    assert [(w.doc, w.part_no) for w in whole] == [("d", 1)]
    assert whole[0].markdown == "\n".join(markdown(parts).values())


ODD = {
    "padded": [("A01", "seen?"), ("B1", "x")],
    "last wins": [("A1", "old"), ("A1", "new"), ("B1", "y")],
    "last is empty": [("A1", "old"), ("A1", None, None, "F()")],
    "nothing wins too": [("A1", "old"), ("A1", None)],
    "no rows": [("A", "x"), ("B", "y")],
    "column without row": [("A1", "x"), ("C", "y")],
    "gaps": [("AA7", "far"), ("C3", "near"), ("B7", "|pipe\nline")],
    "one row": [("A5", "only")],
    "formula without result": [("A1", None, None, "X()"), ("B1", "v")],
    "empty text": [("A1", ""), ("B2", "")],
    "only blanks": [("A1", None), ("B2", None)],
}


@pytest.mark.parametrize("how", [None, HOT])
def test_odd_sheets(spark, how):
    sheets, cells = make(spark, ODD)
    assert markdown(grid.grid_to_markdown(sheets, cells, how=how)) == {s: brute(s, c) for s, c in ODD.items()}


@pytest.mark.parametrize("how", [Splitting(), HOT])
@pytest.mark.parametrize("part_bytes", [60, 1 << 20])
def test_random_sheets_with_a_hot_one(spark, how, part_bytes):
    chance = random.Random(3)
    labels = ["A", "B", "D", "Z", "AA", "AB", "BA", "XFD"]
    content = {"hot": [(f"{chance.choice(labels)}{chance.randint(1, 90)}", f"v{i}") for i in range(300)]}
    for s in range(6):
        content[f"s{s}"] = [(f"{chance.choice(labels)}{chance.randint(1, 9)}", f"w{i}") for i in range(s * 3)]
    merges = {s: [f"A{i}:B{i}" for i in range(40 if s == "hot" else 2)] for s in content}
    sheets, cells = make(spark, content)
    merged = spark.createDataFrame([("d", s, i, r) for s, refs in merges.items() for i, r in enumerate(refs)], MERGES)
    parts = grid.grid_to_markdown(sheets, cells.repartition(7), merged, part_bytes, how)
    want = {s: brute(s, c, merges[s]) for s, c in content.items()}
    assert markdown(parts) == want
    whole = sorted(grid.workbook_markdown(parts, part_bytes, how).collect(), key=lambda p: p.part_no)
    assert "".join(p.markdown for p in whole) == "\n".join(want.values())


def test_empty_cells_can_be_left_out(spark):
    sheets, cells = make(spark, {"s": [("A1", "x"), ("A1", None), ("B2", None), ("C1", None, None, "F()"), ("D1", "")]})
    kept = grid.drop_empty_cells(cells)
    assert sorted(r.address for r in kept.collect()) == ["A1", "C1", "D1"]
    assert markdown(grid.grid_to_markdown(sheets, kept)) == {
        "s": "## Sheet: s\n\n| x |  |  |\n| --- | --- | --- |\n"
    }


def test_cells_are_shuffled_twice_and_labels_once(spark):
    sheets, cells = make(spark, {"s": [("A1", "x")]})
    out = grid.grid_to_markdown(sheets, cells)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("REPARTITION_BY_COL") == 1
    assert "ReusedExchange" in final


def test_wide_sheet(spark):
    def label(n):
        return label(n // 26 - 1) + chr(65 + n % 26) if n >= 26 else chr(65 + n)

    content = {"wide": [(f"{label(n)}{r}", f"{n}-{r}") for n in range(1500) for r in (1, 4) if (n + r) % 3]}
    sheets, cells = make(spark, content)
    assert markdown(grid.grid_to_markdown(sheets, cells)) == {"wide": brute("wide", content["wide"])}


@pytest.mark.parametrize("how", [None, HOT])
def test_dense_cells(spark, how):
    sheets, cells = make(spark, {"s": [("B2", "x"), ("AA4", "y"), ("B2", "z"), ("C07", "lost")] + [("B9", "q")] * 9})
    dense = grid.densify_grid(sheets, cells, how).collect()
    got = sorted((r.rn, r.col_no, r.col, r.text, r.is_header) for r in dense)
    want = []
    for rn, texts in ((2, ["z", "", ""]), (4, ["", "", "y"]), (7, ["", "", ""]), (9, ["q", "", ""])):
        want += [(rn, i + 1, c, t, rn == 2) for i, (c, t) in enumerate(zip(["B", "C", "AA"], texts))]
    assert got == want


def test_axes_and_header(spark):
    _, cells = make(spark, {"s": [("AA10", "x"), ("B2", "y"), ("Z2", "z"), ("Q", "w")]})
    row = grid.sheet_axes(cells).first()
    assert row.columns == ["B", "Q", "Z", "AA"] and row.row_numbers == [2, 10] and row.part_no == 1
    assert [r.row_numbers for r in grid.sheet_axes(cells, part_rows=1).orderBy("part_no").collect()] == [[2], [10]]
    marked = grid.mark_header(grid.row_axis(cells)).orderBy("rn").collect()
    assert [(r.rn, r.is_header) for r in marked] == [(2, True), (10, False)]


def test_filter_sheets(spark):
    _, cells = make(spark, {"a": [("A1", "x")], "b": [("A1", "y")]})
    for names, kept in ((None, {"a", "b"}), ([], {"a", "b"}), (["b", "c"], {"b"})):
        asked = spark.createDataFrame([("d", names)], "doc string, sheet_names array<string>")
        assert {r.sheet for r in grid.filter_sheets(cells, asked).collect()} == kept


def test_counts_and_notes(spark):
    sheets, cells = make(spark, {"a": [("A1", "x")], "b": []})
    assert grid.sheet_count(sheets).first().sheet_count == 2
    merges = spark.createDataFrame([("d", "a", i, r) for i, r in enumerate(["A1:B1", "C3:D4"])], MERGES)
    assert grid.merged_note(merges).first().note == "A1:B1, C3:D4"
    last = grid.dedupe_cells(cells.withColumn("cell_ord", F.explode(F.array(F.lit(0), F.lit(4))))).collect()
    assert [(r.address, r.cell_ord) for r in last] == [("A1", 4)]


def test_duplicates_combine_in_even_shares_of_the_cells(spark):
    cells = spark.range(2000).selectExpr(
        "'d' AS doc", "'s' AS sheet", "cast(id AS int) AS row_ord", "0 AS cell_ord",
        "concat('A', id % 1000) AS address", "cast(id AS string) AS value",
    )
    last = grid.dedupe_cells(cells.coalesce(1))
    assert "REBALANCE_PARTITIONS" in last._jdf.queryExecution().toString()
    assert {(r.address, r.row_ord) for r in last.collect()} == {(f"A{i}", 1000 + i) for i in range(1000)}
