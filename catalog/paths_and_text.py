"""Queries on path, text and cell functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.functions import cells as C
from docspark.functions import paths as P
from docspark.functions.text import js_number, js_trim

QUERIES = {}
ORACLE = {}


def _query(name, sql):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return keep


_EXT = "lower(raw_ext)"


@_query(
    "file_extension",
    f"WITH {si.PATHS_SQL} SELECT doc_id, path, {_EXT} AS extension FROM path_parts",
)
def file_extension(spark, sf_dir):
    return si.paths(spark, sf_dir).withColumn("extension", P.file_extension(F.col("path")))


@_query(
    "file_basename",
    f"""WITH {si.PATHS_SQL} SELECT doc_id, name,
    substr(name, 1, length(name) - length(raw_ext)) AS stem FROM path_parts""",
)
def file_basename(spark, sf_dir):
    path = F.col("path")
    return si.paths(spark, sf_dir).select(
        "doc_id", P.file_basename(path).alias("name"), P.file_basename(path, True).alias("stem")
    )


@_query(
    "file_category",
    f"""WITH {si.PATHS_SQL} SELECT doc_id, category,
    CASE WHEN category IS NULL THEN 'UNSUPPORTED_FORMAT' END AS error_code,
    CASE WHEN category IS NULL THEN 'Unsupported file format: ' || {_EXT}
      || '. Supported: .xlsx, .xls, .xlsm, .xlsb, .docx, .doc, .odt, .pdf' END AS error_message
    FROM (SELECT *, CASE WHEN {_EXT} IN ('.xlsx', '.xls', '.xlsm', '.xlsb') THEN 'excel'
                         WHEN {_EXT} IN ('.docx', '.doc', '.odt') THEN 'word'
                         WHEN {_EXT} = '.pdf' THEN 'pdf' END AS category FROM path_parts)""",
)
def file_category(spark, sf_dir):
    path = F.col("path")
    return (
        si.paths(spark, sf_dir)
        .select("doc_id", P.file_category(path).alias("category"), P.file_category_error(path).alias("error"))
        .select(
            "doc_id",
            "category",
            F.col("error.code").alias("error_code"),
            F.col("error.message").alias("error_message"),
        )
    )


@_query(
    "file_predicates",
    f"""WITH {si.PATHS_SQL} SELECT doc_id, {_EXT} IN ('.xlsx', '.xls', '.xlsm', '.xlsb') AS is_excel,
    {_EXT} IN ('.docx', '.doc', '.odt') AS is_word, {_EXT} = '.pdf' AS is_pdf, {_EXT} = '.docx' AS is_docx
    FROM path_parts""",
)
def file_predicates(spark, sf_dir):
    path = F.col("path")
    return si.paths(spark, sf_dir).select(
        "doc_id",
        P.is_excel(path).alias("is_excel"),
        P.is_word(path).alias("is_word"),
        P.is_pdf(path).alias("is_pdf"),
        P.is_docx(path).alias("is_docx"),
    )


@_query(
    "mime_type",
    f"""WITH {si.PATHS_SQL} SELECT doc_id, CASE {_EXT} WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg'
    WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'image/png' END AS mime_type FROM path_parts""",
)
def mime_type(spark, sf_dir):
    return si.paths(spark, sf_dir).select("doc_id", P.mime_type(F.col("path")).alias("mime_type"))


@_query(
    "js_trim",
    """SELECT doc_id, k, CASE k WHEN 0 THEN text ELSE '' END AS trimmed
    FROM documents, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR doc_id % 4 = 3""",
)
def js_trim_query(spark, sf_dir):
    """Every text between blanks, and rows of blanks alone beside them."""
    padded = r"""CASE doc_id % 4 WHEN 0 THEN concat(' \t', text, '\r\n') WHEN 1 THEN concat('\ufeff\u3000', text, '  ')
        ELSE text END"""
    documents = si.table(spark, sf_dir, "documents")
    blank = documents.where("doc_id % 4 = 3").selectExpr("doc_id", "1 AS k", r"'\u000b\u000c  ' AS padded")
    return (
        documents.selectExpr("doc_id", "0 AS k", f"{padded} AS padded")
        .unionAll(blank)
        .select("doc_id", "k", js_trim(F.col("padded")).alias("trimmed"))
    )


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query(
    "js_number",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{si._DUCK_NUMBER.format(n)} AS {n}" for n in _NUMBERS)
    + " FROM lineitem",
)
def js_number_query(spark, sf_dir):
    return si.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[js_number(F.col(n)).alias(n) for n in _NUMBERS]
    )


# Digits and power of ten make the number, so the text can be put together without it.
_POWERS = """WITH scaled AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST((l_orderkey + l_linenumber) % 61 - 30 AS INTEGER) AS k
  FROM lineitem),
parts AS (SELECT *, rtrim(CAST(q AS VARCHAR), '0') AS d, length(CAST(q AS VARCHAR)) + k AS point FROM scaled)"""


@_query(
    "js_number_powers",
    f"""{_POWERS} SELECT l_orderkey, l_linenumber, CASE
      WHEN point > 21 OR point <= -6 THEN d[1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END
           || CASE WHEN point > 0 THEN 'e+' ELSE 'e' END || (point - 1)
      WHEN point >= length(d) THEN d || repeat('0', point - length(d))
      WHEN point > 0 THEN d[1:point] || '.' || d[point + 1:]
      ELSE '0.' || repeat('0', -point) || d END AS printed FROM parts""",
)
def js_number_powers(spark, sf_dir):
    """Quantities times powers of ten from 1e-30 to 1e30, read from their text."""
    text = F.expr("concat(cast(l_quantity AS int), 'e', (l_orderkey + l_linenumber) % 61 - 30)")
    return si.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", js_number(text).alias("printed"))


@_query(
    "cell_text",
    f"""WITH {si.CELLS_SQL} SELECT doc, sheet, row_ord, cell_ord,
    CASE WHEN result IS NOT NULL THEN result WHEN value IS NOT NULL THEN value ELSE '' END AS text FROM cells_in""",
)
def cell_text(spark, sf_dir):
    return si.cells(spark, sf_dir).select(
        "doc", "sheet", "row_ord", "cell_ord", C.cell_text(F.col("value"), F.col("result")).alias("text")
    )


@_query(
    "split_address",
    f"""WITH {si.CELLS_SQL} SELECT doc, sheet, address, translate(address, '0123456789', '') AS col,
    CAST(nullif(translate(address, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''), '') AS BIGINT) AS rn FROM cells_in""",
)
def split_address(spark, sf_dir):
    return (
        si.cells(spark, sf_dir)
        .select("doc", "sheet", "address", C.split_address(F.col("address")).alias("at"))
        .select("doc", "sheet", "address", "at.col", "at.rn")
    )


_LABEL = """CASE p_partkey % 3 WHEN 0 THEN chr(cast(65 + p_partkey % 26 AS int))
  WHEN 1 THEN concat(chr(cast(65 + p_partkey % 26 AS int)), chr(cast(65 + p_partkey % 25 AS int)))
  ELSE concat(chr(cast(65 + p_partkey % 26 AS int)), chr(cast(65 + p_partkey % 25 AS int)), chr(cast(65 + p_partkey % 23 AS int))) END"""


@_query(
    "column_order",
    f"""SELECT p_brand, string_agg(label, ',' ORDER BY length(label), label) AS labels
    FROM (SELECT DISTINCT p_brand, {_LABEL} AS label FROM part) GROUP BY p_brand""",
)
def column_order(spark, sf_dir):
    # at most 26 + 26^2 + 26^3 distinct labels per brand
    labelled = si.table(spark, sf_dir, "part").selectExpr("p_brand", f"{_LABEL} AS label")
    ordered = F.sort_array(
        F.collect_set(F.struct(C.column_order(F.col("label")).alias("at"), F.col("label")))
    )
    return labelled.groupBy("p_brand").agg(
        F.array_join(F.transform(ordered, lambda x: x["label"]), ",").alias("labels")
    )
