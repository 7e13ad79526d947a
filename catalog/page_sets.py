"""Queries on converted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import stand_ins as si
from docspark.operators import pages as pg
from docspark.operators.ordering import Splitting

QUERIES = {}
ORACLE = {}
PART = 2000


def _query(name, sql):
    def keep(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return keep


_NUMBERED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY image_path) AS page_no,
         count(*) OVER (PARTITION BY doc) AS page_count,
         coalesce(sum(strlen(content)) OVER (PARTITION BY doc ORDER BY image_path
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {pages}),
titled AS (
  SELECT *, CASE WHEN page_count = 1 THEN content
                 ELSE '## Page ' || page_no || chr(10) || chr(10) || content END AS block FROM numbered)"""
_PAGES = f"WITH {si.PAGES_SQL}, {_NUMBERED.format(pages='pages_in')}"


@_query(
    "number_pages",
    f"{_PAGES} SELECT doc, image_path, content, page_no FROM numbered",
)
def number_pages(spark, sf_dir):
    return pg.number_pages(si.pages(spark, sf_dir))


@_query(
    "assemble_pages",
    f"""{_PAGES} SELECT doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
    string_agg(block, chr(10) || chr(10) ORDER BY page_no) AS content, count(*) AS page_count
    FROM titled GROUP BY doc""",
)
def assemble_pages(spark, sf_dir):
    return pg.assemble_pages(si.pages(spark, sf_dir))


@_query(
    "assemble_pages_in_parts",
    f"""{_PAGES} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part) AS part_no,
    count(*) OVER (PARTITION BY doc) AS part_count, content, page_count FROM (
      SELECT doc, before // {PART} AS part, count(*) AS page_count,
      string_agg(CASE WHEN page_no > 1 THEN chr(10) || chr(10) ELSE '' END || block, '' ORDER BY page_no) AS content
      FROM titled GROUP BY doc, before // {PART})""",
)
def assemble_pages_in_parts(spark, sf_dir):
    """Parts of some 2,000 bytes, so that test documents have several."""
    return pg.assemble_pages(si.pages(spark, sf_dir), part_bytes=PART)


_ROLES = """WITH numbered AS (
  SELECT role AS doc, text AS content, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS page_no,
         coalesce(sum(strlen(text)) OVER (PARTITION BY role ORDER BY conv_id, turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM conversations),
parts AS (
  SELECT doc, before // 300 AS part, count(*) AS page_count, string_agg(
    CASE WHEN page_no > 1 THEN chr(10) || chr(10) ELSE '' END || '## Page ' || page_no || chr(10) || chr(10) || content,
    '' ORDER BY page_no) AS content
  FROM numbered GROUP BY doc, before // 300)"""


@_query(
    "assemble_pages_hot_document",
    f"""{_ROLES} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part) AS part_no,
    count(*) OVER (PARTITION BY doc) AS part_count, content, page_count FROM parts""",
)
def assemble_pages_hot_document(spark, sf_dir):
    """A document per role, cut to slices; many pages outweigh the part size of 300 bytes."""
    pages = si.table(spark, sf_dir, "conversations").selectExpr(
        "role AS doc", "struct(conv_id, turn) AS image_path", "text AS content"
    )
    return pg.assemble_pages(pages, part_bytes=300, how=Splitting(slices=32, min_rows=10))


@_query(
    "assemble_pages_unmerged",
    f"{_PAGES} SELECT doc, page_no, block AS content FROM titled",
)
def assemble_pages_unmerged(spark, sf_dir):
    return pg.assemble_pages(si.pages(spark, sf_dir), merge=False)


@_query(
    "assemble_pages_plain",
    f"""{_PAGES} SELECT doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count,
    string_agg(content, chr(10) || chr(10) ORDER BY page_no) AS content, count(*) AS page_count
    FROM numbered GROUP BY doc""",
)
def assemble_pages_plain(spark, sf_dir):
    return pg.assemble_pages(si.pages(spark, sf_dir), headings=False)


@_query(
    "number_pages_hot_document",
    """SELECT role AS doc, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS page_no
    FROM conversations""",
)
def number_pages_hot_document(spark, sf_dir):
    """A document per role, each with a large share of all pages: numbered slice by slice."""
    pages = si.table(spark, sf_dir, "conversations").selectExpr(
        "role AS doc", "conv_id", "turn", "struct(conv_id, turn) AS image_path"
    )
    return pg.number_pages(pages, Splitting(slices=32, min_rows=10)).drop("image_path")


@_query(
    "page_manifest",
    """WITH shots AS (
      SELECT conv_id, concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '.png') AS image_path
      FROM conversations),
    listed AS (SELECT conv_id, string_agg(image_path, ',' ORDER BY image_path) AS images, count(*) AS page_count
               FROM shots GROUP BY conv_id)
    SELECT doc_id AS doc, CAST(1 AS BIGINT) AS part_no, CAST(1 AS BIGINT) AS part_count, images, coalesce(page_count, 0) AS page_count,
           CASE WHEN conv_id IS NULL THEN 'PDF_RENDER_FAILED' END AS error_code,
           CASE WHEN conv_id IS NULL THEN 'No images were generated from PDF' END AS error_message
    FROM documents LEFT JOIN listed ON conv_id = doc_id""",
)
def page_manifest(spark, sf_dir):
    """Documents with a conversation of their number as pages; the others have none."""
    documents = si.table(spark, sf_dir, "documents").selectExpr("doc_id AS doc")
    shots = si.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc", f"{si.PAGE_PATH} AS image_path"
    )
    return pg.page_manifest(documents, shots).select(
        "doc",
        "part_no",
        "part_count",
        F.array_join("images", ",").alias("images"),
        "page_count",
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
    )


@_query(
    "normalise_responses",
    f"""WITH {si.REPLIES_SQL} SELECT doc, image_path, content, error_code, error_message, error_context
    FROM replies_out""",
)
def normalise_responses(spark, sf_dir):
    return si.flat_error(
        pg.normalise_responses(si.replies(spark, sf_dir)), "doc", "image_path", "content"
    )


@_query(
    "fail_whole_document",
    f"""WITH {si.REPLIES_SQL}
    SELECT doc AS key, error_code, error_message, error_context FROM (
      SELECT *, row_number() OVER (PARTITION BY doc ORDER BY image_path) AS nth
      FROM replies_out WHERE error_code IS NOT NULL) WHERE nth = 1""",
)
def fail_whole_document(spark, sf_dir):
    _, failures = pg.fail_whole_document(pg.normalise_responses(si.replies(spark, sf_dir)))
    return si.flat_error(failures, "key")


@_query(
    "surviving_pages",
    f"""WITH {si.REPLIES_SQL} SELECT doc, image_path, content FROM replies_out
    WHERE doc NOT IN (SELECT doc FROM replies_out WHERE error_code IS NOT NULL)""",
)
def surviving_pages(spark, sf_dir):
    whole, _ = pg.fail_whole_document(pg.normalise_responses(si.replies(spark, sf_dir)))
    return whole.select("doc", "image_path", "content")


@_query(
    "missing_images",
    """WITH shots AS (
      SELECT conv_id, turn, concat('/out/', conv_id, '/page-', lpad(CAST(turn + 1 AS VARCHAR), 3, '0'), '.png') AS image_path
      FROM conversations)
    SELECT conv_id AS doc, image_path, 'FILE_NOT_FOUND' AS error_code, 'Image file not found: ' || image_path AS error_message
    FROM shots WHERE conv_id NOT IN (SELECT doc_id FROM labels) OR turn % 5 = 4""",
)
def missing_images(spark, sf_dir):
    """Images are there for conversations whose number is labelled, but for every fifth page."""
    shots = si.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc", "turn", f"{si.PAGE_PATH} AS image_path"
    )
    labelled = si.table(spark, sf_dir, "labels").selectExpr("doc_id AS doc")
    files = shots.where("turn % 5 <> 4").join(labelled, "doc", "left_semi").select(F.col("image_path").alias("path"))
    return si.flat_error(pg.missing_images(shots, files), "doc", "image_path").drop("error_context")
