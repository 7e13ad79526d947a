"""Converted pages: manifests, responses, failures and assembly into documents.

A folder holds one file per name, so (doc, image_path) is unique in ``pages``.
Page order is the byte order of image paths, as in a sorted listing: page-10
comes before page-2, and a three-digit counter sorts wrongly from page 1000 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import errors
from docspark.functions.text import js_trim
from docspark.operators.lookup import lookup
from docspark.operators.ordering import (
    DEFAULT_PART_BYTES,
    Splitting,
    fold_slices,
    list_in_order,
    number_in_order,
    number_slices,
    slicing,
    text_in_order,
)

DOC = ["doc"]
BY_PATH = ["image_path"]


def number_pages(pages: DataFrame, how: Splitting | None = Splitting()) -> DataFrame:
    """Add ``page_no``: the position in the document's sorted list, from 1."""
    return number_in_order(pages, DOC, BY_PATH, "page_no", how)


def page_manifest(
    documents: DataFrame,
    pages: DataFrame,
    part_rows: int = 100_000,
    how: Splitting | None = Splitting(),
) -> DataFrame:
    """Sorted image paths and page count per document, or the error that it has none.

    ``documents`` has one row per ``doc``.
    Gives ``doc, part_no, part_count, images, page_count, error``. A list comes in
    parts of ``part_rows`` paths; nearly every document has one part.
    """
    counts = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("page_count"))
    cut = slicing(pages, DOC, BY_PATH, how)
    lists = fold_slices(
        cut.spread(pages.select("doc", "image_path")),
        cut,
        F.lit(1),
        part_rows,
        images=list_in_order("image_path", BY_PATH),
    )
    known = documents.select("doc").join(counts, "doc", "left")
    # parts look their document up, so those of a large one never meet in one task
    listed = lookup(lists, known.where("page_count IS NOT NULL"), DOC, how).where("page_count IS NOT NULL")
    missing = errors.error(errors.PDF_RENDER_FAILED, errors.NO_IMAGES)
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("array<string>")
    return listed.select(
        "doc", "part_no", "part_count", "images", "page_count", errors.no_error().alias("error")
    ).unionAll(
        known.where("page_count IS NULL").select(
            "doc", one, one, none, F.lit(0).cast("bigint"), missing.alias("error")
        )
    )


def normalise_responses(pages: DataFrame) -> DataFrame:
    """Trim page Markdown and turn missing or failed responses into errors.

    Emptiness is tested before trimming, so a response of blanks becomes empty
    text and not an error.
    """
    failed = errors.error(
        errors.COPILOT_MARKDOWN_FAILED, errors.MODEL_CALL_FAILED, message=F.col("call_error")
    )
    nothing = errors.error(errors.COPILOT_MARKDOWN_FAILED, errors.NO_MARKDOWN)
    error = F.when(F.col("call_error").isNotNull(), failed).when(
        F.col("content").isNull() | (F.col("content") == ""), nothing
    )
    text = F.when(F.col("error").isNull(), js_trim(F.col("content")))
    return pages.withColumn("error", error).withColumn("content", text).drop("call_error")


def missing_images(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages whose image no file has the path of, as ``doc, image_path, error``."""
    message = F.concat(F.lit(errors.IMAGE_NOT_FOUND_PREFIX), F.col("image_path"))
    known = files.select(F.col("path").alias("image_path"))
    return (
        pages.where("image_path IS NOT NULL")
        .select("doc", "image_path")
        .join(known, "image_path", "left_anti")
        .select("doc", "image_path", errors.error(errors.FILE_NOT_FOUND, message).alias("error"))
    )


def fail_whole_document(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of documents without a failure, and the first error of every other document.

    Errors come as ``key, error``. The first failing page is the smallest image
    path with an error, so no numbering is needed; failures combine map-side.
    """
    failures = (
        pages.filter(F.col("error").isNotNull())
        .groupBy(F.col("doc").alias("key"))
        .agg(F.min_by("error", "image_path").alias("error"))
    )
    failed = failures.select(F.col("key").alias("doc"), F.lit(True).alias("_failed"))
    whole = lookup(pages, failed, DOC).filter(F.col("_failed").isNull())
    return whole.drop("error", "_failed"), failures


def assemble_pages(
    pages: DataFrame,
    merge: bool = True,
    headings: bool = True,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> DataFrame:
    """Pages to documents: one page as it is, several under ``## Page i`` headings.

    Gives ``doc, part_no, part_count, content, page_count``, where ``page_count`` is the
    number of pages in the part; documents below ``part_bytes`` have one part.
    Without ``merge`` it gives ``doc, page_no, content``, a row per page, and
    without ``headings`` no heading lines. A column ``octets`` with the bytes of
    ``content`` spares reading the content to look for large documents.
    """
    octets = F.col("octets") if "octets" in pages.columns else F.octet_length("content")
    weighed = pages.select("doc", "image_path", octets.alias("octets"))
    cut = slicing(weighed, DOC, BY_PATH, how, weight=F.col("octets"))
    body = F.coalesce("content", F.lit(""))
    numbered = number_slices(
        pages.select("doc", "image_path", body.alias("body")), cut, "page_no", "alone"
    )
    if headings:
        title = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"))
        titled = F.when(F.col("alone"), F.col("body")).otherwise(F.concat(title, "body"))
    else:
        titled = F.col("body")
    if not merge:
        return numbered.select("doc", "page_no", titled.alias("content"))
    lead = F.when(F.col("page_no") == 1, "").otherwise("\n\n")
    return fold_slices(
        numbered.withColumn("_led", F.concat(lead, titled)),
        cut,
        F.octet_length("body"),
        part_bytes,
        content=text_in_order("_led", BY_PATH),
        page_count=F.count(F.lit(1)),
    )
