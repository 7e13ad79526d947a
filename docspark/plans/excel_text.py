"""Workbook text requests to results, from converted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.lookup import expand, lookup
from docspark.operators.ordering import DEFAULT_PART_BYTES, Splitting
from docspark.operators.pages import (
    assemble_pages,
    fail_whole_document,
    normalise_responses,
    page_manifest,
)
from docspark.operators.requests import split_errors, triage
from docspark.operators.results import result_envelope
from docspark.session import write_and_read


def excel_text(
    requests: DataFrame,
    files: DataFrame,
    pages: DataFrame,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> tuple[DataFrame, DataFrame]:
    """Results (``request_id, part_no, part_count, structured, text``) and errors (``key, error``).

    ``pages`` holds model replies (``doc, image_path, content, call_error``),
    where ``doc`` is the workbook's path, and may name the ``sheet`` a page shows.
    Then requests with sheet names get the pages of these sheets alone, numbered
    among themselves; an empty list or none means all pages. A document without
    pages or with a failed page, of the sheets asked for, yields its error for
    every request that asks for it.
    """
    good, refused = split_errors(
        triage(requests.filter(F.col("tool") == "extract_excel_text"), files), "request_id"
    )
    # a document is a file and the sheets asked for, whatever the number of requests for it
    names = F.array_sort(F.array_distinct("sheet_names"))
    by_sheet = "sheet" in pages.columns and "sheet_names" in requests.columns
    chosen = F.when(F.size(names) > 0, F.to_json(names)) if by_sheet else F.lit(None).cast("string")
    doc = F.when(chosen.isNull(), F.col("file_path")).otherwise(F.concat_ws("\n", "file_path", chosen))
    asked = good.select("request_id", "file_path", doc.alias("doc"), chosen.alias("chosen"))
    documents = asked.select("doc", "file_path", "chosen").distinct()
    wanted = expand(pages.withColumnRenamed("doc", "file_path"), documents, ["file_path"], how)
    if by_sheet:
        listed_sheets = F.from_json("chosen", "array<string>")
        wanted = wanted.where(F.col("chosen").isNull() | F.array_contains(listed_sheets, F.col("sheet")))
    # read four times below, twice without the content
    answered = normalise_responses(wanted.select("doc", "image_path", "content", "call_error"))
    replies = write_and_read(answered.withColumn("octets", F.octet_length("content")), "replies")
    asked, documents = asked.select("request_id", "doc"), documents.select("doc")
    whole, failures = fail_whole_document(replies)
    manifest = page_manifest(documents, replies, how=how)
    listed, unrendered = split_errors(manifest, "doc")
    content = assemble_pages(whole, part_bytes=part_bytes, how=how).drop("page_count")
    failed = failures.unionByName(unrendered)
    # content and image list are cut to parts on their own; part i of one goes with part i
    # of the other, and the longer of the two goes on alone
    result = (
        listed.join(failed.select(F.col("key").alias("doc")), "doc", "left_anti")
        .withColumnRenamed("part_count", "lists")
        .join(content.withColumnRenamed("part_count", "texts"), ["doc", "part_no"], "full")
        # the longer of the two says how many there are: it has each part that the other has
        .withColumn("part_count", F.greatest("lists", "texts"))
        .select("doc", "part_no", "part_count", "content", "images", "page_count")
    )
    results = result_envelope(
        expand(asked, result, ["doc"], how),
        {
            "sourceType": F.lit("excel"),
            "textFormat": F.lit("markdown"),
            "content": "content",
            "images": "images",
            "pageCount": "page_count",
        },
        ["request_id", "part_no", "part_count"],
    )
    # one error per document, which any number of requests may ask for
    failed_requests = (
        lookup(asked, failed.select(F.col("key").alias("doc"), "error"), ["doc"], how)
        .where("error IS NOT NULL")
        .select(F.col("request_id").cast("string").alias("key"), "error")
    )
    return results, refused.unionByName(failed_requests)
