"""Conversion requests to results, from the outputs of converters and renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.lookup import lookup
from docspark.operators.ordering import Splitting
from docspark.operators.pages import page_manifest
from docspark.operators.requests import coalesce_pdf_path, split_errors, triage
from docspark.operators.results import parse_helper_results, result_envelope

# Source types by tool, and how a workbook was rendered.
SOURCE_TYPES = {
    "convert_excel_to_images": "excel",
    "convert_word_to_images": "word",
    "convert_pdf_to_images": "pdf",
}
BY_HELPER = "libreoffice-uno-print-area"
BY_CLI = "libreoffice-cli"


def convert_results(
    requests: DataFrame,
    files: DataFrame,
    converted: DataFrame,
    images: DataFrame,
    part_rows: int = 100_000,
    how: Splitting | None = Splitting(),
) -> tuple[DataFrame, DataFrame]:
    """Results (``request_id, part_no, part_count, structured, text``) and errors (``key, error``).

    Takes the requests of the three conversion tools. ``converted`` has one row
    per request that a converter ran for: ``request_id, pdf_path`` and, where the
    helper ran, its ``stdout, stderr, exit_code``; ``images`` lists
    ``request_id, image_path``. A refused request, a failed helper and a PDF
    without images are errors. ``pdfPath`` is given where the request keeps the
    PDF, ``renderStrategy`` for workbooks.
    """
    tool = F.col("tool")
    own = requests.where(tool.isin(list(SOURCE_TYPES)))
    good, refused = split_errors(triage(own, files), "request_id")
    parsed = parse_helper_results(converted, "stdout")
    outcome = parsed.select(
        "request_id",
        F.col("stdout").isNotNull().alias("by_helper"),
        F.coalesce("result.pdf_path", "pdf_path").alias("pdf"),
        F.when(F.col("stdout").isNotNull(), F.col("error")).alias("error"),
    )
    # requests and outcomes have one row per request
    joined = lookup(good.select("request_id", "tool", "keep_pdf"), outcome, ["request_id"], how)
    is_excel = tool == "convert_excel_to_images"
    judged = joined.withColumn("error", F.when(is_excel, F.col("error")))
    made, failed = split_errors(judged, "request_id")
    documents = made.select(F.col("request_id").alias("doc"))
    pages = images.select(F.col("request_id").alias("doc"), "image_path").join(documents, "doc", "left_semi")
    listed, unrendered = split_errors(page_manifest(documents, pages, part_rows, how), "doc")
    kind = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])[tool]
    strategy = F.when(is_excel, F.when(F.col("by_helper"), BY_HELPER).otherwise(BY_CLI))
    described = made.select(
        F.col("request_id").alias("doc"),
        kind.alias("source_type"),
        coalesce_pdf_path(F.col("keep_pdf"), F.col("pdf")).alias("pdf_path"),
        strategy.alias("strategy"),
    )
    results = result_envelope(
        lookup(listed, described, ["doc"], how).withColumnRenamed("doc", "request_id"),
        {
            "sourceType": "source_type",
            "pdfPath": "pdf_path",
            "images": "images",
            "pageCount": "page_count",
            "renderStrategy": "strategy",
        },
        ["request_id", "part_no", "part_count"],
    )
    return results, refused.unionByName(failed).unionByName(unrendered)
