"""Conversion requests as a table: defaults, validation, existence and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import errors
from docspark.functions.paths import is_docx
from docspark.operators.lookup import lookup

# The tools and the optional fields each of them accepts.
TOOL_FIELDS = {
    "convert_excel_to_images": ["output_dir", "dpi", "sheet_names", "keep_pdf"],
    "convert_word_to_images": ["output_dir", "dpi", "keep_pdf"],
    "convert_pdf_to_images": ["output_dir", "dpi"],
    "extract_excel_text": ["dpi", "sheet_names"],
    "extract_word_text": ["format"],
    "convert_pdf_images_to_markdown": ["dpi", "merge_pages", "preserve_page_headings"],
    "render_document": ["output_mode", "output_dir", "dpi"],
    "get_capabilities": [],
}
NO_FILE_TOOLS = ["get_capabilities"]
# Tools that look for their file first, and the one that asks for .docx before that.
FILE_FIRST_TOOLS = [
    "convert_excel_to_images",
    "convert_word_to_images",
    "convert_pdf_to_images",
    "extract_excel_text",
]
DOCX_FIRST_TOOLS = ["extract_word_text"]

# What a missing field means.
DEFAULTS = {
    "dpi": 150.0,
    "keep_pdf": False,
    "format": "markdown",
    "output_mode": "images",
    "merge_pages": True,
    "preserve_page_headings": True,
}
MIN_DPI = 72
MAX_DPI = 600
FORMATS = ["text", "markdown"]
OUTPUT_MODES = ["images", "text", "markdown", "all"]


def _takes(field: str) -> Column:
    return F.col("tool").isin([t for t, fields in TOOL_FIELDS.items() if field in fields])


def apply_defaults(requests: DataFrame) -> DataFrame:
    """Fill missing fields by tool. Fields a known tool does not take become NULL."""
    known = F.coalesce(F.col("tool").isin(list(TOOL_FIELDS)), F.lit(False))
    filled = {}
    for field in ["output_dir", "sheet_names", *DEFAULTS]:
        if field not in requests.columns:
            continue
        value = F.col(field)
        if field in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field]))
        filled[field] = F.when(_takes(field), value).when(~known, F.col(field))
    return requests.withColumns(filled)


def _input_error() -> Column:
    """The first rule a request with defaults breaks, else NULL."""
    tool, dpi = F.col("tool"), F.col("dpi")
    unknown = F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("")))
    bad_dpi = F.isnan(dpi) | (dpi != F.floor(dpi)) | (dpi < MIN_DPI) | (dpi > MAX_DPI)
    rules = [
        (tool.isNull() | ~tool.isin(list(TOOL_FIELDS)), unknown),
        (~tool.isin(NO_FILE_TOOLS) & F.col("file_path").isNull(), F.lit("filePath is required")),
        (
            _takes("dpi") & bad_dpi,
            F.lit(f"dpi must be an integer from {MIN_DPI} to {MAX_DPI}"),
        ),
        (
            _takes("format") & ~F.col("format").isin(FORMATS),
            F.lit("format must be one of " + ", ".join(FORMATS)),
        ),
        (
            _takes("output_mode") & ~F.col("output_mode").isin(OUTPUT_MODES),
            F.lit("outputMode must be one of " + ", ".join(OUTPUT_MODES)),
        ),
    ]
    first = F.coalesce(*[F.when(broken, message) for broken, message in rules])
    return F.when(first.isNotNull(), errors.error(errors.INVALID_TOOL_INPUT, first))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Apply defaults and add ``error``: ``INVALID_TOOL_INPUT`` with the first broken rule."""
    return apply_defaults(requests).withColumn("error", _input_error())


def _missing_error() -> Column:
    return errors.error(
        errors.FILE_NOT_FOUND, F.concat(F.lit(errors.FILE_NOT_FOUND_PREFIX), F.col("file_path"))
    )


def _with_existence(requests: DataFrame, files: DataFrame) -> DataFrame:
    # distinct paths combine map-side; many requests may ask for one path
    known = files.select(F.col("path").alias("file_path")).distinct()
    found = lookup(requests, known.withColumn("_found", F.lit(True)), ["file_path"])
    return found.select(*requests.columns, "_found")


def check_exists(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``error``: ``FILE_NOT_FOUND`` where no file has the request's path."""
    missing = F.col("_found").isNull() & F.col("file_path").isNotNull()
    return (
        _with_existence(requests, files)
        .withColumn("error", F.when(missing, _missing_error()))
        .drop("_found")
    )


def missing_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Only the requests whose file is missing, as ``key, error``."""
    asked = requests.filter(F.col("file_path").isNotNull())
    return (
        _with_existence(asked, files)
        .filter(F.col("_found").isNull())
        .select(F.col("request_id").cast("string").alias("key"), _missing_error().alias("error"))
    )


def triage(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Validate and add the first failing check as ``error``; the order depends on the tool.

    Conversions and workbook text: input, then missing file. Word text: input,
    then not .docx, then missing file. Works on streaming requests too.
    """
    tool = F.col("tool")
    not_docx = errors.error(
        errors.UNSUPPORTED_FORMAT, F.concat(F.lit(errors.ONLY_DOCX_PREFIX), F.col("file_path"))
    )
    checked = _with_existence(validate_requests(requests), files)
    wrong_type = F.when(tool.isin(DOCX_FIRST_TOOLS) & ~is_docx(F.col("file_path")), not_docx)
    missing = F.when(
        tool.isin(FILE_FIRST_TOOLS + DOCX_FIRST_TOOLS) & F.col("_found").isNull(), _missing_error()
    )
    first = F.coalesce(F.col("error"), wrong_type, missing)
    return checked.withColumn("error", first).drop("_found")


def split_errors(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the others as ``key, error``."""
    good = df.filter(F.col("error").isNull()).drop("error")
    bad = df.filter(F.col("error").isNotNull())
    return good, bad.select(F.col(key).cast("string").alias("key"), "error")


def coalesce_pdf_path(keep_pdf: Column, pdf_path: Column) -> Column:
    """The PDF's path where it is kept, else NULL."""
    return F.when(keep_pdf, pdf_path)
