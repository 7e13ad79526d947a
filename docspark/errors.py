"""Errors as data: a failed document or request is a row, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPE = "struct<code:string,message:string,context:map<string,string>>"

# The codes callers match on.
FILE_NOT_FOUND = "FILE_NOT_FOUND"
UNSUPPORTED_FORMAT = "UNSUPPORTED_FORMAT"
LIBREOFFICE_NOT_FOUND = "LIBREOFFICE_NOT_FOUND"
PYTHON_NOT_FOUND = "PYTHON_NOT_FOUND"
LIBREOFFICE_UNO_CONVERSION_FAILED = "LIBREOFFICE_UNO_CONVERSION_FAILED"
LIBREOFFICE_CLI_CONVERSION_FAILED = "LIBREOFFICE_CLI_CONVERSION_FAILED"
PDF_RENDER_TOOL_NOT_FOUND = "PDF_RENDER_TOOL_NOT_FOUND"
PDF_RENDER_FAILED = "PDF_RENDER_FAILED"
EXCEL_TEXT_EXTRACTION_FAILED = "EXCEL_TEXT_EXTRACTION_FAILED"
WORD_TEXT_EXTRACTION_FAILED = "WORD_TEXT_EXTRACTION_FAILED"
COPILOT_CLI_NOT_FOUND = "COPILOT_CLI_NOT_FOUND"
GITHUB_TOKEN_MISSING = "GITHUB_TOKEN_MISSING"
COPILOT_MARKDOWN_FAILED = "COPILOT_MARKDOWN_FAILED"
INVALID_TOOL_INPUT = "INVALID_TOOL_INPUT"

# Message texts callers match on.
NO_MARKDOWN = "No Markdown content received from GitHub Copilot"
MODEL_CALL_FAILED = "GitHub Copilot SDK failed to convert image to Markdown"
NO_IMAGES = "No images were generated from PDF"
HELPER_INVALID_JSON = "Python UNO helper returned invalid JSON"
HELPER_FAILED = "Python UNO conversion failed"
FILE_NOT_FOUND_PREFIX = "File not found: "
IMAGE_NOT_FOUND_PREFIX = "Image file not found: "
UNSUPPORTED_PREFIX = "Unsupported file format: "
ONLY_DOCX_PREFIX = "Only .docx files are supported for text extraction. Received: "
EXCEL_READ_PREFIX = "Failed to read Excel file: "
WORD_READ_PREFIX = "Failed to extract text from Word file: "


def error(code: str, message: Column | str, /, **context: Column) -> Column:
    """An error struct. Context entries whose value is NULL are left out."""
    if isinstance(message, str):
        message = F.lit(message)
    pairs = [c for k, v in context.items() for c in (F.lit(k), v.cast("string"))]
    if pairs:
        entries = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    else:
        entries = F.lit(None)
    return F.struct(
        F.lit(code).alias("code"), message.alias("message"), entries.alias("context")
    ).cast(ERROR_TYPE)


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)
