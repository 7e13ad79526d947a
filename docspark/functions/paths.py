"""Path functions: extension, base name, category, MIME type. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import errors

# Extensions per category, in the order error messages list them.
EXCEL_EXTENSIONS = [".xlsx", ".xls", ".xlsm", ".xlsb"]
WORD_EXTENSIONS = [".docx", ".doc", ".odt"]
PDF_EXTENSIONS = [".pdf"]
DOCX_EXTENSION = ".docx"
CATEGORIES = {
    **dict.fromkeys(EXCEL_EXTENSIONS, "excel"),
    **dict.fromkeys(WORD_EXTENSIONS, "word"),
    **dict.fromkeys(PDF_EXTENSIONS, "pdf"),
}

# MIME types by extension; anything else counts as PNG.
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
}
DEFAULT_MIME_TYPE = "image/png"


def file_basename(path: Column, strip_ext: bool = False) -> Column:
    """Last path segment, trailing slashes ignored, optionally without its extension."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    if not strip_ext:
        return name
    return F.left(name, F.length(name) - F.length(_raw_extension(path)))


def _raw_extension(path: Column) -> Column:
    # a dot counts only after the name's first character, so ".bashrc" has none, nor has ".."
    return F.regexp_extract(path, r"(?s)^(?:.*/)?(?!\.\./*\z)[^/]+?(\.[^./]*)/*\z", 1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty when the last segment has none."""
    return F.lower(_raw_extension(path))


def file_category(path: Column) -> Column:
    """``excel``, ``word`` or ``pdf``; NULL for any other extension."""
    return F.try_element_at(_mapping(CATEGORIES), file_extension(path))


def file_category_error(path: Column) -> Column:
    """The error that goes with a NULL category, naming what is supported."""
    supported = ", ".join(EXCEL_EXTENSIONS + WORD_EXTENSIONS + PDF_EXTENSIONS)
    message = F.concat(
        F.lit(errors.UNSUPPORTED_PREFIX), file_extension(path), F.lit(f". Supported: {supported}")
    )
    return F.when(
        path.isNotNull() & file_category(path).isNull(),
        errors.error(errors.UNSUPPORTED_FORMAT, message),
    )


def is_excel(path: Column) -> Column:
    return file_extension(path).isin(EXCEL_EXTENSIONS)


def is_word(path: Column) -> Column:
    return file_extension(path).isin(WORD_EXTENSIONS)


def is_pdf(path: Column) -> Column:
    return file_extension(path).isin(PDF_EXTENSIONS)


def is_docx(path: Column) -> Column:
    return file_extension(path) == DOCX_EXTENSION


def mime_type(path: Column) -> Column:
    found = F.try_element_at(_mapping(MIME_TYPES), file_extension(path))
    return F.coalesce(found, F.lit(DEFAULT_MIME_TYPE))


def _mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
