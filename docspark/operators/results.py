"""Shaping of results: format choice, helper output, JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark import errors
from docspark.functions.text import js_trim

HELPER_TYPE = (
    "struct<ok:boolean,pdf_path:string,render_strategy:string,sheet_count:bigint>"
)


def select_format(df: DataFrame, format: Column | str) -> DataFrame:
    """Choose the text column for format ``text``, the Markdown column otherwise.

    A string is one format for all rows, a column gives each row its own. Adds
    ``source_type``, ``text_format`` and ``content`` in place of both texts.
    """
    wanted = F.lit(format) if isinstance(format, str) else format
    return df.select(
        *[c for c in df.columns if c not in ("text", "markdown")],
        F.lit("word").alias("source_type"),
        wanted.alias("text_format"),
        F.when(wanted == "text", F.col("text")).otherwise(F.col("markdown")).alias("content"),
    )


def parse_helper_results(df: DataFrame, json_col: str) -> DataFrame:
    """Parse the converter helper's output into ``result`` or ``error``.

    Output that is no JSON, and a JSON null, is an error that keeps the raw
    output (``stderr`` and ``exit_code`` columns are used where present). A
    falsy ``ok`` is an error with the helper's message or a standard one.
    """
    raw = F.col(json_col)

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("_parsed", f"$.{path}", kind)

    ok_type = F.schema_of_variant(F.try_variant_get("_parsed", "$.ok", "variant"))
    numeric_zero = F.coalesce(field("ok", "double") == 0, F.lit(False)) & ~ok_type.isin(
        "BOOLEAN", "STRING"
    )
    falsy = (
        ok_type.isNull()
        | (ok_type == "VOID")
        | ((ok_type == "BOOLEAN") & (field("ok", "string") == "false"))
        | ((ok_type == "STRING") & (field("ok", "string") == ""))
        | numeric_zero
    )
    unreadable = F.col("_parsed").isNull() | F.is_variant_null("_parsed")
    extra = {
        name: F.col(column)
        for name, column in (("stderr", "stderr"), ("exitCode", "exit_code"))
        if column in df.columns
    }
    invalid = errors.error(
        errors.LIBREOFFICE_UNO_CONVERSION_FAILED, errors.HELPER_INVALID_JSON, stdout=raw, **extra
    )
    failed = errors.error(
        errors.LIBREOFFICE_UNO_CONVERSION_FAILED,
        F.coalesce(field("error.message", "string"), F.lit(errors.HELPER_FAILED)),
        errorCode=field("error.code", "string"),
    )
    result = F.struct(
        F.lit(True).alias("ok"),
        field("pdfPath", "string").alias("pdf_path"),
        field("renderStrategy", "string").alias("render_strategy"),
        field("sheetCount", "bigint").alias("sheet_count"),
    ).cast(HELPER_TYPE)
    return (
        df.withColumn("_parsed", F.try_parse_json(js_trim(raw)))
        .withColumn("error", F.when(unreadable, invalid).when(falsy, failed))
        .withColumn("result", F.when(F.col("error").isNull(), result))
        .drop("_parsed")
    )


def result_envelope(df: DataFrame, fields: dict[str, Column | str], keep: list[str]) -> DataFrame:
    """JSON text beside the structured result; NULL fields are left out of the text.

    ``fields`` maps JSON names to columns, ``keep`` names columns to carry along.
    The JSON is compact.
    """
    columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]
    packed = df.select(*keep, F.struct(*columns).alias("structured"))
    return packed.withColumn("text", F.to_json("structured"))
