"""Word text requests to results, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.lookup import expand, lookup
from docspark.operators.ordering import DEFAULT_PART_BYTES, Splitting
from docspark.operators.requests import split_errors, triage
from docspark.operators.results import result_envelope, select_format
from docspark.sources.docx import extract_docx


def word_text(
    requests: DataFrame,
    files: DataFrame,
    part_bytes: int = DEFAULT_PART_BYTES,
    how: Splitting | None = Splitting(),
) -> tuple[DataFrame, DataFrame]:
    """Results (``request_id, part_no, part_count, structured, text``) and errors (``key, error``).

    Requests are checked against file paths alone; only files that a valid
    request asks for are opened, each once.
    """
    good, refused = split_errors(
        triage(requests.filter(F.col("tool") == "extract_word_text"), files.select("path")),
        "request_id",
    )
    wanted = good.select(F.col("file_path").alias("path")).distinct()
    word = extract_docx(files.join(wanted, "path", "left_semi"), part_bytes, how)
    asked = good.select("request_id", F.col("file_path").alias("doc"), "format")
    chosen = select_format(expand(asked, word.documents, ["doc"], how), F.col("format"))
    results = result_envelope(
        chosen,
        {"sourceType": "source_type", "textFormat": "text_format", "content": "content"},
        ["request_id", "part_no", "part_count"],
    )
    # one error per file, which any number of requests may ask for
    unreadable = (
        lookup(asked, word.errors.select(F.col("key").alias("doc"), "error"), ["doc"], how)
        .where("error IS NOT NULL")
        .select(F.col("request_id").cast("string").alias("key"), "error")
    )
    return results, refused.unionByName(unreadable)
